"""Transcript writers: JSON, plain text, SRT and Markdown, one row a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.functions.text import cue, markdown_escape, minute_second, srt_time
from captionmill.sources.whole_files import write_files

FORMATS = ("json", "txt", "srt", "md")


def _ordered(segments: DataFrame, *fields):
    """One row a video: the fields of its segments in order of ``seq``."""
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("rows"))
    return rows


def txt(segments: DataFrame) -> DataFrame:
    return _ordered(segments, cue("text").alias("t")).select("video_id", F.array_join(F.transform("rows", lambda r: F.concat(r["t"], F.lit("\n"))), "").alias("body"))


def srt(segments: DataFrame) -> DataFrame:
    """Numbered cues from 1, a blank line between them."""
    text = F.concat(srt_time("start"), F.lit(" --> "), srt_time("end"), F.lit("\n"), cue("text"), F.lit("\n"))
    return _ordered(segments, text.alias("t")).select("video_id", F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), r["t"])), "\n").alias("body"))


def md(segments: DataFrame) -> DataFrame:
    line = F.concat(F.lit("**["), F.col("source"), F.lit("] "), minute_second("start"), F.lit("–"), minute_second("end"), F.lit("** "), markdown_escape(cue("text")))
    return _ordered(segments, line.alias("t")).select("video_id", F.array_join(F.transform("rows", lambda r: F.concat(r["t"], F.lit("\n"))), "").alias("body"))


def json(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """{segments: [...], language}, nulls written. ``languages`` (video_id, language)."""
    names = ["start", "end", "text", "source", "asr_logprob", "ocr_confidence", "language"]
    rows = _ordered(segments, *names).select("video_id", F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names])).alias("segments"))
    own = rows.join(languages.withColumnRenamed("language", "l"), "video_id")
    return own.select("video_id", F.to_json(F.struct("segments", F.col("l").alias("language")), {"ignoreNullFields": "false", "pretty": "true"}).alias("body"))


def render(segments: DataFrame, form: str, languages: DataFrame | None = None) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    return json(segments, languages) if form == "json" else {"txt": txt, "srt": srt, "md": md}[form](segments)


def write(bodies: DataFrame, folder: str, form: str) -> None:
    """One file a video, ``<video_id>.<form>``, with the body's own bytes. A file is
    there whole or not at all; see ``sources.whole_files``."""
    write_files(bodies.select(F.concat("video_id", F.lit(f".{form}")).alias("name"), "body"), folder)
