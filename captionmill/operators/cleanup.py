"""Model clean-up of texts: which rows are sent and which answers are taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionmill.functions.text import strip
from captionmill.schema import BOTH, ON_SCREEN, SPEECH

#: Fixed value: longest answer taken, in lengths of the text.
MOST = 2.0
TARGETS = {"screen": (ON_SCREEN, BOTH), "speech": (SPEECH,)}


def accepted(text, response) -> Column:
    """The answer without carriage returns, unless it is null, blank or too
    long; then the text as it was."""
    t, r = (F.col(x) if isinstance(x, str) else x for x in (text, response))
    clean = F.replace(r, F.lit("\r"), F.lit(""))
    return F.when(r.isNotNull() & (strip(clean) != "") & (F.length(clean) <= MOST * F.length(t)), clean).otherwise(t)


def clean(segments: DataFrame, target: str, client: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """Segments whose target rows went through a client, which is made once in
    each worker. Only ``text`` changes; other rows never leave the JVM."""
    mine = F.col("source").isin(*TARGETS[target])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            yield pdf.assign(response=call(pdf["text"].tolist()))

    sent = segments.where(mine)
    answers = sent.mapInPandas(ask, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in sent.schema)}, response string")
    return segments.where(~mine).unionByName(answers.withColumn("text", accepted("text", "response")).drop("response"))


def transcribe(files: DataFrame, engine: Callable[[], Callable[[str, bytes], list[tuple]]]) -> DataFrame:
    """Segments of media files by a speech or text-recognition engine, made
    once in each worker: it gives (start, end, text, confidence, language)
    rows for a (path, content). Blank texts go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = engine()
        for pdf in batches:
            rows = [(p, k, *row) for p, c in zip(pdf["path"], pdf["content"]) for k, row in enumerate(r for r in call(p, c) if r[2] and r[2].strip())]
            yield pd.DataFrame(rows, columns=["path", "seq", "start", "end", "text", "confidence", "language"])

    return files.select("path", "content").mapInPandas(run, "path string, seq long, start double, end double, text string, confidence double, language string")


RESPONSE = "language string, text string, segments array<struct<start:double,end:double,text:string,avg_logprob:double>>"


def parse_responses(bodies: DataFrame, most: float = 1e9) -> DataFrame:
    """Segments of speech service answers (video_id, chunk_no, body): a body
    that is no such JSON, or holds an unusable time, fails the run; an unusable
    confidence becomes null; blank texts go."""
    from captionmill.functions.text import finite_time

    said = bodies.withColumn("r", F.from_json("body", RESPONSE, {"mode": "FAILFAST"}))
    fail = lambda why: F.raise_error(F.lit(why))
    each = said.select("video_id", "chunk_no", F.col("r.language").alias("language"), F.posexplode(F.coalesce("r.segments", fail("an answer has no segments").cast("array<struct<start:double,end:double,text:string,avg_logprob:double>>"))).alias("seq", "s"))
    good = finite_time("s.start", most) & finite_time("s.end", most)
    start = F.when(good, F.col("s.start")).otherwise(fail("a time is unusable").cast("double"))
    rows = each.select("video_id", "chunk_no", "seq", start.alias("start"), F.col("s.end").alias("end"), strip("s.text").alias("text"), F.when(finite_time("s.avg_logprob", most), F.col("s.avg_logprob")).alias("asr_logprob"), "language")
    return rows.where("text <> ''")
