"""Filters, cross-frame dedup and the speech/on-screen merge of segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionmill.functions import similarity
from captionmill.functions.text import cue, full_key, overlaps
from captionmill.operators.clusters import cluster_keys
from captionmill.operators.stored import stored
from captionmill.schema import BOTH, ON_SCREEN, SPEECH

COLUMNS = ["video_id", "seq", "start", "end", "text", "source", "asr_logprob", "ocr_confidence", "language"]


def rank(source: str = "source") -> Column:
    """Speech and merged rows before on-screen rows that start together."""
    return F.when(F.col(source) == ON_SCREEN, 1).otherwise(0)


def in_order(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.orderBy(*(keys or ["video_id"]), "start", rank(), "seq")


def drop_patterns(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Without on-screen rows whose stripped text matches a pattern of their
    video's profile. ``profiles`` (video_id, patterns) may lack videos."""
    from captionmill.functions.text import strip

    told = segments.join(profiles.select("video_id", "patterns"), "video_id", "left")
    hit = F.exists(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: F.rlike(strip("text"), p))
    return told.where((F.col("source") != ON_SCREEN) | ~F.coalesce(hit, F.lit(False))).drop("patterns")


def drop_confidence(boxes: DataFrame, least: float = 0.6) -> DataFrame:
    return boxes.where(F.col("score") >= least)


# Recurrence -------------------------------------------------------------------


def key_counts(segments: DataFrame) -> DataFrame:
    """Rows per canonical key of the on-screen rows of each video, with the
    first row's seq; empty keys are left out."""
    keyed = segments.where(F.col("source") == ON_SCREEN).withColumn("key", full_key("text"))
    return keyed.where("key <> ''").groupBy("video_id", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def drop_recurring(segments: DataFrame, frames: DataFrame, threshold: float = 0.95, fuzzy: float = 90.0, least_frames: int = 0) -> DataFrame:
    """Without on-screen rows whose key cluster holds ``threshold`` times as
    many rows as the video has frames, or more. ``frames`` (video_id,
    frame_count); videos with no frames, or fewer than ``least_frames``, pass."""
    counts = key_counts(segments)
    clustered = counts.join(cluster_keys(counts, fuzzy / 100), ["video_id", "key"])
    total = F.sum("n").over(Window.partitionBy("video_id", "cluster"))
    often = clustered.withColumn("total", total).join(frames, "video_id").where((F.col("frame_count") > 0) & (F.col("frame_count") >= least_frames))
    often = often.where(F.col("total") / F.col("frame_count") >= threshold).select("video_id", "key")
    keyed = segments.withColumn("key", F.when(F.col("source") == ON_SCREEN, full_key("text")))
    kept = keyed.join(often, ["video_id", "key"], "left_anti")
    # Rows without any letter share the empty key, which counts on its own.
    blank = keyed.where("key = ''").groupBy("video_id").agg(F.count("*").alias("n")).join(frames, "video_id")
    blank = blank.where((F.col("frame_count") > 0) & (F.col("frame_count") >= least_frames) & (F.col("n") / F.col("frame_count") >= threshold)).select("video_id", F.lit("").alias("key"))
    return kept.join(blank, ["video_id", "key"], "left_anti").select(*segments.columns)


def of_closed_videos(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of the videos that ``ends`` (video_id) names as complete: shares of
    a video's frames mean nothing before its last frame is in."""
    return segments.join(ends.select("video_id"), "video_id", "left_semi")


# Dedup as gaps and islands ----------------------------------------------------


def dedup(segments: DataFrame, threshold: float = 0.85, min_duration: float = 0.0, gap: float = 2.0, ratio=similarity.ratio) -> DataFrame:
    """On-screen rows of one canonical key become clusters; a row extends the
    cluster of the row before it if it is similar enough and starts at most
    ``gap`` after that row's end. A cluster has the first row's start, text and
    language, the last row's end and the mean of the known confidences;
    shorter ones than ``min_duration`` go. Speech passes; merged rows do not."""
    keyed = segments.where(F.col("source") == ON_SCREEN).withColumn("key", full_key("text")).where("key <> ''")
    run = Window.partitionBy("video_id", "key").orderBy("start", "seq")
    lagged = keyed.withColumn("before", F.lag("text").over(run)).withColumn("before_end", F.lag("end").over(run))
    near = F.col("start") - F.col("before_end") <= gap
    # Equal texts, far ones and those whose lengths rule it out are not compared.
    open_ = near & (F.col("text") != F.col("before")) & (similarity.ratio_bound("text", "before") >= threshold)
    alike = ratio(F.when(open_, F.col("text")), F.when(open_, F.col("before"))) >= threshold
    same = F.coalesce(near & ((F.col("text") == F.col("before")) | (open_ & alike)), F.lit(False))
    broken = F.when(F.col("before").isNull() | ~same, 1).otherwise(0)
    islands = lagged.withColumn("broken", broken).withColumn("island", F.sum("broken").over(run))
    at = F.struct("start", "seq")
    out = islands.groupBy("video_id", "key", "island").agg(
        F.min("seq").alias("seq"), F.min("start").alias("start"), F.max_by("end", at).alias("end"), F.min_by("text", at).alias("text"),
        F.lit(ON_SCREEN).alias("source"), F.lit(None).cast("double").alias("asr_logprob"), F.avg("ocr_confidence").alias("ocr_confidence"), F.min_by("language", at).alias("language"),
    )
    kept = out.where(F.col("end") - F.col("start") >= min_duration).select(*COLUMNS)
    return segments.where(F.col("source") == SPEECH).select(*COLUMNS).unionByName(kept)


# Merge ------------------------------------------------------------------------


def similar_texts(speech: DataFrame, screen: DataFrame, threshold: float = 0.85, bucket: float = 60.0, score=similarity.wratio) -> DataFrame:
    """Pairs of texts (video_id, s_text, o_text, score) that are similar and may
    stand in rows that overlap in time. Time is cut into buckets for an equi-join,
    and a text enters a bucket once, with the span of its rows there, so that
    texts which recur are compared once, not row by row."""

    def spans(rows: DataFrame, side: str) -> DataFrame:
        cut = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest("start", "end") / bucket)))
        own = rows.select("video_id", F.col("text").alias(f"{side}_text"), "start", "end", cut.alias("bucket"))
        return own.groupBy("video_id", "bucket", f"{side}_text").agg(F.min("start").alias(f"{side}_start"), F.max("end").alias(f"{side}_end"))

    near = spans(speech, "s").join(spans(screen, "o"), ["video_id", "bucket"]).where(overlaps("s_start", "s_end", "o_start", "o_end"))
    told = near.select("video_id", "s_text", "o_text").distinct().withColumn("score", score(F.col("s_text"), F.col("o_text")))
    return told.where(F.col("score") >= threshold)


class _Free:
    """The rows of one text in the order (start, seq): a tree of the latest ends
    of those not taken leads to the first one that reaches a time."""

    def __init__(self, rows: pd.DataFrame):
        self.start, self.seq, self.size = rows["start"].tolist(), rows["seq"].tolist(), 1 << (len(rows) - 1).bit_length()
        levels = [np.concatenate([rows["end"].to_numpy(float), np.full(self.size - len(rows), -np.inf)])]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).max(1))
        self.latest = [-np.inf, *np.concatenate(levels).tolist()]

    def first(self, start: float, end: float) -> int | None:
        """Place of the first free row that overlaps ``start`` to ``end``."""
        latest, i = self.latest, 1
        if latest[1] < start:
            return None
        while i < self.size:
            i *= 2
            i += latest[i] < start
        i -= self.size
        return i if self.start[i] <= end else None

    def take(self, i: int) -> None:
        latest, i = self.latest, i + self.size
        latest[i] = -np.inf
        while i := i // 2:
            latest[i] = max(latest[2 * i], latest[2 * i + 1])


def _resolve(video: pa.Table) -> pa.Table:
    """The choice of one video's spoken rows, in order, from its rows and pairs of
    texts. Its time and memory grow with these, not with the rows that overlap."""
    rows = video.to_pandas()
    names, _ = pd.factorize(pd.concat([rows["text"], rows["o_text"]]))
    rows["name"], rows["o_name"] = names[: len(rows)], names[len(rows) :]
    free = {n: _Free(own) for n, own in rows[rows["kind"] == "o"].sort_values(["start", "seq"]).groupby("name")}
    places: dict[int, list] = {}
    for f in free.values():
        for i, seq in enumerate(f.seq):
            places.setdefault(seq, []).append((f, i))
    likes: dict[int, list] = {}  # per spoken text, the texts it may take by falling score, ties together
    for (name, score), own in rows[rows["kind"] == "x"].sort_values("score", ascending=False).groupby(["name", "score"], sort=False):
        likes.setdefault(name, []).append((-score, [free[o] for o in own["o_name"] if o in free]))
    chosen, at, best = [], None, None
    spoken = rows[rows["kind"] == "s"].sort_values("seq")[["seq", "start", "end", "name"]]
    for seq, start, end, name in [*spoken.itertuples(index=False, name=None), (None, 0.0, 0.0, -1)]:
        if seq != at:
            if best is not None:
                chosen.append((at, best[2]))
                for f, i in places[best[2]]:
                    f.take(i)
            at, best = seq, None
        for worse, texts in likes.get(name, ()):
            found = [(worse, f.start[i], f.seq[i]) for f in texts if (i := f.first(start, end)) is not None]
            if found:
                best = min(found) if best is None else min(best, *found)
                break
    s_seq, o_seq = zip(*chosen) if chosen else ((), ())
    return pa.table({"video_id": pa.array([rows["video_id"].iloc[0]] * len(chosen), pa.string()), "s_seq": pa.array(s_seq, pa.int64()), "o_seq": pa.array(o_seq, pa.int64())})


def merge_pairs(speech: DataFrame, screen: DataFrame, threshold: float = 0.85, score=similarity.wratio) -> DataFrame:
    """The rows that become one (video_id, s_seq, o_seq). Only rows whose text is
    similar to one of the other channel go through the sequential choice, with
    these texts; never the pairs of rows, which grow with the square of a video."""
    alike = stored(similar_texts(speech, screen, threshold, score=score), "merge-texts")

    def rows(of: DataFrame, kind: str) -> DataFrame:
        known = of.join(alike.select("video_id", F.col(f"{kind}_text").alias("text")), ["video_id", "text"], "left_semi").dropna(subset=["seq", "start", "end"])
        return known.select("video_id", F.lit(kind).alias("kind"), F.col("seq").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"), "text")

    texts = alike.select("video_id", F.lit("x").alias("kind"), F.col("s_text").alias("text"), "o_text", "score")
    every = rows(speech, "s").unionByName(rows(screen, "o")).unionByName(texts, allowMissingColumns=True)
    # A number keeps adaptive execution from putting many videos, small but slow, into one task.
    spread = every.repartition(int(speech.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")
    return spread.groupBy("video_id").applyInArrow(_resolve, "video_id string, s_seq long, o_seq long")


def merge(speech: DataFrame, screen: DataFrame, threshold: float = 0.85, score=similarity.wratio) -> DataFrame:
    """Speech rows, in order, take the best similar on-screen row that overlaps
    and is not taken (ties: earliest start, least seq) and become BOTH: the
    speech text on one line, the span of both, the speech confidence. All
    other rows stay. ``seq`` is renumbered in the order of the result: by
    start, speech first; a video with one channel keeps that channel's order."""
    pairs = stored(merge_pairs(speech, screen, threshold, score), "merge-pairs")
    o = screen.select("video_id", F.col("seq").alias("o_seq"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    met = pairs.join(o, ["video_id", "o_seq"]).withColumnRenamed("s_seq", "seq")
    both = speech.join(met, ["video_id", "seq"], "left")
    is_both = F.col("o_seq").isNotNull()
    spoken = both.select(
        "video_id", "seq", F.least("start", "o_start").alias("start"), F.greatest("end", "o_end").alias("end"), F.when(is_both, cue("text")).otherwise(F.col("text")).alias("text"),
        F.when(is_both, BOTH).otherwise(F.col("source")).alias("source"), "asr_logprob", F.when(is_both, F.lit(None)).otherwise(F.col("ocr_confidence")).alias("ocr_confidence"), "language", F.lit(0).alias("channel"),
    )
    left = screen.join(pairs.select("video_id", F.col("o_seq").alias("seq")), ["video_id", "seq"], "left_anti").select(*COLUMNS, F.lit(1).alias("channel"))
    every = spoken.unionByName(left)
    channels = Window.partitionBy("video_id")
    alone = F.min("channel").over(channels) == F.max("channel").over(channels)
    place = F.row_number().over(channels.orderBy(F.when(~F.col("alone"), F.col("start")), "channel", "seq"))
    return every.withColumn("alone", alone).withColumn("seq", place.cast("long")).select(*COLUMNS)


def shift(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of audio chunks on the time line of the whole: ``chunks``
    (video_id, chunk_no, start_s)."""
    own = segments.join(chunks, ["video_id", "chunk_no"])
    return own.withColumn("start", F.col("start") + F.col("start_s")).withColumn("end", F.col("end") + F.col("start_s")).drop("start_s")


def chunk_language(chunks: DataFrame, default: str = "en") -> DataFrame:
    """Language of the first chunk that has text: (video_id, chunk_no, language, n_segments)."""
    first = F.min_by("language", F.when(F.col("n_segments") > 0, F.col("chunk_no")))
    return chunks.groupBy("video_id").agg(F.coalesce(first, F.lit(default)).alias("language"))
