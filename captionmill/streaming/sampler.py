"""Ordered operators over streams: frame choice, session dedup, batch resume.

State is kept per video (or per video and text key) and bounded: one small
frame, or one open cluster. What a closed video alone can tell, such as the
recurrence filter, stays a batch operator.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from captionmill.functions.similarity import indel
from captionmill.functions.text import full_key
from captionmill.operators.frames import Selector, downscale, max_gap


def scene_change_stream(frames: DataFrame, threshold: float = 0.05, fps: float = 1.0, idle_ms: int = 60_000) -> DataFrame:
    """(video_id, frame_idx) of the frames to read, as they come. Frames of a
    video must arrive in order. A video without frames for ``idle_ms`` is over:
    its last frame follows if it was held back and differs. The timer runs on
    processing time, so the query wants a continuing trigger (or one batch):
    ``availableNow`` would wait for timers without end."""
    gap = max_gap(fps)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: Selector = pickle.loads(state.get[0]) if state.exists else Selector(threshold, gap)
        chosen = []
        if state.hasTimedOut:
            last = own.finish()
            chosen = [] if last is None else [last]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("frame_idx", kind="stable")
            for i, h, w, g in zip(rows["frame_idx"], rows["height"], rows["width"], rows["gray"]):
                if own.offer(int(i), downscale(np.frombuffer(g, np.uint8).reshape(h, w))):
                    chosen.append(int(i))
            state.update((pickle.dumps(own),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"video_id": [key[0]] * len(chosen), "frame_idx": chosen})

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id string, frame_idx long", "own binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


CLUSTER = "video_id string, seq long, start double, end double, text string, ocr_confidence double, language string, n long"
_OPEN = "seq long, start double, end double, text string, known double, n_known long, language string, n long, last string"


def dedup_stream(points: DataFrame, threshold: float = 0.85, gap: float = 2.0, min_duration: float = 0.0) -> DataFrame:
    """Clusters of on-screen rows (seq, start, text and language of the first
    row, end of the last, mean of the known confidences, number of rows), closed
    as soon as a row breaks them or the watermark on ``at`` (a timestamp of
    ``start``) passes their end by more than ``gap`` seconds. Clusters shorter
    than ``min_duration`` go. ``points`` has video_id, seq, start, end, text,
    ocr_confidence, language and ``at``; the last clusters of a video follow
    when rows of any video move the watermark beyond them."""

    def closed(key: tuple, open_: list) -> pd.DataFrame:
        rows = [(key[0], *c[:4], c[4] / c[5] if c[5] else None, *c[6:8]) for c in open_ if c[2] - c[1] >= min_duration]
        out = pd.DataFrame(rows, columns=["video_id", "seq", "start", "end", "text", "ocr_confidence", "language", "n"])
        return out.astype({"ocr_confidence": "float64"})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            c = state.get
            state.remove()
            yield closed(key, [c])
            return
        c, done = (state.get if state.exists else None), []
        rows = pd.concat(list(batches)).sort_values(["start", "seq"], kind="stable")
        for seq, start, end, text, own, language in zip(rows["seq"], rows["start"], rows["end"], rows["text"], rows["ocr_confidence"], rows["language"]):
            known = 0 if own is None or own != own else 1
            if c is not None and start - c[2] <= gap and indel(text.lower(), c[8].lower()) >= threshold:
                c = (*c[:2], float(end), c[3], c[4] + (own if known else 0.0), c[5] + known, c[6], c[7] + 1, text)
                continue
            done += [] if c is None else [c]
            c = (int(seq), float(start), float(end), text, float(own) if known else 0.0, known, language, 1, text)
        state.update(c)
        state.setTimeoutTimestamp(max(int((c[2] + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield closed(key, done)

    keyed = points.withColumn("key", full_key("text")).where("key <> ''")
    return keyed.groupBy("video_id", "key").applyInPandasWithState(step, CLUSTER, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


class ClosedVideos(StatefulProcessor):
    """Appends the rows of a video to a list, so a batch costs what it brings, and gives
    the list on in parts when the end is in. A closed video is remembered as one number,
    for ever or for ``keep_ms``, and its rows that come after go."""

    def __init__(self, kept: T.StructType, keep_ms: int | None, part: int = 10_000):
        self.kept, self.keep_ms, self.part = kept, keep_ms, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.kept)
        self.closed = handle.getValueState("closed", "frame_count long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame_count, gone = None, self.closed.exists()
        for pdf in rows:
            if gone:
                continue
            ends = pdf["is_end"].fillna(False).astype(bool)
            own = pdf.loc[~ends, self.kept.names].astype(object)
            if len(own):
                self.rows.appendList([tuple(r) for r in own.where(own.notna(), None).itertuples(index=False)])
            if ends.any():
                frame_count = int(pdf.loc[ends, "frame_count"].iloc[-1])
        if frame_count is None:
            return
        held = iter(self.rows.get()) if self.rows.exists() else iter(())
        while part := list(itertools.islice(held, self.part)):
            yield pd.DataFrame([tuple(r) for r in part], columns=self.kept.names).assign(frame_count=frame_count)
        self.rows.clear()
        self.closed.update((frame_count,))

    def close(self) -> None:
        pass


def closed_video_stream(points: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Rows of a video, held until its row with ``is_end`` (which carries no text of its
    own) is in, and given on together with ``frame_count``, the number of its frames: the
    whole video that a recurrence filter needs. State lies in RocksDB, which the session
    must name as its state store; rows are appended to it, never read back before the
    end. Rows that come after a video's end go. With ``keep_ms`` closed videos are
    forgotten after that time, on a timer that wants a continuing trigger."""
    kept = T.StructType([f for f in points.schema if f.name not in ("is_end", "frame_count")])
    schema = T.StructType([*kept, T.StructField("frame_count", T.LongType())])
    return points.groupBy("video_id").transformWithStateInPandas(ClosedVideos(kept, keep_ms), schema, "Append", "None" if keep_ms is None else "ProcessingTime")


def resume_items(spark, folder: str, checkpoint: str, handle) -> None:
    """Hand each new item file of ``folder`` to ``handle(DataFrame, batch_id)``
    once; what a checkpoint holds as done is not handed over again. At least
    once: ``handle`` sees a batch again if it failed inside it, so a handle that
    writes should do so by ``append_once``."""
    items = spark.readStream.schema("seq long, source string").json(folder)
    items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(rows: DataFrame, target: str, batch_id: int) -> bool:
    """Add the rows of a batch to the Parquet table ``target``, once however often the
    batch comes: they are written aside and put in place as ``batch_id=<id>`` by a rename
    that fails if the place is taken. False if the batch was there already."""
    spark = rows.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    aside, place = hadoop.Path(f"{target}/_pending-{batch_id}-{uuid.uuid4().hex}"), hadoop.Path(f"{target}/batch_id={batch_id}")
    fs = place.getFileSystem(conf)
    if fs.exists(place):
        return False
    rows.write.parquet(aside.toString())
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(place), how)
    except Py4JJavaError as e:
        fs.delete(aside, True)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True
