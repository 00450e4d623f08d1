"""WAV splitting at quiet points, and the same search on sample tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the splitter.
HEADER_BYTES, MIN_CHUNK_S, SEARCH_S, WINDOW_S = 44, 1, 10, 0.1


def quietest(samples: np.ndarray, window: int) -> int | None:
    """Start of the window of least energy among (frames, channels), the last
    of equals; None if there is no whole window."""
    if len(samples) < window:
        return None
    total = np.concatenate([[0], np.cumsum((samples.astype(np.int64) ** 2).sum(1))])
    energy = total[window:] - total[:-window]
    return len(energy) - 1 - int(np.argmin(energy[::-1]))


def cuts(samples: np.ndarray, rate: int, max_bytes: int) -> list[tuple[int, int]]:
    """Frame ranges of the chunks of (frames, channels) 16-bit samples."""
    total, frame = len(samples), samples.shape[1] * 2
    if total == 0:
        return []
    if total * frame + HEADER_BYTES <= max_bytes:
        return [(0, total)]
    least, most = int(MIN_CHUNK_S * rate), (max_bytes - HEADER_BYTES) // frame
    if most < least:
        raise ValueError("the limit leaves no room for the shortest chunk")
    window, out, at = max(1, int(WINDOW_S * rate)), [], 0
    while total - at > most:
        latest = max(min(at + most, total - least), at + least)
        earliest = max(at + least, latest - int(SEARCH_S * rate))
        best = quietest(samples[earliest:latest], window)
        cut = latest if best is None else earliest + best + window // 2
        out.append((at, cut))
        at = cut
    return [*out, (at, total)]


def split_wavs(files: DataFrame, max_bytes: int = 25_000_000 - 4096) -> DataFrame:
    """Chunks of the rows of a ``binaryFile`` table (path, content): path,
    chunk_no, start_s, content. Only 16-bit PCM is taken; a file that fits is
    handed on as it is. One file is one row, so a task holds one file."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError("only 16-bit PCM can be split")
                    rate, channels, data = w.getframerate(), w.getnchannels(), w.readframes(w.getnframes())
                samples = np.frombuffer(data, "<i2").reshape(-1, channels)
                whole = cuts(samples, rate, max_bytes) if len(content) > max_bytes else [(0, len(samples))][: len(samples)]
                for k, (a, b) in enumerate(whole):
                    body = content
                    if len(whole) > 1:
                        out = io.BytesIO()
                        with wave.open(out, "wb") as w:
                            w.setnchannels(channels)
                            w.setsampwidth(2)
                            w.setframerate(rate)
                            w.writeframes(samples[a:b].tobytes())
                        body = out.getvalue()
                    rows.append((path, k, a / rate, body))
            yield pd.DataFrame(rows, columns=["path", "chunk_no", "start_s", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, chunk_no int, start_s double, content binary")


def quietest_position(samples: DataFrame, window: int) -> DataFrame:
    """(key, pos): start of the quietest window of each key of a sample table
    (key, pos, sample); the last of equals."""
    frame = Window.partitionBy("key").orderBy("pos").rowsBetween(0, window - 1)
    sums = samples.withColumn("energy", F.sum(F.col("sample") * F.col("sample")).over(frame)).withColumn("n", F.count("*").over(frame))
    return sums.where(F.col("n") == window).groupBy("key").agg(F.max_by("pos", F.struct(F.negative("energy"), F.col("pos"))).alias("pos"))
