"""Frame sampling, block differences, masks and contrast on gray frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the sampler.
MAX_GAP_S, MAX_GAP_FRAMES, LONGEST, GRID = 30.0, 10, 320, 16


def stride(frames: DataFrame, fps: float = 1.0) -> DataFrame:
    """Every n-th frame with its time, n the rounded quotient of the rates."""
    n = F.greatest(F.lit(1), F.rint(F.col("native_fps") / fps)).cast("long")
    rate = F.when(F.col("native_fps") > 0, F.col("native_fps")).otherwise(F.raise_error(F.lit("a frame rate must be positive")).cast("double"))
    return frames.where(F.pmod("frame_idx", n) == 0).withColumn("ts", F.col("frame_idx") / rate)


def max_gap(fps: float) -> int:
    return max(1, min(round(fps * MAX_GAP_S), MAX_GAP_FRAMES))


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted mean over the source pixels that each cell covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * (n / m)
        lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        return np.maximum(hi - lo, 0) / (n / m)

    return weights(a.shape[0], height) @ a @ weights(a.shape[1], width).T


def downscale(gray: np.ndarray) -> np.ndarray:
    h, w = gray.shape
    if max(h, w) <= LONGEST:
        return gray
    k = LONGEST / max(h, w)
    return np.rint(area_resize(gray.astype(float), max(1, round(h * k)), max(1, round(w * k)))).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """Largest mean absolute difference of any block of a 16 by 16 grid, in 0..1."""
    d = np.abs(a.astype(float) - b.astype(float))
    return float(area_resize(d, min(GRID, d.shape[0]), min(GRID, d.shape[1])).max()) / 255


def vector_difference(a: Column, b: Column, blocks: int = GRID, scale: float = 255.0) -> Column:
    """The same for one row of cells held as arrays whose length ``blocks`` divides."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    size = (F.size(a) / blocks).cast("int")
    mean = lambda k: F.aggregate(F.slice(d, k * size + 1, size), F.lit(0.0), lambda s, x: s + x) / size
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), mean)) / scale


class Selector:
    """The choice of one video's frames, against the last frame chosen."""

    def __init__(self, threshold: float, gap: int):
        self.threshold, self.gap = threshold, gap
        self.last = self.pending = None
        self.since = 0

    def offer(self, key, small) -> bool:
        if self.last is None:
            take = True
        else:
            d = difference(self.last, small)
            self.since += 1
            take = d >= self.threshold or self.since >= self.gap
            self.pending = None if take else (key, d)
        if take:
            self.last, self.since, self.pending = small, 0, None
        return take

    def finish(self):
        """The key of a last frame that was held back although it differs."""
        return self.pending[0] if self.pending and self.pending[1] > 0 else None


def scene_changes(frames: DataFrame, threshold: float = 0.05, fps: float = 1.0) -> DataFrame:
    """(video_id, frame_idx) of the frames to read: the first; those that
    differ enough from the last chosen one; one after ``max_gap`` skipped; and
    the video's last frame if it was skipped and differs at all. The choice
    depends on the last choice, so each video is a sequential fold."""
    gap = max_gap(fps)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx", kind="stable")
        own, chosen = Selector(threshold, gap), []
        for i, h, w, g in zip(pdf["frame_idx"], pdf["height"], pdf["width"], pdf["gray"]):
            if own.offer(i, np.frombuffer(g, np.uint8).reshape(h, w)):
                chosen.append(i)
        last = own.finish()
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "frame_idx": chosen + ([] if last is None else [last])})

    def shrink(batches):
        for pdf in batches:
            small = [downscale(np.frombuffer(g, np.uint8).reshape(h, w)) for h, w, g in zip(pdf["height"], pdf["width"], pdf["gray"])]
            yield pdf.assign(height=[a.shape[0] for a in small], width=[a.shape[1] for a in small], gray=[np.ascontiguousarray(a).tobytes() for a in small])

    # Frames are shrunk where they lie; a video's small frames are what is gathered.
    own = frames.select("video_id", "frame_idx", "height", "width", "gray")
    return own.mapInPandas(shrink, own.schema).groupBy("video_id").applyInPandas(choose, "video_id string, frame_idx long")


def frame_counts(chosen: DataFrame) -> DataFrame:
    """Frames read per video, with or without text: the recurrence denominator."""
    return chosen.groupBy("video_id").agg(F.count("*").alias("frame_count"))


def mask_zones(frames: DataFrame, zones: DataFrame) -> DataFrame:
    """Frames with the zones of their video painted black. ``zones`` (video_id,
    zones array<struct<x,y,w,h>>) are shares of the frame; edges are cut to
    whole pixels, the far corner's pixel included."""

    def paint(batches):
        for pdf in batches:
            out = []
            for h, w, g, rects in zip(pdf["height"], pdf["width"], pdf["gray"], pdf["zones"]):
                if rects is None or not len(rects):
                    out.append(g)
                    continue
                a = np.frombuffer(g, np.uint8).reshape(h, w).copy()
                for r in rects:
                    x0, y0, x1, y1 = int(r["x"] * w), int(r["y"] * h), int((r["x"] + r["w"]) * w), int((r["y"] + r["h"]) * h)
                    a[max(y0, 0) : min(y1, h) + 1, max(x0, 0) : min(x1, w) + 1] = 0
                out.append(a.tobytes())
            yield pdf.assign(gray=out).drop(columns="zones")

    return frames.join(zones, "video_id", "left").mapInPandas(paint, frames.schema)


def equalize(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: clipped histograms of
    a grid of tiles, blended between the tiles' centres."""
    h, w = gray.shape
    a = np.pad(gray, ((0, -h % tiles), (0, -w % tiles)), mode="reflect" if min(h, w) > tiles else "edge")
    th, tw = a.shape[0] // tiles, a.shape[1] // tiles
    limit = max(int(clip * th * tw / 256), 1)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(a[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            spare = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + spare // 256
            n[: 256 : max(256 // max(spare % 256, 1), 1)][: spare % 256] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(n) * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: maps[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], gray]
    return np.rint((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))).astype(np.uint8)


def preprocess(frames: DataFrame) -> DataFrame:
    """Frames with equalised contrast, batch by batch."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(gray=[equalize(np.frombuffer(g, np.uint8).reshape(h, w)).tobytes() for h, w, g in zip(pdf["height"], pdf["width"], pdf["gray"])])

    return frames.mapInPandas(run, frames.schema)


def slide_times(images: DataFrame) -> DataFrame:
    """Start and end of the images of a photo post: equal shares of the audio's
    duration, or a second each without audio. (video_id, image_no, duration)."""
    n = F.count("*").over(Window.partitionBy("video_id"))
    i = F.row_number().over(Window.partitionBy("video_id").orderBy("image_no")) - 1
    share = F.coalesce(F.col("duration") / n, F.lit(1.0))
    return images.withColumn("start", i * share).withColumn("end", (i + 1) * share)
