"""Text boxes of a frame to lines in reading order.

The two ordered folds (dropping nested copies, grouping by a running mean) run
over the boxes of one frame as higher-order functions in the JVM; the rest is
windows and aggregates keyed by frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionmill.functions.bidi import in_reading_order

FRAME = ["video_id", "frame_ts"]


def axis_box(box: Column) -> dict[str, Column]:
    """Bounds, centre and height of a polygon."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1, "x_center": (x0 + x1) / 2, "y_center": (y0 + y1) / 2, "height": y1 - y0}


def _frames(boxes: DataFrame) -> DataFrame:
    """One row a frame, its boxes in order of ``pos``."""
    row = F.struct("pos", "text", "score", "x_min", "x_max", "y_min", "y_max", "x_center", "y_center", "height")
    return boxes.groupBy(*FRAME).agg(F.array_sort(F.collect_list(row)).alias("boxes"))


_ACCEPT = """aggregate(boxes, slice(boxes, 1, 0), (kept, b) -> CASE WHEN exists(kept, k -> k.text = b.text
    AND k.x_min < b.x_max AND b.x_min < k.x_max AND k.y_min < b.y_max AND b.y_min < k.y_max) THEN kept ELSE concat(kept, array(b)) END)"""


def _lines(tolerance: str) -> str:
    """Number of the line of each box, in order of the vertical centre."""
    return f"""aggregate(sorted, named_struct('n', 0, 'mean', 0D, 'line', -1, 'out', cast(array() AS array<int>)), (s, b) ->
        CASE WHEN s.n > 0 AND abs(b.y_center - s.mean) <= {tolerance}
        THEN named_struct('n', s.n + 1, 'mean', (s.mean * s.n + b.y_center) / (s.n + 1), 'line', s.line, 'out', concat(s.out, array(s.line)))
        ELSE named_struct('n', 1, 'mean', b.y_center, 'line', s.line + 1, 'out', concat(s.out, array(s.line + 1))) END, s -> s.out)"""


def with_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns(axis_box(F.col("box")))


def drop_nested(boxes: DataFrame) -> DataFrame:
    """Without boxes that strictly overlap an accepted box of the same text."""
    return _frames(boxes).select(*FRAME, F.inline(F.expr(_ACCEPT)))


def group_lines(boxes: DataFrame, y_ratio: float = 0.5) -> DataFrame:
    """Each box with its line, its place in the line and the frame's mean
    height. A box joins the line while it lies within ``y_ratio`` mean heights
    of the line's running mean."""
    return _lined(_frames(boxes), y_ratio)


def _lined(frames: DataFrame, y_ratio: float) -> DataFrame:
    framed = frames.withColumn("mean_height", F.expr("aggregate(boxes, 0D, (s, b) -> s + b.height) / size(boxes)"))
    by_y = framed.withColumn("sorted", F.expr("array_sort(boxes, (l, r) -> CASE WHEN l.y_center < r.y_center THEN -1 WHEN l.y_center > r.y_center THEN 1 ELSE l.pos - r.pos END)"))
    numbered = by_y.withColumn("line", F.expr(_lines(f"mean_height * {y_ratio}D")))
    return numbered.select(*FRAME, "mean_height", F.posexplode(F.arrays_zip(F.col("sorted").alias("b"), "line")).alias("place", "z")).select(*FRAME, "mean_height", "place", F.col("z.line").alias("line"), "z.b.*")


def split_columns(lined: DataFrame, x_ratio: float = 2.0) -> DataFrame:
    """Lines cut where the gap to the box before is over ``x_ratio`` mean
    heights; one row a piece, its texts in reading order joined by spaces."""
    across = Window.partitionBy(*FRAME, "line").orderBy("x_center", "place")
    gap = F.col("x_min") - F.lag("x_max").over(across) > F.col("mean_height") * x_ratio
    cut = lined.withColumn("cut", F.when(gap, 1).otherwise(0)).withColumn("chunk", F.sum("cut").over(across).cast("int"))
    pieces = cut.groupBy(*FRAME, "line", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("x_center", "place", "text"))).alias("parts"), F.avg("score").alias("mean_conf"),
        F.avg("height").alias("mean_box_height"), F.avg("y_center").alias("y_center"), F.avg("x_center").alias("x_center"),
    )
    texts = pieces.withColumn("texts", F.transform("parts", lambda p: p["text"]))
    return texts.select(*FRAME, "line", "chunk", F.array_join(in_reading_order(F.col("texts")), " ").alias("text"), "mean_conf", "mean_box_height", "y_center", "x_center")


def aggregate_boxes(boxes: DataFrame, min_confidence: float = 0.6, y_ratio: float = 0.5, x_ratio: float = 2.0) -> DataFrame:
    """Boxes (video_id, frame_ts, pos, box, text, score) to lines."""
    sure = with_bounds(boxes.where(F.col("score") >= min_confidence))
    kept = _frames(sure).select(*FRAME, F.expr(_ACCEPT).alias("boxes"))  # gathered once for both folds
    return split_columns(_lined(kept, y_ratio), x_ratio)


def normalized(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Line geometry as shares of the frame: ``frames`` (video_id, height, width)."""
    own = lines.join(frames, "video_id")
    return own.withColumns({"normalized_height": F.col("mean_box_height") / F.col("height"), "x_center_norm": F.col("x_center") / F.col("width"), "y_center_norm": F.col("y_center") / F.col("height")}).drop("height", "width")


def to_segments(lines: DataFrame, language: str) -> DataFrame:
    """Point segments at the frame's time, numbered in order within the video."""
    order = Window.partitionBy("video_id").orderBy("frame_ts", "line", "chunk")
    null = F.lit(None).cast("double")
    return lines.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("frame_ts").alias("start"), F.col("frame_ts").alias("end"), "text", F.lit("ON-SCREEN").alias("source"), null.alias("asr_logprob"), F.col("mean_conf").alias("ocr_confidence"), F.lit(language).alias("language"))
