"""Platforms, their screen zones and text patterns, and profile resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a source that name its platform, in order.
PLATFORM_PARTS = (("tiktok.com", "tiktok"), ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("instagram.com", "instagram"))

#: Fixed values: (platform, zones to mask, zones of automatic captions, text patterns).
PROFILES = (
    ("tiktok", ((0.85, 0.0, 0.15, 1.0), (0.0, 0.88, 1.0, 0.12), (0.0, 0.0, 1.0, 0.05)), ((0.05, 0.55, 0.90, 0.23),), (r"(?U)^@[\w.]+$", r"(?U)^\d+(\.\d+)?[KkMm]?$", "♬.*")),
    ("youtube", ((0.88, 0.10, 0.12, 0.80), (0.0, 0.88, 1.0, 0.12), (0.0, 0.0, 1.0, 0.05)), (), (r"(?i)^SUBSCRIBE$", r"(?i)^#shorts$", r"(?U)^@[\w.\-]+$")),
    ("instagram", ((0.86, 0.20, 0.14, 0.70), (0.0, 0.85, 1.0, 0.15), (0.0, 0.0, 1.0, 0.06)), ((0.05, 0.50, 0.81, 0.25),), (r"(?iU)^Original audio\b.*", ".*· Reel$", r"(?U)^@[\w.\-]+$")),
    ("generic", (), (), ()),
)
FREQUENCY_THRESHOLD = 0.95


def platform(source) -> Column:
    low = F.lower(F.col(source) if isinstance(source, str) else source)
    out = F
    for part, name in PLATFORM_PARTS:
        out = out.when(low.contains(part), name)
    return out.otherwise("unknown")


def is_photo_post(source) -> Column:
    low = F.lower(F.col(source) if isinstance(source, str) else source)
    return low.contains("tiktok.com") & low.contains("/photo/")


def profile_name(requested, source) -> Column:
    """The profile in effect: ``auto`` looks at the source; unknown is generic."""
    req = F.col(requested) if isinstance(requested, str) else requested
    name = F.when(req == "auto", platform(source)).otherwise(req)
    known = F.when(name.isin("unknown", "generic"), "generic").when(name.isin(*[p[0] for p in PROFILES]), name)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown platform: "), name)).cast("string"))


def profiles(spark: SparkSession) -> DataFrame:
    """The profile table: four rows."""
    rect = "struct<x:double,y:double,w:double,h:double>"
    return spark.createDataFrame([(n, list(z), list(c), list(p), FREQUENCY_THRESHOLD) for n, z, c, p in PROFILES], f"platform string, zones array<{rect}>, caption_zones array<{rect}>, patterns array<string>, frequency_threshold double")


def check_zone(zone: Column) -> Column:
    """The zone, if it lies within the unit square; an error otherwise."""
    fits = lambda a, b: (zone[a] >= 0) & (zone[b] >= 0) & (zone[a] + zone[b] <= 1 + 1e-9)
    return F.when(fits("x", "w") & fits("y", "h"), zone).otherwise(F.raise_error(F.lit("a zone leaves the frame")))


def resolve(videos: DataFrame) -> DataFrame:
    """Videos (video_id, source, requested) with their profile. The profile
    table has a fixed number of rows, so it is broadcast."""
    named = videos.withColumn("platform", profile_name("requested", "source"))
    return named.join(F.broadcast(profiles(videos.sparkSession)), "platform")


def recogniser_models(log: DataFrame) -> DataFrame:
    """(run, det, rec): the last detection and recognition model that each run
    says it uses. ``log`` has run, seq and message; other messages are passed over."""
    name = F.element_at(F.split(F.regexp_extract("message", r"^Using (.+\.onnx)$", 1), r"[/\\\\]"), -1)
    said = log.select("run", "seq", name.alias("name"))
    det = F.col("name").rlike(r"[_-]det[_.-]")
    rec = ~det & F.col("name").rlike(r"[_-]rec[_.-]")
    last = lambda kind: F.max_by(F.when(kind, F.col("name")), F.when(kind, F.col("seq")))
    return said.groupBy("run").agg(last(det).alias("det"), last(rec).alias("rec"))
