"""Readers of media folders, URL lists and JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionmill.functions.text import is_download
from captionmill.schema import EVAL_JSON, GROUND_TRUTH_JSON

#: Suffixes of a photo post's files.
IMAGES, AUDIO = ("jpg", "jpeg", "png", "webp"), ("mp3", "m4a", "aac", "wav")


def acquisition(source, exists=None) -> Column:
    """How a source is come by: ``file`` if it is there, ``download`` for web
    addresses, ``error`` otherwise."""
    s = F.col(source) if isinstance(source, str) else source
    there = F.lit(False) if exists is None else exists
    return F.when(there, "file").when(is_download(s), "download").otherwise("error")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def photo_files(files: DataFrame) -> DataFrame:
    """Images and the first audio of photo posts, from a table with ``path``:
    video_id (the folder), kind, image_no in order of the path. Only a
    folder's own files count."""
    kind = F.when(_suffix(F.col("path")).isin(*IMAGES), "image").when(_suffix(F.col("path")).isin(*AUDIO), "audio")
    own = files.withColumn("video_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("kind", kind).where("kind IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("video_id", "kind").orderBy("path")) - 1
    return own.withColumn("image_no", nth).where("kind = 'image' OR image_no = 0")


def read_photo_posts(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return photo_files(files)


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Text files read whole, for ``manifest.parse_list``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected texts of one JSON object a file, numbered in order; ``required``
    is true where it is left out, the file's stem is the video."""
    raw = spark.read.schema(GROUND_TRUTH_JSON).option("mode", "FAILFAST").json(path, multiLine=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    each = raw.select(stem.alias("video_id"), "language", F.posexplode("expected_texts").alias("gt_seq", "e"))
    spans = F.transform("e.appearances", lambda a: F.struct(a[0].alias("start"), a[1].alias("end")))
    return each.select("video_id", "language", F.col("gt_seq").cast("long").alias("gt_seq"), "e.text", "e.start", "e.end", F.coalesce("e.required", F.lit(True)).alias("required"), spans.alias("appearances"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation results, one JSON object a file."""
    return spark.read.schema(EVAL_JSON).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
