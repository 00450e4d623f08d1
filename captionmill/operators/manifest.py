"""URL lists, playlist expansion, the batch manifest and output paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionmill.functions.text import LINE_END, is_url, output_stem, strip
from captionmill.operators.stored import stored
from captionmill.schema import MANIFEST


def parse_list(files: DataFrame) -> DataFrame:
    """(path, line_no, source) of text files read whole (path, value): a
    leading byte order mark, blank lines and outer white space go."""
    body = F.regexp_replace("value", "^\ufeff", "")
    lines = files.select("path", F.posexplode(F.split(body, LINE_END)).alias("line_no", "line"))
    return lines.select("path", "line_no", strip("line").alias("source")).where("source <> ''")


def entry_url(entry: Column) -> Column:
    """Address of a playlist entry: url, page, or one made of the id; empty
    strings count as absent."""
    said = lambda c: F.nullif(entry[c], F.lit(""))
    return F.coalesce(said("url"), said("webpage_url"), F.concat(F.lit("https://www.youtube.com/watch?v="), said("id")))


def playlist(kind: Column, entries: Column, source: Column) -> Column:
    """Addresses of a playlist's entries, those without one left out; null for
    what is no playlist or no address. An empty playlist is an empty array."""
    return F.when(is_url(source) & (kind == "playlist"), F.array_compact(F.transform(entries, entry_url)))


def expand(sources: DataFrame) -> DataFrame:
    """Playlists (column ``expanded``, null for single items) put in place of
    their line, one level deep; order kept, ``seq`` renumbered."""
    n = F.size(F.coalesce("expanded", F.array("source")))
    dealt = stored(sources.withColumn("n", n).repartitionByRange("line_no").withColumn("part", F.spark_partition_id()), "playlists")  # a recomputed id may differ
    # One row a partition: the running total goes over partitions, not over rows.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    ahead = F.sum("n").over(Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(F.broadcast(offsets), "part")
    each = placed.select("offset", "ahead", F.posexplode(F.coalesce("expanded", F.array("source"))).alias("pos", "source"))
    return each.select((F.col("offset") + F.col("ahead") + F.col("pos")).cast("long").alias("seq"), "source")


def _fs(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_manifest(spark, path: str, version: int = 1) -> DataFrame:
    """The manifest at ``path`` (JSON lines with a version), or an empty one if
    it is missing, broken or of another version: a run then starts afresh. After
    a stop within ``write_manifest`` the new manifest is put in its place first, so
    that what is derived from the rows read can be written over them."""
    _recover(spark, path)
    empty = spark.createDataFrame([], MANIFEST)
    if not _exists(spark, path):
        return empty
    raw = spark.read.schema(f"version int, {MANIFEST}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    fine = raw.where(f"_bad IS NOT NULL OR version IS NULL OR version <> {version} OR source IS NULL OR status IS NULL").isEmpty()
    return raw.select("seq", "source", "status", "output_path", "error") if fine else empty


def _recover(spark, path: str) -> None:
    """Finish the renames of a writer that stopped between them."""
    fs, at = _fs(spark, path)
    if not fs.exists(at) and fs.exists(_fs(spark, f"{path}.new/_SUCCESS")[1]):
        fs.rename(_fs(spark, f"{path}.new")[1], at)


def write_manifest(manifest: DataFrame, path: str, version: int = 1) -> None:
    """Write the manifest aside, then put it in place by renames; at every
    moment either the old or the new one can be read."""
    spark = manifest.sparkSession
    (fs, at), new, old = _fs(spark, path), _fs(spark, f"{path}.new")[1], _fs(spark, f"{path}.old")[1]
    _recover(spark, path)
    manifest.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def reconcile(urls: DataFrame, state: DataFrame) -> DataFrame:
    """The list (seq, source) with what is known of each source: its first row
    in ``state`` keeps status, path and error; the others are pending. Rows of
    ``state`` that the list no longer has go."""
    first = Window.partitionBy("source").orderBy("seq")
    known = state.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("source", "status", "output_path", "error")
    return urls.join(known, "source", "left").select("seq", "source", F.coalesce("status", F.lit("pending")).alias("status"), "output_path", "error")


def pending(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("status") != "done")


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


#: A stem that another stem's numbering may reach: that stem and the number, as numbering writes it.
_NUMBERED = r"(?s)^(.*)\(([2-9]|[1-9]\d{1,17})\)$"


def _parent(stem: str) -> tuple[Column, Column]:
    return F.regexp_extract(stem, _NUMBERED, 1), F.nullif(F.regexp_extract(stem, _NUMBERED, 2), F.lit("")).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (stem, seq, item) with ``nth``, the items of the stem up to each by ``seq``;
    a stem of many items is cut into stretches, so that no task counts it alone."""
    dealt = stored(rows.repartitionByRange("stem", "seq").withColumn("part", F.spark_partition_id()), "stems")  # a recomputed id may differ
    item = F.col("item").cast("long")
    before = F.sum("total").over(Window.partitionBy("stem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("part", "stem").agg(F.sum(item).alias("total")).select("part", "stem", F.coalesce(before, F.lit(0)).alias("offset"))
    here = F.sum(item).over(Window.partitionBy("part", "stem").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("here", here).join(offsets, ["part", "stem"]).withColumn("nth", F.col("offset") + F.col("here")).drop("part", "here", "offset")


def output_paths(items: DataFrame, folder: str, suffix: str, taken: DataFrame | None = None) -> DataFrame:
    """A path for each item (seq, source, video_id), unique in the run and
    against ``taken`` (output_path): in the order of ``seq``, an item whose stem
    is taken gets the first free of ``(2)``, ``(3)``, ...

    A stem's items take its numbers in order, but for numbers that other names
    hold: paths taken before, and the first item of a stem that ends in such a
    number. Which those are is decided family by family (stems alike but for
    numbers) from distinct names alone; items only count their place.
    """
    own = items.select(F.col("seq").cast("long").alias("seq"), "source", output_stem("source", "video_id").alias("stem")).where("seq IS NOT NULL AND stem IS NOT NULL")
    of, number = _parent("stem")
    firsts = own.groupBy("stem").agg(F.min("seq").alias("seq")).withColumn("of", of).withColumn("k", number)
    claims = firsts.where("k IS NOT NULL").join(firsts.select(F.col("stem").alias("of")), "of", "left_semi")
    claims = claims.select(F.col("of").alias("stem"), "seq", F.col("stem").alias("child"), "k", F.lit(False).alias("item"))
    placed = stored(_placed(own.withColumn("item", F.lit(True)).unionByName(claims, allowMissingColumns=True)), "placed")
    names = placed.where("NOT item").select("child", F.col("stem").alias("of"), "k", "nth", "seq", F.lit(False).alias("gone"))
    if taken is not None:
        ours = taken.where(F.startswith("output_path", F.lit(folder + "/")) & F.endswith("output_path", F.lit(suffix)))
        gone = ours.select(F.expr(f"substring(output_path, {len(folder) + 2}, length(output_path) - {len(folder) + 1 + len(suffix)})").alias("stem")).distinct()
        names = names.unionByName(gone.select(F.col("stem").alias("child"), of.alias("of"), F.coalesce(number, F.lit(0)).alias("k"), F.lit(0).alias("nth"), F.lit(0).alias("seq"), F.lit(True).alias("gone")))
    held = names.groupBy(F.regexp_replace("child", r"(\(\d+\))+$", "").alias("root")).applyInPandas(_held, "stem string, runs array<struct<v: bigint, j: bigint>>")
    nth = placed.where("item").join(held, "stem", "left")
    n = nth.withColumn("n", F.expr("nth + coalesce(array_max(transform(filter(runs, x -> x.v < nth), x -> x.j)), 0)"))
    name = F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("("), "n", F.lit(")")))
    return n.select("seq", "source", F.concat(F.lit(folder + "/"), name, F.lit(suffix)).alias("output_path"))


def _held(names: pd.DataFrame) -> pd.DataFrame:
    """Numbers of one family's stems that others hold (1: the stem itself). ``names``: paths taken
    before (``gone``; k is 0 without a number), and stems that another stem's numbering may reach, with the items of
    that stem ahead of their first. ``runs``: the j-th number held, less j, is v; the last j of each v."""
    held: dict[str, set[int]] = {}
    for child, of, k in names.loc[names["gone"], ["child", "of", "k"]].itertuples(index=False):
        held.setdefault(child, set()).add(1)
        if k:
            held.setdefault(of, set()).add(int(k))
    claims = names[~names["gone"]]
    claims = claims.assign(depth=claims["of"].str.len()).sort_values(["depth", "of", "seq"])  # a stem's own name is settled before its numbers
    for of, own in claims.groupby("of", sort=False):
        mine = held.setdefault(of, set())
        ahead, passed = sorted(mine), 0  # a sorted list is a heap
        for child, k, nth in own[["child", "k", "nth"]].itertuples(index=False):
            while ahead and ahead[0] <= nth + passed:
                heapq.heappop(ahead)
                passed += 1
            if k in mine:
                continue
            if nth and k <= nth + passed:
                held.setdefault(child, set()).add(1)
            else:
                mine.add(int(k))
                heapq.heappush(ahead, int(k))
    runs = [(stem, {c - j: j for j, c in enumerate(sorted(ns), 1)}) for stem, ns in held.items() if ns]
    return pd.DataFrame([(stem, [{"v": v, "j": j} for v, j in r.items()]) for stem, r in runs], columns=["stem", "runs"])
