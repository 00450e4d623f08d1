"""Greedy first-match clusters of similar keys, as joins in rounds.

A key, in order of first appearance, joins the first cluster that has a similar
member, or opens one. Clusters count in the order of their first keys, so a key's
cluster is the least cluster of its earlier neighbours, and a key without any opens
one. Neighbours come from a self-join on the rarest characters of the keys (two
strings of ratio t share at least n t / (2 - t) characters, so they meet in one of
the n - n t / (2 - t) + 1 rarest of either), with a bound by length, and the ratio
itself. Nothing is gathered by group, and the keys of a group are never all paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionmill.functions import similarity
from captionmill.operators.stored import dropped, stored


def neighbours(nodes: DataFrame, group: str, threshold: float, ratio=similarity.ratio) -> DataFrame:
    """Pairs (group, i, j), j before i, of the keys of ``nodes`` (group, pos, low)
    whose ratio is ``threshold`` (over 0) or more."""
    size = F.length("low")
    chars = nodes.where(size > 0).select(group, "pos", size.alias("n"), F.explode(F.split("low", "")).alias("char")).where("char <> ''").groupBy(group, "pos", "n", "char").agg(F.count("*").alias("times"))
    counted = chars.select(group, "pos", "n", "char", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    rare = counted.groupBy("char", "nth").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy(group, "pos").orderBy("often", "char", "nth"))
    shared = F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9)
    heads = counted.join(rare, ["char", "nth"]).withColumn("place", place).where(F.col("place") <= F.col("n") - shared + 1).select(group, "pos", "n", "char", "nth")
    later, earlier = heads.withColumnRenamed("pos", "i"), heads.select(group, "char", "nth", F.col("pos").alias("j"), F.col("n").alias("m"))
    fits = 2.0 * F.least("n", "m") / (F.col("n") + F.col("m")) >= threshold
    met = later.join(earlier, [group, "char", "nth"]).where((F.col("j") < F.col("i")) & fits).select(group, "i", "j").distinct()
    text = lambda p, t: nodes.select(group, F.col("pos").alias(p), F.col("low").alias(t))
    told = met.join(text("i", "a"), [group, "i"]).join(text("j", "b"), [group, "j"])
    return told.where(ratio(F.col("a"), F.col("b")) >= threshold).select(group, "i", "j")


def settle(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, pos, first): the first key of each key's cluster, the least of the keys
    without an earlier neighbour that a chain of earlier neighbours leads to. Such keys
    pass their number on, and in each round the keys that have got a lesser one pass it
    on in turn, until none has; a family of keys that are all alike takes two rounds."""
    edges = stored(edges, "cluster-edges")
    follow = edges.select(group, F.col("i").alias("pos"), F.lit(True).alias("follows")).distinct()
    began = nodes.select(group, "pos").join(follow, [group, "pos"], "left").select(group, "pos", F.when(F.col("follows").isNull(), F.col("pos")).alias("first"), F.col("follows").isNull().alias("new"))
    state = stored(began, "clusters")
    while not state.where("new").isEmpty():
        told = edges.join(state.where("new").select(group, F.col("pos").alias("j"), F.col("first").alias("via")), [group, "j"]).groupBy(group, F.col("i").alias("pos")).agg(F.min("via").alias("via"))
        better = F.coalesce(F.col("via") < F.col("first"), F.col("via").isNotNull())
        last, state = state, stored(state.join(told, [group, "pos"], "left").select(group, "pos", F.least("first", "via").alias("first"), better.alias("new")), "clusters")
        dropped(last)
    dropped(edges)
    return state


def cluster_keys(keys: DataFrame, threshold: float = 0.9, group: str = "video_id", ratio=similarity.ratio) -> DataFrame:
    """(group, key, cluster) of distinct keys: ``keys`` has ``key`` and
    ``first_seq``, ties by key. Keys are compared in lower case. A threshold of 0
    or less makes one cluster of each group; an empty table has none."""
    order = Window.partitionBy(group).orderBy("first_seq", "key")
    nodes = keys.select(group, "key", F.lower("key").alias("low"), F.row_number().over(order).cast("long").alias("pos"))
    if threshold <= 0:
        return nodes.select(group, "key", F.lit(0).alias("cluster"))
    nodes = stored(nodes, "keys")
    first = settle(nodes, neighbours(nodes, group, threshold, ratio), group)
    number = F.dense_rank().over(Window.partitionBy(group).orderBy("first")) - 1
    return nodes.join(first, [group, "pos"]).select(group, "key", number.cast("int").alias("cluster"))
