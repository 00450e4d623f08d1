"""MinHash near-duplicate detection with tensored banding.

A document is the set of its 5-word shingles. Two collections of ``m`` short
sketches are made, each sketch a hash of ``t`` minhashes; the table keys are
all pairs of one sketch from either collection. So 2*m*t minhashes give m*m
tables of 2*t minhashes each, where separate tables would need m*m*2*t.
Documents with one shingle set are one class, and classes alone are banded.

Candidates of a table key are confirmed in two rounds, on the full shingle
sets made again from the texts. First every class is compared with the one it
meets most often among the least classes of its tables; the links found join
most of a group to one component. Classes tied together by these choices,
confirmed or not, are dealt into blocks of about ``BLOCK``. Then, for each table key that still holds several
components, the blocks of its classes are compared block by block, every class
of one with every class of the other. So no pair of different components that
met in a table is left out, no pair of classes is ever a row, and a text
travels once for each block its own block is compared with.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import internal, make_room, release, stored
from captionmill.llm.components import connected

SHINGLE, SPREAD, BLOCK = 5, 200, 400


# Shingles and sketches -------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z folded, words
    between ASCII white space; fewer than five words are one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    k = min(SHINGLE, len(w))
    total = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
    return np.unique(_mix(total))


@functools.lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = lambda i, s: xxhash.xxh3_64_intdigest(f"{s}{i}".encode(), 11)
    return np.array([h(i, "a") | 1 for i in range(n)], np.uint64), np.array([h(i, "b") for i in range(n)], np.uint64)


def sketches(sets: list[np.ndarray], m: int, t: int) -> np.ndarray:
    """2*m sketches (rows) of each non-empty set; minima run over all sets of
    a batch at once."""
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    a, b = _coefficients(2 * m * t)
    out = np.zeros((len(sets), 2 * m), np.uint64)
    for i in range(2 * m):
        for j in range(i * t, i * t + t):
            out[:, i] = _mix(out[:, i] * np.uint64(31) + np.minimum.reduceat(flat * a[j] + b[j], start))
    return out


SKETCHED = "doc_id long, text_hash long, n_shingles long, set_key binary, sketch array<long>"


def _sketcher(m: int, t: int):
    def run(batches):
        make_room()
        for batch in batches:
            for part in _slices(batch, 2_000_000):
                texts = part.column(1).to_pylist()
                sets = [shingle_set(x) for x in texts]
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, rows = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, r in zip(full, sketches([sets[i] for i in full], m, t).view(np.int64).tolist()):
                        keys[i], rows[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), r
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    return run


# Candidates and confirmation -------------------------------------------------


def _tables(classes: DataFrame, m: int) -> DataFrame:
    """(key, id, n) of table keys that hold two classes or more."""
    left, right = f"slice(sketch, 1, {m})", f"slice(sketch, {m + 1}, {m})"
    keys = f"flatten(transform({left}, (a, i) -> transform({right}, (b, j) -> xxhash64(a, b, i, j))))"
    rows = classes.select("id", "n", F.explode(F.expr(keys)).alias("key"))
    met = F.count("*").over(Window.partitionBy("key"))
    return rows.withColumn("met", met).where("met > 1").drop("met")


def _confirmer(percent: int):
    def run(batches):
        at, own = None, None
        for batch in batches:
            x, y = [], []
            for head, role, other, text in zip(*(c.to_pylist() for c in batch.columns[:1] + batch.columns[2:])):
                if role == 0:  # the text against which the next rows are held; copies of an id are held each
                    own = [*own, shingle_set(text)] if at == head and own is not None and open_ else [shingle_set(text)]
                    at, open_ = head, True
                    continue
                open_ = False
                s = shingle_set(text)
                for o in own if at == head else []:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if len(s) and both * 100 >= percent * (len(o) + len(s) - both):
                        x.append(head)
                        y.append(other)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (head, other: ids) whose full sets are that similar.

    A head's text goes once to every group of about ``SPREAD`` partners; rows
    stream through sorted, so a task holds the set of one head."""
    heads = pairs.groupBy("head").agg(F.count("*").alias("n")).select("head", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts"))
    lead = pool.join(heads, pool["id"] == heads["head"]).select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("other"), "text")
    dealt = pairs.join(heads, "head").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
    follow = pool.join(dealt, pool["id"] == dealt["other"]).select("head", "part", F.lit(1).alias("role"), "other", "text")
    rows = lead.unionByName(follow).repartition("head", "part").sortWithinPartitions("head", "part", "role", "other")
    return stored(rows.mapInArrow(_confirmer(percent), "u long, v long"), "links")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Intersection sizes of all sets of one block with all of another, as
    products of 0/1 matrices over the shingles that both blocks hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    shared = np.intersect1d(*flat)
    where = []
    for sets, f in zip((left, right), flat):
        at = np.searchsorted(shared, f)
        has = at < len(shared)
        has[has] = shared[at[has]] == f[has]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        where.append((row[has], at[has]))
    for a in range(0, len(shared), columns):
        both = []
        for n, (row, at) in zip((len(left), len(right)), where):
            m, own = np.zeros((n, min(columns, len(shared) - a)), np.float32), (at >= a) & (at < a + columns)
            m[row[own], at[own] - a] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out


def _block_links(members: list[tuple[int, int, str]], percent: int) -> list[tuple[int, int]]:
    """Links between the sides of a block pair; side 2 belongs to both."""
    sides = [[(i, shingle_set(t)) for side, i, t in members if side in (s, 2)] for s in (0, 1)]
    sides = [[x for x in side if len(x[1])] for side in sides]
    if not all(sides):
        return []
    both = _overlaps(*([s for _, s in side] for side in sides))
    a, b = (np.array([len(s) for _, s in side]) for side in sides)
    ids = [np.array([i for i, _ in side]) for side in sides]
    return _forest(both * 100 >= percent * (a[:, None] + b[None, :] - both), *ids)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id that it reaches) over the links of two sides: what the
    links join stays joined, without a row for each link."""
    least = {i: i for i in [*left.tolist(), *right.tolist()]}
    top = np.iinfo(np.int64).max
    while True:
        own_l, own_r = (np.array([least[i] for i in side.tolist()]) for side in (left, right))
        new_l = np.minimum(own_l, np.where(linked, own_r[None, :], top).min(1))
        new_r = np.minimum(own_r, np.where(linked, new_l[:, None], top).min(0))
        before = dict(least)
        for i, x in zip([*left.tolist(), *right.tolist()], [*new_l.tolist(), *new_r.tolist()]):
            least[i] = min(least[i], x)
        if least == before:
            return [(i, x) for i, x in least.items() if i != x]


def _block_comparer(percent: int):
    def run(batches):
        at, members = None, []
        out = lambda links: pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])
        for batch in batches:
            for *pair, side, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if pair != at:
                    if members:
                        yield out(_block_links(members, percent))
                    at, members = pair, []
                members.append((side, i, text))
        if members:
            yield out(_block_links(members, percent))

    return run


def _mixed_blocks(met: DataFrame, parts: DataFrame, tied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block of each id, block pairs to compare): those whose classes meet in
    a key with several components."""
    ids = met.select("id").distinct().join(tied.select(F.col("node").alias("id"), F.col("component").alias("head")), "id", "left").select("id", F.coalesce("head", "id").alias("head"))
    size = ids.groupBy("head").agg(F.count("*").alias("n"))
    blocks = stored(ids.join(size, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("part")), "blocks")
    own = met.join(blocks, "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = own.groupBy("key", "head", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    span = Window.partitionBy("key")
    held = held.withColumn("key_low", F.min("low").over(span)).withColumn("key_high", F.max("high").over(span)).where("key_low <> key_high")
    left = held.select("key", F.col("head").alias("a_head"), F.col("part").alias("a_part"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    right = held.select("key", F.col("head").alias("b_head"), F.col("part").alias("b_part"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    order = (F.col("a_head") < F.col("b_head")) | ((F.col("a_head") == F.col("b_head")) & (F.col("a_part") <= F.col("b_part")))
    mixed = F.least("a_low", "b_low") != F.greatest("a_high", "b_high")
    return blocks, left.join(right, "key").where(order & mixed).select("a_head", "a_part", "b_head", "b_part").distinct()


def block_confirmed(blocks: DataFrame, pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    pairs = stored(pairs, "block-pairs")
    same = (F.col("a_head") == F.col("b_head")) & (F.col("a_part") == F.col("b_part"))
    named = ["a_head", "a_part", "b_head", "b_part"]
    sides = pairs.select(*named, F.when(same, 2).otherwise(0).alias("side"), F.col("a_head").alias("head"), F.col("a_part").alias("part")).unionByName(pairs.where(~same).select(*named, F.lit(1).alias("side"), F.col("b_head").alias("head"), F.col("b_part").alias("part")))
    rows = pool.join(blocks, "id").join(sides, ["head", "part"]).select(*named, "side", "id", "text")
    dealt = rows.repartition(*named).sortWithinPartitions(*named, "side", "id")
    return stored(dealt.mapInArrow(_block_comparer(percent), "u long, v long"), "links")


def bands(percent: int, t: int = 3) -> int:
    """The least m for which a pair at ``percent`` is missed by all m * m
    tables with probability 1.5e-4 at most: 10 at 85 %, 14 at 80 %. A pair is
    missed when all m sketches of one collection differ, or all of the other."""
    alike = (percent / 100) ** t
    return 1 if alike >= 1 else max(1, math.ceil(math.log(1.5e-4 / 2) / math.log(1 - alike)))


def near_duplicates(docs: DataFrame, percent: int = 80, m: int | None = None, t: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id (the
    least doc_id reachable over links) and kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their
    shingle sets. By default m follows ``percent`` (``bands``): a pair at 85 %
    is missed by all 100 tables of percent = 85 with probability 1.5e-4, one at
    80 % by the 196 of percent = 80 with 9e-5. Null and empty texts have no shingle and link with nothing. Each row goes by its own text, also where
    rows share a doc_id. Rows with a null doc_id are kept, alone.
    """
    m = bands(percent, t) if m is None else m
    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = stored(rows.mapInArrow(_sketcher(m, t), SKETCHED), "sketches")
    # One row for each shingle set; partial sums absorb large groups of copies.
    classes = stored(
        sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes"
    )
    met = stored(_tables(classes, m), "tables")
    ids = met.select("id").distinct()
    pool = stored(rows.join(ids, rows["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
    least = F.min("id").over(Window.partitionBy("key"))
    often = met.withColumn("head", least).where("head <> id").groupBy("id", "head").agg(F.count("*").alias("n"))
    heads = stored(often.groupBy(F.col("id").alias("other")).agg(F.max_by("head", F.struct("n", F.negative("head"))).alias("head")), "heads")
    links = confirmed(heads, pool, percent)
    blocks, pairs = _mixed_blocks(met, connected(links), connected(heads.select(F.col("other").alias("u"), F.col("head").alias("v"))))
    parts = connected(links.unionByName(block_confirmed(blocks, pairs, pool, percent)))
    return _joined_back(sketched, classes, parts)


def _joined_back(sketched: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with their components. Classes with over a thousandth of all
    rows, at most a thousand by count, are broadcast; the others are joined by
    class, and there no key is large."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    by_class = classes.select("set_key", "id", "copies").join(parts.withColumnRenamed("node", "id"), "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("component_id"))
    hot = F.broadcast(by_class.where(F.col("copies") * 1000 > total).select("set_key", F.col("component_id").alias("hot_id")))
    told = ["doc_id", "text_hash", "n_shingles"]
    own = sketched.select(*told, "set_key")
    bare = own.where("set_key IS NULL OR doc_id IS NULL").select(*told, F.col("doc_id").alias("component_id"))
    own = own.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(hot, "set_key", "left")
    large, rest = own.where("hot_id IS NOT NULL"), own.where("hot_id IS NULL").drop("hot_id")
    rest = rest.join(by_class.where(F.col("copies") * 1000 <= total).select("set_key", "component_id"), "set_key")
    every = large.select(*told, F.col("hot_id").alias("component_id")).unionByName(rest.select(*told, "component_id")).unionByName(bare)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _hash_text(batches):
    for batch in batches:
        own = np.array([xxhash.xxh3_64_intdigest(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.int64())], names=[*batch.schema.names[:-1], "text_hash"])


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, that of the least id,
    under the columns of ``docs``. Of rows alike in id and text one stays;
    texts without a word and rows with a null id all stay."""
    found = near_duplicates(docs, percent)
    row = F.struct(*[docs[c] for c in docs.columns])
    keyed = docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.col("text").alias("text_hash"))
    kinds = keyed.schema
    hashed = keyed.mapInArrow(_hash_text, kinds[:2].add("text_hash", "long"))
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.max("n_shingles").alias("n_shingles"))
    one = hashed.join(kept, ["doc_id", "text_hash"]).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(1))))
    stay = one.where("nth = 1 OR n_shingles = 0").select("row").unionByName(hashed.where("doc_id IS NULL").select("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
