"""Collocations: frequent phrases of adjacent words, scored by how much more often
they occur than their parts.

1. Words are counted by language. A word's id is a 64-bit hash of language and
   word; the table of all words shows whether two of them share an id, and then
   another seed is taken. Words of ``min_count`` occurrences are the dictionary.
2. Pieces break at words outside the dictionary. Tasks hold it as a bitmap of
   ``BITS`` places, the same size for any dictionary; a word that passes by chance
   only lets through phrases that the counts drop later.
3. Ids of adjacent words are packed into keys of 16 bytes, and then of 24 bytes for
   places where both pairs are in the bitmap of frequent pairs. The first eight
   bytes are an exclusive-or of all ids, rotated, so keys spread evenly over the
   range of 64-bit numbers whatever the first word, and the first word can be had
   back. A task counts a chunk of text by itself and cuts its sorted keys at the
   bounds of equal ranges; ranges are partitions, sized by the number of words. A
   partition is radix-sorted, 16 bits a pass, and its runs are summed.
4. Phrases are joined with the counts of their parts and of the longer phrases
   around them. The best of a language are taken from salted groups first.

Counts are exact and nothing but bitmaps and a few numbers reaches the driver.
"""

from __future__ import annotations

import functools
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import internal, make_room, release, stored

BITS = 26  # places of a bitmap: 8 MB
CHUNK, PER_RANGE, SALT = 6_000_000, 3_000_000, 64
UNKNOWN = "und"
#: White space, and what ends a piece besides; A-Z are folded to a-z.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _ENDS else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FLAT = bytes(32 if c == 10 else c for c in range(256))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word number of each word, number of its piece, the words) of some texts."""
    folded = b"\n".join(texts).translate(_FOLD)
    code = np.frombuffer(folded, np.uint8)
    gap = (code == 32) | (code == 10)
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(code) else np.zeros(0, int)
    piece = np.searchsorted(np.flatnonzero(code == 10), begins)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(folded)], np.int64).tobytes()), pa.py_buffer(folded.translate(_FLAT))])
    parts = pc.split_pattern(flat.cast(pa.large_binary()), b" ").flatten()
    coded = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), piece, coded.dictionary.to_pylist()


def ids_of(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    own = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.array([xxhash.xxh3_64_intdigest(w, own) for w in words], np.uint64)


def _chunks(batches):
    """(language, texts) of about ``CHUNK`` bytes at most, a text at least, from
    (language, text) rows."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for batch in batches:
        for part in _slices(batch, CHUNK):
            held += zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist())
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= CHUNK:
                yield from _by_language(held)
                held, size = [], 0
    yield from _by_language(held)


def _by_language(rows):
    for lang, own in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        yield lang, [t for _, t in own]


def _word_counter(seed: int):
    def run(batches):
        make_room()
        for lang, texts in _chunks(batches):
            which, _, words = words_of(texts)
            n = np.bincount(which, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(lang, words, seed).view(np.int64)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["id", "lang", "word", "n"])

    return run


def count_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """The stored table id, lang, word, n of all words and the seed of its ids."""
    for seed in range(8):
        words = stored(rows.mapInArrow(_word_counter(seed), "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if not words.groupBy("id").count().where("count > 1").limit(1).count():
            return words, seed
        release(words)
    raise ValueError("every seed gives two words one id")


def bitmap(numbers: DataFrame, name: str) -> np.ndarray:
    """The places, by their first ``BITS`` bits, of a column of longs."""
    places = numbers.select(F.expr(f"cast(shiftrightunsigned({name}, {64 - BITS + 6}) as int)").alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - BITS}) & 63 as int))").alias("bit"))
    got = places.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def has(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _turned(ids: np.ndarray, by: int) -> np.ndarray:
    return ids << np.uint64(by) | ids >> np.uint64(64 - by)


def leading(ids: list[np.ndarray]) -> np.ndarray:
    """The first eight bytes of the keys of phrases, given the ids of their words."""
    out = ids[0].copy()
    for k, more in enumerate(ids[1:], 1):
        out ^= _turned(more, 32 >> (k - 1))
    return out


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Keys as rows of big-endian bytes."""
    return np.stack([leading(ids), *ids[1:]], axis=1).astype(">u8").view(np.uint8).reshape(-1, 8 * len(ids))


def unpacked(keys: np.ndarray) -> list[np.ndarray]:
    own = [np.ascontiguousarray(c) for c in np.ascontiguousarray(keys).view(">u8").astype(np.uint64).T]
    own[0] = leading(own)
    return own


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width byte keys, 16 bits a pass from the last to the first."""
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16)
    order = np.arange(len(keys), dtype=np.int64)
    for d in reversed(range(digits.shape[1])):
        order = order[np.argsort(digits[order, d], kind="stable")]  # numpy's stable sort of 16-bit numbers is a radix sort
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of ``n`` over their runs."""
    if not len(keys):
        return keys, n
    order = radix_order(keys)
    keys, n = keys[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[begins], np.add.reduceat(n, begins)


def _phrases(size: int, seed: int, ranges: int, words, pairs):
    """Packed runs (range, keys, counts) of the phrases of ``size`` words."""
    shift = np.uint64(64 - ranges)

    def run(batches):
        make_room()
        for lang, texts in _chunks(batches):
            which, piece, names = words_of(texts)
            ids = ids_of(lang, names, seed)
            known = has(words.value, ids)[which] if len(which) else np.zeros(0, bool)
            at = np.flatnonzero(known[: max(len(which) - size + 1, 0)])
            for k in range(1, size):
                at = at[known[at + k]]
                at = at[piece[at + k] == piece[at]]
            for k in range(size - 1) if pairs is not None else ():
                at = at[has(pairs.value, leading([ids[which[at + k]], ids[which[at + k + 1]]]))]
            numbers = which[at].astype(np.uint64)
            for k in range(1, size - 1):  # words before the last as one number
                _, numbers = np.unique(numbers * np.uint64(len(names)) + which[at + k].astype(np.uint64), return_inverse=True)
                numbers = numbers.astype(np.uint64)
            _, one, n = np.unique(numbers * np.uint64(max(len(names), 1)) + which[at + size - 1].astype(np.uint64), return_index=True, return_counts=True)
            keys = packed([ids[which[at[one] + k]] for k in range(size)])
            top = np.ascontiguousarray(keys[:, :8]).view(">u8").astype(np.uint64)[:, 0]
            order = np.argsort(top)
            part = (top[order] >> shift).astype(np.int64) if ranges else np.zeros(len(top), np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for i, j in zip(cut, [*cut[1:], len(part)]):
                yield pa.RecordBatch.from_arrays([pa.array([part[i]], pa.int32()), pa.array([keys[order[i:j]].tobytes()], pa.binary()), pa.array([n[order[i:j]].astype("<i4").tobytes()], pa.binary())], names=["range", "keys", "counts"])

    return run


def _summed(size: int, least: int):
    names = [f"w{k}" for k in range(1, size + 1)]

    def run(batches):
        make_room()
        keys, counts = [], []
        for batch in batches:
            keys += batch.column(1).to_pylist()
            counts += batch.column(2).to_pylist()
        all_keys = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 8 * size)
        keys, n = run_lengths(all_keys, np.frombuffer(b"".join(counts), "<i4").astype(np.int64))
        keys, n = keys[n >= least], n[n >= least]
        ids = unpacked(keys)
        lead = leading(ids)
        for i in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].view(np.int64)) for x in (lead, *ids)] + [pa.array(n[i : i + 100_000])], names=["lead", *names, "n"])

    return run


def count_phrases(rows: DataFrame, size: int, least: int, seed: int, total: int, words, pairs=None) -> DataFrame:
    """The stored table lead, w1 .. w<size>, n of phrases of ``least`` occurrences."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(0, int(np.ceil(np.log2(max(parts, total / PER_RANGE)))))
    runs = rows.mapInArrow(_phrases(size, seed, ranges, words, pairs), "range int, keys binary, counts binary")
    schema = ", ".join(["lead long", *[f"w{k} long" for k in range(1, size + 1)], "n long"])
    return stored(runs.repartitionById(1 << ranges, F.col("range")).mapInArrow(_summed(size, least), schema), f"phrases-{size}")


def _named(k: int, shift: int = 0) -> list[str]:
    return [f"w{i + shift}" for i in range(1, k + 1)]


def _scored(counts: dict[int, DataFrame], words: DataFrame, size: int) -> DataFrame:
    """lang, phrase, a, l, r, score and the word ids of the phrases of one size."""
    out = counts[size].drop("lead").withColumnRenamed("n", "a")
    for k, name in enumerate(_named(size), 1):
        own = [F.col("lang")] if k == 1 else []
        out = out.join(words.select(F.col("id").alias(name), *own, F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}")), name)
    for k in range(2, size):
        first, rest = [F.col(c) for c in _named(k)], [F.col(c).alias(x) for c, x in zip(_named(k), _named(k, size - k))]
        out = out.join(counts[k].select(*first, F.col("n").alias(f"first{k}")), _named(k)).join(counts[k].select(*rest, F.col("n").alias(f"rest{k}")), _named(k, size - k))
    cuts = []
    for k in range(1, size):
        left, right = f"n{k}" if k == 1 else f"first{k}", f"n{size}" if k == size - 1 else f"rest{size - k}"
        score = "cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD div (cast({} as decimal(15,0)) * cast({} as decimal(15,0)))".format(left, right)
        cuts.append(F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    least = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(1, size + 1)])
    return out.select("lang", phrase.alias("phrase"), "a", least["l"].alias("l"), least["r"].alias("r"), least["score"].alias("score"), *_named(size))


def mine(docs: DataFrame, min_count: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top``
    phrases of 2 to ``longest`` words, by score, then a, both falling, then phrase.

    A phrase occurs ``a`` >= ``min_count`` times within pieces, its parts at the cut
    of least score (ties: the first) ``l`` and ``r`` times, the language has ``n``
    words, and score is floor(1000000 a a / (l r)). Phrases within a longer one that
    occurs half as often or more are dropped. Null texts are empty, null languages
    ``und``; repeated rows count each; whole texts are read; an empty table gives
    an empty result and columns besides text and lang are not read.
    """
    spark = docs.sparkSession
    rows = internal(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = count_words(rows)
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= min_count)
    known, pairs = spark.sparkContext.broadcast(bitmap(frequent, "id")), None
    counts: dict[int, DataFrame] = {}
    for size in range(2, longest + 1):
        counts[size] = count_phrases(rows, size, min_count, seed, total, known, pairs)
        pairs = pairs or spark.sparkContext.broadcast(bitmap(counts[2], "lead"))
    found = []
    for size in counts:
        own = _scored(counts, frequent, size)
        around = [counts[more].select(*[F.col(c).alias(x) for c, x in zip(_named(size, shift), _named(size))], "n") for more in range(size + 1, longest + 1) for shift in range(more - size + 1)]
        if around:
            most = functools.reduce(DataFrame.unionByName, around).groupBy(*_named(size)).agg(F.max("n").alias("most"))
            own = own.join(most, _named(size), "left").where("most IS NULL OR 100 * most < 50 * a")
        found.append(own.select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("w1", "w2"), F.lit(SALT)).alias("salt")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = stored(best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(words, *counts.values())
    known.destroy()
    pairs.destroy()
    return out
