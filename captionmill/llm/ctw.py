"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is its UTF-8 bytes with A-Z folded and one end byte (0xFF, which no
UTF-8 text holds); what stands before the first byte is 0xFF too. Each byte is
eight binary decisions. A decision's node is (the last d bytes, the bits so
far) for every depth d from 0 to ``DEPTH``. A node holds a Krichevsky-
Trofimov estimate of its two counts; its weighted probability is half its own
estimate and half the product of its children's, and prediction mixes the
estimates along the path by the resulting posterior weights.

Every gram of DEPTH + 1 bytes takes part. Documents are dealt into blocks by a
hash of id and text, and each block sends its distinct grams once, packed, with
their counts in training texts. They go to buckets by their nearest ``SPLIT``
context bytes, so that a bucket holds whole subtrees below that depth. A first
pass over the buckets sums what the nodes above need, which the byte alphabet
bounds (256 contexts at SPLIT = 2) and which is broadcast; a second one gives
each block the log10 probabilities of its grams back.

The word-unigram base needs each word's training count in every document.
Each block sends its distinct words along with its grams, gets their counts
over the corpus back, and is scored.
"""

from __future__ import annotations

import dataclasses
import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import internal, stored, word_numbers

DEPTH, SPLIT, MARK, END_WORD = 5, 2, 0xFF, b" "
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = bytes(32 if 9 <= b <= 13 else b for b in _FOLD)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH + 1)-byte gram that ends at each byte of each text and at its
    end byte, as integers, and where each text's grams begin."""
    pad = bytes([MARK]) * DEPTH
    data = np.frombuffer(b"".join(pad + t.translate(_FOLD) + bytes([MARK]) for t in texts), np.uint8)
    key = np.zeros(max(len(data) - DEPTH, 0), np.uint64)
    for k in range(DEPTH + 1):
        key = (key << np.uint64(8)) | data[k : len(data) - DEPTH + k]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(size + DEPTH) - size - DEPTH
    take = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return key[take], np.cumsum(size) - size


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys))


def _distinct(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block and their counts in its training texts."""
    parts = []
    for batch in block.select(["learn", "text"]).to_batches():
        for part in _slices(batch, 2_000_000):
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            for flag in (True, False):
                keys, n = np.unique(grams([t.encode() for y, t in rows if y == flag])[0], return_counts=True) if any(y == flag for y, _ in rows) else (np.zeros(0, np.uint64), np.zeros(0))
                parts.append((keys, n * flag))
    return _summed(parts)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    near = (keys >> np.uint64(8)) & np.uint64((1 << 8 * SPLIT) - 1)
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte place by byte place, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _prefixes(keys: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the grams of each depth up to ``depth``, from those of the last."""
    return [_summed([(keys & np.uint64((1 << 8 * (d + 1)) - 1), n)]) for d in range(depth + 1)]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


@dataclasses.dataclass
class Model:
    """Nodes of each depth: key (context << 8 | bits so far, with a leading
    one), the log-odds of a 1 and the weight of stopping there; and grams with
    their log10 probabilities, found through a hash table."""

    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: np.ndarray
    values: np.ndarray

    def pack(self) -> bytes:
        """Keys as differences, all of it compressed."""
        parts = [np.diff(k, prepend=np.uint64(0)) for k, _, _ in self.nodes] + [np.diff(self.grams, prepend=np.uint64(0))]
        parts += [x for _, odds, stop in self.nodes for x in (odds, stop)] + [self.values]
        return zstandard.compress(pickle.dumps(parts), 3)

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        parts = pickle.loads(zstandard.decompress(data))
        keys, rest = [np.cumsum(k, dtype=np.uint64) for k in parts[: DEPTH + 2]], parts[DEPTH + 2 :]
        return cls([(k, rest[2 * d], rest[2 * d + 1]) for d, k in enumerate(keys[:-1])], keys[-1], rest[-1])

    def index(self) -> Model:
        """Build the hash table: in each round a gram settles in each free slot."""
        size = 1 << max(4, (4 * len(self.grams)).bit_length())
        self.slots, self.held = np.full(size, EMPTY), np.zeros(size, np.float32)
        left, at = np.arange(len(self.grams)), self._slot(self.grams)
        while len(left):
            free = self.slots[at] == EMPTY
            own, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.slots[own], self.held[own] = self.grams[who], self.values[who]
            stay = self.slots[at] != self.grams[left]
            left, at = left[stay], (at[stay] + 1) & (size - 1)
        return self

    def _path(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram, along the nodes."""
        out = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for i in range(8):
            bits = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
            one = (byte >> np.uint64(7 - i)) & np.uint64(1) == 1
            p = np.full(len(keys), 0.5)
            for d in range(DEPTH, -1, -1):
                context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
                key, odds, stop = self.nodes[d]
                if not len(key):
                    continue
                want = context << np.uint64(8) | bits
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                here = 1 / (1 + np.exp(np.where(one, -1.0, 1.0) * odds[at]))
                weight = stop[at].astype(float)
                p = np.where(key[at] == want, weight * here + (1 - weight) * p, 0.5)
            out += np.log10(p)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte, given those before it."""
        out, at = np.empty(len(keys), np.float32), self._slot(keys)
        out[:] = self.held[at]
        open_ = np.flatnonzero(self.slots[at] != keys)
        at, missing = at[open_], []
        while len(open_):
            gone = self.slots[at] == EMPTY
            missing.append(open_[gone])
            open_, at = open_[~gone], (at[~gone] + 1) & (len(self.slots) - 1)
            hit = self.slots[at] == keys[open_]
            out[open_[hit]] = self.held[at[hit]]
            open_, at = open_[~hit], at[~hit]
        missing = np.concatenate(missing) if missing else np.zeros(0, int)
        if len(missing):
            own, back = np.unique(keys[missing], return_inverse=True)
            out[missing] = self._path(own)[back]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        keys, start = grams(texts)
        out = np.zeros(len(texts))
        for a in range(0, len(keys), 1 << 20):  # a long text runs over several parts
            b = min(a + (1 << 20), len(keys))
            first, last = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, b)
            out[first:last] += np.add.reduceat(self.log10(keys[a:b]).astype(np.float64), np.maximum(start[first:last] - a, 0))
        return out


def _grow(counts: list, depths: range, below: tuple[np.ndarray, np.ndarray] | None, nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """Set the nodes of ``depths``, deepest first; ``below`` and what is given
    back are node keys and log weighted probabilities of the depth below."""
    for d in depths:
        gram, n = counts[d]
        keys, ones, alls = [], [], []
        for i in range(8):
            node = (gram >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << i) | ((gram & np.uint64(255)) >> np.uint64(8 - i))
            bit = (gram >> np.uint64(7 - i)) & np.uint64(1)
            own, back = np.unique(node, return_inverse=True)
            keys.append(own)
            alls.append(np.bincount(back, n, len(own)))
            ones.append(np.bincount(back, n * bit, len(own)))
        key, total, one = np.concatenate(keys), np.concatenate(alls), np.concatenate(ones)
        order = np.argsort(key)
        key, total, one = key[order], total[order], one[order]
        estimate = _log_kt(total - one, one)
        stop, weighted = np.ones(len(key)), estimate
        if below is not None:
            child, value = below  # node key of a child without its farthest byte is the parent's
            at = np.searchsorted(key, child & np.uint64((1 << 8 * (d + 1)) - 1))
            product = np.bincount(at, value, len(key))
            weighted = np.logaddexp(estimate, product) - math.log(2)
            stop = np.exp(estimate - math.log(2) - weighted)
        nodes[d] = (key, np.log((one + 0.5) / (total - one + 0.5)), stop)
        below = (key, weighted)
    return below


def build(counts: list[tuple[np.ndarray, np.ndarray]], top: Model | None = None, asked: np.ndarray | None = None) -> Model:
    """Weights from the deepest contexts up, then the table of ``asked`` grams
    (default: those counted). With ``top``, the nodes above SPLIT are its own."""
    nodes = [None] * (DEPTH + 1) if top is None else top.nodes[:SPLIT] + [None] * (DEPTH + 1 - SPLIT)
    _grow(counts, range(DEPTH, -1 if top is None else SPLIT - 1, -1), None, nodes)
    gram = counts[DEPTH][0] if asked is None else asked
    model = Model(nodes, gram, np.zeros(0, np.float32))
    model.values = np.concatenate([np.zeros(0), *[model._path(gram[i : i + 200_000]) for i in range(0, len(gram), 200_000)]]).astype(np.float32)
    return model


def _bucket_grams(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The grams that the blocks sent to a bucket and their training counts."""
    parts, size = [], 0
    for keys, n in zip(bucket["grams"], bucket["counts"]):
        parts.append((np.cumsum(_unpack(keys.as_py(), np.uint64), dtype=np.uint64), _unpack(n.as_py(), np.int64)))
        size += len(parts[-1][0])
        if size > 4_000_000:  # what is held follows the distinct grams, not the blocks
            parts = [_summed(parts)]
            size = 0
    return _summed(parts)


def _learnt(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return _prefixes(keys[n > 0], n[n > 0])


def _bucket_top(bucket: pa.Table) -> pa.Table:
    """Counts of the grams just above SPLIT and, for their nodes, the log
    product over the children that lie in this bucket."""
    counts = _learnt(*_bucket_grams(bucket))
    key, weighted = _grow(counts, range(DEPTH, SPLIT - 1, -1), None, [None] * (DEPTH + 1))
    node, product = _summed([(key & np.uint64((1 << 8 * SPLIT) - 1), weighted)])
    gram, n = counts[SPLIT - 1]
    return pa.table({"product": pa.array([False] * len(gram) + [True] * len(node), pa.bool_()), "key": np.concatenate([gram, node]).astype(np.int64), "value": np.concatenate([n, product]).astype(float)})


def _top(sums: pa.Table) -> Model:
    """The nodes above SPLIT, from what all buckets told."""
    product, key, value = sums["product"].to_numpy(), sums["key"].to_numpy().astype(np.uint64), sums["value"].to_numpy()
    none = np.zeros(0, np.uint64)
    nodes = [(none, np.zeros(0), np.zeros(0)) for _ in range(DEPTH + 1)]
    _grow(_prefixes(key[~product], value[~product], SPLIT - 1), range(SPLIT - 1, -1, -1), (key[product], value[product]), nodes)
    return Model(nodes, none, np.zeros(0, np.float32))


def _bucket_values(top):
    def run(bucket: pa.Table) -> pa.Table:
        keys, n = _bucket_grams(bucket)
        model = build(_learnt(keys, n), Model.unpack(top.value), keys)
        back = [_pack(model.values[np.searchsorted(keys, np.cumsum(_unpack(k.as_py(), np.uint64), dtype=np.uint64))]) for k in bucket["grams"]]
        return pa.table({"block": bucket["block"].cast(pa.int32()), "bucket": bucket["bucket"].cast(pa.int32()), "scores": pa.array(back, pa.binary())})

    return run


# The word base ----------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs without ASCII white space, A-Z folded."""
    return word_numbers(texts, _GAPS)


END_HASH = np.array([xxhash.xxh3_64_intdigest(END_WORD)], np.uint64).view(np.int64)[0]


def _block_asks(buckets: int):
    """A block's distinct words with their training counts, and a row for each
    bucket with the block's grams there and their training counts."""

    def run(block: pa.Table) -> pa.Table:
        which, ends, hashes = _words(block["text"])
        size = np.diff(np.concatenate([[0], ends]))
        learn = block["learn"].to_numpy()
        n = np.bincount(which, np.repeat(learn, size).astype(float), len(hashes)).astype(np.int64)
        seen = np.bincount(which, minlength=len(hashes)) > 0
        h, n = np.append(hashes[seen], END_HASH), np.append(n[seen], int(learn.sum()))
        keys, counts = _distinct(block)
        counts, at = counts.astype(np.int64), _bucket(keys, buckets)
        own = np.unique(at)
        packed = [_pack(np.diff(keys[at == b], prepend=np.uint64(0))) for b in own]
        told = [_pack(counts[at == b]) for b in own]
        none = lambda k: [None] * k
        return pa.table({
            "block": pa.array(np.full(len(h) + len(own), block["block"][0].as_py()), pa.int32()), "word": pa.array([*h.tolist(), *none(len(own))], pa.int64()), "n": pa.array([*n.tolist(), *none(len(own))], pa.int64()),
            "bucket": pa.array([*none(len(h)), *own.tolist()], pa.int32()), "grams": pa.array([*none(len(h)), *packed], pa.binary()), "counts": pa.array([*none(len(h)), *told], pa.binary()),
        })

    return run


def _block_scorer(buckets: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        which, ends, hashes = _words(block["text"])
        vocabulary, values = told.filter(pc.is_null(told["bucket"])), told.filter(pc.is_valid(told["bucket"]))
        word, count = vocabulary["word"].to_numpy(), vocabulary["c"].to_numpy()
        order = np.argsort(word)
        word, count = word[order], count[order]
        at = np.minimum(np.searchsorted(word, hashes), len(word) - 1)
        known = np.where(word[at] == hashes, count[at], 0)
        end = count[np.searchsorted(word, END_HASH)]
        start = np.concatenate([[0], ends[:-1]])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.stack([start, ends])], axis=0)[0]
        logs = total(np.log10(known + 1.0)[which]) + math.log10(end + 1.0)
        keys, _ = _distinct(block)
        where, value = _bucket(keys, buckets), np.zeros(len(keys), np.float32)
        for b, v in zip(values["bucket"].to_pylist(), values["scores"]):
            value[where == b] = _unpack(v.as_py(), np.float32)
        model, scores = Model([], keys, value).index(), []
        for batch in block.select(["block", "text"]).to_batches():
            for part in _slices(batch, 1_000_000):  # bounds what scoring holds
                scores.append(model.scores([t.encode() for t in part.column(1).to_pylist()]))
        return pa.table({
            "block": block["block"].cast(pa.int32()), "doc_id": block["doc_id"].cast(pa.int64()), "n_tokens": pa.array(ends - start + 1, pa.int64()),
            "n_known": pa.array(total((known > 0).astype(np.int64)[which]) + int(end > 0), pa.int64()), "n_bytes": pc.add(pc.binary_length(block["text"]), 1).cast(pa.int64()), "log_counts": pa.array(logs, pa.float64()), "score": pa.array(np.concatenate(scores), pa.float64()),
        })

    return run


def score(docs: DataFrame, learn, block_bytes: int = 8_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score,
    n_bytes (with the end byte), code length per byte in bits, and score (log10 probability of the folded text with its end). ``learn`` is a condition on doc_id for training rows.

    A null text counts as empty: one end token. Without training rows nothing
    is known, and each binary decision has probability one half. Repeated rows
    are learnt and scored each, in one block; a null doc_id is scored like any
    other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(learn(F.col("doc_id")), F.lit(False)))
    blocks = -(-(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1) // block_bytes)
    buckets = -(-blocks // 4)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    asks = stored(dealt.groupBy("block").applyInArrow(_block_asks(buckets), "block int, word long, n long, bucket int, grams binary, counts binary"), "lm-asks")
    asked = asks.where("bucket IS NOT NULL").select("block", "bucket", "grams", "counts").groupBy("bucket")
    sums = asked.applyInArrow(_bucket_top, "product boolean, key long, value double").groupBy("product", "key").agg(F.sum("value").alias("value"))
    top = spark.sparkContext.broadcast(_top(sums.toArrow()).pack())
    values = asked.applyInArrow(_bucket_values(top), "block int, bucket int, scores binary")
    words = asks.where("bucket IS NULL").select("block", "word", "n")
    # A common word has a row in every block: it is summed before it is exchanged, and the join back can be split.
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    train_tokens, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    vocabulary = words.select("block", "word").join(counts, "word")
    told = vocabulary.select("block", "word", "c").unionByName(values, allowMissingColumns=True)
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_block_scorer(buckets), "block int, doc_id long, n_tokens long, n_known long, n_bytes long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(train_tokens + v + 1)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", (-F.col("score") / (F.col("n_bytes") * math.log10(2))).alias("bits_per_byte"))
