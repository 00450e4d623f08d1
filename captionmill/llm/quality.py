"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed features: its words, the pairs of neighbouring words,
and the character n-grams of each word between its borders. A pair of equal words is
one feature whatever the word, as a back reference. Each feature has a learned
vector, a document is the mean of its features' vectors, and a softmax over its
product with an output matrix gives the probability of each label. Vectors and
outputs are trained together by stochastic gradient descent in numpy, with a rate
that falls to nothing.

The learner reads a bounded sample: about ``max_train`` labelled documents with about
``max_chars`` characters, chosen by a hash of the id. Their features are hashed in
Spark tasks, and the driver holds distinct features of the sample alone. The model has
a fixed size (``BUCKETS`` by ``DIM``), is broadcast once and scores whole texts in
slices.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import SPACE, internal, make_room, release, stored
from captionmill.llm.toxicity import _bounded

BUCKETS, DIM, SIZES = 1 << 17, 8, (2, 3, 4)
_SPACE = bytes(32 if chr(c) in SPACE else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x2545F4914F6CDD1D)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def _word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, places of the features of the words one after another,
    how many each word has): the word itself and its n-grams of bytes."""
    framed = b"".join(b"\x02" + w + b"\x03" for w in words)
    code = np.frombuffer(framed, np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(code))  # bytes of the word from here on
    h, grams, owners = np.zeros(len(code), np.uint64), [], []
    for k in range(max(SIZES)):
        h[: len(code) - k] = _mixed(h[: len(code) - k] * np.uint64(257) + code[k:]) if len(code) > k else h[:0]
        if k + 1 in SIZES:
            ok = left > k
            grams.append(h[ok] + np.uint64(k))
            owners.append(owner[ok])
    power = _mixed(np.arange(1, max(size, default=0) + 1, dtype=np.uint64))
    place = np.arange(len(code)) - np.repeat(end - size, size)
    whole = _mixed(np.add.reduceat(_mixed(code * _MIX + power[place]), end - size)) if len(words) else np.zeros(0, np.uint64)
    hashes, owners = np.concatenate([whole, *grams]), np.concatenate([np.arange(len(words)), *owners])
    order = np.argsort(owners, kind="stable")
    return whole, (_mixed(hashes[order]) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owners, minlength=len(words))


@dataclasses.dataclass
class Bag:
    """The words of ``n`` texts: each word's text and number, each distinct word's
    feature places one after another, and the place of each neighbouring pair."""

    n: int
    text: np.ndarray
    word: np.ndarray
    places: np.ndarray
    many: np.ndarray
    pair_text: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Bag:
        plain = pa.concat_arrays([texts.cast(pa.large_string())])
        data = plain.buffers()[2].to_pybytes() if plain.buffers()[2] else b""
        folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(plain), [None, plain.buffers()[1], pa.py_buffer(data.translate(_SPACE))])
        lists = pc.split_pattern(folded, b" ")
        parts = lists.flatten()
        full = pc.greater(pc.binary_length(parts), 0)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
        coded = parts.filter(full).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        whole, places, many = _word_features(coded.dictionary.to_pylist())
        a, b, near = whole[word[:-1]], whole[word[1:]], text[:-1] == text[1:]
        pair = np.where(a == b, _SAME, a + _MIX * _mixed(b))[near]
        return cls(len(texts), text, word, places, many, text[:-1][near], (_mixed(pair) % np.uint64(BUCKETS)).astype(np.int64))

    def totals(self) -> np.ndarray:
        """Features of each text, 1 at least."""
        return np.maximum(np.bincount(self.text, self.many[self.word], self.n) + np.bincount(self.pair_text, minlength=self.n), 1)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, count) of the distinct features of each text."""
        seen, n = np.unique(self.text * max(len(self.many), 1) + self.word, return_counts=True)
        text, word = np.divmod(seen, max(len(self.many), 1))
        size, first = self.many[word], (np.cumsum(self.many) - self.many)[word]
        spread = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        at = np.concatenate([np.repeat(text, size) * BUCKETS + self.places[spread], self.pair_text * BUCKETS + self.pair])
        times = np.concatenate([np.repeat(n, size), np.ones(len(self.pair), np.int64)])
        order = np.argsort(at)
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        text, place = np.divmod(at[order][begins], BUCKETS)
        return text, place, np.add.reduceat(times[order], begins) if len(begins) else times


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their owner (owners in order)."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(begins):
        out[owner[begins]] = np.add.reduceat(rows, begins)
    return out


@dataclasses.dataclass
class Model:
    """``vectors`` by place, ``out`` by dimension and label, ``bias`` by label."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text. A distinct word's vectors are
        added up once, however often it occurs."""
        bag = Bag.of(texts)
        words = _sums(self.vectors[bag.places], np.repeat(np.arange(len(bag.many)), bag.many), len(bag.many))
        hidden = _sums(words[bag.word], bag.text, bag.n) + _sums(self.vectors[bag.pair], bag.pair_text, bag.n)
        return self.probabilities(hidden / bag.totals()[:, None])[:, 1]


def sgd(labels: np.ndarray, size: np.ndarray, place: np.ndarray, weight: np.ndarray, epochs: int = 10, rate: float = 8.0, batch: int = 16, seed: int = 7) -> Model:
    """Train on documents of ``size`` features each, whose weights add up to 1, in
    passes of shuffled batches."""
    rng = np.random.default_rng(seed)
    start, n1 = np.cumsum(size) - size, int(labels.sum())
    prior = np.log([(len(labels) - n1 + 0.5) / (len(labels) + 1), (n1 + 0.5) / (len(labels) + 1)])
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), prior.astype(np.float32))
    steps, done = epochs * -(-len(labels) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            now, done = np.float32(rate * (1 - done / steps)), done + 1
            many = size[own]
            at = np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            text, p, w = np.repeat(np.arange(len(own)), many), place[at], weight[at][:, None]
            hidden = _sums(model.vectors[p] * w, text, len(own))
            error = (np.eye(2, dtype=np.float32)[labels[own]] - model.probabilities(hidden)) / np.float32(len(own))
            back = error @ model.out.T
            model.out += now * (hidden.T @ error)
            model.bias += now * np.float32(0.1) * error.sum(0)
            by_place = np.argsort(p, kind="stable")
            begins = np.flatnonzero(np.diff(p[by_place], prepend=-1))
            if len(begins):
                model.vectors[p[by_place][begins]] += now * np.add.reduceat((back[text] * w)[by_place], begins)
    return model


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])


def _hashed(batches):
    make_room()
    for batch in batches:
        for part in _slices(batch, 1_000_000, 2):
            text, place, n = (bag := Bag.of(part.column(2))).features()
            ends = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            weight = (n / bag.totals()[text]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight))], schema=_SAMPLE)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4_000, max_chars: int = 12_000_000) -> Model:
    """Fit on the documents that ``labels`` (doc_id, quality) marks.

    Documents with a null id, text or label give no example; of several labels for
    one id the least counts, of several texts the least. At most about ``max_train``
    labelled documents with about ``max_chars`` characters are used. With no example of
    one of the labels every score is the smoothed label rate.
    """
    marked = internal(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("label"))
    n = marked.count()
    if n > max_train:
        marked = marked.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 30)) < int(max_train / n * (1 << 30)))
    texts = internal(docs, "doc_id", "text").where("text IS NOT NULL")
    # The chosen ids number about max_train at any input size.
    found = texts.join(F.broadcast(marked), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))
    chosen = stored(found, "quality-examples")
    sample = _bounded(chosen, marked, max_chars)
    rows = sample.select("doc_id", "label", "text").mapInArrow(_hashed, "doc_id long, label int, places array<int>, weights array<float>").toArrow()
    release(chosen)
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")  # one order, however the tasks ended
    y = rows["label"].to_numpy()[order].astype(int)
    if not (0 < y.sum() < len(y)):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.log([1 - rate, rate]).astype(np.float32))
    rows = rows.take(pa.array(order)).combine_chunks()
    size = pc.list_value_length(rows["places"]).to_numpy().astype(int)
    return sgd(y, size, *[pc.list_flatten(rows[c]).to_numpy() for c in ("places", "weights")])


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score (the probability of label 1) and predicted (1 from ``least``
    on) of every row of ``docs``. Whole texts are scored, repeated rows each and
    alike; null and empty texts get what the output's bias alone gives; an empty table
    gives an empty result; other columns are not read."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make_room()
        for batch in batches:
            for part in _slices(batch, 2_000_000):
                p = told.value.scores(part.column(1)).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
