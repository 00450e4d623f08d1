"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The vocabulary is every word of the labelled examples, a sample bounded by
``max_examples`` texts and about ``max_chars`` characters. A word weighs
log(1 + tf) * idf * s: document frequencies are counted over all documents, and
s, between ``FLOOR`` and 1, grows with how far the word's rates in the two
labels lie apart, so that the cosine compares what bears on the label. No word
is left out; words that no example holds have no place in the space.

The examples are kept as inverted lists and laid out in blocks of ``BLOCK``. The
``LONG`` longest lists carry block maxima. A query reads its short lists in
full, adds the maxima of its long lists to an upper bound for each block, reads
the block of the highest bound, and then those whose bound beats its k-th best
cosine so far; the rest is never read. The neighbours are those of a full
comparison. Votes are weighted by distance, shrunk to the label rate and put on
a probability scale by a logistic curve fitted on leave-one-out votes of the
examples.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import internal, make_room, stored, word_numbers
from captionmill.llm.ctw import _pack, _unpack
from captionmill.llm.decontaminate import _FOLD

BLOCK, LONG, FLOOR = 64, 1024, 0.05
WORDS = 64  # for the layout: examples that share their commonest word of these lie together


def counts_of(texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 64-bit hash, count) of the distinct words of each text."""
    which, ends, hashes = word_numbers(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, _FOLD)
    row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    key, n = np.unique(row * max(len(hashes), 1) + which, return_counts=True)
    return key // max(len(hashes), 1), hashes.view(np.uint64)[key % max(len(hashes), 1)], n


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each list, one list after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclasses.dataclass
class Index:
    """Vocabulary with weights, and the examples as rows (of ``size`` entries in
    ``terms`` and ``weights``), sorted so that blocks are alike."""

    words: np.ndarray  # sorted 64-bit hashes
    idf: np.ndarray  # idf * s of each word
    ids: np.ndarray
    labels: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    k: int
    prior: float
    blank: float  # score of texts without a word of the vocabulary
    curve: tuple[float, float] = (1.0, 0.0)

    def __getstate__(self) -> dict:
        """The fields alone, the entries compressed: what a broadcast writes to
        every executor's disk."""
        own = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        return own | {"terms": _pack(np.diff(self.terms.astype(np.int64), prepend=0)), "weights": _pack(self.weights.astype(np.float32))}

    def __setstate__(self, own: dict) -> None:
        self.__dict__.update(own | {"terms": np.cumsum(_unpack(own["terms"], np.int64)), "weights": _unpack(own["weights"], np.float32)})

    def shared(self, spark):
        """One broadcast of this index, made once."""
        if not hasattr(self, "_told"):
            self._told = spark.sparkContext.broadcast(self)
        return self._told

    def lists(self) -> Index:
        """Build the inverted lists, once for each process."""
        if not hasattr(self, "start"):
            n, owner = len(self.ids), np.repeat(np.arange(len(self.ids)), self.size)
            length = np.bincount(self.terms, minlength=len(self.words))
            order = np.argsort(self.terms, kind="stable")
            self.owner, self.weight, self.start, self.length = owner[order].astype(np.int32), self.weights[order], np.cumsum(length) - length, length
            self.long = np.argsort(-length, kind="stable")[: min(LONG, len(length))]
            self.column = np.full(len(self.words), -1)
            self.column[self.long] = np.arange(len(self.long))
            at = self.column[self.terms]
            self.tables = np.zeros((-(-n // BLOCK), BLOCK, len(self.long)), np.float32)
            self.tables[owner[at >= 0] // BLOCK, owner[at >= 0] % BLOCK, at[at >= 0]] = self.weights[at >= 0]
            self.peaks = self.tables.max(1) if n else np.zeros((0, len(self.long)), np.float32)
        return self

    def vectors(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, word number, unit weight) of the known words of each text."""
        row, h, n = counts_of(texts)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        row, at = row[known], at[known]
        w = np.log1p(n[known]) * self.idf[at]
        norm = np.sqrt(np.bincount(row, w * w, len(texts)))
        return row, at, (w / norm[row]).astype(np.float32)

    def neighbours(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, example numbers) of the k nearest of each of ``n`` queries,
        best first, ties by number; places without a positive cosine hold 0 and -1."""
        self.lists()
        most, blocks = len(self.peaks) * BLOCK, len(self.peaks)
        if not blocks:
            return np.zeros((n, k), np.float32), np.full((n, k), -1)
        at = self.column[term]
        dense = np.zeros((n, len(self.long)), np.float32)
        dense[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        short = at < 0
        size = self.length[term[short]]
        place = _spread(self.start[term[short]], size)
        cell = np.repeat(row[short] * most, size) + self.owner[place]
        score = np.bincount(cell, np.repeat(weight[short], size) * self.weight[place], n * most).astype(np.float32).reshape(n, blocks, BLOCK)
        bound = (score.max(2) + dense @ self.peaks.T) * (1 + 1e-5) + 1e-6
        read, best = np.zeros((n, blocks), bool), np.argmax(bound, axis=1)
        read[np.arange(n), best] = True
        self._read(read, dense, score)
        least = np.zeros(n, np.float32) if k > BLOCK else -np.partition(-score[np.arange(n), best], k - 1, axis=1)[:, k - 1]
        more = (bound >= least[:, None]) & (bound > 1e-6) & ~read
        self._read(more, dense, score)
        score[~(read | more)] = 0
        flat = score.reshape(n, most)
        least = -np.partition(-flat, min(k, most) - 1, axis=1)[:, min(k, most) - 1]
        i, j = np.nonzero((flat >= least[:, None]) & (flat > 0))
        order = np.lexsort((j, -flat[i, j], i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, nth = i[nth < k], j[nth < k], nth[nth < k]
        top, who = np.zeros((n, k), np.float32), np.full((n, k), -1)
        top[i, nth], who[i, nth] = flat[i, j], j
        return top, who

    def _read(self, which: np.ndarray, dense: np.ndarray, score: np.ndarray) -> None:
        """Add the long lists to the scores of the blocks that ``which`` marks."""
        for b in np.flatnonzero(which.any(0)).tolist():
            own = np.flatnonzero(which[:, b])
            score[own, b] += dense[own] @ self.tables[b].T

    def votes(self, top: np.ndarray, who: np.ndarray) -> np.ndarray:
        w = np.where(who >= 0, 1 / (0.1 + 1 - np.minimum(top, 1)), 0)
        y = self.labels[who] if len(self.labels) else np.zeros_like(top)
        return ((w * y).sum(1) + self.prior) / (w.sum(1) + 1)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        raw = np.clip(raw, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(raw / (1 - raw)) + self.curve[1])))

    def nearest(self, texts, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``neighbours`` of texts, 256 at a time: what is held at once."""
        row, term, weight = self.vectors(texts)
        cut = np.searchsorted(row, np.arange(0, len(texts) + 256, 256))
        found = [self.neighbours(row[a:b] - i * 256, term[a:b], weight[a:b], min(256, len(texts) - i * 256), k) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if i * 256 < len(texts)]
        return (np.concatenate(x) for x in zip(*found)) if found else (np.zeros((0, k), np.float32), np.zeros((0, k), int))

    def scores(self, texts):
        """(score, cosines, example numbers) of each text."""
        top, who = self.nearest(texts, self.k)
        return np.where(who[:, 0] >= 0, self.probability(self.votes(top, who)), self.blank), top, who

    def left_out(self, texts, ids: np.ndarray) -> np.ndarray:
        """Raw votes for examples, without their own."""
        top, who = self.nearest(texts, self.k + 1)
        own = (who >= 0) & (self.ids[who] == ids[:, None])
        last = ~own.any(1) & (who[:, -1] >= 0)
        own[last, -1] = True  # its own copy is not among the k + 1: k of them vote
        return self.votes(np.where(own, 0, top), np.where(own, -1, who))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge towards (1, 0)."""
    w, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + 1e-2 * (w - [1, 0])
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def weight_of(a: np.ndarray, b: np.ndarray, n1: int, n0: int, df: np.ndarray, n: int) -> np.ndarray:
    """idf * s of words that stand in ``a`` of n1 examples of label 1, in ``b``
    of n0 of label 0 and in ``df`` of n documents. s follows the z-score of the
    smoothed log-ratio of the two rates and is 1 from 4 on."""
    z = (np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return (np.log((n + 1) / (df + 1)) + 1e-3) * np.maximum(FLOOR, np.minimum(np.abs(z) / 4, 1) ** 2)


def layout(size: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_words: int) -> np.ndarray:
    """An order of the examples in which those alike stand together: by the
    heaviest of the ``WORDS`` commonest words, then by the heaviest word."""
    owner, length = np.repeat(np.arange(len(size)), size), np.bincount(terms, minlength=n_words)
    common = np.isin(terms, np.argsort(-length, kind="stable")[:WORDS])
    lead = np.full((2, len(size)), -1)
    for i, part in enumerate((common, np.ones(len(terms), bool))):
        order = np.lexsort((terms[part], weights[part], owner[part]))
        lead[i, owner[part][order]] = terms[part][order]  # the last of each owner stays
    return np.lexsort((np.arange(len(size)), lead[1], lead[0]))


def _labelled_words(batches):
    for batch in batches:
        row, h, _ = counts_of(batch.column(1).cast(pa.large_string()))
        y = batch.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), pa.array(y, pa.int32())], names=["word", "label"])


def _frequencies(words):
    """Documents by place of the vocabulary, once for each task; -1: all documents."""

    def run(batches):
        make_room()
        df, n = np.zeros(len(words.value), np.int64), 0
        for batch in batches:
            for part in _slices(batch, 2_000_000, 0):
                _, h, _ = counts_of(part.column(0).cast(pa.large_string()))
                at = np.minimum(np.searchsorted(words.value, h), len(df) - 1)
                df += np.bincount(at[words.value[at] == h], minlength=len(df))
                n += part.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["place", "n"])

    return run


def _bounded(sample: DataFrame, marked: DataFrame, max_chars: int) -> DataFrame:
    total = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= max_chars:
        return sample
    return sample.where(F.pmod(F.xxhash64(F.lit("chars"), F.col("doc_id")), F.lit(1 << 30)) < int(max_chars / total * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 12_000, max_chars: int = 60_000_000, k: int = 25, statistics: DataFrame | None = None) -> Index:
    """Fit on the documents that ``labels`` (doc_id, toxic) marks.

    Documents with a null id, text or label give no example; of several
    labels for one id the highest counts, of several texts the least. At most
    about ``max_examples`` labelled documents with about ``max_chars``
    characters are used, chosen by a hash of the id. Document frequencies are
    counted over all of ``statistics`` (default: ``docs``). Without usable
    examples every score is the smoothed label rate.
    """
    spark = docs.sparkSession
    marked = internal(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    n = marked.count()
    if n > max_examples:
        share = int(max_examples / n * (1 << 30))
        marked = marked.where(F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 30)) < share)
    texts = internal(docs, "doc_id", "text").where("text IS NOT NULL")
    # The chosen ids number about max_examples at any input size.
    found = texts.join(F.broadcast(marked), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))
    sample = _bounded(stored(found, "toxic-examples"), marked, max_chars)
    n1, n0 = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    prior = (n1 + 0.5) / (n1 + n0 + 1)
    none = np.zeros(0)
    counted = sample.select("label", "text").mapInArrow(_labelled_words, "word long, label int").groupBy("word").agg(F.sum("label").alias("a"), F.count_if(F.col("label") == 0).alias("b")).toArrow()
    if not (n1 and n0 and counted.num_rows):
        return Index(none.astype(np.uint64), none, none.astype(np.int64), none, none.astype(int), none.astype(int), none.astype(np.float32), k, prior, prior)
    words = counted["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, a, b = words[order], counted["a"].to_numpy()[order], counted["b"].to_numpy()[order]
    known = spark.sparkContext.broadcast(words)
    whole = (docs if statistics is None else statistics).select(F.coalesce("text", F.lit("")).alias("text"))
    got = whole.mapInArrow(_frequencies(known), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, times = got["place"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(words))
    df[place[place >= 0]] = times[place >= 0]
    empty = Index(words, weight_of(a, b, n1, n0, df, int(times[place < 0].sum())), none.astype(np.int64), none, none.astype(int), none.astype(int), none.astype(np.float32), k, prior, prior)
    told = spark.sparkContext.broadcast(empty)

    def vectors(batches):
        for batch in batches:
            for part in _slices(batch, 2_000_000, 2):
                row, term, weight = told.value.vectors(part.column(2).cast(pa.large_string()))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight, pa.float32()))], names=["doc_id", "label", "terms", "weights"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, terms array<int>, weights array<float>").orderBy("doc_id").toArrow()
    index = _laid_out(empty, rows)
    known.destroy()
    told.destroy()
    if len(index.ids) > 1 and 0 < index.labels.sum() < len(index.labels):
        index.curve = _calibrated(sample, index)
    return index


def _laid_out(empty: Index, rows: pa.Table) -> Index:
    size = np.array([len(x) for x in rows["terms"]], int)
    terms, weights = (np.concatenate([c.values.to_numpy() if not c.offset else c.flatten().to_numpy() for c in rows[x].chunks] or [np.zeros(0)]) for x in ("terms", "weights"))
    by_term = np.lexsort((terms, np.repeat(np.arange(len(size)), size)))
    terms, weights = terms[by_term].astype(int), weights[by_term].astype(np.float32)
    y, ids, full = rows["label"].to_numpy().astype(float), rows["doc_id"].to_numpy(), size > 0
    order = np.flatnonzero(full)[layout(size[full], terms, weights, len(empty.words))]
    place = _spread((np.cumsum(size) - size)[order], size[order])
    blank = (y[~full].sum() + empty.prior) / ((~full).sum() + 1)
    return dataclasses.replace(empty, ids=ids[order], labels=y[order], size=size[order], terms=terms[place], weights=weights[place], blank=float(blank))


def _calibrated(sample: DataFrame, index: Index) -> tuple[float, float]:
    told = index.shared(sample.sparkSession)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 2_000_000, 2):
                raw = told.value.left_out(part.column(2).cast(pa.large_string()), part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(raw.astype(float))], names=["label", "raw"])

    got = sample.select("doc_id", "label", "text").mapInArrow(run, "label int, raw double").orderBy("raw", "label").toArrow()
    raw = np.clip(got["raw"].to_numpy(), 1e-6, 1 - 1e-6)
    return _logistic(np.log(raw / (1 - raw)), got["label"].to_numpy().astype(float))


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """doc_id, score, predicted and the nearest examples (ids, cosines and
    labels, at most ``evidence``) of every row of ``docs``.

    Whole texts are scored, repeated rows each and alike; ties among the
    nearest go by the order of the examples. Null and empty texts, and texts
    without a word of any example, get the label rate of the examples without
    a word, and no evidence. An empty table gives an empty result.
    """
    told, curve = index.shared(docs.sparkSession), index.curve

    def run(batches):
        make_room()
        own = told.value
        own.curve = curve  # fitted after the index was sent
        for batch in batches:
            for part in _slices(batch, 2_000_000, 1):
                p, top, who = own.scores(part.column(1).cast(pa.large_string()))
                near = [[{"doc_id": int(own.ids[i]), "cosine": float(c), "label": int(own.labels[i])} for c, i in zip(t, w) if i >= 0] for t, w in zip(top[:, :evidence].tolist(), who[:, :evidence].tolist())]
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.astype(float)), pa.array((p >= 0.5).astype(np.int32)), pa.array(near, kind)], names=["doc_id", "score", "predicted", "evidence"])

    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>")
