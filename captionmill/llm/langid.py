"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else becomes a gap; character 1-, 2-
and 3-grams are hashed into ``BUCKETS`` places. Training counts are summed by
(language, place) in Spark; the matrix of log-probabilities has a fixed
number of rows and a column for each language, and is broadcast. Scoring is
batch-wise in numpy: the rows of the matrix at all n-gram places of a batch
are added up by document.

The learner reads a bounded sample: about ``max_train`` labelled documents,
chosen by a hash of the id, so the choice does not depend on the order or
partitioning of the table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import fold_of, internal, make_room

BUCKETS, MAX_LANGUAGES, UNKNOWN = 1 << 16, 512, "und"  # beyond that many languages training refuses
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram places of all texts, position by position (a row for
    each order), and where each text begins."""
    folded = [" " + _GAP.sub(" ", t.lower()) + " " for t in texts]
    code = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(f) for f in folded], np.int64)
    start = np.cumsum(size) - size
    prime = np.uint32(2654435761)
    h1 = (code + np.uint32(1)) * prime
    h2, h3 = h1.copy(), h1.copy()
    h2[1:] = (h1[:-1] * np.uint32(31) + h1[1:] + np.uint32(7)) * prime
    h3[2:] = (h2[1:-1] * np.uint32(131) + h1[2:] + np.uint32(13)) * prime
    h2[start], h3[start] = h1[start], h1[start]  # no gram runs across two texts
    h3[start + 1] = h2[start + 1]
    return np.stack([h >> np.uint32(16) for h in (h1, h2, h3)]), start


def _counter(batches):
    make_room()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for k, t in zip(langs, texts) if k == lang]
            counts = np.zeros(BUCKETS, np.int64)
            for i in range(0, len(own), 500):
                counts += np.bincount(places(own[i : i + 500])[0].reshape(-1), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "place", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.logp = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language or -1, its posterior) of each text.

        The three orders overlap, so the log-likelihood is divided by three
        before it becomes a posterior. Ties go to the first language in order.
        """
        best, top = np.full(len(texts), -1), np.zeros(len(texts))
        has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not has or not self.langs:
            return best, top
        at, start = places([texts[i] for i in has])
        total = np.zeros((len(has), len(self.langs)))
        for a in range(0, at.shape[1], 1 << 18):
            b = min(a + (1 << 18), at.shape[1])
            one, last = np.searchsorted(start, a, "right") - 1, np.searchsorted(start, b)
            rows = self.logp[at[0, a:b]] + self.logp[at[1, a:b]] + self.logp[at[2, a:b]]
            total[one:last] += np.add.reduceat(rows, np.maximum(start[one:last] - a, 0), axis=0)
        total /= 3
        e = np.exp(total - total.max(1, keepdims=True))
        best[has], top[has] = total.argmax(1), e.max(1) / e.sum(1)
        return best, top


def train(docs: DataFrame, max_train: int = 12_000) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang); rows with a null
    text or lang are left out, repeated rows count each. Without rows the model
    knows no language. Every language of the sample is learnt; more than
    ``MAX_LANGUAGES`` are an error, as the matrix has a column for each."""
    rows = internal(docs, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    n = rows.count()
    if n > max_train:
        share = int(max_train / n * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) < share)
    counted = rows.select("lang", "text").mapInArrow(_counter, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages are more than the broadcast matrix may hold ({MAX_LANGUAGES})")
    counts = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        counts[i, own["place"].to_numpy()] = own["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior) of every row of ``docs``.

    Texts that are null or hold no letter get ``und`` and 0. Whole texts are
    scored; repeated rows are scored each; no other column is read.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make_room()
        own = told.value
        for batch in batches:
            for part in _slices(batch, 2_000_000):
                best, top = own.scores(part.column(1).to_pylist())
                names = pa.array([own.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(top)], names=["doc_id", "lang_pred", "score"])

    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or whose posterior is
    below ``least``; the columns stay as they are. Null texts and texts without
    a letter go; repeated rows are judged each and alike."""
    told, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        make_room()
        for batch in batches:
            for part in _slices(batch, 2_000_000, at):
                best, top = told.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array((best >= 0) & (top >= least)))
        make_room()  # steps in the JVM may follow, during which workers only wait

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, n: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(fold_of(docs["doc_id"], n) != held_out)
