"""Token counts as delta-maintained rollups.

A change feed of inserts, deletes and revised counts becomes signed deltas
that are added up by (source, lang, tokenizer_version) and kept as one small
table for each batch. Totals are the sum over committed batches, so they
follow the corpus without reading it again.

A batch's table lies in a folder of its own name. The batch is committed by a
marker file called after its id, which names that folder and is put in place by
a rename that does not overwrite. A marker names one folder, so a batch counts
once whoever commits it, and a run that dies before leaves nothing that counts.
Compaction writes the sum as one more folder and then a numbered snapshot file
with the ids it folds; the highest snapshot holds, together with the markers it
does not name. Every moment between two steps is thus a whole state. Folders of
folded batches go after the snapshot stands; markers stay, so that replays are
still known.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import held, make_room, remove
from captionmill.llm.encoding import PieceCounter

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


# Small files through Hadoop ----------------------------------------------------


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place whole, or not at all; False if there is one."""
    sc, draft = spark.sparkContext, f"{path}.{uuid.uuid4().hex}.draft"
    fs, at = _fs(spark, draft)
    out = fs.create(at)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = sc._jvm.org.apache.hadoop.fs
    option = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(option, 1)
    options[0] = option.valueOf("NONE")
    try:
        hadoop.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(at, hadoop.Path(path), options)
    except Py4JJavaError:
        fs.delete(at, False)
        if not fs.exists(hadoop.Path(path)):
            raise
        return False
    return _read(spark, path) == text


# The ledger ---------------------------------------------------------------------


def _marker(batch_id: str) -> str:
    """A file name for any batch id: its bytes in hex."""
    return "batch-" + batch_id.encode().hex()


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of ``changes`` (op, source, lang, tokenizer_version, n_tokens,
    prev_n_tokens): insert +1 and +n, delete -1 and -n, revise 0 and n minus
    the earlier count. Unknown or null ops are refused; null counts are 0;
    null keys are a group of their own. Sums are made before the shuffle."""
    op, n, prev = F.col("op"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("prev_n_tokens", F.lit(0))
    refuse = lambda kind: F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast(kind)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(refuse("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - prev).otherwise(refuse("long"))
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens"))


def commit(changes: DataFrame, path: str, batch_id: str) -> bool:
    """Add a batch to the rollup at ``path``; False if it was there already."""
    spark, marker = changes.sparkSession, f"{path}/log/{_marker(batch_id)}"
    if _fs(spark, marker)[0].exists(_fs(spark, marker)[1]):
        return False
    folder = uuid.uuid4().hex
    signed(changes).coalesce(1).write.parquet(f"{path}/data/{folder}")
    if _publish(spark, marker, folder):
        return True
    remove(spark, f"{path}/data/{folder}")
    return False


def _state(spark: SparkSession, path: str) -> tuple[int, list[str], dict[str, str]]:
    """Number of the snapshot that holds (0: none), the folders that count, and
    the folder of each marker that the snapshot does not name."""
    names = _names(spark, f"{path}/log")
    last = max([int(n.split("-")[1]) for n in names if n.startswith("snapshot-") and not n.endswith(".draft")], default=0)
    told = json.loads(_read(spark, f"{path}/log/snapshot-{last}")) if last else {"folder": None, "ids": []}
    own = {n: _read(spark, f"{path}/log/{n}") for n in sorted(set(names) - set(told["ids"])) if n.startswith("batch-") and not n.endswith(".draft")}
    return last, [f for f in (told["folder"], *own.values()) if f], own


def totals(spark: SparkSession, path: str) -> DataFrame:
    """n_docs and n_tokens by source, lang and tokenizer_version over all
    committed batches, without keys that have come back to nothing. A rollup
    without batches is empty."""
    return _summed(spark, path, _state(spark, path)[1])


def _summed(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], DELTA)
    deltas = spark.read.schema(DELTA).parquet(*[f"{path}/data/{f}" for f in folders])
    summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs <> 0 OR n_tokens <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Replace the tables of all committed batches by their sum."""
    last, folders, own = _state(spark, path)
    if not own:
        return
    folder = uuid.uuid4().hex
    _summed(spark, path, folders).coalesce(1).write.parquet(f"{path}/data/{folder}")
    before = json.loads(_read(spark, f"{path}/log/snapshot-{last}"))["ids"] if last else []
    if _publish(spark, f"{path}/log/snapshot-{last + 1}", json.dumps({"folder": folder, "ids": [*before, *own]})):
        for f in folders:
            remove(spark, f"{path}/data/{f}")
    else:  # another compaction was first
        remove(spark, f"{path}/data/{folder}")


# Counting -------------------------------------------------------------------------


@held
def _counter(tokenizers: tuple[tuple[str, str, str | None], ...]) -> PieceCounter:
    return PieceCounter(tokenizers)


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, str | None]]) -> DataFrame:
    """doc_id, source, lang and ``counts``, a map from version to number of
    tokens, of every row of ``docs``. ``tokenizers``: version -> (file, split
    pattern or None), see ``PieceCounter``. Null and empty texts count 0,
    repeated rows each; nulls in the other columns stay. An empty table gives
    no rows."""
    named = tuple((v, *x) for v, x in sorted(tokenizers.items()))

    def run(batches):
        make_room(_counter)
        counter = _counter(named)
        for batch in batches:
            for part in _slices(batch, 4_000_000, 3):
                n = counter.counts(part.column(3).cast(pa.large_string()))
                keys = pa.array([v for v, *_ in named] * part.num_rows, pa.string())
                ends = pa.array(range(0, part.num_rows * len(named) + 1, len(named)), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.MapArray.from_arrays(ends, keys, pa.array(n.T.ravel(), pa.int64()))], names=["doc_id", "source", "lang", "counts"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"], docs["lang"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, counts map<string,long>")
