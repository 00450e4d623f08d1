"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in most operators here.
SPACE = " \t\n\x0b\x0c\r"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests on one machine) a temporary
    folder is made and registered as the checkpoint folder, so that both roads
    end in one place. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="captionmill-")
        sc.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage at a place that outlives any executor. The schema
    is handed over, so that an empty table reads back as well.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")  # what the plan has shuffled goes when the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_HELD: list = []


def held(maker):
    """An ``lru_cache`` for something large that a Python worker keeps between
    tasks, which ``make_room`` lets go of."""
    cached = functools.lru_cache(maxsize=1)(maker)
    _HELD.append(cached)
    return cached


def make_room(*keep) -> None:
    """Called as a task begins: what other operators have left in this Python
    worker goes, so that a worker never holds the memories of several. What is
    free goes back to the machine, as the worker's executor and its other
    workers need it."""
    for cached in _HELD:
        if cached not in keep and cached.cache_info().currsize:
            cached.cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def internal(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever else the table carries cannot clash."""
    return docs.select(*[docs[n] for n in names])


def word_numbers(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number of each word, where each text's words end, 64-bit hash of
    each word number) after a byte-wise translation by ``table``, which leaves
    words between blanks. Texts are large strings without nulls."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    plain = pa.concat_arrays([texts.cast(pa.large_string())])  # offsets from 0
    folded = pa.LargeStringArray.from_buffers(len(plain), plain.buffers()[1], pa.py_buffer((plain.buffers()[2].to_pybytes() if plain.buffers()[2] else b"").translate(table)))
    lists = pc.split_pattern(folded, " ")
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = np.array([len(n) > 0 for n in names], bool)[which] if len(which) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    return which[full], ends, np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64).view(np.int64)
