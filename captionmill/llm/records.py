"""Token-ID output: length-delimited binary records with an offset index.

A record is framed as ``length u64 | masked crc of length u32 | payload |
masked crc of payload u32``, all little-endian, the checksums CRC-32C rotated
and shifted by a constant, so that common record readers can open the files.
The payload is ``doc_id i64 | flags u8 | 3 zero bytes | n u32 | n ids`` with
ids 2 bytes wide for vocabularies up to 65,536 and 4 bytes wide otherwise.

Beside each data file lies an index of fixed-width entries (offset, length,
doc_id, n_tokens), by which single records can be fetched in any order.

Rows are range-partitioned by doc_id, so the files in manifest order hold the
documents in ascending order. A task writes to a name of its own attempt and
only attempts whose result reached the manifest count: a lost executor leaves
an orphan file, never a duplicate or a torn record.
"""

from __future__ import annotations

import functools
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import internal, make_room
from captionmill.llm.encoding import piece_encoder

#: Fixed values of the format.
CRC_POLY, MASK_DELTA = 0x82F63B78, 0xA282EAD8
HEAD, HEAD_BYTES, NULL_ID, WIDE = "<qBxxxI", 16, 1, 2
INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4"), ("doc_id", "<i8"), ("null_id", "u1")])
LANE = 256

MANIFEST = "shard int, data string, index string, n_records long, n_tokens long, block_offset array<long>, block_bytes array<long>, block_tokens array<long>"


# CRC-32C over many byte strings at once ------------------------------------


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte table, and for each k the four tables that append 2**k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLY), t >> 1)
    one = lambda c: t[c & 255] ^ (c >> 8)
    basis = one(np.uint32(1) << np.arange(32, dtype=np.uint32))
    steps = []
    for _ in range(40):
        quad = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                quad[byte] ^= np.where(np.arange(256) >> bit & 1, basis[8 * byte + bit], 0).astype(np.uint32)
        steps.append(quad)
        basis = _append(quad, basis)
    return t, steps


def _append(quad: np.ndarray, c: np.ndarray) -> np.ndarray:
    return quad[0][c & 255] ^ quad[1][c >> 8 & 255] ^ quad[2][c >> 16 & 255] ^ quad[3][c >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part. Lanes of 256 bytes run side by side and are then
    folded by the linear maps that append zero bytes."""
    t, steps = _tables()
    size = np.array([len(p) for p in parts], np.int64)
    lanes = -(-size // LANE)
    first = np.cumsum(lanes) - lanes
    rows = np.zeros((int(lanes.sum()), LANE), np.uint8)
    flat = rows.reshape(-1)
    for p, n, at in zip(parts, size.tolist(), ((first + lanes) * LANE).tolist()):
        flat[at - n : at] = np.frombuffer(p, np.uint8)  # zeros in front leave a zero register as it is
    reg = np.zeros(len(rows), np.uint32)
    for col in np.ascontiguousarray(rows.T):
        reg = t[(reg ^ col) & 255] ^ (reg >> 8)
    out, order = np.zeros(len(parts), np.uint32), np.argsort(-lanes, kind="stable")
    for k in range(int(lanes.max(initial=0))):
        order = order[: np.count_nonzero(lanes[order] > k)]
        out[order] = _append(steps[8], out[order]) ^ reg[first[order] + k]
    init = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0)).bit_length()):
        has = size >> k & 1 == 1
        init[has] = _append(steps[k], init[has])
    return out ^ init ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


# Files ----------------------------------------------------------------------

#: Pieces that a worker remembers, and bytes of text that it encodes and frames at a time.
PIECES, SLICE = 350_000, 2_000_000


def _open(path: str):
    """(file system, path in it) by URI, so that any store Arrow knows will do."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + x.tobytes() + p + y.tobytes() for n, x, p, y in zip(lengths, a, payloads, b)]


def _writer(path: str, tokenizer_path: str, end_id: int | None, block_bytes: int):
    def write(batches):
        make_room(piece_encoder)
        encoder = piece_encoder(tokenizer_path, PIECES)
        wide, dtype = encoder.vocab.dtype.itemsize == 4, encoder.vocab.dtype
        tail = b"" if end_id is None else np.asarray([end_id], dtype).tobytes()
        shard, files, index, offset = TaskContext.get().partitionId(), None, [], 0
        blocks = []  # [offset, bytes, tokens]
        for batch in batches:
            for part in _slices(batch, SLICE):
                if files is None:
                    stem = f"{path}/data/part-{shard:05d}-{uuid.uuid4().hex}"
                    where, local = _open(f"{stem}.rec")
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    files = (stem, where, where.open_output_stream(local))
                ids, ends = encoder.encode(part.column(1))
                n = np.diff(ends) + (end_id is not None)
                doc_ids = part.column(0)
                null = np.asarray(doc_ids.is_null())
                doc_ids = np.asarray(doc_ids.fill_null(0))
                payloads = [struct.pack(HEAD, d, NULL_ID * bool(z) | WIDE * wide, k) + ids[a:b].tobytes() + tail for d, z, k, a, b in zip(doc_ids.tolist(), null, n.tolist(), ends[:-1], ends[1:])]
                framed = _frame(payloads)
                size = np.array([len(f) for f in framed], np.int64)
                rows = np.zeros(len(framed), INDEX)
                rows["offset"], rows["length"], rows["n_tokens"], rows["doc_id"], rows["null_id"] = offset + np.cumsum(size) - size, size, n, doc_ids, null
                index.append(rows.tobytes())
                for o, s, k in zip(rows["offset"].tolist(), size.tolist(), n.tolist()):
                    if not blocks or blocks[-1][1] >= block_bytes:
                        blocks.append([o, 0, 0])
                    blocks[-1][1] += s
                    blocks[-1][2] += k
                files[2].write(b"".join(framed))
                offset += int(size.sum())
        if files is None:
            return
        files[2].close()
        where, local = _open(f"{files[0]}.idx")
        with where.open_output_stream(local) as out:
            out.write(b"".join(index))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "data": [f"{files[0]}.rec"], "index": [f"{files[0]}.idx"],
            "n_records": [sum(map(len, index)) // INDEX.itemsize], "n_tokens": [sum(b[2] for b in blocks)],
            "block_offset": [[b[0] for b in blocks]], "block_bytes": [[b[1] for b in blocks]], "block_tokens": [[b[2] for b in blocks]],
        })

    return write


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, block_bytes: int = 4_000_000) -> None:
    """Write every document of ``docs`` (doc_id, text) as records below ``path``.

    Null and empty texts give a record of the end id alone. A null doc_id
    sorts first and is flagged. Repeated ids give a record each, ordered by
    text. An empty table gives an empty manifest.
    """
    rows = internal(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(path, tokenizer_path, end_id, block_bytes), MANIFEST).write.parquet(f"{path}/manifest")


def _parse(buf: bytes):
    """(doc_id or None, ids) of each record of a block, its checksums compared."""
    at, lengths, payloads, said = 0, [], [], []
    while at < len(buf):
        n = struct.unpack_from("<Q", buf, at)[0]
        if at + 16 + n > len(buf):
            raise ValueError("a record is cut short")
        lengths.append(buf[at : at + 8])
        payloads.append(buf[at + 12 : at + 12 + n])
        said.append((buf[at + 8 : at + 12], buf[at + 12 + n : at + 16 + n]))
        at += 16 + n
    for crc, want in ((masked(crc32c(lengths)), b"".join(a for a, _ in said)), (masked(crc32c(payloads)), b"".join(b for _, b in said))):
        if crc.astype("<u4").tobytes() != want:
            raise ValueError("a record's checksum differs")
    for p in payloads:
        doc_id, flags, n = struct.unpack_from(HEAD, p)
        yield None if flags & NULL_ID else doc_id, np.frombuffer(p, "<u4" if flags & WIDE else "<u2", n, HEAD_BYTES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()),
        "n_tokens": pa.array([len(r[2]) for r in rows], pa.int64()), "ids_le": pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
    })


RECORD = "doc_id long, start long, n_tokens long, ids_le binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens and the ids as
    little-endian unsigned 32-bit integers, block by block from the files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row a shard: the running total goes over file sizes, not over documents.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    blocks = shards.select("data", "before", F.explode(F.arrays_zip("block_offset", "block_bytes", F.expr("transform(block_tokens, (x, i) -> aggregate(slice(block_tokens, 1, i), 0L, (s, y) -> s + y))").alias("skip"))).alias("b"))
    blocks = blocks.select("data", F.col("b.block_offset").alias("offset"), F.col("b.block_bytes").alias("bytes"), (F.col("before") + F.col("b.skip")).alias("start"))

    def read(batches):
        make_room()
        for batch in batches:
            for row in batch.to_pylist():
                where, local = _open(row["data"])
                with where.open_input_file(local) as f:
                    buf = f.read_at(row["bytes"], row["offset"])
                start, out = row["start"], []
                for doc_id, ids in _parse(buf):
                    out.append((doc_id, start, ids))
                    start += len(ids)
                if out:
                    yield _batch(out)

    # The rows are tiny, their blocks are not: a fixed number keeps them apart.
    n = shards.agg(F.sum(F.size("block_offset"))).first()[0] or 1
    return blocks.repartition(-(-n // 4), "data", "offset").mapInArrow(read, RECORD)


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order fixed by ``seed``, fetched one by one
    through the index files: shuffle_key, doc_id, n_tokens, ids_le."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("data", "index")

    def entries(batches):
        make_room()
        for batch in batches:
            for row in batch.to_pylist():
                where, local = _open(row["index"])
                with where.open_input_file(local) as f:
                    table = np.frombuffer(f.read(), INDEX)
                yield pa.RecordBatch.from_pydict({"data": [row["data"]] * len(table), "offset": table["offset"].astype(np.int64), "bytes": table["length"].astype(np.int64)})

    def fetch(batches):
        make_room()
        for batch in batches:
            out, opened = [], {}
            for row in batch.to_pylist():
                if row["data"] not in opened:
                    where, local = _open(row["data"])
                    opened[row["data"]] = where.open_input_file(local)
                (doc_id, ids), = _parse(opened[row["data"]].read_at(row["bytes"], row["offset"]))
                out.append((doc_id, row["shuffle_key"], ids))
            for f in opened.values():
                f.close()
            if out:
                yield _batch(out).rename_columns(["doc_id", "shuffle_key", "n_tokens", "ids_le"])

    index = manifest.repartition("data").mapInArrow(entries, "data string, offset long, bytes long")
    mixed = index.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.regexp_extract("data", r"part-(\d+)-", 1), "offset"))
    return mixed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key").mapInArrow(fetch, "doc_id long, shuffle_key long, n_tokens long, ids_le binary")


def as_ids(ids_le: bytes) -> list[int]:
    return np.frombuffer(ids_le, "<u4").tolist()
