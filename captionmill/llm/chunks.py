"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes of a text sets chunk borders that depend on the
bytes nearby alone, so documents that share a passage share chunks wherever
the passage stands. A chunk is encoded once and its ids are kept by its
128-bit hash. As a border may fall inside a word, each join of two chunks is
repaired: the text from the last whole word of the left chunk to the first
whole word of the right one is encoded anew, and the repair is taken when its
ids agree with those of both chunks at both ends. Where they differ the two
chunks are fused, encoded as one and joined again, at most until the whole
text is one chunk. The result is always that of encoding the whole text.

The chunks' memory belongs to a Python worker and is bounded: a chunk is
encoded once per worker while it stays there. Sharing ids between executors
would shuffle every text for the sake of the shared part; see the README.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.common import held, internal, make_room
from captionmill.llm.encoding import PieceEncoder, piece_encoder


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A random word for each byte, from a hash of it."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def borders(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``. The hash at a byte covers 32 bytes:
    the sum of their random words, each shifted by its distance."""
    if not len(data):
        return []
    h = _gear()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), len(data)]:
        while m - last > most:
            last += most
            while last < len(data) and data[last] & 0xC0 == 0x80:  # not within a character
                last += 1
            out.append(last)
        while m < len(data) and data[m] & 0xC0 == 0x80:
            m += 1
        if m - last >= least or (m == len(data) and m > last):
            out.append(m)
            last = m
    return out


class _Chunk:
    """Head up to the first sure word start, body of whole words, tail."""

    __slots__ = ("body", "first", "head", "ids", "last", "n_first", "n_last", "tail", "thin")

    def __init__(self, data: bytes, opens: bool, closes: bool):
        a = np.frombuffer(data, np.uint8)
        sure = np.flatnonzero(((a[1:] == 32) | (a[1:] == 10)) & (a[:-1] > 32) & (a[:-1] < 127)) + 1
        cut = [*([0] if opens else []), *sure.tolist(), *([len(data)] if closes else [])]
        self.thin = len(cut) < 3
        self.head = self.tail = self.body = self.first = self.last = ""
        self.ids = b""
        self.n_first = self.n_last = 0
        if self.thin:
            self.head = data.decode()
            return
        self.head, self.body, self.tail = data[: cut[0]].decode(), data[cut[0] : cut[-1]].decode(), data[cut[-1] :].decode()
        self.first, self.last = data[cut[0] : cut[1]].decode(), data[cut[-2] : cut[-1]].decode()

    def all_head(self) -> None:
        """Become a chunk without a body of its own."""
        self.thin, self.head, self.tail, self.ids, self.n_first, self.n_last = True, self.head + self.body + self.tail, "", b"", 0, 0


class ChunkEncoder:
    def __init__(self, encoder: PieceEncoder, bits: int = 10, least: int = 256, most: int = 16384, limit: int = 48_000_000):
        self.encoder, self.bits, self.least, self.most, self.limit = encoder, bits, least, most, limit
        self.kept: dict[bytes, _Chunk] = {}
        self.held = 0
        self.new_bytes = self.all_bytes = self.fused = 0

    def _many(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encoder.encode(texts)
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _chunks(self, plans: list[list[tuple[bytes, bool, bool]]]) -> list[list[_Chunk]]:
        keys = [[xxhash.xxh3_128_digest(d) + bytes([o, c]) for d, o, c in p] for p in plans]
        new = {k: _Chunk(*x) for p, ks in zip(plans, keys) for x, k in zip(p, ks) if k not in self.kept}
        made = [c for c in new.values() if not c.thin]
        done = self._many([x for c in made for x in (c.body, c.first, c.last)])
        for c, ids, first, last in zip(made, done[0::3], done[1::3], done[2::3]):
            self.new_bytes += len(c.body)
            c.ids, c.n_first, c.n_last = ids, len(first), len(last)
            if ids[: len(first)] != first or ids[len(ids) - len(last) :] != last:
                c.all_head()  # its words do not stand for themselves: the joins encode it whole
            c.body = ""
        size = sum(len(c.ids) + len(c.head) + 300 for c in new.values())
        out = [[new[k] if k in new else self.kept[k] for k in ks] for ks in keys]
        if self.held + size > self.limit:
            self.kept.clear()
            self.held = 0
        self.kept.update(new)
        self.held += size
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, as the tokenizers library gives them."""
        plans = []
        for t in texts:
            data = t.encode()
            self.all_bytes += len(data)
            ends = borders(np.frombuffer(data, np.uint8), self.bits, self.least, self.most)
            plans.append([(data[a:b], a == 0, b == len(data)) for a, b in zip([0, *ends], ends)])
        out: list[bytes] = [b""] * len(texts)
        open_ = [i for i, p in enumerate(plans) if p]
        while open_:
            chunks = dict(zip(open_, self._chunks([plans[i] for i in open_])))
            spans, windows = {}, []
            for i in open_:
                spans[i] = self._joins(chunks[i], windows)
            repaired = self._many(windows) if windows else []
            again = []
            for i in open_:
                bad = self._splice(chunks[i], spans[i], repaired)
                if isinstance(bad, bytes):
                    out[i] = bad
                else:  # fuse what did not agree
                    self.fused += 1
                    a, b = bad
                    p = plans[i]
                    plans[i] = p[:a] + [(b"".join(x[0] for x in p[a : b + 1]), p[a][1], p[b][2])] + p[b + 1 :]
                    again.append(i)
            open_ = again
        return out

    @staticmethod
    def _joins(chunks: list[_Chunk], windows: list[str]) -> list[tuple[int, int, int]]:
        """(left chunk or -1, right chunk or the count, window) for each stretch between bodies."""
        full = [k for k, c in enumerate(chunks) if not c.thin]
        out = []
        for a, b in zip([-1, *full], [*full, len(chunks)]):
            left, right = chunks[a] if a >= 0 else None, chunks[b] if b < len(chunks) else None
            middle = (left.tail if left else "") + "".join(c.head for c in chunks[a + 1 : b]) + (right.head if right else "")
            if not middle and (left is None or right is None):
                out.append((a, b, -1))
                continue
            windows.append((left.last if left else "") + middle + (right.first if right else ""))
            out.append((a, b, len(windows) - 1))
        return out

    def _splice(self, chunks, joins, repaired):
        parts = []
        for a, b, w in joins:
            left, right = chunks[a] if a >= 0 else None, chunks[b] if b < len(chunks) else None
            if w >= 0:
                ids = repaired[w]
                lo, hi = left.n_last if left else 0, right.n_first if right else 0
                same = len(ids) >= lo + hi and (not left or ids[:lo] == left.ids[len(left.ids) - lo :]) and (not right or ids[len(ids) - hi :] == right.ids[:hi])
                if not same:
                    return max(a, 0), min(b, len(chunks) - 1)
                parts.append(ids[lo : len(ids) - hi])
            if right:
                parts.append(right.ids)
        return b"".join(parts)


@held
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(piece_encoder(path))


ENCODED = "doc_id long, n_tokens long, ids_le binary, ids_sha256 string, decoded string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("ids_le", "decoded")) -> DataFrame:
    """Per document: doc_id, n_tokens, the ids (``ids_le``: little-endian
    unsigned 32-bit), the decoded text, and a sha256 of either. ``outputs``
    names the long columns wanted; the others of the two are null.

    Null and empty texts have no ids and decode to the empty text. Repeated
    rows are encoded each; columns beside doc_id and text are not read. Every
    row stands alone, so the plan has no exchange.
    """

    def run(batches):
        make_room(piece_encoder, chunk_encoder)
        encoder = chunk_encoder(tokenizer_path)
        vocab = encoder.encoder.vocab
        number = [str(i) for i in range(len(vocab.bytes))]
        say, spell = number.__getitem__, vocab.bytes.__getitem__
        for batch in batches:
            for part in _slices(batch, 4_000_000):
                packed = encoder.encode(part.column(1).to_pylist())
                n, wide, shas, texts, text_shas = [], [], [], [], []
                for p in packed:
                    ids = np.frombuffer(p, vocab.dtype)
                    each = ids.tolist()
                    text = b"".join(map(spell, each)).decode("utf-8", "replace")
                    n.append(len(each))
                    wide.append(ids.astype("<u4").tobytes() if "ids_le" in outputs else None)
                    shas.append(hashlib.sha256(",".join(map(say, each)).encode()).hexdigest())
                    texts.append(text if "decoded" in outputs else None)
                    text_shas.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(wide, pa.binary()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(text_shas, pa.string())],
                    names=["doc_id", "n_tokens", "ids_le", "ids_sha256", "decoded", "decoded_sha256"],
                )

    rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ENCODED)


def _slices(batch: pa.RecordBatch, most: int, at: int = 1):
    """Parts of a batch of about ``most`` bytes of text, a row at least; the
    text is column ``at``."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most)))
        yield batch.slice(i, j - i)
        i = j
