"""Still images decoded to gray frames, batch by batch: binary PGM, and PNG of 8 bits
a sample without interlacing. What can't be read keeps its row with a status."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionmill.sources.whole_files import pgm_header

#: Fixed values of the PNG format: its signature, and samples by colour type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
OK, UNREADABLE, EMPTY = "ok", "unreadable", "empty"
MOST_PIXELS = 1 << 28


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", content, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a cut or damaged chunk")
        yield kind, body
        at += 12 + size


def _unfiltered(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples from filtered rows, whose first byte names the filter."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + bpp), np.uint8)  # a row and a pixel of zeros in front
    for y, line in enumerate(lines, 1):
        kind, x = line[0], line[1:]
        own, up = out[y, bpp:], out[y - 1]
        if kind == 0:
            own[:] = x
        elif kind == 1:
            own[:] = np.cumsum(x.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            own[:] = x + up[bpp:]
        elif kind in (3, 4):
            row, above, add = out[y], up.tolist(), x.tolist()
            now = [0] * bpp
            for i, v in enumerate(add):
                a, b, c = now[i], above[i + bpp], above[i]
                if kind == 3:
                    guess = a + b >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now.append(v + guess & 255)
            row[:] = now
        else:
            raise ValueError("an unknown filter")
    return out[1:, bpp:]


def _png(content: bytes) -> np.ndarray:
    data, palette, head = [], None, None
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in SAMPLES or not 0 < w * h <= MOST_PIXELS:
        raise ValueError("a form that is not read")
    bpp = SAMPLES[colour]
    raw = zlib.decompressobj().decompress(b"".join(data), h * (w * bpp + 1))
    pixels = _unfiltered(np.frombuffer(raw, np.uint8).reshape(h, w * bpp + 1), bpp).reshape(h, w, bpp)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    return _gray(pixels[:, :, :3]) if pixels.shape[2] >= 3 else pixels[:, :, 0]


def _gray(rgb: np.ndarray) -> np.ndarray:
    """Luma by the usual weights, rounded."""
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def decode(content: bytes) -> np.ndarray | None:
    """The gray pixels of an image, or None."""
    try:
        if content.startswith(SIGNATURE):
            return _png(content)
        size, _, w, h = pgm_header(content)
        return np.frombuffer(content, np.uint8, w * h, size).reshape(h, w)
    except (ValueError, TypeError, IndexError, struct.error, zlib.error):
        return None


def encode_png(gray: np.ndarray) -> bytes:
    """A gray PNG whose rows use all five filters in turn."""
    h, w = gray.shape
    wide = np.pad(gray.astype(int), ((1, 0), (1, 0)))
    lines = []
    for y in range(1, h + 1):
        a, b, c, kind = wide[y, :-1], wide[y - 1, 1:], wide[y - 1, :-1], (y - 1) % 5
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        guess = [np.zeros(w, int), a, b, (a + b) >> 1, np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))][kind]
        lines.append(bytes([kind]) + ((wide[y, 1:] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def decoded(images: DataFrame, observation: Observation | None = None) -> DataFrame:
    """``images`` (with ``content``) with height, width, gray and status instead of
    the content: ``ok``, ``empty`` for no content, ``unreadable`` for what is no whole
    image of a known form. ``observation`` gets the rows by status as they pass."""

    def run(batches):
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n != "content"]
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                content = part["content"].to_pylist()
                got = [decode(c) if c else None for c in content]
                status = [OK if g is not None else UNREADABLE if c else EMPTY for g, c in zip(got, content)]
                size = [pa.array([None if g is None else g.shape[k] for g in got], pa.int32()) for k in (0, 1)]
                gray = pa.array([None if g is None else g.tobytes() for g in got], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in rest], *size, gray, pa.array(status)], names=[*[batch.schema.names[k] for k in rest], "height", "width", "gray", "status"])

    kept = [f for f in images.schema if f.name != "content"]
    out = images.mapInArrow(run, T.StructType(kept).add("height", T.IntegerType()).add("width", T.IntegerType()).add("gray", "binary").add("status", "string"))
    if observation is None:
        return out
    return out.observe(observation, *[F.count_if(F.col("status") == s).alias(s) for s in (OK, UNREADABLE, EMPTY)])


def readable(images: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The decoded images without those that can't be read, which are counted."""
    return decoded(images, observation).where(F.col("status") == OK).drop("status")
