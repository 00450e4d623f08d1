"""Benchmark decontamination: one Aho-Corasick automaton over the windows of
all test items, run once over each normalised document.

Text is normalised byte by byte: A-Z become lower case, every other ASCII
byte outside 0-9 and a-z becomes a gap, and words are joined by one space.
A window is ``window`` consecutive words of an item; an item with fewer
words, but not none, is one window. Windows carry a space at either end, so
only whole words match. Matches are mapped back to character offsets of the
original text.

Items are broadcast only behind a check of their size: they are dealt into
blocks of about ``block_chars`` = 500,000 characters. An automaton takes some 340
bytes for each character of its items, so a worker holds about 170 MB. With
several blocks each is scanned for in a pass of its own, one after another, and
the blocks' findings are united by document.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.chunks import _slices
from captionmill.llm.common import held, internal, make_room, stored

_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

FOUND = "doc_id long, row_key long, n_words long, hits array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = words_of(text)
    n = min(window, len(words))
    return {b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)} if n else set()


@held
def _automaton(items: tuple[tuple[str, str], ...], window: int):
    """The automaton, whose values are (words in the window, indices of items)."""
    import ahocorasick

    owners: dict[bytes, set[int]] = {}
    for i, (_, text) in enumerate(items):
        for w in windows_of(text, window):
            owners.setdefault(w, set()).add(i)
    machine = ahocorasick.Automaton()
    for w, own in owners.items():
        machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, sorted(own)))
    if owners:
        machine.make_automaton()
    return machine if owners else None


def _scan(text: str, machine):
    """n_words, hit word ranges, their spans in the text, and item indices."""
    data = text.encode()
    folded = data.translate(_FOLD)
    words = folded.split()
    if machine is None or not words:
        return len(words), [], [], set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a character for each byte
    found = list(machine.iter(line))
    if not found:
        return len(words), [], [], set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    lasts = np.searchsorted(gaps, [e for e, _ in found]) - 1
    items, ranges = set(), []
    for last, (_, (n, own)) in sorted(zip(lasts.tolist(), found), key=lambda x: x[0] - x[1][1][0]):
        items.update(own)
        first = last - n + 1
        if ranges and first <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], last)
        else:
            ranges.append([first, last])
    at = [m.span() for m in _WORD.finditer(folded)]
    place = lambda byte: len(data[:byte].decode())
    return len(words), ranges, [(place(at[a][0]), place(at[b][1])) for a, b in ranges], items


def _scanner(items, window):
    def run(batches):
        make_room(_automaton)
        own = items.value
        machine = _automaton(own, window)
        for batch in batches:
            for part in _slices(batch, 4_000_000, 2):
                out = {k: [] for k in ("n_words", "hits", "spans", "items")}
                for text in part.column(2).to_pylist():
                    n, hits, spans, found = _scan(text, machine)
                    out["n_words"].append(n)
                    out["hits"].append([{"first": a, "last": b} for a, b in hits])
                    out["spans"].append([{"start": a, "end": b} for a, b in spans])
                    out["items"].append(sorted({own[i][0] for i in found}))
                pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out["n_words"], pa.int64()), pa.array(out["hits"], pair("first", "last")), pa.array(out["spans"], pair("start", "end")), pa.array(out["items"], pa.list_(pa.string()))],
                    names=["doc_id", "row_key", "n_words", "hits", "spans", "items"],
                )

    return run


def _item_blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, DataFrame]:
    """The number of blocks, and items by block."""
    items = internal(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-total // block_chars) or 1
    return n, items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))


def _passes(benchmark: DataFrame, block_chars: int):
    """(number of blocks, broadcast of the (id, text) pairs of one block), block
    by block. A block's broadcast goes when the next one is asked for."""
    n, items = _item_blocks(benchmark, block_chars)
    for k in range(n):
        part = items.where(F.col("block") == k).drop("block").toLocalIterator()
        own = benchmark.sparkSession.sparkContext.broadcast(tuple(sorted((r["item_id"], r["text"]) for r in part)))
        yield n, own
        if n > 1:
            own.unpersist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 500_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside any occurring
    window), spans (start, end in characters of the original text) and items
    (ids, as sorted strings, of items with an occurring window).

    Null and empty texts have no words. Items without words or with a null id
    match nothing; repeated items and ids count once. An empty benchmark
    gives no hits. Repeated document rows each give a row.
    """
    text, found = F.coalesce("text", F.lit("")).alias("text"), []
    for n, own in _passes(benchmark, block_chars):
        # Without several blocks no row has to be found again, so no key is made.
        key = F.lit(0) if n == 1 else F.xxhash64("doc_id", "text")
        rows = internal(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), key.cast("long").alias("row_key"), text)
        told = rows.mapInArrow(_scanner(own, window), FOUND)
        found.append(told if n == 1 else stored(told, "items-found"))
    if len(found) == 1:
        n_hit = F.expr("aggregate(hits, 0L, (s, h) -> s + h.last - h.first + 1)")
        return found[0].select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")
    return _united(found)


def _united(found: list[DataFrame]) -> DataFrame:
    """The blocks' findings by row; rows alike in id and text share a key and count."""
    every = functools.reduce(DataFrame.unionByName, [f.withColumn("block", F.lit(k)) for k, f in enumerate(found)])
    by_row = every.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("copies"),
        F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"),
    )
    union = """aggregate(array_sort(hits), named_struct('n', 0L, 'upto', -1L),
        (s, h) -> named_struct('n', s.n + greatest(h.last - greatest(h.first, s.upto + 1) + 1, 0L), 'upto', greatest(s.upto, h.last)), s -> s.n)"""
    one = by_row.select("doc_id", "n_words", F.expr(union).alias("n_hit"), F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), "copies")
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def _dropper(own, window: int, at: int):
    def run(batches):
        make_room(_automaton)
        machine = _automaton(own.value, window)
        for batch in batches:
            for part in _slices(batch, 4_000_000, at):
                keep = [not (t and _scan(t, machine)[1]) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 500_000) -> DataFrame:
    """``docs`` without documents that hold a window of an item. Each block of
    items decides row by row, so no join is needed; rows with a null id are
    scanned as well. Null and empty texts and texts without a word stay, repeated
    rows are judged each and alike. The columns stay as they are."""
    at, schema = docs.columns.index("text"), docs.schema
    for n, own in _passes(benchmark, block_chars):
        docs = docs.mapInArrow(_dropper(own, window, at), schema)
        docs = docs if n == 1 else stored(docs, "items-dropped")
    return docs
