"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor, a chain of its rows. An edit transducer
keeps (K, 0), re-roles to user or assistant (R, 2) or deletes (D, 3) a row and
inserts an empty user or assistant turn (I, 2); blank and duplicate rows can only
be deleted, and a truncated row that stays adds 1. A role-grammar acceptor takes
the initials ``(s?(ua)+)?``. The three are composed lazily, an arc at a time when a
state is first met, and the shortest path is found in topological order. Weights
are pairs (cost, label string), compared in this order, so ties fall to the
ASCII-least string of labels.

The weights of a stretch of rows form a matrix over the grammar's four states, and
matrices multiply associatively: of two equally dear paths over the same rows
neither label string is a prefix of the other, as more labels would be more inserts.
So a conversation of any length is cut at every ``STRETCH`` rows of a global range
order, the stretches are weighed in parallel, and a conversation's few matrices are
multiplied as a sorted stream. Texts are read a second time, sorted by
conversation, to write the repaired turns; a task then holds one conversation's
labels, never its texts.

Nulls: a null role or text is one space. A null conv_id is a conversation, a null
turn comes first and is no turn number. Rows are ordered by turn, then role, then text
(byte order); rows alike in all three are interchangeable. Only the initial of a
role counts for the grammar, and an empty or other initial can't be kept.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from captionmill.llm.common import SPACE, internal, make_room, stored

KEEP, REROLE, DELETE, INSERT, LATE = 0, 2, 3, 2, 1
#: The role grammar: from state by initial to state, and where it may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, STATES, ROLES = (0, 3), range(4), {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
STRETCH = 12  # bits of the row number within a range partition
_ORDER = ("conv_id", "turn", "role", "text")


def _least(ways: list) -> dict:
    """The least weight for each state of (state, cost, labels)."""
    out: dict = {}
    for state, *weight in ways:
        if state not in out or tuple(weight) < out[state]:
            out[state] = tuple(weight)
    return out


@functools.cache
def _inserted(state: int) -> dict:
    """Weights of the states that inserts alone lead to, ``state`` itself first.
    Each insert costs, so no state is worth meeting twice on the way."""
    ways, last = [(state, 0, "")], [(state, 0, "")]
    for _ in STATES[1:]:
        last = [(NEXT[s, r], c + INSERT, w + "I") for s, c, w in last for r in ROLES if (s, r) in NEXT]
        ways += last
    return _least(ways)


@functools.cache
def _row(state: int, initial: str, fault: str) -> dict:
    """Weights of the states behind one row: inserts, then an edit of the row."""
    ways = []
    for s, (c, w) in _inserted(state).items():
        ways.append((s, c + DELETE, w + "D"))
        if fault in (SOUND, TRUNCATED):
            c += LATE * (fault == TRUNCATED)
            ways += [(NEXT[s, r], c + cost, w + label) for label, cost, r in [("K", KEEP, initial), *(("R", REROLE, r) for r in ROLES)] if (s, r) in NEXT]
    return _least(ways)


def stretch(rows: list[tuple[str, str]], entry: int) -> dict:
    """Weights of the states behind ``rows`` (initial, fault) from state ``entry``."""
    now = {entry: (0, "")}
    for row in rows:
        now = _least([(t, c + cost, w + labels) for s, (c, w) in now.items() for t, (cost, labels) in _row(s, *row).items()])
    return now


def ended(now: dict) -> tuple[int, str]:
    """The least weight of an end, inserts behind the last row included."""
    return min((c + cost, w + labels) for s, (c, w) in now.items() for t, (cost, labels) in _inserted(s).items() if t in FINAL)


def _plain(df: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return internal(df, *_ORDER).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damage(df: DataFrame) -> DataFrame:
    """Faults put into the rows by crc32 of ``conv_id:turn`` (nulls: one space)
    modulo 20: 0 drops a row, 1 empties its text, 2 takes out its full stops, question
    and exclamation marks, 3 repeats it, 4 makes its role user. An empty table stays
    empty; columns other than conv_id, turn, role and text go."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _plain(df).withColumn("h", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).where("h <> 0")
    rows = rows.withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role"))).withColumn("text", F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select(*_ORDER, F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _faults(df: DataFrame) -> DataFrame:
    """conv_id, turn, at (a number in row order), initial and fault of every row.

    Range partitions split a large conversation, and rows alike in everything go by
    their place in the scan. The first row of each repeated role and text of a
    conversation is found by a sum with partial results and joined back; a join,
    unlike a window, can split a hot key."""
    core = F.rtrim("text", F.lit(SPACE))
    fault: Column = F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    placed = _plain(df).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*_ORDER, "place").sortWithinPartitions(*_ORDER, "place")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = stored(placed.select("conv_id", "turn", F.monotonically_increasing_id().alias("at"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), key.alias("key")), "turns")
    again = rows.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    return met.select("conv_id", "turn", "at", "initial", F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def _weigher(schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        make_room()
        group = group.sort_by("at")
        convs, ats = group["conv_id"].to_pylist(), group["at"].to_pylist()
        rows = list(zip(group["initial"].to_pylist(), group["fault"].to_pylist()))
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and convs[j] == convs[i] and ats[j] >> STRETCH == ats[i] >> STRETCH:
                j += 1
            seq = [r[0] for r in rows[i:j]]
            ways = [{"entry": p, "exit": q, "cost": c, "labels": w} for p in STATES for q, (c, w) in stretch(rows[i:j], p).items()]
            out.append({"conv_id": convs[i], "at": ats[i], "first": seq[0], "last": seq[-1], "illegal": sum(map(_illegal, seq, seq[1:])), "ways": ways})
            i = j
        return pa.Table.from_pylist(out, schema)

    return run


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _multiplier(schema: pa.Schema):
    """A sorted stream of stretches becomes a row for each conversation."""

    def run(batches):
        make_room()
        conv, now, last, illegal, met = None, None, "", 0, False

        def told():
            cost, labels = ended(now)
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "illegal": illegal, "cost": cost, "audit": labels}], schema)

        done = []
        for batch in batches:
            for x in batch.to_pylist():
                if not met or x["conv_id"] != conv:
                    if met:
                        done.append(told())
                    conv, now, illegal, met = x["conv_id"], {0: (0, "")}, 0, True
                else:
                    illegal += _illegal(last, x["first"])
                now = _least([(w["exit"], now[w["entry"]][0] + w["cost"], now[w["entry"]][1] + w["labels"]) for w in x["ways"] if w["entry"] in now])
                illegal, last = illegal + x["illegal"], x["last"]
            yield from done
            done = []
        if met:
            yield told()

    return run


def inspect(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every
    conversation of ``df`` (conv_id, turn, role, text). An empty table gives an empty
    result; columns of other names are not read; very long texts and very long
    conversations are judged whole."""
    conv = df.schema["conv_id"].dataType
    faults = stored(_faults(df), "turn-faults")
    told = faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == x).alias(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
    )
    way = "array<struct<entry:int,exit:int,cost:long,labels:string>>"
    weighed = T.StructType().add("conv_id", conv).add("at", "long").add("first", "string").add("last", "string").add("illegal", "long").add("ways", T.DataType.fromDDL(way))
    total = T.StructType().add("conv_id", conv).add("illegal", "long").add("cost", "long").add("audit", "string")
    blocks = faults.groupBy(F.shiftright("at", 33).alias("block")).applyInArrow(_weigher(to_arrow_schema(weighed)), weighed)
    audits = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_multiplier(to_arrow_schema(total)), total)
    return one_row_each(told, audits)


def one_row_each(*parts: DataFrame) -> DataFrame:
    """Tables with a row for each conversation side by side, null ids included."""
    all_rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return all_rows.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in all_rows.columns if c != "conv_id"])


def repaired(df: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, edit, role and text of the repaired turns: ``df`` under the
    ``audit`` that ``inspect`` gives its conversations. A conversation's turns
    stand together and in order within one partition."""
    head = audits.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = _plain(df).select("conv_id", F.lit(1).alias("kind"), F.lit("").alias("audit"), "turn", "role", "text")
    schema = audits.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")).schema
    ordered = head.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def run(batches):
        make_room()
        kind: list = []
        yield from _turns(_edited(_lines(batches, kind)), kind)

    return ordered.mapInArrow(run, schema)


def _lines(batches, kind: list):
    """The rows of a stream of batches; ``kind`` gets the type of conv_id."""
    for batch in batches:
        kind[:] = [batch.schema.field(0).type]
        yield from zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)])


def _edited(lines):
    """The turns of sorted lines: a conversation's labels, then its rows."""
    labels, at, state, place, of = "", 0, 0, 0, None
    for conv_id, kind, audit, role, text in itertools.chain(lines, [(None, 0, "", "", "")]):
        while at < len(labels) and labels[at] == "I":
            new = _next_role(state)
            yield of, place, "I", new, ""
            at, state, place = at + 1, NEXT[state, new[0]], place + 1
        if not kind:
            labels, at, state, place, of = audit, 0, 0, 0, conv_id
            continue
        edit, at = labels[at], at + 1
        if edit != "D":
            new = role if edit == "K" else _next_role(state)
            yield of, place, edit, new, text
            state, place = NEXT[state, new[0]], place + 1


def _next_role(state: int) -> str:
    """The one role of those that may be put in which the grammar takes here."""
    return next(name for r, name in ROLES.items() if (state, r) in NEXT)


def _turns(rows, kind: list, most: int = 4_000_000):
    """Batches of the rows, of about ``most`` characters."""
    held: list[tuple] = []
    size = 0
    for row in itertools.chain(rows, [None]):
        if held and (row is None or size > most or len(held) >= 10_000):
            a, b, c, d, e = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a, kind[0]), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string()), pa.array(e, pa.string())], names=["conv_id", "place", "edit", "role", "text"])
            held, size = [], 0
        if row is not None:
            held.append(row)
            size += len(row[4])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the newline-joined ``role:text`` of the turns that
    ``repaired`` gave, read as it gave them. A digest is sequential by nature, so one
    task streams a conversation; it holds one batch."""
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        conv, sha, n = None, None, None
        for batch in batches:
            done: list[tuple] = []
            for conv_id, place, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if place == 0:
                    if sha:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = conv_id, hashlib.sha256()
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            n = batch.schema.field(0).type
            yield _digests(done, n)
        if sha:
            yield _digests([(conv, sha.hexdigest())], n)

    return turns.mapInArrow(run, T.StructType().add("conv_id", kind).add("repaired_sha256", "string"))


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ([],) * 2
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.string())], names=["conv_id", "repaired_sha256"])
