"""Phrase mining, the quality classifier and conversation repair against plain versions."""

import collections
import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("captionmill.llm")

from captionmill.llm import collocations, conversations, quality, queries

DOCS = "doc_id long, text string, lang string, n long, word string, score double"


def docs(spark, rows):
    """doc rows with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, 1, "x", 0.5) for i, t, lang in rows], DOCS)


# Phrases ------------------------------------------------------------------------


def plain_phrases(rows, least=10, top=2000, longest=3):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    around = collections.defaultdict(int)
    for (lang, w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in good.items():
        if (lang, w) in around and 100 * around[lang, w] >= 50 * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, each in out.items() for i, (s, a, p, left, right) in enumerate(sorted(each)[:top], 1)}


def phrase_rows(rng, n=150):
    words = ["the", "The", "new", "york", "city", "Über", "x", "straße", "of", "a", "\x1c", "é"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))
    return [(i, rng.choice([text(), text(), text(), "new york city " * 3, None, ""]), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("chunk", [300, 6_000_000])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = phrase_rows(random.Random(4))
    got = collocations.mine(docs(spark, rows).repartition(5), top=40)
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, top=40)
    longer = collocations.mine(docs(spark, rows), longest=4, top=30)
    assert {tuple(r) for r in longer.collect()} == plain_phrases(rows, top=30, longest=4)


def test_phrases_of_long_texts_repeats_and_nothing(spark):
    long = "deep sea diver " * 30_000
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, None, None)]
    assert {tuple(r) for r in collocations.mine(docs(spark, rows)).collect()} == plain_phrases(rows)
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, [(1, "only once here", "en")])).count() == 0


def test_radix_order_and_keys():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 5, 4000).astype(np.uint64) * np.uint64(1 << 61), rng.integers(0, 9, 4000).astype(np.uint64), rng.integers(0, 1 << 63, 4000).astype(np.uint64)]
    keys = collocations.packed(ids)
    assert all((a == b).all() for a, b in zip(collocations.unpacked(keys), ids))
    order = collocations.radix_order(keys)
    assert [k.tobytes() for k in keys[order]] == sorted(k.tobytes() for k in keys)
    distinct, n = collocations.run_lengths(keys[np.arange(4000) % 7], np.ones(4000, np.int64))
    assert len(distinct) == 7 and n.sum() == 4000


def test_ids_that_two_words_share_lead_to_another_seed(spark, monkeypatch):
    def counter(seed):
        def run(batches):
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([7, 7 + seed]), pa.array(["en", "en"]), pa.array(["a", "b"]), pa.array([1, 1])], names=["id", "lang", "word", "n"])

        return run

    monkeypatch.setattr(collocations, "_word_counter", counter)
    words, seed = collocations.count_words(docs(spark, [(1, "a b", "en")]).select("lang", "text").coalesce(1))
    assert seed == 1 and sorted(r["id"] for r in words.collect()) == [7, 8]


# Quality ------------------------------------------------------------------------


def judged(rng, n):
    words = ["river", "stone", "Garden", "the", "walks", "slowly", "and", "evening"]
    out = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice("abcde") for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        kind = rng.randrange(3)
        text = " ".join(w) if not bad else (" ".join(w).upper() + "!!" if kind == 0 else " | ".join(w) if kind == 1 else " ".join(x for x in w[:6] for _ in range(8)))
        out.append((i, text, int(not bad)))
    return out


def test_quality_classifier_learns_and_is_the_same_in_any_order(spark):
    rows = judged(random.Random(2), 500)
    table = docs(spark, [(i, t, "en") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 4], "doc_id long, quality int, score int")
    model = quality.train(table, labels)
    again = quality.train(table.repartition(7), labels.repartition(3))
    assert (model.vectors == again.vectors).all() and (model.out == again.out).all()
    told = {r["doc_id"]: r["predicted"] for r in quality.score(table, model, least=0.7).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 0]
    assert sum(told[i] == y for i, y in held) >= 0.97 * len(held)


def test_quality_odd_rows(spark):
    rows = judged(random.Random(2), 60)
    long = rows[1][1] * 3000
    table = docs(spark, [(i, t, None) for i, t, _ in rows] + [(900, None, None), (901, "", "en"), (902, " \n\x0b", "en"), (None, "words", "en"), (1, rows[1][1], "en"), (903, long, "en")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")
    got = quality.score(table, quality.train(table, labels)).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (900, 901, 902)}
    assert len(blank) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert quality.score(docs(spark, []), quality.train(table, labels)).count() == 0
    none = quality.train(table, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(table, none).collect()} == {round(float(none.probabilities(np.zeros((1, quality.DIM)))[0, 1]), 6)}


def test_features_by_word_and_one_by_one_agree():
    texts = ["one one two three", "", "a", None, "straße  Über\tx x x"]
    bag = quality.Bag.of(pa.array([t or "" for t in texts], pa.string()))
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32), rng.normal(size=(quality.DIM, 2)).astype(np.float32), np.zeros(2, np.float32))
    text, place, n = bag.features()
    hidden = np.zeros((len(texts), quality.DIM))
    np.add.at(hidden, text, model.vectors[place] * n[:, None])
    want = model.probabilities(hidden / bag.totals()[:, None])[:, 1]
    assert np.allclose(model.scores(pa.array([t or "" for t in texts], pa.string())), want, atol=1e-5)
    assert n.sum() == bag.totals()[[0, 2, 4]].sum()


# Conversations --------------------------------------------------------------------

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_audit(rows):
    """Cheapest edits by uniform-cost search over whole label strings; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "")], set()  # (cost, labels, rows read, roles given)
    while heap:
        cost, labels, i, roles = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, labels
        if (i, roles[-1:]) in seen:  # met before for less, or by lesser labels
            continue
        seen.add((i, roles[-1:]))
        feasible = lambda r: any(GRAMMAR.fullmatch(r + x) for x in ("", "a", "ua"))
        steps = [(2, "I", i, roles + r) for r in "ua"]
        if i < len(rows):
            role, _, fault = rows[i]
            steps.append((3, "D", i + 1, roles))
            if fault in ("", "truncated"):
                late = fault == "truncated"
                steps += [(late, "K", i + 1, roles + (role[:1] or "?")), (2 + late, "R", i + 1, roles + "u"), (2 + late, "R", i + 1, roles + "a")]
        for c, label, j, r in steps:
            if feasible(r):
                heapq.heappush(heap, (cost + c, labels + label, j, r))


def plain_repair(rows):
    """All figures of op13 over (conv_id, turn, role, text) rows."""
    out, by = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        said = lambda x: " " if x is None else str(x)
        h, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = plain_audit([(r, t, f) for (_, r, t), f in zip(own, faults)])
        said, roles, i = [], "", 0
        final = len(audit) - audit.count("D")
        for label in audit:
            place = len(roles)
            want = {"u": "user", "a": "assistant"}["ua"[(place - final % 2) % 2]]
            if label == "I":
                said.append(f"{want}:")
            else:
                _, role, text = own[i]
                i += 1
                if label == "D":
                    continue
                said.append(f"{role if label == 'K' else want}:{text}")
            roles += said[-1][0]
        assert GRAMMAR.fullmatch(roles)
        out[conv] = (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, audit string, cost long, at long"


def chats(rng, n):
    texts = ["Yes.", "No", "Why?", "", " \n", "So it is!", "é…", "Yes.\x0b", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = [(conv, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for conv in range(n) for t in range(rng.randrange(1, 9)) if rng.random() < 0.95]
    return rows + [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(6)] + rows[:20]


def repaired(spark, tmp_path, rows, name="a"):
    spark.createDataFrame([(*r, "x", 9, 1) for r in rows], CONV).write.parquet(os.path.join(tmp_path, name, "conversations.parquet"))
    got = queries.op13_conversation_repair(spark, os.path.join(tmp_path, name)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repair_equals_plain_search(spark, tmp_path):
    rows = chats(random.Random(5), 150)
    assert repaired(spark, tmp_path, rows) == plain_repair(rows)


def test_a_long_conversation_is_cut_and_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "STRETCH", 2)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Turn {t}." if t % 7 else "cut") for t in range(90)] + chats(rng, 20)
    assert repaired(spark, tmp_path, rows) == plain_repair(rows)


def test_stretches_multiply_like_one():
    rng = random.Random(7)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(0, 9))]
        k = rng.randrange(0, len(rows) + 1)
        left = conversations.stretch(rows[:k], 0)
        both = conversations._least([(q, c + c2, w + w2) for p, (c, w) in left.items() for q, (c2, w2) in conversations.stretch(rows[k:], p).items()])
        assert both == conversations.stretch(rows, 0)
        assert conversations.ended(both) == plain_audit([(r, "", f) for r, f in rows])


def test_repair_of_nothing_and_of_very_long_texts(spark, tmp_path):
    assert repaired(spark, tmp_path, [], "none") == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "Gone."), (6, 0, "user", "long text. " * 200_000), (6, 1, "assistant", "Fine.")]
    got = repaired(spark, tmp_path, rows, "long")
    assert got == plain_repair(rows) and got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_turns_are_real_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi.", "", 0, 0), (1, 1, "user", "Hello.", "", 0, 0)], CONV)
    seen = conversations.inspect(df)
    got = [tuple(r) for r in conversations.repaired(df, seen).collect()]
    assert [r["audit"] for r in seen.collect()] == ["IKKI"]
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "K", "user", "Hello."), (1, 3, "I", "assistant", "")]
