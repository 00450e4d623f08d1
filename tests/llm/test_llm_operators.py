import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("captionmill.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from captionmill.llm import chunks, components, ctw, decontaminate, hostrules, langid, linededup, neardup, records, rollups, toxicity
from captionmill.llm.common import fold_of, scratch
from captionmill.llm.encoding import PieceEncoder
from captionmill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id long"
WORDS = ["the", "cat", "sat", "on", "a", "mat", "with", "Dog", "and", "häuser", "straße", "run", "blue", "green", "old", "new", "river", "stone"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def table(spark, rows):
    """doc rows with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "x", 7) for i, t, lang, s in rows], SCHEMA)


def odd_rows():
    """Nulls, empty and very long texts, repeated rows."""
    rng = random.Random(3)
    long = "\n".join(prose(rng, 30) for _ in range(400))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "One two", "en", None), (5, long, "de", "b"), (6, long, "de", "b"), (6, long, "de", "b"), (None, prose(rng, 20), "en", "a")]
    return rows + [(10 + i, prose(rng, rng.randrange(5, 60)), "en", "a") for i in range(12)]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ALPHABET = [" ", "\n", "a", "b", "'s", "é", "\t", "\xa0", "中", "<|endoftext|>", "1", ".", "\x00", "  ", "\r\n", "᠎", "\x1c", "\x85", " ", "the ", "word "]


def test_piece_and_chunk_encoding_equal_the_library(tok):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", "x" * 5000, " " * 300]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    pieces = PieceEncoder(tokenizer_path(), limit=500)
    ids, ends = pieces.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    small = chunks.ChunkEncoder(PieceEncoder(tokenizer_path()), bits=3, least=4, most=64, limit=20_000)
    assert [np.frombuffer(p, "<u2").tolist() for i in range(0, len(texts), 100) for p in small.encode(texts[i : i + 100])] == want
    assert [small.encoder.vocab.decode(w) for w in want[:500]] == [tok.decode(w, skip_special_tokens=False) for w in want[:500]]


def test_pieces_that_come_once_do_not_drive_out_the_others(tok):
    class Told(PieceEncoder):
        asked = ""

        def _raw(self, texts):
            self.asked += "".join(texts)
            return super()._raw(texts)

    own = Told(tokenizer_path(), limit=1000)
    often = "".join(f" often{i}x" for i in range(300))
    for k in range(20):
        text = "a" + often + "".join(f" rare{k}y{i}x" for i in range(500))
        assert own.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert own.asked.count(" often7x") <= 2 and len(own.seen) <= 1000


def test_chunks_are_shared_between_documents():
    rng = random.Random(2)
    passage = prose(rng, 3000)
    own = chunks.ChunkEncoder(PieceEncoder(tokenizer_path()))
    own.encode([prose(rng, 200) + " " + passage])
    before = own.new_bytes
    own.encode([prose(rng, 150) + " " + passage])
    assert own.new_bytes - before < 0.3 * len(passage)


def test_encode_documents(spark, tok):
    rows = odd_rows()
    got = chunks.encode_documents(table(spark, rows), tokenizer_path()).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest(), t or "") for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded"]) for r in got) == want
    assert chunks.encode_documents(table(spark, []), tokenizer_path()).count() == 0


def test_crc32c_matches_a_bytewise_version():
    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (records.CRC_POLY if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(4)
    parts = [b"123456789", b"", *(rng.randbytes(rng.randrange(900)) for _ in range(20))]
    assert records.crc32c(parts).tolist() == [plain(p) for p in parts]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283


def test_records_round_trip(spark, tok):
    rows = odd_rows()
    path = scratch(spark, "test-records")
    records.write_records(table(spark, rows), path, tokenizer_path(), 2, block_bytes=500)
    want, start = [], 0
    for i, t in sorted([(i, t or "") for i, t, *_ in rows], key=lambda r: (r[0] is not None, r)):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    mixed = records.read_shuffled(spark, path, 5).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["n_tokens"]) for r in mixed) == sorted((w[0] is not None, w[0], w[2]) for w in want)
    empty = scratch(spark, "test-records")
    records.write_records(table(spark, []), empty, tokenizer_path())
    assert records.read_records(spark, empty).count() == 0


def test_a_damaged_record_is_refused():
    framed = bytearray(b"".join(records._frame([b"0123456789abcdef" + b"\x01\x00"])))
    framed[14] ^= 1
    with pytest.raises(ValueError):
        list(records._parse(bytes(framed)))


def brute_lines(rows, num=4, den=5):
    """Plain version over rows without null or repeated ids."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lines, first = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if word.search(line):
                line = re.sub(r"[\x09\x0B-\x0D]", " ", line)
                lines.append((i, k, line))
                first.setdefault(line, (i, k))
    reps = [(i, k, set(word.findall(x))) for i, k, x in lines if first[x] == (i, k)]
    links = [(a[:2], b[:2]) for a, b in itertools.combinations(reps, 2) if den * len(a[2] & b[2]) >= num * len(a[2] | b[2])]
    near = {b for _, b in links}
    gone = {(i, k) for i, k, x in lines if first[x] != (i, k)} | near
    n = collections.Counter(i for i, _ in near)
    return {i: (n[i], None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t, *_ in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randrange(3, 14)) for _ in range(60)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(0, 8)):
            words = rng.choice(base).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(100))
            own.append(" ".join(words))
        rows.append((i, "\n".join(own), "en", "a"))
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "a b\n\n" + base[0], "en", "a")]
    got = {r["doc_id"]: (r["n_near"], r["text"]) for r in linededup.dedup_lines(table(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got == want
    assert any(n for n, _ in want.values())
    assert linededup.dedup_lines(table(spark, [])).count() == 0


def test_lines_of_texts_that_share_an_id(spark):
    rows = [(1, "a b c d e", "en", "a"), (1, "zz\nb c d e f g\na b c d e", "en", "a"), (2, "zz\nown words", "en", "a"), (2, "zz\nown words", "en", "a"), (3, None, "en", "a"), (3, "", "en", "a")]
    got = sorted((r["doc_id"], r["text"] or "") for r in linededup.dedup_lines(table(spark, rows)).collect())
    assert got[2:] == [(2, "own words"), (2, "own words"), (3, ""), (3, "")]
    # The two texts of document 1 keep one copy of the shared line between them.
    assert sorted(x for _, t in got[:2] for x in t.split("\n") if x) == ["a b c d e", "b c d e f g", "zz"]


def test_a_family_of_near_lines_leaves_its_first(spark):
    """Heads, and lines that differ from their heads but match another line."""
    rng = random.Random(41)
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join([*words[:100 - k], *(f"v{j}" for j in range(k))]) for k in range(0, 40, 4)]
    rows = [(i, t, "en", "a") for i, t in enumerate(rng.sample(chain, len(chain)))]
    rows += [(100 + i, " ".join(rng.sample([*words[:95], f"x{i}"], 96)), "en", "a") for i in range(60)]
    got = {r["doc_id"]: (r["n_near"], r["text"]) for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_short_lines_take_part_in_line_dedup(spark):
    rows = [(1, "Share this\nHome\n\na b c d", "en", "a"), (2, "Home\n\nthis Share\nd c b a\nown", "en", "a"), (3, "a b c\nHome", "en", "a"), (4, "Home", "en", "a")]
    got = {r["doc_id"]: tuple(r)[1:] for r in linededup.dedup_lines(table(spark, rows)).select("doc_id", "n_lines", "n_copies", "n_near", "text").collect()}
    assert got == {1: (3, 0, 0, rows[0][1]), 2: (4, 1, 2, "\nown"), 3: (2, 1, 0, "a b c"), 4: (1, 1, 0, "")}
    assert {r["doc_id"] for r in linededup.without_repeated_lines(table(spark, rows)).collect()} == {1, 2, 3}


def test_prefix_words_of_lines(spark):
    """Keys without nulls, which are sorted as numbers, and the bound on a
    partner's words against the length and place filters it stands for."""
    rows = spark.createDataFrame([(1, 0, "\tb  a\rb\n \nc"), (2, 0, " ".join(f"w{i}" for i in range(90)))], "doc_id long, tag long, text string")
    classes = linededup.line_classes(rows)
    assert not classes.schema["prefix"].dataType.containsNull
    assert sorted((r["doc_id"], r["line"], r["n"], len(r["prefix"])) for r in classes.collect()) == [(1, 0, 2, 1), (1, 2, 1, 1), (2, 0, 90, 19)]
    sizes = spark.createDataFrame([(i, 0, 0, n, 0, 0, list(range(n - -(-n * 4 // 5) + 1))) for i, n in enumerate([*range(1, 24), 80, 81, 100])], "doc_id long, tag long, line int, n int, bits long, more long, prefix array<long>")
    posts = linededup._posts(sizes, 4, 5).select("n", "key", "most").collect()
    for a, b in itertools.product(posts, posts):
        plain = a["n"] * 5 >= b["n"] * 4 and b["n"] * 5 >= a["n"] * 4 and min(a["n"] - a["key"], b["n"] - b["key"]) * 9 >= 4 * (a["n"] + b["n"])
        assert (a["n"] <= b["most"] and b["n"] <= a["most"]) == plain


def test_counts_behind_the_rarity_of_words(spark):
    """Words over all lines and kinds of white space, from texts split once; the
    session's settings are as before."""
    rows = spark.createDataFrame([(1, 0, "a\tb  a\n\n \nc\rb\x0ba"), (2, 0, ""), (3, 0, "c\x0cd")], "doc_id long, tag long, text string")
    counts = linededup._counts(rows)
    assert sorted(r["n"] for r in counts.collect()) == [1, 2, 2, 3]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    before = spark.conf.get(linededup._ROOM, None)
    linededup._rarity(rows)
    assert spark.conf.get(linededup._ROOM, None) == before


def test_line_dedup_odd_rows(spark):
    rows = odd_rows()
    out = linededup.without_repeated_lines(table(spark, rows))
    assert out.columns == table(spark, []).columns
    left = [r["doc_id"] for r in out.collect()]
    assert 5 in left and 2 in left and 3 in left and None in left and 1 in left
    assert 6 not in left  # all its lines stand in document 5


def test_rollups(spark):
    path = scratch(spark, "test-rollup")
    row = "op string, source string, lang string, tokenizer_version string, n_tokens long, prev_n_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), row)
    assert rollups.totals(spark, path).count() == 0
    first = batch(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 7, None))
    assert rollups.commit(first, path, "b/1") and not rollups.commit(first, path, "b/1")
    rollups.commit(batch(("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("delete", None, None, "v1", 7, None)), path, "b/2")
    assert [tuple(r) for r in rollups.totals(spark, path).collect()] == [("a", "en", "v1", 1, 12)]
    rollups.compact(spark, path)
    assert not rollups.commit(first, path, "b/1")
    assert [tuple(r) for r in rollups.totals(spark, path).collect()] == [("a", "en", "v1", 1, 12)]
    with pytest.raises(Exception, match="unknown op"):
        rollups.commit(batch(("upsert", "a", "en", "v1", 1, None)), path, "b/3")
    assert rollups.commit(batch(), path, "b/4")


def test_rollup_races_and_stops(spark, monkeypatch):
    """Two writers of one batch, a writer that stops, and a compaction that
    stops before or after its snapshot: every state gives the same totals."""
    path = scratch(spark, "test-rollup")
    row = "op string, source string, lang string, tokenizer_version string, n_tokens long, prev_n_tokens long"
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], row)
    sums = lambda: [(r["n_docs"], r["n_tokens"]) for r in rollups.totals(spark, path).collect()]
    assert rollups.commit(batch(10), path, "1")
    publish = rollups._publish

    def late(spark, marker, text):
        """Another writer of the same batch is just before this one."""
        assert publish(spark, marker, open_folder)
        return publish(spark, marker, text)

    open_folder = "other"
    rollups.signed(batch(5)).write.parquet(f"{path}/data/other")
    monkeypatch.setattr(rollups, "_publish", late)
    assert not rollups.commit(batch(5), path, "2")
    assert sums() == [(2, 15)]

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(rollups, "_publish", stop)
    for step in (lambda: rollups.commit(batch(7), path, "3"), lambda: rollups.compact(spark, path)):
        with pytest.raises(OSError):
            step()
        assert sums() == [(2, 15)]
    monkeypatch.setattr(rollups, "_publish", publish)
    with monkeypatch.context() as m:  # the snapshot stands, nothing is cleared away
        m.setattr(rollups, "remove", stop)
        with pytest.raises(OSError):
            rollups.compact(spark, path)
    assert sums() == [(2, 15)] and not rollups.commit(batch(5), path, "2")
    assert rollups.commit(batch(7), path, "3")
    rollups.compact(spark, path)
    assert sums() == [(3, 22)] and not rollups.commit(batch(10), path, "1")


def test_op3_counts_tokens_like_the_libraries(spark, tok, tmp_path):
    import base64

    import tiktoken

    from captionmill.llm import queries

    rng = random.Random(51)
    rows = odd_rows() + [(500 + i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))), rng.choice(["en", None]), rng.choice("ab")) for i in range(200)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    each = {i: r["counts"] for i, r in enumerate(rollups.counted(table(spark, rows).coalesce(1), queries.tokenizer_versions()).collect())}
    assert [(c["byte_bpe_50k"], c["byte_bpe_multi_50k"]) for c in each.values()] == [(len(tok.encode(t or "", add_special_tokens=False).ids), len(multi.encode_ordinary(t or ""))) for _, t, *_ in rows]
    n, docs = collections.Counter(), collections.Counter()
    for _, t, lang, source in rows:
        n[source, lang] += len(multi.encode_ordinary(t or ""))
        docs[source, lang] += 1
    got = {(r["source"], r["lang"]): (r["tokenizer_version"], r["n_docs"], r["n_tokens"]) for r in queries.op3_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: ("byte_bpe_multi_50k", docs[k], n[k]) for k in docs}


def test_ctw_model_predicts_a_distribution_and_learns():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)).encode() for _ in range(50)]
    key, n = np.unique(ctw.grams(texts)[0], return_counts=True)
    counts = []
    for d in range(ctw.DEPTH + 1):
        own, back = np.unique(key & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        counts.append((own, np.bincount(back, n)))
    model = ctw.Model.unpack(ctw.build(counts).pack()).index()
    for context in (0, int(key[3]) >> 8, 0x616C70686100):
        every = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert abs((10.0 ** model._path(every)).sum() - 1) < 1e-9
    assert np.allclose(model.log10(key), model._path(key), atol=1e-5)
    seen, odd = model.scores([b"alpha beta gamma", b"zqxj wvk yyqq zz"])
    assert seen > -8 and odd < 4 * seen
    # A root-only sequence is the KT estimate itself, mixed with nothing seen below.
    assert np.allclose(ctw._log_kt(np.array([2.0]), np.array([1.0])), math.log(0.5 * 0.75 * 0.5 / 3))


def test_ctw_base_equals_plain_counts(spark):
    rows = [r for r in odd_rows() if r[0] != 6] + [(99, "Unseen WORDS unseen", "en", "a")]
    got = {r["doc_id"]: r for r in ctw.score(table(spark, rows), lambda i: F.coalesce(i != 99, F.lit(True)), block_bytes=3000).collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None] for i, t, *_ in rows}
    count = collections.Counter(w for i, ws in words.items() if i != 99 for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for i, ws in words.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), rel_tol=1e-9)
        assert got[i]["score"] < 0
    assert ctw.score(table(spark, []), lambda i: i >= 0).count() == 0


def brute_ctw(texts, asked):
    """log10 probabilities by a context tree over plain dictionaries."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t) + b"\xff"
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def decisions(text):
        data = b"\xff" * ctw.DEPTH + fold(text)
        for k in range(ctw.DEPTH, len(data)):
            for i in range(8):
                yield data[k - ctw.DEPTH : k], (1 << i) | (data[k] >> (8 - i)), (data[k] >> (7 - i)) & 1

    for text in texts:
        for context, bits, bit in decisions(text):
            for d in range(ctw.DEPTH + 1):
                counts[context[ctw.DEPTH - d :], bits][bit] += 1
                if d:
                    kids[context[ctw.DEPTH - d + 1 :], bits].add(context[ctw.DEPTH - d :])
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    stop, weighted = {}, {}
    for context, bits in sorted(counts, key=lambda k: -len(k[0])):
        own = log_kt(*counts[context, bits])
        stop[context, bits], weighted[context, bits] = 1.0, own
        if len(context) < ctw.DEPTH:
            both = np.logaddexp(own, sum(weighted[k, bits] for k in kids[context, bits])) - math.log(2)
            stop[context, bits], weighted[context, bits] = math.exp(own - math.log(2) - both), both

    def log10(text):
        out = 0.0
        for context, bits, bit in decisions(text):
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                node = context[ctw.DEPTH - d :], bits
                if node in counts:
                    p = stop[node] * (counts[node][bit] + 0.5) / (sum(counts[node]) + 1) + (1 - stop[node]) * p
            out += math.log10(p)
        return out

    return [log10(t) for t in asked]


def test_ctw_scores_equal_brute_force_over_several_buckets(spark):
    rng = random.Random(21)
    rows = [(i, None if i == 3 else prose(rng, rng.randrange(0, 40)) + rng.choice(["", "é ß", "\n中"]), "en", "a") for i in range(40)]
    want = brute_ctw([(t or "").encode() for i, t, *_ in rows if i % 5], [(t or "").encode() for _, t, *_ in rows])
    got = {r["doc_id"]: r["score"] for r in ctw.score(table(spark, rows), lambda i: i % 5 != 0, block_bytes=800).collect()}
    assert np.allclose([got[i] for i in range(40)], want, rtol=1e-5)
    none = {r["doc_id"]: r["score"] for r in ctw.score(table(spark, rows), lambda i: i < 0).collect()}
    assert all(math.isclose(none[i], -8 * (len((t or "").encode()) + 1) * math.log10(2), rel_tol=1e-5) for i, t, *_ in rows)


def test_ctw_learns_every_gram_of_a_large_text(spark):
    """More distinct grams (about 700,000) than any earlier bound on them."""
    rng = random.Random(22)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=7000)), "en", "a") for i in range(100)]
    key, n = np.unique(ctw.grams([t.encode() for _, t, *_ in rows])[0], return_counts=True)
    assert len(key) > 1 << 19
    counts = []
    for d in range(ctw.DEPTH + 1):
        own, back = np.unique(key & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        counts.append((own, np.bincount(back, n)))
    want = ctw.build(counts).index().scores([t.encode() for _, t, *_ in rows])
    got = {r["doc_id"]: r["score"] for r in ctw.score(table(spark, rows), lambda i: i >= 0, block_bytes=100_000).collect()}
    assert np.allclose([got[i] for i in range(100)], want, rtol=1e-4)


def brute_hits(text, items, window=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        n = min(window, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in own:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(1, 25))) for i in range(8)] + [(8, "The CAT!"), (9, None), (10, ""), (None, "blue"), (8, "The CAT!")]
    rows = []
    for i in range(40):
        t = rng.choice([x for _, x in items if x]).split()
        cut = t[rng.randrange(len(t)) // 2 :]
        rows.append((i, prose(rng, 10) + ", " + " ".join(cut).upper() + "; " + prose(rng, 12), "en", "a"))
    rows += odd_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter((i, *brute_hits(t or "", [x for x in items if x[0] is not None])[:2], tuple(brute_hits(t or "", [x for x in items if x[0] is not None])[2])) for i, t, *_ in rows)
    for block in (10**9, 60):  # one automaton, and several
        got = decontaminate.find_contamination(table(spark, rows), bench, block_chars=block).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert kept.count() == sum(v for k, v in want.items() if not k[2])
    assert decontaminate.find_contamination(table(spark, rows), bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_spans_lie_in_the_original(spark):
    bench = spark.createDataFrame([(1, "straße über Grün")], "item_id long, text string")
    text = "ÄÖ — Straße, über: Grün!"
    (row,) = decontaminate.find_contamination(table(spark, [(1, text, "de", "a")]), bench).collect()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["Straße, über: Grün"]


def test_host_rules_equal_plain_counts(spark):
    rng = random.Random(10)
    rows = odd_rows() + [(200 + i, " ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(40))) + "\n#* <x>\n#* <x>", "en", f"h{i % 4}") for i in range(40)]
    got = hostrules.base_counts(table(spark, rows)).collect()

    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = collections.Counter(grams)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in hostrules.SYMBOLS for c in t), len(lines) - len(set(lines)), len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)})

    want = collections.Counter((i, *plain(t or "")) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert hostrules.apply_rules(table(spark, [])).count() == 0


def test_host_verdicts_shrink(spark):
    good, bad = prose(random.Random(1), 30), "x"
    rows = [(i, bad if i % 10 else good, "en", "junk") for i in range(200)] + [(1000 + i, good, "en", f"h{i % 20}") for i in range(400)] + [(5000, bad, "en", "tiny"), (5001, good, "en", "tiny"), (5002, good, "en", None)]
    kept = {r["doc_id"]: r["kept"] for r in hostrules.apply_rules(table(spark, rows)).collect()}
    assert not any(kept[i] for i in range(200))
    assert all(kept[1000 + i] for i in range(400)) and kept[5001] and kept[5002] and not kept[5000]


def test_language_id(spark):
    rng = random.Random(11)
    voice = {"en": "the and ing tion ou th wh".split(), "de": "sch ung keit ein ch ü ß".split(), "es": "ción que os ar ñ la el".split()}
    make = lambda lang: " ".join("".join(rng.choice(voice[lang]) for _ in range(3)) for _ in range(25))
    rows = [(i, make(lang), lang, "a") for i, lang in enumerate(["en", "de", "es"] * 60)] + [(900, "1234 !!", "en", "a"), (901, None, "en", "a"), (902, make("en"), None, "a"), (903, make("de") * 4000, "de", "a")]
    docs = table(spark, rows)
    model = langid.train(langid.training_rows(docs))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[903]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in langid.keep_known(docs, model).collect()}
    assert not kept & {900, 901} and 902 in kept
    none = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def plain_bayes(train, asked):
    """(language, posterior) by dictionaries, one character after another."""
    prime, full = 2654435761, 1 << 32

    def found(text):
        t = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        ones = [(ord(c) + 1) * prime % full for c in t]
        twos = [ones[0]] + [(a * 31 + b + 7) * prime % full for a, b in zip(ones, ones[1:])]
        threes = [ones[0], twos[1]] + [(a * 131 + b + 13) * prime % full for a, b in zip(twos[1:], ones[2:])]
        return collections.Counter(h >> 16 for hs in (ones, twos, threes) for h in hs)

    counts = collections.defaultdict(collections.Counter)
    for text, lang in train:
        counts[lang].update(found(text))
    out = []
    for text in asked:
        bag = found(text)
        logs = {k: sum(n * math.log((c[g] + 0.5) / (c.total() + 0.5 * langid.BUCKETS)) for g, n in bag.items()) / 3 for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_id_equals_plain_counts(spark):
    rng = random.Random(61)
    rows = [(i, prose(rng, rng.randrange(1, 9)) + rng.choice(["", " schön ß", " çà et là", " 中文"]), rng.choice(["en", "de", "fr"]), "a") for i in range(120)]
    rows += [(5, rows[5][1], "de", "a"), (5, rows[5][1], "de", "a"), (700, None, "en", "a"), (701, "12 !", "en", "a")]
    model = langid.train(table(spark, rows))
    asked = [t for _, t, *_ in rows[:120]]
    want = plain_bayes([(t, lang) for _, t, lang, _ in rows if t], asked)
    best, top = model.scores(asked)
    assert [model.langs[b] for b in best] == [k for k, _ in want]
    assert np.allclose(top, [p for _, p in want], atol=1e-3)
    assert langid.predict(table(spark, []), model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        langid.train(table(spark, [(i, "text", f"l{i}", "a") for i in range(langid.MAX_LANGUAGES + 1)]))


def test_every_query_on_odd_tables(spark, tmp_path):
    from captionmill.llm import queries

    rows = odd_rows() + [(10, "another text under one id", None, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 and None) for i in range(20)] + [(None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 0, "user", "Hello."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries.queries().items():
        got = query(spark, str(tmp_path))
        if name == "op3_token_rollup":
            assert got.agg(F.sum("n_docs")).first()[0] == len(rows)
        elif name == "op13_conversation_repair":
            assert got.count() == 2
        elif name not in ("pipeline", "op11_collocations"):
            assert got.count() == len(rows), name


def test_worker_memories_make_room():
    from captionmill.llm import common
    from captionmill.llm.encoding import piece_encoder

    piece_encoder(tokenizer_path())
    common.make_room(piece_encoder)
    assert piece_encoder.cache_info().currsize == 1
    common.make_room()
    assert piece_encoder.cache_info().currsize == 0


def test_make_room_gives_free_memory_back_to_the_machine():
    from captionmill.llm import common

    def own_mb():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    blocks = [np.ones(100_000, np.uint8) for _ in range(1500)]
    last = blocks.pop()  # what lies above the others in the C heap
    blocks.clear()
    before = own_mb()
    common.make_room()
    assert own_mb() < before - 100 and last.all()


def test_a_chunk_whose_words_disagree_is_repaired(tok):
    """An encoder that sees words in context: no chunk may be trusted, the text still comes out whole."""

    class Odd(PieceEncoder):
        def encode(self, texts, block=0):
            own = [[len(t) % 7, *self.tokenizer.encode(t, add_special_tokens=False).ids] for t in texts]
            return np.array([i for ids in own for i in ids], self.vocab.dtype), np.cumsum([0, *map(len, own)])

    text = prose(random.Random(3), 400)
    (got,) = chunks.ChunkEncoder(Odd(tokenizer_path()), bits=3, least=4, most=64).encode([text])
    assert np.frombuffer(got, "<u2").tolist() == [len(text) % 7, *tok.encode(text, add_special_tokens=False).ids]


def brute_components(rows, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for g in range(25):
        words = prose(rng, rng.randrange(40, 120)).split()
        for _ in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(999)}"
            rows.append((len(rows) + 3, " ".join(own), "en", "a"))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "One TWO", "en", "a"), (903, "one  two", "en", "a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows), percent=85).collect()}
    want = brute_components(rows, 85)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_bands_find_pairs_at_the_threshold():
    assert neardup.bands(85) == 10 and neardup.bands(80) == 14
    rng = np.random.default_rng(14)
    pairs = [rng.integers(0, 1 << 63, 100).astype(np.uint64) for _ in range(4000)]
    missed = lambda m: int((~neardup_met(pairs, m)).sum())
    assert missed(10) > 1 >= missed(neardup.bands(80))


def neardup_met(pairs, m):
    """Whether the first and the last 90 of 100 shingles (Jaccard 0.8) meet in a table."""
    a, b = (neardup.sketches([p[cut] for p in pairs], m, 3) for cut in (slice(0, 90), slice(10, 100)))
    same = a == b
    return same[:, :m].any(1) & same[:, m:].any(1)


def test_near_duplicate_stage_and_odd_rows(spark):
    docs = table(spark, odd_rows())
    out = neardup.without_near_duplicates(docs)
    left = sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is not None, x))
    assert out.columns == docs.columns
    assert left.count(5) == 1 and 6 not in left and {1, 2, 3, 4} <= set(left) and None in left
    assert neardup.without_near_duplicates(table(spark, [])).count() == 0


def test_block_overlaps():
    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.integers(0, 300, 40).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup._overlaps(left, right, columns=32).tolist() == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            for w in rng.sample(["idiot", "moron", "trash"], 2):
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "en", "a"), (901, "", "en", "a")]
    marked = spark.createDataFrame(labels + [(5000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    index = toxicity.fit(table(spark, rows), marked.where(fold_of(F.col("doc_id"), 5) != 0))
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), index).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert got[900]["score"] == got[901]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["evidence"] for i, r in got.items() if i < 600 and i % 5 == 0)
    none = toxicity.fit(table(spark, rows), marked.where("false"))
    assert {round(r["score"], 6) for r in toxicity.score(table(spark, rows), none).collect()} == {0.5}


def plain_toxicity(rows, labels, asked, k=25):
    """Scores by a comparison with all examples, over plain dictionaries."""
    texts = {i: t for i, t, *_ in rows}
    own = sorted(i for i, y in labels.items() if texts.get(i) is not None)
    bags = {i: collections.Counter(decontaminate.words_of(texts[i])) for i in own}
    n1 = sum(labels[i] for i in own)
    n0 = len(own) - n1
    df = collections.Counter(w for t in texts.values() for w in set(decontaminate.words_of(t)))
    weight = {}
    for w in {w for b in bags.values() for w in b}:
        a, b = (sum(labels[i] == y for i in own if w in bags[i]) for y in (1, 0))
        z = (math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        weight[w] = (math.log((len(texts) + 1) / (df[w] + 1)) + 1e-3) * max(0.05, min(abs(z) / 4, 1) ** 2)

    def unit(bag):
        v = {w: math.log1p(n) * weight[w] for w, n in bag.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    units = {i: unit(b) for i, b in bags.items()}
    prior = (n1 + 0.5) / (n1 + n0 + 1)

    def vote(v, without=None):
        near = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), i) for i, u in units.items() if i != without), reverse=True)[:k]
        w = [1 / (1.1 - min(c, 1)) for c, _ in near if c > 0]
        return (sum(x * labels[i] for x, (_, i) in zip(w, near)) + prior) / (sum(w) + 1)

    odds = lambda p: math.log(p / (1 - p))
    slope, offset = toxicity._logistic(np.array([odds(vote(units[i], i)) for i in own]), np.array([float(labels[i]) for i in own]))
    return {i: 1 / (1 + math.exp(-(slope * odds(vote(unit(collections.Counter(decontaminate.words_of(texts[i]))))) + offset))) for i in asked}


def test_toxicity_equals_a_full_comparison(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randrange(5, 60)) + (" vile scum" if i % 7 == 0 else ""), "en", "a") for i in range(260)]
    labels = {i: int(i % 7 == 0) for i in range(200)}
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    index = toxicity.fit(table(spark, rows), marked)
    assert len(index.words) > toxicity.BLOCK and len(index.ids) == 200
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, rows), index).collect()}
    want = plain_toxicity(rows, labels, range(200, 260))
    assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-4)


def test_toxicity_odd_rows(spark):
    """Very long texts, repeated rows and ids with several texts, ties, clashing columns, empty tables."""
    rows = odd_rows() + [(10, "another text of ten", "en", "a")] + [(300 + i, "same words here", "en", "a") for i in range(40)]
    marked = spark.createDataFrame([(i, int(i % 2)) for i in [1, 2, 5, 6, *range(10, 20), *range(300, 330)]] + [(5, 0)], "doc_id long, toxic int")
    index = toxicity.fit(table(spark, rows), marked)
    assert len(set(index.ids.tolist())) == len(index.ids)
    got = toxicity.score(table(spark, rows), index).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 6) for r in got if r["doc_id"] and r["doc_id"] >= 300}) == 1
    assert toxicity.score(table(spark, []), index).count() == 0
    none = toxicity.fit(table(spark, []), marked)
    assert {r["score"] for r in toxicity.score(table(spark, rows), none).collect()} == {0.5}


def test_block_index_equals_a_full_comparison(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG", 12)  # long lists, short lists and blocks that are skipped
    rng = np.random.default_rng(7)
    rows = np.where(rng.random((500, 60)) < 0.15, rng.random((500, 60)), 0).astype(np.float32)
    rows[np.arange(500), np.arange(500) // 20] += 4
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = toxicity.Index(np.arange(60, dtype=np.uint64), np.ones(60), np.arange(500), np.zeros(500), (rows > 0).sum(1), np.nonzero(rows)[1], rows[rows > 0], 10, 0.5, 0.5)
    q = rows[::7]
    reads, read = [], toxicity.Index._read
    monkeypatch.setattr(toxicity.Index, "_read", lambda self, which, *x: reads.append(which.mean()) or read(self, which, *x))
    top, who = index.neighbours(*np.nonzero(q), q[q > 0], len(q), 10)
    assert np.allclose(top, -np.sort(-(q @ rows.T), axis=1)[:, :10], atol=1e-5)
    assert np.allclose(np.take_along_axis(q @ rows.T, who, 1), top, atol=1e-5) and sum(reads) < 0.7


def test_forest_keeps_what_links_join():
    linked = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 1]], bool)
    assert sorted(neardup._forest(linked, np.array([5, 9, 7]), np.array([8, 3, 7]))) == [(5, 3), (8, 3), (9, 3)]


def test_pipeline_equals_a_plain_version(spark, tok, tmp_path):
    """All five stages, over null, empty and repeated rows and clashing columns."""
    import corpus_pipeline

    rng = random.Random(31)
    body, item = prose(rng, 80).split(), prose(rng, 12)
    broken = lambda words, at: "\n".join(" ".join(words[max(k, 0) : k + 10]) for k in range(at, len(words), 10))
    rows = odd_rows() + [(50, broken(body, 0), "en", "a"), (51, broken([*body[:40], "edited", *body[41:]], -5), "en", "a"), (55, "1234 !!", "en", "a")]
    rows += [(52, "Menu\n" + prose(rng, 15), "en", "a"), (53, "Menu\n" + prose(rng, 15), "de", "a"), (54, "Menu", "en", "a"), (56, f"{prose(rng, 9)} {item.upper()} {prose(rng, 9)}", "en", "a"), (None, f"x {item} y", "en", "a")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # Of two languages one has half of the posterior, so a letter is enough to stay.
    known = [r for r in rows if re.search(r"[a-z]", r[1] or "")]
    loose = [(i, t) for i, t, *_ in known if i is None]
    own = {r[0]: r for r in known if r[0] is not None}  # rows alike in id are alike in text here
    texts = {i: t for i, (_, t) in brute_lines(own.values()).items()}
    left = [(i, t) for i, t in texts.items() if t == own[i][1] or t.strip()]
    stay = [(i, t) for i, t in left if brute_components(left, 80)[i][1] == i]
    clean = [(i, t) for i, t in stay + loose if not brute_hits(t, [(1, item)])[1]]
    assert len(known) < len(rows) and 54 not in dict(left) and 51 in dict(left) and 51 not in dict(stay) and len(clean) == len(stay + loose) - 2
    want = collections.Counter((i, hashlib.sha256(",".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in clean)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
