import io
import random
import unicodedata
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from captionmill import schema
from captionmill.functions import bidi, lanes, languages, similarity, text
from captionmill.operators import audio, boxes, cleanup, evaluation, frames, manifest, profiles, segments, sinks
from captionmill.sources import media

exact = lambda a, b: F.when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0)


def seg(spark, *rows):
    """(video, seq, start, end, text, source[, confidence])"""
    full = [(v, q, float(s), float(e), t, src, None, rest[0] if rest else None, "en") for v, q, s, e, t, src, *rest in rows]
    return spark.createDataFrame(full, schema.SEGMENT)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_similarity_anchors(spark):
    for a, b, want in [("SUBSCRIBE!", "Subscribe.", 0.900), ("SUBSCRIBE!", "SUBSCRIBE", 0.947), ("Subscribe →", "SUBSCRIBE!", 0.857), ("", "", 1.0)]:
        assert round(lanes.ratios([a], [b])[0], 3) == want
        assert round(one(spark, similarity.ratio_sql(F.lit(a), F.lit(b))), 3) == want
    assert lanes.ratios(["Hello world"], ["Random text"])[0] < 0.9
    long = "Keine Kampfsporttechnik, keine Gewalt, sondern nur ein Wort und hier ist es"
    assert 0.85 <= similarity.weighted(long, "KEINE KAMPFSPORTTECHNIK KEINE") < 0.9
    assert similarity.weighted("I love this city", "Ich mag Berge sehr gern") < 0.85


def test_lcs_equals_a_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert similarity.lcs(a, b) == row[-1]


def test_text_functions(spark):
    assert one(spark, text.canonical_key(F.lit("  Straße "))) == "strasse"
    assert one(spark, text.cue(F.lit(" a \n b\x1c "))) == "a b"
    assert one(spark, text.srt_time(F.lit(3661.0005))) == "01:01:01,000" and one(spark, text.srt_time(F.lit(360000.0015))) == "100:00:00,002"
    assert one(spark, text.minute_second(F.lit(3600.0))) == "60:00" and one(spark, text.minute_second(F.lit(59.9))) == "0:59"
    assert one(spark, text.markdown_escape(F.lit("a\\|`"))) == "a\\\\\\|\\`"
    stems = {"a/b.c.mp4": "b.c", ".hidden": ".hidden", "x/": "x", "a:b?.txt": "a_b_", "": "file", "noext": "noext"}
    assert {p: one(spark, text.local_stem(F.lit(p))) for p in stems} == stems
    assert one(spark, text.retry_delay(F.lit(3), F.lit("soon"))) == 8.0 and one(spark, text.retry_delay(F.lit(99), F.lit(None).cast("string"))) == 60.0
    assert one(spark, text.retry_delay(F.lit(0), F.lit("2.5"))) == 2.5


def test_languages(spark):
    cases = {"English": "en", "de-AT": "de", "klingon": "fr", "yue": "yue", " haitian creole ": "ht", "ZZ": "zz"}
    assert {k: one(spark, languages.speech_language(F.lit(k), F.lit("FR"))) for k in cases} == cases
    assert one(spark, languages.speech_language(F.lit(None).cast("string"))) == "en"
    assert [one(spark, languages.recogniser(F.lit(s), F.lit(d))) for s, d in [("latin", None), ("auto", "ru"), ("auto", ""), ("kn", None), ("ka", None), ("xx", None)]] == ["latin", "eslav", "en", "ka", "ka", "en"]
    row = lambda **k: one(spark, languages.model_parameters(F.lit(k.pop("s")), F.lit(k.pop("lang")), F.lit(k.pop("iso", None)).cast("string"), **{n: F.lit(v) for n, v in k.items()}))
    assert tuple(row(s="v6", lang="latin", iso="de"))[:7] == ("de", "PP-OCRv6", "small", "de", "PP-OCRv6", "small", False)
    assert tuple(row(s="v6", lang="arabic", iso="ar"))[:7] == ("multi", "PP-OCRv4", "mobile", "arabic", "PP-OCRv4", "mobile", True)
    assert tuple(row(s="v6", lang="latin", iso="de", det_lang="multi"))[:2] == ("multi", "PP-OCRv4")
    assert tuple(row(s="classic", lang="th", det_type="server"))[:5] == ("ch", "PP-OCRv4", "server", "th", "PP-OCRv5")
    assert row(s="classic", lang="arabic", rec_version="PP-OCRv6")["error"] and row(s="classic", lang="en", det_type="tiny")["error"]


#: Boxes on screen and in reading order: Hebrew and Latin letters, Western and Arabic digits, marks.
ORDERS = """x y z > x y z | 7 8 > 7 8 | 你 世 7 > 你 世 7 | ב א > א ב | ב 7 א > א 7 ב | x y ב א > א ב x y | ג 8 7 ב > ב 7 8 ג | u v ג x y ב > ב x y ג u v
| : x א > א x : | ב ! x א > א x ! ב | : x 7 א > א x 7 : | x y 7 א > א x y 7 | ٣ x א > א x ٣ | y ٣ x א > א x ٣ y | x א y z > x א y z | x א y 7 > x א y 7
| x ב א y > x א ב y | x 7 א y > x א 7 y | x 8 7 א y > x א 7 8 y | x ב 7 א y > x א 7 ב y | x א ٣ y > x ٣ א y | x א ! ٣ y > x ٣ ! א y | x א 7 y > x א 7 y
| x א y ! > x א y ! | x א y ב z > x א y ב z | x 7 א > א x 7 | x 8 7 א > א x 8 7 | x ב א > א ב x | y א x > y א x"""


def test_reading_orders(spark):
    rows = [tuple(side.split() for side in row.split(" > ")) for row in ORDERS.replace("\n", " ").split(" | ")] + [([], [])]
    assert [bidi.order(a) for a, _ in rows] == [b for _, b in rows]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(bidi.in_reading_order(F.col("a")).alias("o"), "b").collect()
    assert [r["o"] for r in got] == [r["b"] for r in got]


def test_reading_order():
    ar, he = "مرحبا", "שלום"
    assert bidi.order(["Hello", "2024"]) == ["Hello", "2024"]
    assert bidi.order(["Welcome", ar, he, "to"]) == ["Welcome", he, ar, "to"]
    assert bidi.order(["2024", "AI", "Model", ar]) == [ar, "2024", "AI", "Model"]
    assert bidi.order(["Hello", "2024", ar, "today"]) == ["Hello", ar, "2024", "today"]
    assert bidi.order([ar, "١٢", he]) == [he, "١٢", ar]
    assert unicodedata.bidirectional("١") == "AN"


def loop_dedup(rows, threshold, gap, least):
    """The plain sequential definition."""
    out, keys = [r for r in rows if r[5] == "SPEECH"], {}
    for r in rows:
        if r[5] == "ON-SCREEN" and r[4].casefold().strip():
            keys.setdefault(r[4].casefold().strip(), []).append(r)
    for own in keys.values():
        cluster = []
        for r in [*sorted(own, key=lambda r: (r[2], r[1])), None]:
            if r and cluster and similarity.indel(r[4].lower(), cluster[-1][4].lower()) >= threshold and r[2] - cluster[-1][3] <= gap:
                cluster.append(r)
                continue
            if cluster and cluster[-1][3] - cluster[0][2] >= least:
                out.append((*cluster[0][:3], cluster[-1][3], cluster[0][4], "ON-SCREEN"))
            cluster = [r]
    return sorted((r[2], r[3], r[4], r[5]) for r in out)


def test_dedup_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [("v", i, t := rng.randrange(0, 40) / 2, t + rng.choice([0, 0.5, 3]), rng.choice(["Hi", "hi", " HI", "straße", "STRASSE", "  "]), rng.choice(["ON-SCREEN"] * 4 + ["SPEECH", "BOTH"])) for i in range(150)]
    for least in (0.0, 1.0):
        got = segments.dedup(seg(spark, *rows), 0.85, least, 2.0).collect()
        assert sorted((r["start"], r["end"], r["text"], r["source"]) for r in got) == loop_dedup(rows, 0.85, 2.0, least)


def test_dedup_means_known_confidences(spark):
    got = segments.dedup(seg(spark, ("v", 1, 0, 0, "a b", "ON-SCREEN", 0.5), ("v", 2, 1, 1, "a b", "ON-SCREEN", None), ("v", 3, 3, 3, "A B", "ON-SCREEN", 1.0))).collect()
    assert [(r["end"], r["ocr_confidence"], r["text"]) for r in got] == [(3.0, 0.75, "a b")]


def test_recurrence_and_clusters(spark):
    rows = [("v", i, i, i, t, "ON-SCREEN") for i, t in enumerate(["SUBSCRIBE!", "Subscribe.", "SUBSCRIBE"])]
    count = spark.createDataFrame([("v", 3)], "video_id string, frame_count long")
    assert segments.drop_recurring(seg(spark, *rows), count).count() == 0
    assert segments.drop_recurring(seg(spark, *rows), count, least_frames=4).count() == 3
    other = [("v", i, i, i, t, "ON-SCREEN") for i, t in enumerate(["Hello world", "Goodbye sun", "Random text"])]
    assert segments.drop_recurring(seg(spark, *other), count).count() == 3
    keys = lambda names, t: [r["cluster"] for r in segments.cluster_keys(spark.createDataFrame([("v", k, i) for i, k in enumerate(names)], "video_id string, key string, first_seq long"), t).orderBy("cluster").collect()]
    assert keys(["hello world", "hemlo world", "hell world"], 0.7) == [0, 0, 0] and keys(["zeta", "alpha", "mid"], 0.99) == [0, 1, 2] and keys(["a", "b"], 0.0) == [0, 0]


def test_pattern_filter(spark):
    own = profiles.resolve(spark.createDataFrame([("v", "https://www.TikTok.com/x", "auto"), ("w", "clip.mp4", "auto")], "video_id string, source string, requested string"))
    rows = [("v", 1, 0, 0, " @größe ", "ON-SCREEN"), ("v", 2, 0, 0, "12.5K", "ON-SCREEN"), ("v", 3, 0, 0, "@x", "SPEECH"), ("v", 4, 0, 0, "text", "ON-SCREEN"), ("w", 5, 0, 0, "@x", "ON-SCREEN"), ("z", 6, 0, 0, "@x", "ON-SCREEN")]
    assert sorted(r["seq"] for r in segments.drop_patterns(seg(spark, *rows), own).collect()) == [3, 4, 5, 6]


def merged(spark, speech, screen, score=exact):
    got = segments.merge(seg(spark, *speech), seg(spark, *screen), score=score).orderBy("seq").collect()
    return [(r["start"], r["end"], r["text"], r["source"]) for r in got]


def test_merge_cases(spark):
    assert merged(spark, [("v", 0, 0, 5, "hello  world", "SPEECH")], [("v", 0, 5, 5, "hello  world", "ON-SCREEN")]) == [(0, 5, "hello world", "BOTH")]
    assert [r[3] for r in merged(spark, [("v", 0, 0, 10, "X", "SPEECH"), ("v", 1, 1, 9, "X", "SPEECH")], [("v", 0, 2, 8, "X", "ON-SCREEN")])] == ["BOTH", "SPEECH"]
    assert merged(spark, [("v", 0, 0, 10, "X", "SPEECH")], [("v", 0, 3, 4, "x", "ON-SCREEN"), ("v", 1, 0, 1, "x", "ON-SCREEN")])[1] == (3, 4, "x", "ON-SCREEN")
    assert merged(spark, [("v", 0, 9, 9, "b ", "SPEECH"), ("v", 1, 1, 1, "a", "SPEECH")], []) == [(9, 9, "b ", "SPEECH"), (1, 1, "a", "SPEECH")]
    long = "Keine Kampfsporttechnik, keine Gewalt, sondern nur ein Wort und hier ist es"
    assert [r[3] for r in merged(spark, [("v", 0, 0, 5, long, "SPEECH")], [("v", 0, 1, 3, "KEINE KAMPFSPORTTECHNIK KEINE", "ON-SCREEN")], similarity.wratio)] == ["BOTH"]


def test_merge_equals_a_loop_under_contention(spark):
    rng = random.Random(5)
    make = lambda n, src: [("v", i, s := rng.randrange(200), s + rng.randrange(90), rng.choice("ABC"), src) for i in range(n)]
    speech, screen = make(40, "SPEECH"), make(40, "ON-SCREEN")
    taken, want = set(), []
    for s in speech:
        fit = sorted((o[2], o[1]) for o in screen if o[1] not in taken and s[2] <= o[3] and o[2] <= s[3] and s[4] == o[4])
        if fit:
            taken.add(fit[0][1])
            o = screen[fit[0][1]]
            want.append((min(s[2], o[2]), max(s[3], o[3]), "BOTH"))
        else:
            want.append((s[2], s[3], "SPEECH"))
    want += [(o[2], o[3], "ON-SCREEN") for o in screen if o[1] not in taken]
    got = [(r[0], r[1], r[3]) for r in merged(spark, speech, screen)]
    assert sorted(got) == sorted(want) and [g[0] for g in got] == sorted(g[0] for g in got)


def test_merge_compares_texts_not_rows(spark):
    rng, asked = random.Random(6), spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:  # A-B and A-C are ties, B-C is worse, D is alone
        asked.add(len(a))
        return pd.Series([1.0 if x == y else 0.0 if "D" in x + y else 0.95 if "A" in x + y else 0.9 for x, y in zip(a, b)])

    make = lambda src, own: [("v", i, s := rng.randrange(40), s + rng.randrange(6), rng.choice(own), src) for i in range(300)]
    speech, screen = make("SPEECH", "ABCD"), make("ON-SCREEN", "ABCA")
    score = lambda x, y: 1.0 if x == y else 0.0 if "D" in x + y else 0.95 if "A" in x + y else 0.9
    taken, want = set(), []
    for s in speech:
        fit = sorted((-score(s[4], o[4]), o[2], o[1]) for o in screen if o[1] not in taken and s[2] <= o[3] and o[2] <= s[3] and score(s[4], o[4]) >= 0.85)
        if fit:
            taken.add(fit[0][2])
            want.append((s[1], fit[0][2]))
    got = segments.merge(seg(spark, *speech), seg(spark, *screen), score=alike)
    assert asked.value <= 24  # 12 pairs of texts, similar ones again behind the filter; over 10,000 pairs of rows overlap
    spans = [(min(speech[s][2], screen[o][2]), max(speech[s][3], screen[o][3])) for s, o in want]
    assert sorted((r["start"], r["end"]) for r in got.where("source = 'BOTH'").collect()) == sorted(spans)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def lines_of(spark, *rows):
    data = [("v", 0.0, i, [tuple(map(float, p)) for p in b], t, s) for i, (b, t, s) in enumerate(rows)]
    return [r["text"] for r in boxes.aggregate_boxes(spark.createDataFrame(data, schema.BOX)).orderBy("line", "chunk").collect()]


def test_boxes(spark):
    assert lines_of(spark, (box(60, 0, 100, 10), "b", 0.9), (box(0, 1, 50, 11), "a", 0.6), (box(0, 40, 50, 50), "c", 0.9), (box(0, 40, 50, 50), "low", 0.59)) == ["a b", "c"]
    assert lines_of(spark, (box(0, 0, 10, 10), "a", 1.0), (box(30, 0, 40, 10), "b", 1.0), (box(60.5, 0, 70, 10), "c", 1.0)) == ["a b", "c"]  # a gap of two heights stays, more does not
    assert lines_of(spark, (box(0, 0, 10, 10), "x", 1.0), (box(2, 2, 8, 8), "x", 1.0), (box(10, 0, 20, 10), "x", 1.0)) == ["x x"]
    assert lines_of(spark, (box(0, 0, 10, 10), "a", 1.0), (box(20, 5, 30, 15), "b", 1.0)) == ["a b"]  # half a height is within reach


def test_frames(spark):
    grey = lambda v: np.full((2, 2), v, np.uint8).tobytes()
    values = [0, 0, 200, 200, 201] + [201] * 12 + [202]
    data = spark.createDataFrame([("v", i, 1.0, 2, 2, grey(v)) for i, v in enumerate(values)], schema.FRAME)
    assert sorted(r["frame_idx"] for r in frames.scene_changes(data).collect()) == [0, 2, 12, 17]
    assert frames.max_gap(1.0) == 10 and frames.max_gap(0.01) == 1
    assert [r["frame_idx"] for r in frames.stride(data.withColumn("native_fps", F.lit(2.5))).orderBy("frame_idx").collect()][:3] == [0, 2, 4]
    a = np.zeros((32, 32), np.uint8)
    b = a.copy()
    b[:2, :2] = 255
    assert frames.difference(a, b) == 1.0 and frames.difference(a, a) == 0.0
    zones = spark.createDataFrame([("v", [(0.5, 0.0, 0.5, 0.4)])], "video_id string, zones array<struct<x:double,y:double,w:double,h:double>>")
    row = frames.mask_zones(data.where("frame_idx = 2"), zones).first()
    assert np.frombuffer(row["gray"], np.uint8).tolist() == [200, 0, 200, 200]
    assert frames.downscale(np.zeros((640, 480), np.uint8)).shape == (320, 240)
    flat = frames.equalize(np.arange(4096, dtype=np.uint32).reshape(64, 64).astype(np.uint8))
    assert flat.shape == (64, 64) and flat.dtype == np.uint8


def wav(samples, rate=1000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_wav_split(spark):
    x = np.full(9000, 1000, np.int16)
    x[2500:2700] = 0
    data = spark.createDataFrame([("a.wav", wav(x)), ("b.wav", wav(x[:100])), ("c.wav", wav([]))], "path string, content binary")
    rows = audio.split_wavs(data, max_bytes=44 + 2 * 4000).orderBy("path", "chunk_no").collect()
    assert [r["path"] for r in rows] == ["a.wav"] * 3 + ["b.wav"]
    assert rows[1]["start_s"] == 2.65  # the middle of the last quiet window
    joined = np.concatenate([np.frombuffer(r["content"][44:], "<i2") for r in rows[:3]])
    assert joined.tolist() == x.tolist() and all(len(r["content"]) <= 44 + 8000 for r in rows)
    with pytest.raises(ValueError):
        audio.cuts(np.zeros((9000, 1), np.int16), 1000, 100)


def expected(spark, *rows):
    return spark.createDataFrame([("v", i, t, s, e, req, app) for i, (t, s, e, req, app) in enumerate(rows)], schema.EXPECTED)


def test_scores(spark):
    ratio = similarity.ratio
    heard = seg(spark, ("v", 0, 0, 0, "big red", "ON-SCREEN"), ("v", 1, 1, 1, "house here", "ON-SCREEN"), ("v", 2, 9, 9, "noise zzz", "ON-SCREEN"), ("v", 3, 1.5, 1.5, "today", "ON-SCREEN"))
    gt = expected(spark, ("house here big red", None, None, True, None), ("absent words", 50.0, None, True, None), ("big red house here today", None, None, False, None))
    rows = {r["gt_seq"]: r for r in evaluation.per_text(heard, gt, ratio=ratio).collect()}
    assert rows[0]["matched"] and rows[0]["used"] == [0, 1] and rows[0]["best_candidate"] == "house here big red"
    assert rows[1]["similarity"] == 0.0 and not rows[1]["near_miss"]
    assert rows[2]["similarity"] > 0.85
    row = evaluation.score(heard, gt, ratio=ratio).first()
    assert row["recall"] == 0.5 and row["precision"] >= 0.5 and row["mean_match_similarity"] == 1.0
    far = seg(spark, ("v", 0, 0, 0, "big red", "ON-SCREEN"), ("v", 1, 2.5, 2.5, "house here", "ON-SCREEN"))
    assert not evaluation.per_text(far, gt.where("gt_seq = 0"), ratio=ratio).first()["matched"]  # further apart than two seconds


def test_noise_and_appearances(spark):
    heard = seg(spark, ("v", 0, 0, 1, "logo", "ON-SCREEN"), ("v", 1, 5, 7, "junk", "ON-SCREEN"), ("v", 2, 5, 6, "junk", "BOTH"), ("v", 3, 5, 6, "junk", "SPEECH"))
    gt = expected(spark, ("LOGO", None, None, True, [(0.0, 1.0), (9.0, 9.5)]), ("other", None, None, False, None))
    row = evaluation.noise(heard, gt).first()
    assert (row["total_segments"], row["junk_count"], row["unmatched_count"], row["retained_overlay_recall"]) == (3, 1, 2, 0.5)


def test_spatial_and_verdict(spark):
    g = spark.createDataFrame([("v", 1, "k", "K", 0.1, 0.0, 0.0, False), ("v", 2, "k", "k", 0.3, 0.6, 0.8, True), ("v", 3, "z", "z", 0.2, 0.5, 0.5, False)], "video_id string, seq long, key string, text string, normalized_height double, x_center_norm double, y_center_norm double, matched boolean")
    rows = {r["canonical_text"]: r for r in evaluation.spatial(g, g.select("video_id", "key").distinct().withColumn("cluster", F.col("key"))).collect()}
    assert rows["K"]["position_stability"] == pytest.approx(0.5) and rows["K"]["matched"] and rows["z"]["position_stability"] is None
    record = "clip string, language string, ocr_model_set string, expected long, matched long, segments long, unmatched long, raw_recall double"
    make = lambda *rows: evaluation.summarize(spark.createDataFrame([(c, lang, m, e, k, 10, u, 1.0) for c, lang, m, e, k, u in rows], record))
    reasons = lambda s: sorted((r["scope"], r["reason"]) for r in evaluation.verdict(s, "a", "b", languages=("en", "de")).collect())
    assert reasons(make(("c", "en", "a", 50, 50, 1), ("c", "en", "b", 50, 50, 1))) == [("de", "no results")]
    assert reasons(make(("c", "en", "a", 50, 50, 1), ("d", "en", "b", 50, 50, 1), ("c", "de", "a", 0, 0, 1), ("c", "de", "b", 0, 0, 2))) == [("de", "unmatched_rate"), ("en", "clip sets differ")]
    assert reasons(make(("c", "en", "a", 50, 50, 1), ("c", "en", "b", 50, 48, 1), ("c", "de", "a", 50, 50, 1), ("c", "de", "b", 50, 49, 1))) == [("en", "recall"), ("overall", "recall")]


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "state")
    assert manifest.read_manifest(spark, path).count() == 0
    state = spark.createDataFrame([(0, "a", "done", "o/a", None), (1, "a", "failed", None, "x"), (2, "gone", "done", None, None)], schema.MANIFEST)
    manifest.write_manifest(state, path)
    assert manifest.read_manifest(spark, path).count() == 3 and manifest.read_manifest(spark, path, version=2).count() == 0
    import os

    os.rename(path, f"{path}.new")  # a stop between the two renames
    resumed = manifest.read_manifest(spark, path)
    assert resumed.count() == 3
    manifest.write_manifest(resumed.where("seq < 2"), path)  # derived from what is overwritten
    assert manifest.read_manifest(spark, path).count() == 2
    manifest.write_manifest(state, path)
    urls = spark.createDataFrame([(0, "b"), (1, "a")], "seq long, source string")
    rows = manifest.reconcile(urls, manifest.read_manifest(spark, path)).orderBy("seq").collect()
    assert [(r["source"], r["status"]) for r in rows] == [("b", "pending"), ("a", "done")]
    items = spark.createDataFrame([(i, s, None) for i, s in enumerate(["x.mp4", "d/x.mkv", "x(2).mp4", "e/x.avi"])], "seq long, source string, video_id string")
    assert [r["output_path"] for r in manifest.output_paths(items, "o", ".md").orderBy("seq").collect()] == ["o/x.md", "o/x(2).md", "o/x(2)(2).md", "o/x(3).md"]
    taken = spark.createDataFrame([("o/x.md",), ("o/x(3).md",), ("p/x(4).md",), ("o/y.txt",)], "output_path string")
    more = items.unionByName(spark.createDataFrame([(4, "y.mp4", None)], items.schema))
    assert [r["output_path"] for r in manifest.output_paths(more, "o", ".md", taken).orderBy("seq").collect()] == ["o/x(2).md", "o/x(4).md", "o/x(2)(2).md", "o/x(5).md", "o/y.md"]
    lists = spark.createDataFrame([("l", "﻿http://a\r\n\n  b  c\x1d")], "path string, value string")
    assert [r["source"] for r in manifest.parse_list(lists).orderBy("line_no").collect()] == ["http://a", "b", "c"]


def test_sinks(spark, tmp_path):
    s = seg(spark, ("v", 0, 0, 1.5, "a\nb|", "SPEECH"), ("v", 1, 61, 62, "c", "ON-SCREEN"))
    body = lambda form: sinks.render(s, form, spark.createDataFrame([("v", "en")], "video_id string, language string")).first()["body"]
    assert body("txt") == "a b|\nc\n"
    assert body("srt") == "1\n00:00:00,000 --> 00:00:01,500\na b|\n\n2\n00:01:01,000 --> 00:01:02,000\nc\n"
    assert body("md") == "**[SPEECH] 0:00–0:01** a b\\|\n**[ON-SCREEN] 1:01–1:02** c\n"
    assert '"asr_logprob" : null' in body("json") and '"language" : "en"' in body("json")
    sinks.write(sinks.render(s, "txt"), str(tmp_path / "out"), "txt")
    assert [(f.name, f.read_text()) for f in (tmp_path / "out").iterdir()] == [("v.txt", "a b|\nc\n")]
    with pytest.raises(ValueError):
        sinks.render(s, "pdf")


def test_cleanup(spark):
    s = seg(spark, ("v", 0, 0, 1, "helo", "ON-SCREEN"), ("v", 1, 0, 1, "wrld", "SPEECH"), ("v", 2, 0, 1, "ab", "BOTH"))
    client = lambda: lambda texts: ["hello\r" if t == "helo" else "far too long" for t in texts]
    assert [r["text"] for r in cleanup.clean(s, "screen", client).orderBy("seq").collect()] == ["hello", "wrld", "ab"]
    bodies = spark.createDataFrame([("v", 0, '{"language":"english","text":"","segments":[{"start":0.0,"end":1.0,"text":" x ","avg_logprob":-0.5},{"start":1.0,"end":2.0,"text":" "}]}')], "video_id string, chunk_no int, body string")
    assert [(r["text"], r["asr_logprob"]) for r in cleanup.parse_responses(bodies).collect()] == [("x", -0.5)]
    with pytest.raises(Exception):
        cleanup.parse_responses(bodies.withColumn("body", F.lit('{"segments":[{"start":1e12,"end":2.0,"text":"x"}]}'))).collect()


def test_media(spark):
    files = spark.createDataFrame([("f/b.JPG",), ("f/a.png",), ("f/z.mp3",), ("f/y.wav",), ("f/n.txt",)], "path string")
    assert [(r["path"], r["kind"]) for r in media.photo_files(files).orderBy("path").collect()] == [("f/a.png", "image"), ("f/b.JPG", "image"), ("f/y.wav", "audio")]
    images = spark.createDataFrame([("v", 0, 4.0), ("v", 1, 4.0), ("w", 0, None)], "video_id string, image_no int, duration double")
    assert [(r["start"], r["end"]) for r in frames.slide_times(images).orderBy("video_id", "image_no").collect()] == [(0, 2), (2, 4), (0, 1)]


def test_streams(spark, tmp_path):
    from captionmill.streaming import sampler

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    grey = lambda v: np.full((2, 2), v, np.uint8).tobytes()
    rows = [("v", i, 1.0, 2, 2, grey(v)) for i, v in enumerate([0, 0, 200, 200, 255])]
    spark.createDataFrame(rows, schema.FRAME).coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(schema.FRAME).parquet(str(tmp_path / "frames"))
    q = sampler.scene_change_stream(stream).writeStream.format("memory").queryName("chosen").outputMode("append").trigger(once=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["frame_idx"] for r in spark.table("chosen").collect()) == [0, 2, 4]
    spark.conf.set("spark.sql.shuffle.partitions", "4")




def test_dedup_stream(spark, tmp_path):
    from captionmill.streaming import sampler

    rows = [("v", 0, 100.0, 100.0, "Hi", 0.5, "en"), ("v", 1, 101.0, 101.0, "hi", None, "de"), ("v", 2, 109.0, 109.0, "hi", None, None), ("v", 3, 130.0, 130.0, "other", 0.9, "en")]
    later = [("w", 0, 900.0, 900.0, "late", None, None)]
    kinds = "video_id string, seq long, start double, end double, text string, ocr_confidence double, language string"
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "points" / f"n={i}"))
    for name, shortest in (("clusters", 0.0), ("long_clusters", 0.5)):
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points" / "*")).withColumn("at", F.timestamp_seconds("start")).withWatermark("at", "0 seconds")
        q = sampler.dedup_stream(stream, min_duration=shortest).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    told = lambda name: sorted((r["seq"], r["start"], r["end"], r["text"], r["ocr_confidence"], r["language"], r["n"]) for r in spark.table(name).where("video_id = 'v'").collect())
    # The later row moves the watermark, so the last clusters of the first video follow.
    assert told("clusters") == [(0, 100.0, 101.0, "Hi", 0.5, "en", 2), (2, 109.0, 109.0, "hi", None, None, 1), (3, 130.0, 130.0, "other", 0.9, "en", 1)]
    assert told("long_clusters") == [(0, 100.0, 101.0, "Hi", 0.5, "en", 2)]


def test_closed_videos(spark, tmp_path):
    from captionmill.streaming import sampler

    kinds = "video_id string, seq long, text string, is_end boolean, frame_count long"
    parts = ([("v", 0, "a", False, None), ("w", 0, "b", False, None)], [("v", 1, None, None, None), ("v", 2, "d", True, 7), ("w", 1, "c", False, None)], [("v", 3, "late", False, None), ("x", None, None, True, 0)], [("w", 2, None, True, 3)])
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kinds).coalesce(1).write.parquet(str(tmp_path / "points" / f"n={i}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = sampler.closed_video_stream(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.table("closed").collect())) == [("v", 0, "a", 7), ("v", 1, None, 7), ("w", 0, "b", 3), ("w", 1, "c", 3)]
    rows = spark.createDataFrame([("v", 1), ("w", 1)], "video_id string, seq long")
    assert [r["video_id"] for r in segments.of_closed_videos(rows, spark.createDataFrame([("v",)], "video_id string")).collect()] == ["v"]


def test_report_tables_and_models(spark):
    records = spark.createDataFrame([("c", "en", "a", 3, 2, 8, 1, 0.5), ("d", "en", "a", 0, 0, 0, 0, 0.0)], "clip string, language string, ocr_model_set string, expected long, matched long, segments long, unmatched long, raw_recall double")
    lines = [r["line"] for r in evaluation.clip_table(records).orderBy("language", "clip", "ocr_model_set").collect()]
    assert lines == ["| c | en | a | 2/3 = 0.667 | 0.500 | 0.125 | 8 |", "| d | en | a | 0/0 = 1.000 | 1.000 | 0.000 | 0 |"]
    assert [r["line"] for r in evaluation.language_table(evaluation.summarize(records)).collect()] == ["| en | a | 2 | 2/3 = 0.667 | 0.500 | 0.125 | 8 |"]
    stats = spark.createDataFrame([("v", "b", 2), ("v", "a", 2), ("v", "c", 5)], "video_id string, canonical_text string, occurrence_count long")
    assert [r["canonical_text"] for r in evaluation.by_frequency(stats).collect()] == ["c", "a", "b"]
    log = [(1, 0, "Using /m/a_det_1.onnx"), (1, 1, "Using C:\\m\\b-rec.2.onnx"), (1, 2, "using /m/z_det_.onnx"), (1, 3, "Using /m/c_det_3.onnx"), (2, 0, "hello")]
    got = {r["run"]: (r["det"], r["rec"]) for r in profiles.recogniser_models(spark.createDataFrame(log, "run long, seq long, message string")).collect()}
    assert got == {1: ("c_det_3.onnx", "b-rec.2.onnx"), 2: (None, None)}


def test_resume(spark, tmp_path):
    from captionmill.streaming import sampler

    seen = []
    spark.createDataFrame([(0, "a"), (1, "b")], "seq long, source string").coalesce(1).write.json(str(tmp_path / "items"))
    for _ in range(2):
        sampler.resume_items(spark, str(tmp_path / "items"), str(tmp_path / "done"), lambda df, _: seen.extend(r["source"] for r in df.orderBy("seq").collect()))
    assert seen == ["a", "b"]


def test_a_batch_is_added_once(spark, tmp_path):
    from captionmill.streaming import sampler

    target = str(tmp_path / "table")
    failing = []

    def handle(df, batch_id):
        sampler.append_once(df, target, batch_id)
        if not failing:  # a stop after the data is in place and before the stream knows
            failing.append(batch_id)
            raise RuntimeError("stopped")

    spark.createDataFrame([(0, "a"), (1, "b")], "seq long, source string").coalesce(1).write.json(str(tmp_path / "items"))
    with pytest.raises(Exception, match="stopped"):
        sampler.resume_items(spark, str(tmp_path / "items"), str(tmp_path / "done"), handle)
    sampler.resume_items(spark, str(tmp_path / "items"), str(tmp_path / "done"), handle)
    assert sorted(r["source"] for r in spark.read.parquet(target).collect()) == ["a", "b"]
    assert not sampler.append_once(spark.range(3), target, 0) and sampler.append_once(spark.createDataFrame([(2, "c")], "seq long, source string"), target, 1)
    assert spark.read.parquet(target).count() == 3 and not list((tmp_path / "table").glob("_pending*"))


def test_views_hold_whole_texts(spark, tmp_path):
    from captionmill.plans import catalog
    from captionmill.sources.derived import load

    long = " ".join(f"word{i}" for i in range(300))
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "no " + long), (1, 2, "user", "and " + long)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(r["text"] for r in load(spark, str(tmp_path), "turns").collect()) == sorted([long, "no " + long, "and " + long])
    assert {r["text"] for r in load(spark, str(tmp_path), "captions").collect()} == {long + "!", ("and " + long).upper()}
    got = {r["gt_seq"]: r["similarity"] for r in catalog.per_text_results(spark, str(tmp_path)).collect()}
    assert got == {0: round(2 * len(long) / (2 * len(long) + 1), 6), 2: 0.0}


def test_scores_compare_texts_not_rows(spark):
    import itertools

    rng, asked = random.Random(8), spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([similarity.indel(x.lower(), y.lower()) for x, y in zip(a, b)])

    rows = [("v", q, t := rng.randrange(30) / 2, t + rng.randrange(3), rng.choice(["big red", "Big Red", "house", "here today"]), "ON-SCREEN") for q in rng.sample(range(900), 150)]
    texts = ["big red house", "house here today", "here today house big red", "big red big red", "nothing"]
    sought = [(rng.choice(texts) + " " * i, *rng.choice([(None, None), (3.0, 6.0), (5.0, None), (None, 4.0), (2.0, 3.0)]), True, None) for i in range(12)]
    want, found = {}, set()
    for g, (text_, lo, hi, *_) in enumerate(sought):
        near = sorted((r for r in rows if (lo is None or r[3] >= lo) and (hi is None or r[2] <= hi)), key=lambda r: r[1])
        sim = lambda *t, to=text_: similarity.indel(" ".join(t).lower(), to.lower())
        found |= {r[1] for r in near if sim(r[4]) >= 0.85}
        best = max([(sim(r[4]), -r[1], r[4]) for r in near], default=(0.0, 0, None))
        best, used = (best[0], best[2]) if best[0] > 0 else (0.0, None), []
        two = [(sim(x[4], y[4]), -a[1], -b[1], a is x, (x, y), (a, b)) for a, b in itertools.combinations(near, 2) if b[2] - a[2] in (d / 2 for d in range(-4, 5)) for x, y in ((a, b), (b, a))]
        if two and max(two, key=lambda t: t[:4])[0] > best[0]:
            top = max(two, key=lambda t: t[:4])
            best, used, ends = (top[0], " ".join(r[4] for r in top[4])), [r[1] for r in top[5]], top[5]
            third = [r for r in near if r[1] not in used and max(r[2], *(e[2] for e in ends)) - min(r[2], *(e[2] for e in ends)) <= 2]
            three = [(sim(*(x[4] for x in p)), -r[1], -n, " ".join(x[4] for x in p), r[1]) for r in third for n, p in enumerate(itertools.permutations((r, *ends)))]
            if best[0] < 0.85 and three and max(three)[0] > best[0]:
                best, used = max(three)[:1] + max(three)[3:4], sorted([*used, max(three)[4]])
        want[g] = (round(best[0], 9), best[1], used)
        found |= set(used) if best[0] >= 0.85 else set()
    heard, gt = seg(spark, *rows), expected(spark, *sought)
    got = {r["gt_seq"]: (round(r["similarity"], 9), r["best_candidate"], r["used"]) for r in evaluation.per_text(heard, gt, ratio=ratio).collect()}
    assert got == want
    assert asked.value <= 12 * (4 + 2 * 10 + 6 * 4)  # texts, pairs of them and orders of three, for each expected text
    assert abs(evaluation.score(heard, gt, ratio=ratio).first()["precision"] - len(found) / len(rows)) < 1e-9


def test_output_paths_have_no_last_number(spark):
    rng = random.Random(9)
    stems = ["x"] * 1200 + ["x(2)"] * 3 + ["x(700)", "x(5)", "x(5)", "x(2)(2)", "x(02)", "x(1)", "y"] + [f"x({n})" for n in rng.sample(range(2, 1500), 100)]
    rng.shuffle(stems)
    taken = ["x(4)", "x(1201)", "x(2)(3)", "y", "z"] + [f"x({n})" for n in range(300, 340)]
    for gone in ([], taken):
        used, want = set(gone), []
        for stem in stems:
            name, n = stem, 1
            while name in used:
                n += 1
                name = f"{stem}({n})"
            used.add(name)
            want.append(f"o/{name}.md")
        items = spark.createDataFrame([(i, f"{s}.mp4", None) for i, s in enumerate(stems)], "seq long, source string, video_id string")
        before = spark.createDataFrame([(f"o/{s}.md",) for s in gone], "output_path string") if gone else None
        got = [r["output_path"] for r in manifest.output_paths(items, "o", ".md", before).orderBy("seq").collect()]
        assert got == want
