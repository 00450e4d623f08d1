"""Lane-parallel ratios and clusters by rounds against their plain definitions."""

import random

import numpy as np
import pytest

from captionmill.functions import lanes, similarity
from captionmill.operators import clusters, segments


def strings(rng, n, longest, alphabet="abcde fgh"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 1.0 if not a and not b else 2 * plain_lcs(a, b) / (len(a) + len(b))


def plain_partial(a, b):
    a, b = sorted((a, b), key=len)
    n, m = len(a), len(b)
    if not n:
        return float(not m)
    spans = [(max(i, 0), min(i + n, m)) for i in range(1 - n, m)]
    best = max(plain_ratio(a, b[i:j]) for i, j in spans)
    return max(best, *(plain_ratio(b, a[i:j]) for i, j in spans)) if n == m else best


@pytest.mark.parametrize("longest", [1, 30, 150])
def test_ratios_equal_the_definition(longest):
    rng = random.Random(longest)
    a, b = strings(rng, 120, longest), strings(rng, 120, 2 * longest, "abcdé fgĥ中\x00")
    assert np.allclose(lanes.ratios(a, b), [plain_ratio(x, y) for x, y in zip(a, b)], atol=1e-12)


def test_words_carry_into_one_another():
    a, b = ["ab" * 200, "x" * 129, "a" * 64, "a" * 65], ["ba" * 300, "x" * 500, "a" * 64, "a" * 66 + "b"]
    assert lanes.ratios(a, b).tolist() == [plain_ratio(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("longest", [2, 25, 90])
def test_partial_ratios_equal_the_definition(longest):
    rng = random.Random(longest)
    a, b = strings(rng, 40, longest, "abc d"), strings(rng, 40, 2 * longest, "abc d")
    a, b = a + ["same len", "abcd"], b + ["nel emas", "bcda"]
    assert np.allclose(lanes.partials(a, b), [plain_partial(x, y) for x, y in zip(a, b)], atol=1e-12)


def test_lowering_may_change_lengths():
    assert lanes.ratios(["İX", "ΑΣ", "STRASSE"], ["i̇x", "ας", "straße"]).tolist() == [1.0, 1.0, plain_ratio("strasse", "straße")]


def test_weighted_anchors():
    w = lambda a, b: lanes.weighted_ratios([a], [b])[0]
    assert w("", "a") == 0 and w("", "") == 0
    assert w("one two three", "three one two") == pytest.approx(0.95)
    assert w("one two three four", "one two three four five") == pytest.approx(0.95)
    assert w("new york mets", "new york mets vs atlanta braves tonight") == pytest.approx(0.9)
    assert w("abcd", "x" * 20 + "abcd" + "y" * 20) == pytest.approx(0.6)


def test_nulls_stay_null(spark):
    rows = spark.createDataFrame([("a", None), (None, None), ("ab", "ab")], "a string, b string")
    got = rows.select(similarity.ratio("a", "b"), similarity.wratio("a", "b")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (1.0, 1.0)]


def plain_clusters(keys, threshold):
    out, found = {}, []
    for _, key in sorted(keys):
        at = next((i for i, c in enumerate(found) if any(plain_ratio(key.lower(), k) >= threshold for k in c)), len(found))
        found += [[]] * (at == len(found))
        found[at] = found[at] + [key.lower()]
        out[key] = at
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.7, 0.4, 0.05])
def test_clusters_equal_the_loop(spark, threshold):
    rng = random.Random(9)
    groups = {g: {k: i for i, k in enumerate(dict.fromkeys(strings(rng, 60, 9, "abcD e") + [""]))} for g in ("v", "w")}
    rows = [(g, k, i // 2) for g, own in groups.items() for k, i in own.items()]
    got = clusters.cluster_keys(spark.createDataFrame(rows, "video_id string, key string, first_seq long"), threshold)
    want = {(g, k, c) for g, own in groups.items() for k, c in plain_clusters([(i // 2, k) for k, i in own.items()], threshold).items()}
    assert {tuple(r) for r in got.collect()} == want


def test_cluster_edges(spark):
    of = lambda keys, t: [r["cluster"] for r in segments.cluster_keys(spark.createDataFrame([("v", k, i) for i, k in enumerate(keys)], "video_id string, key string, first_seq long"), t).orderBy("key").collect()]
    assert of(["hello world", "hemlo world", "hell world"], 0.7) == [0, 0, 0]
    assert of(["zeta", "alpha", "mid"], 0.99) == [1, 2, 0]
    assert of(["zeta", "alpha", "mid"], 0.0) == [0, 0, 0]
    assert of([], 0.5) == []
