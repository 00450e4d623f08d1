"""String similarity: normalised Indel ratio and a weighted ratio.

``ratio`` is 2 * LCS / (n + m) of the lower-cased strings, two empty strings
being equal. The production form compares the pairs of an Arrow batch side by
side (``lanes``); ``lcs`` is the plain bit-parallel row for a single pair, and the
SQL form is for plans without Python workers and for short strings. ``ratio_bound`` is the best ratio that the
lengths allow, a cheap filter to put in front.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionmill.functions import lanes


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits per character of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


def _of_known(a: pd.Series, b: pd.Series, of) -> pd.Series:
    """``of`` over the pairs without a null; null for the others."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = of(a[known].tolist(), b[known].tolist())
    return pd.Series(out).astype(object).where(pd.Series(known), None)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio in 0..1; null if either side is."""
    return _of_known(a, b, lanes.ratios)


def ratio_bound(a, b) -> Column:
    n, m = F.length(_col(a)), F.length(_col(b))
    return F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / F.greatest(n + m, F.lit(1)))


def ratio_sql(a, b) -> Column:
    """The same without Python: a fold of LCS rows over the characters."""
    x, y = F.lower(_col(a)), F.lower(_col(b))
    chars = lambda t: F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))
    row0 = F.transform(chars(x), lambda c: F.lit(0))

    def step(row, c):
        init = F.struct(F.lit(0).alias("left"), F.lit(0).alias("diag"), F.array().cast("array<int>").alias("out"))
        cells = F.zip_with(chars(x), row, lambda k, up: F.struct(k.alias("k"), up.alias("up")))

        def cell(s, p):
            best = F.when(p["k"] == c, s["diag"] + 1).otherwise(F.greatest(s["left"], p["up"]))
            return F.struct(best.alias("left"), p["up"].alias("diag"), F.concat(s["out"], F.array(best)).alias("out"))

        return F.aggregate(cells, init, cell, lambda s: s["out"])

    last = F.aggregate(chars(y), row0, step)
    common = F.coalesce(F.when(F.size(last) > 0, F.element_at(last, -1)), F.lit(0))
    n = F.length(x) + F.length(y)
    return F.when(n == 0, 1.0).otherwise(2.0 * common / F.greatest(n, F.lit(1)))


def weighted(a: str | None, b: str | None) -> float | None:
    """The weighted ratio in 0..1 of one pair."""
    return None if a is None or b is None else float(lanes.weighted_ratios([a], [b])[0])


@F.pandas_udf(T.DoubleType())
def wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted ratio in 0..1 (see ``lanes.weighted_ratios``); null if either side is."""
    return _of_known(a, b, lanes.weighted_ratios)


def register(spark) -> None:
    """The functions for SQL text: indel_ratio, wratio, reading_order, canonical_key."""
    from captionmill.functions.bidi import reading_order
    from captionmill.functions.text import canonical_key_unicode

    for name, f in {"indel_ratio": ratio, "wratio": wratio, "reading_order": reading_order, "canonical_key": canonical_key_unicode}.items():
        spark.udf.register(name, f)
