"""Similarity of many pairs of strings at once: bit-parallel subsequence rows in numpy.

A pair is a lane: one or more 64-bit words hold the state of a whole row of the
dynamic program over the shorter string, and a step takes one character of the
longer string in every lane. Lanes of like size share a block whose match tables
fit the cache. For the best stretch of a longer string the lanes are the places of
that string: all windows of one length advance together, and the match masks they
need at a step are one shifted slice.
"""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
TABLE, PLACES = 1 << 19, 1 << 16  # words of a block's match tables, and of its windows


class Texts:
    """Lower-cased strings as one array of dense character codes from 1 on."""

    def __init__(self, *columns: list[str]):
        self.size, codes = [], []
        for column in columns:
            joined = "".join(column)
            if joined.isascii():
                codes.append(np.frombuffer(joined.lower().encode(), np.uint8))
            else:  # lowering may change a string's length
                column = [t.lower() for t in column]
                codes.append(np.frombuffer("".join(column).encode("utf-32-le", "surrogatepass"), np.uint32))
            self.size.append(np.fromiter(map(len, column), np.int64, len(column)))
        seen = np.zeros(1 + max((int(c.max(initial=0)) for c in codes), default=0), bool)
        for c in codes:
            seen[c] = True
        rank = np.cumsum(seen, dtype=np.int32)
        self.kinds = int(rank[-1]) + 1
        rank = rank.astype(np.uint8 if self.kinds <= 256 else np.int32)
        self.codes, self.start = np.concatenate([rank[c] for c in codes]), []
        for n in self.size:
            self.start.append(np.cumsum(n) - n + sum(int(x.sum()) for x in self.size[: len(self.start)]))


def _matrix(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes by lane and place, 0 behind the end."""
    place = np.arange(int(size.max(initial=0)))
    inside = place < size[:, None]
    if inside.all():
        return codes[start[:, None] + place]
    out = np.zeros(inside.shape, codes.dtype)
    out[inside] = codes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out


def _tables(short: np.ndarray, kinds: int, words: int) -> np.ndarray:
    """Match masks of each lane and character, a row of ``words`` for each."""
    lane = np.arange(len(short)) * kinds
    table = np.zeros(len(short) * kinds * words, np.uint64)
    for i, at in enumerate(((short + lane[:, None]) * words).T.copy()):
        at += i >> 6
        table[at] |= np.uint64(1 << (i & 63))
    table = table.reshape(-1, words)
    table[lane] = 0
    return table


def _advance(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The next row of every lane; words from the least significant on."""
    hit = state & mask
    total = state + hit
    if state.ndim > 1 and state.shape[1] > 1:
        carry = total < state
        while (up := carry[:, :-1]).any():
            total[:, 1:] += up
            carry = np.concatenate([np.zeros((len(up), 1), bool), up & (total[:, 1:] == 0)], axis=1)
    total |= np.subtract(state, hit, out=hit)
    return total


def _common(state: np.ndarray) -> np.ndarray:
    """Subsequence lengths: the zeros of a state."""
    return 64 * (state.size // max(len(state), 1)) - np.bitwise_count(state).reshape(len(state), -1).sum(1, dtype=np.int64)


def _dense(codes: np.ndarray, kinds: int) -> tuple[np.ndarray, int]:
    """A map of codes to those that a block has, 0 for the others."""
    seen = np.zeros(kinds, bool)
    seen[codes.reshape(-1)] = True
    seen[0] = False
    at = np.cumsum(seen, dtype=np.int32) * seen
    return at, int(at.max(initial=0)) + 1


def _blocks(words: np.ndarray, weight: np.ndarray, most: int):
    """Stretches of one number of words whose weights add up to ``most`` or so."""
    i = 0
    while i < len(words):
        ends = np.searchsorted(words, words[i], "right")
        j = i + max(1, int(np.searchsorted(np.cumsum(weight[i:ends]), most, "right")))
        yield i, j
        i = j


def common(texts: Texts) -> np.ndarray:
    """Lengths of the longest common subsequences of two columns, pair by pair."""
    swap = texts.size[0] > texts.size[1]
    size = np.where(swap, texts.size[1], texts.size[0]), np.where(swap, texts.size[0], texts.size[1])
    codes, at = texts.codes, texts.start
    start = np.where(swap, at[1], at[0]), np.where(swap, at[0], at[1])
    words = np.maximum(-(-size[0] // 64), 1)
    order = np.lexsort((size[1], words))
    out = np.zeros(len(words), np.int64)
    for i, j in _blocks(words[order], words[order] * min(texts.kinds, 96), TABLE):
        own = order[i:j]
        short, long = (_matrix(codes, start[k][own], size[k][own]) for k in (0, 1))
        dense, kinds = _dense(short, texts.kinds)
        table = _tables(dense[short], kinds, int(words[own[0]]))
        steps = np.ascontiguousarray((dense[long] + (np.arange(len(own)) * kinds)[:, None]).T)
        table = table[:, 0].copy() if table.shape[1] == 1 else table
        state = np.full((len(own), *table.shape[1:]), ONES)
        for step in steps:
            state = _advance(state, table.take(step, axis=0))
        out[own] = _common(state)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 LCS / (n + m) of the lower-cased strings; 1 for two empty ones."""
    texts = Texts(a, b)
    total = texts.size[0] + texts.size[1]
    return np.where(total > 0, 2 * common(texts) / np.maximum(total, 1), 1.0)


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter string with any stretch of the longer one up to
    its own length; of two of one length either is the shorter. An empty string
    has 0 with others and 1 with another."""
    swap = [len(x.lower()) > len(y.lower()) for x, y in zip(a, b)]
    a, b = [y if s else x for s, x, y in zip(swap, a, b)], [x if s else y for s, x, y in zip(swap, a, b)]
    texts = Texts(a, b)
    n, m = texts.size
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    even = np.flatnonzero((n == m) & (n > 0))
    rows = np.concatenate([np.flatnonzero(n > 0), even])
    other = np.arange(len(rows)) >= len(rows) - len(even)
    codes, at = texts.codes, texts.start
    begin = np.where(other, at[1][rows], at[0][rows]), np.where(other, at[0][rows], at[1][rows])
    words = -(-n[rows] // 64)
    order = np.lexsort((-n[rows], words))
    rows, begin, words = rows[order], [x[order] for x in begin], words[order]
    for i, j in _blocks(words, words * (m[rows] + 2 * n[rows]), PLACES):
        best = _windows(codes, begin[0][i:j], n[rows[i:j]], begin[1][i:j], m[rows[i:j]], texts.kinds, int(words[i]))
        np.maximum.at(out, rows[i:j], best)
    return out


def _windows(codes: np.ndarray, begin: np.ndarray, n: np.ndarray, start: np.ndarray, m: np.ndarray, all_kinds: int, words: int) -> np.ndarray:
    """The best ratio of each pair of a block; pairs with the longest short string
    first. A long string lies between two stretches of n - 1 places that match
    nothing, so that windows over its ends are windows like all others."""
    short = _matrix(codes, begin, n)
    dense, kinds = _dense(short, all_kinds)
    table = _tables(dense[short], kinds, words)
    length = m + 2 * (n - 1)
    base = np.cumsum(length) - length
    pair = np.repeat(np.arange(len(n)), length)
    place = np.arange(len(pair)) - base[pair]
    inside = place - (n[pair] - 1)
    text = (inside >= 0) & (inside < m[pair])
    mask = np.zeros((len(pair) + int(n[0]), words), np.uint64)
    mask[: len(pair)][text] = table[dense[codes[(start[pair] + inside)[text]]] + kinds * pair[text]]
    state = np.full((len(pair), words), ONES)
    active = np.cumsum(length)[np.searchsorted(-n, -np.arange(1, n[0] + 1), "right") - 1]  # places whose window has a step left
    if words == 1:
        mask, state = mask[:, 0].copy(), state[:, 0].copy()
    for t, k in enumerate(active):
        state[:k] = _advance(state[:k], mask[t : t + k])
    width = np.minimum(inside + n[pair], m[pair]) - np.maximum(inside, 0)
    ratio = np.where(width > 0, 2 * _common(state) / (n[pair] + np.maximum(width, 1)), 0.0)
    return np.maximum.reduceat(ratio, base)


def _tokens(a: str, b: str) -> tuple[str, str, str, str, str]:
    """Sorted tokens of both, the shared ones, and the others of each, joined."""
    x, y = a.split(), b.split()
    both = set(x) & set(y)
    return tuple(" ".join(sorted(t)) for t in (x, y, both, set(x) - both, set(y) - both))


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted ratios. Strings of like length (under 1.5 times) take the ratio or
    0.95 of the token ratio; others the ratio, 0.9 of the partial ratio (0.6 beyond
    8 times) or 0.95 of that of the partial token ratio. An empty string has 0."""
    a, b = [t.lower() for t in a], [t.lower() for t in b]
    out = ratios(a, b)
    n, m = np.array([len(t) for t in a], int), np.array([len(t) for t in b], int)
    out[(n == 0) | (m == 0)] = 0
    long = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    scale = np.where(long < 1.5, 1.0, np.where(long <= 8, 0.9, 0.6))
    whole: list[tuple] = []  # (pair, factor, left, right) under the ratio
    part: list[tuple] = []  # and under the partial ratio
    for i in np.flatnonzero((n > 0) & (m > 0) & (out < 1)):
        x, y, core, dx, dy = _tokens(a[i], b[i])
        if long[i] >= 1.5:
            part.append((i, scale[i], a[i], b[i]))
        if not x or not y:
            continue
        factor = 0.95 * scale[i]
        if core and (long[i] >= 1.5 or not dx or not dy):
            out[i] = max(out[i], factor)
            continue
        if long[i] < 1.5:
            left, right = (" ".join(filter(None, (core, d))) for d in (dx, dy))
            whole += [(i, factor, x, y), (i, factor, left, right)]
            if core:  # the core is a prefix of both
                out[i] = max(out[i], factor * 2 * len(core) / (len(core) + min(len(left), len(right))))
        else:
            part += [(i, factor, x, y)] + [(i, factor, dx, dy)] * ((x, y) != (dx, dy))
    for jobs, of in ((whole, ratios), (part, partials)):
        if jobs:
            at, factor, left, right = zip(*jobs)
            np.maximum.at(out, np.array(at), np.array(factor) * of(list(left), list(right)))
    return out
