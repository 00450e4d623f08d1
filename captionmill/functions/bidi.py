"""Reading order of the boxes of one line, given left to right on screen.

A line without Hebrew or Arabic letters stays as it is. Other lines are one of
two kinds. If the first and last box with a letter are purely left-to-right,
the line is left-to-right, and each stretch of right-to-left boxes in it is
turned around, with the numbers that belong to it. Otherwise the line is
right-to-left: the boxes are turned around, and each stretch with Latin
letters between right-to-left boxes is turned back, from its first to its last
Latin or number box.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts written from right to left, for the test that sends no other line's texts to Python.
RTL_RANGES = "[֐-ࣿיִ-﷿ﹰ-﻿\U00010800-\U00010fff\U0001e800-\U0001efff]"


def _kinds(text: str) -> set[str]:
    """The bidirectional classes of the characters, R and AL as one."""
    return {"R" if c == "AL" else c for c in map(unicodedata.bidirectional, text)}


def order(texts: list[str]) -> list[str]:
    kinds = [_kinds(t) for t in texts]
    if not any("R" in k for k in kinds):
        return list(texts)
    lettered = [k for k in kinds if k & {"L", "R"}]
    plain = all("R" not in k for k in (lettered[0], lettered[-1]))
    at = _turned_stretches(kinds) if plain else _turned_line(kinds)
    return [texts[i] for i in at]


#: A stretch in letters of ``_letter``: right-to-left boxes with what lies between them,
#: from the first number of the neutral boxes before it to the last Arabic number behind it.
_STRETCH = re.compile("(?:[AE][AEN]*)?R(?:[AEN]*R)*(?:[AEN]*A)?")


def _letter(kinds: set[str]) -> str:
    """R or L for a box with such letters, A or E for one with numbers only, else N."""
    return next((letter for kind, letter in (("R", "R"), ("L", "L"), ("AN", "A"), ("EN", "E")) if kind in kinds), "N")


def _turned_stretches(kinds: list[set[str]]) -> list[int]:
    at = list(range(len(kinds)))
    for m in _STRETCH.finditer("".join(map(_letter, kinds))):
        at[m.start() : m.end()] = at[m.start() : m.end()][::-1]
    return at


def _turned_line(kinds: list[set[str]]) -> list[int]:
    """Last box first; then the Latin stretches are put back into screen order."""
    line = list(range(len(kinds)))[::-1]
    fixed = [bool(kinds[i] & {"R", "AN"}) for i in line]
    for is_fixed, places in itertools.groupby(range(len(line)), fixed.__getitem__):
        between = [] if is_fixed else list(places)
        if any("L" in kinds[line[p]] for p in between):
            ends = [p for p in between if kinds[line[p]] & {"L", "EN"}]
            line[ends[0] : ends[-1] + 1] = sorted(line[ends[0] : ends[-1] + 1])
    return line


@F.pandas_udf(T.ArrayType(T.StringType()))
def reading_order(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else order(list(t)))


def in_reading_order(texts: Column) -> Column:
    """The texts of a line in reading order. Lines in other scripts reach the
    Python worker as nulls, whatever they hold."""
    return F.coalesce(reading_order(F.when(F.array_join(texts, "").rlike(RTL_RANGES), texts)), texts)
