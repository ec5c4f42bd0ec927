"""Stems by the algorithm of Porter (1980), over the distinct words of a column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V, _C = "(?:[aeiou]|(?<=[^aeiou])y)", "(?:[^aeiouy]|^y|(?<=[aeiou])y)"
_HAS_VOWEL = re.compile(_V)
_MEASURE = re.compile(f"{_V}+{_C}+")
_DOUBLE = re.compile(r"([^aeiouy])\1$")
_CVC = re.compile(f"{_C}{_V}[^aeiouwxy]$")

_STEP2 = dict(pair.split() for pair in "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble".split(","))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _m(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own.

    >>> porter("relational"), porter("hopping"), porter("visualization")
    ('relat', 'hop', 'visual')
    """
    w = word.lower()
    if len(w) < 3:
        return w
    # Plurals and participles.
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    elif (e := _longest(w, ("ed", "ing"))) and _HAS_VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _CVC.search(w):
            w += "e"
    if w.endswith("y") and _HAS_VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    # Suffixes, by the longest that fits.
    for table in (_STEP2, _STEP3):
        if (e := _longest(w, table)) and _m(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    if (e := _longest(w, _STEP4)) and _m(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    # Final e and double l.
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _CVC.search(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))


def vocabulary_stems(words: DataFrame, column: str = "token") -> DataFrame:
    """``column`` and its stem for each distinct word; join it back on the word."""
    return words.select(column).distinct().withColumn("stem", stem(column))


#: The stem of one word, for those that have no table of words.
vocabulary_stems.word = porter
