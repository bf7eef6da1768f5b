"""Text cleaning and stemming."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a short default stop-list; pass a longer one as a table of words
STOP_WORDS = ("a an and are as at be been but by for from had has have he her his i in is it its not of on or said she that the their they this to was were which who will with would you").split()


def clean(text: Column) -> Column:
    """Non-ASCII characters deleted, lower-cased, everything but letters and digits blanked."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", "")), "[^a-z0-9]", " ")


def tokens(text: Column) -> Column:
    """Non-empty pieces of a cleaned text that are not all digits."""
    return F.filter(F.split(clean(text), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


# The suffixes and replacements of the published stemmer (Porter, 1980) with its
# author's two later changes (bli, logi). Longest suffix first is not needed: each step takes
# the longest that fits.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_LONG2, _LONG3 = sorted(_STEP2, key=len, reverse=True), sorted(_STEP3, key=len, reverse=True)
_LONG4 = sorted(_STEP4, key=len, reverse=True)
_VC = re.compile("VC")
_RUNS = re.compile(r"(.)\1+")


def _shape(stem: str) -> str:
    """C and V of each letter: y after a consonant is a vowel, digits are consonants."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "C")
        out += "V" if vowel else "C"
    return out


def _m(stem: str) -> int:
    return len(_VC.findall(_RUNS.sub(r"\1", _shape(stem))))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "CVC" and w[-1] not in "wxy"


def _ends(w: str, suffixes: list[str]) -> str | None:
    return next((s for s in suffixes if w.endswith(s) and len(w) > len(s)), None)


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "V" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "C":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _m(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, order in ((_STEP2, _LONG2), (_STEP3, _LONG3)):
        s = _ends(w, order)
        if s and _m(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _ends(w, _LONG4)
    if s and _m(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _m(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_vocabulary(words: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of the distinct words: Python sees each word once, not each occurrence."""
    return words.select(F.col(col).alias("term")).where("term IS NOT NULL").distinct().withColumn("stem", stem_udf("term"))
