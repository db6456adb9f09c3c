"""English stems by the published suffix-stripping algorithm of 1980 (Porter), as an Arrow-batched column function."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, rules) -> tuple[str, str] | None:
    return max(((a, b) for a, b in rules if w.endswith(a)), key=lambda r: len(r[0]), default=None)


@lru_cache(100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; diacritics are folded first."""
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    if len(w) <= 2:
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    elif (end := "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else "") and "v" in _shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (r := _longest(w, rules)) and _m(w[: len(w) - len(r[0])]) > 0:
            w = w[: len(w) - len(r[0])] + r[1]
    r = _longest(w, [(x, "") for x in (*_STEP4, "ion")])
    if r:
        base = w[: len(w) - len(r[0])]
        if _m(base) > 1 and (r[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


def stems(text):
    """array<string>: the stems of a text's words in order, to be stored once at ingest."""

    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [stem(w) for w in re.findall(r"[^\W_]+", (t or "").lower())])

    return f(text)


def has_phrase(stemmed, phrase: str):
    """Whether the stems of a phrase stand side by side in an array of stems; the index of an inverted list isn't needed."""
    want = [stem(w) for w in re.findall(r"[^\W_]+", phrase.lower())]
    if not want:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(stemmed, " "), F.lit(" ")), F.lit(f" {' '.join(want)} "))
