"""Lexemes of English text, and cover-density ranking."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The usual English stop words of text search.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Fixed values of the published English stemmer (Porter's second).
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, start: int) -> int:
    m = re.search("[aeiouy][^aeiouy]", word[start:])
    return start + m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def _longest(word: str, suffixes: tuple[str, ...] | dict) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(200_000)
def stem(word: str) -> str:
    """The English stem of a lower-case word."""
    if len(word) <= 2 or word in _INVARIANT:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("'s?'?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_S:
        return w
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: len(w) - len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    ending = _longest(w, (*_STEP2, "ogi", "li"))
    if ending and len(w) - len(ending) >= r1:
        base = w[: -len(ending)]
        if ending == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif ending == "li":
            w = base if base[-1:] in tuple(_LI) else w
        else:
            w = base + _STEP2[ending]
    ending = _longest(w, (*_STEP3, "ative"))
    if ending and len(w) - len(ending) >= r1:
        if ending != "ative":
            w = w[: -len(ending)] + _STEP3[ending]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    ending = _longest(w, (*_STEP4, "ion"))
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def positions_of(text: str | None, stemmed: bool = True) -> dict[str, list[int]]:
    """Lexeme to its positions, counted over all words from 1."""
    out: dict[str, list[int]] = {}
    for at, m in enumerate(_TOKEN.finditer((text or "").lower()), 1):
        if m[0] not in STOP:
            out.setdefault(stem(m[0]) if stemmed else m[0], []).append(at)
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def to_lexemes(text: pd.Series) -> pd.Series:
    """English lexemes of a text with their positions: stop words out, stems in."""
    return text.map(positions_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def query_lexemes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(positions_of(t)))


def words(text: Column) -> Column:
    """Lower-case words, native, not stemmed."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cover_density_of(positions: list[list[int]]) -> float:
    """Sum over minimal covers of all terms of 0.1 / (1 + words in between that are no terms)."""
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((at, k) for k, own in enumerate(positions) for at in own)
    last = [0] * len(positions)
    score, begin_before = 0.0, 0
    for at, k in events:
        last[k] = at
        begin = min(last)
        if begin > begin_before:  # a cover that starts later than the one before is minimal
            score += 0.1 / (1 + max(0, at - begin - (len(positions) - 1)))
            begin_before = begin
    return score


@F.pandas_udf(T.DoubleType())
def cover_density(positions: pd.Series) -> pd.Series:
    """positions: array<array<int>>, one array for each term of the query."""
    return positions.map(lambda own: cover_density_of([list(p) if p is not None else [] for p in own]))
