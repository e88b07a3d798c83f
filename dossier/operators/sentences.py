"""A sentence splitter that learns abbreviations from the texts themselves.

A word that nearly always has a period is an abbreviation. As Kiss and Strunk (2006) published it: the log-likelihood ratio
of "a period follows in 99 of 100 cases" against "a period follows it as often as any word", times e^-(its letters),
times its inner periods and one, divided by its letters to the power of how often it stands without a period. One aggregation
counts, for every word, how often it stands with and without a period, before a number, and in small letters; what the
splitter keeps is bounded: `most` abbreviations, numbering words and common small words each, the best of them.

Between two tokens a sentence ends after a closing mark, unless the next token begins small, or a number follows a
word that mostly has one (No. 7), or the word is an abbreviation, an initial or has inner periods (U.S.), and what follows
isn't a common word with a capital. Line ends always end one. Null and empty texts have no sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEADING, TRAILING = r"""^["'(\[{«“„¿¡]+""", r"""["')\]}»”,;:]+$"""
#: The least score of an abbreviation, as published.
SCORE = 0.3


def tokens(text: Column) -> Column:
    """Tokens between blanks without quotes and brackets around them."""
    bare = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, LEADING, ""), TRAILING, ""))
    return F.filter(bare, lambda t: t != "")


def word_counts(texts: DataFrame) -> DataFrame:
    """word (small, without its last period), total, with_period, before_number, small, of all texts (text)."""
    t = texts.select(tokens(F.col("text")).alias("t"))
    rows = t.select(F.explode(F.transform("t", lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(F.col("t"), i + 1), F.lit("")).alias("next")))).alias("p"))
    dotted = F.endswith("p.w", F.lit(".")) & (F.length("p.w") > 1)
    word = F.lower(F.when(dotted, F.expr("substring(p.w, 1, length(p.w) - 1)")).otherwise(F.col("p.w")))
    named = rows.select(word.alias("word"), dotted.alias("dotted"), (dotted & F.col("p.next").rlike("^[0-9]")).alias("number"), (F.col("p.w") == F.lower("p.w")).alias("small"))
    return named.groupBy("word").agg(F.count("*").alias("total"), F.count_if("dotted").alias("with_period"), F.count_if("number").alias("before_number"), F.count_if("small").alias("small"))


def scored(counts: DataFrame) -> DataFrame:
    """counts with the score of each word that has a period somewhere and begins with a letter."""
    sums = counts.agg(F.sum("total").alias("n"), F.sum("with_period").alias("dots"))  # one row
    rows = counts.filter((F.col("with_period") > 0) & F.col("word").rlike(r"^\p{L}")).crossJoin(F.broadcast(sums))
    a, ab = F.col("total"), F.col("with_period")
    chance = F.col("dots") / F.col("n")
    rare = lambda n, p: F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p))
    ratio = -2 * (rare(ab, chance) + rare(a - ab, 1 - chance) - rare(ab, F.lit(0.99)) - rare(a - ab, F.lit(0.01)))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) / F.pow(letters.cast("double"), (a - ab).cast("double"))
    return rows.select("word", "total", "with_period", "before_number", "small", score.alias("score"))


@dataclass(frozen=True)
class Sentences:
    """A splitter (text to sentences) with what fit() learned."""

    abbreviations: frozenset[str] = frozenset()
    numbering: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two tokens."""
        word = re.sub(TRAILING, "", re.sub(LEADING, "", token))
        after = re.sub(LEADING, "", following)
        if not word or word[-1] not in ".!?…" or not after or after[0].islower():
            return False
        if word[-1] != "." or word == ".":
            return True
        stem = word[:-1].lower()
        if after[0].isdigit() and stem in self.numbering:
            return False
        if stem in self.abbreviations or "." in stem or len(stem) == 1 and stem.isalpha():
            return after[0].isupper() and re.sub(r"[.!?…]+$", "", re.sub(TRAILING, "", after)).lower() in self.common
        return True

    def __call__(self, text: str) -> list[str]:
        out = []
        for line in (text or "").splitlines():
            begin, before = 0, None
            for m in re.finditer(r"\S+", line):
                if before is not None and self.ends(before, m[0]):
                    out.append(line[begin : m.start()].strip())
                    begin = m.start()
                before = m[0]
            out.append(line[begin:].strip())
        return [s for s in out if s]


def fit(texts: DataFrame, most: int = 5000, least: int = 3) -> Sentences:
    """The splitter for texts like these. `most` bounds each of its lists, `least` is how often a word must stand to count."""
    counts = word_counts(texts.filter("text is not null"))
    rows = scored(counts).filter(F.col("with_period") >= least)
    best = rows.filter(F.col("score") >= SCORE).orderBy(F.desc("score"), "word").limit(most)
    numbered = rows.filter(2 * F.col("before_number") > F.col("with_period")).orderBy(F.desc("before_number"), "word").limit(most)
    common = counts.filter((2 * F.col("small") > F.col("total")) & (F.col("total") >= least) & F.col("word").rlike(r"^\p{L}+$")).orderBy(F.desc("total"), "word").limit(most)
    words = lambda df: frozenset(r["word"] for r in df.select("word").collect())
    return Sentences(words(best), words(numbered), words(common))
