"""Operator 9: quality rules with adaptive thresholds.

Word, symbol, line and repetition counts are taken from every whole text. In place of fixed cutoffs, the limits of
each (lang, source) come from mergeable quantile summaries of its own documents that meet the base rules
(percentile_approx merges partial summaries before the shuffle, so a hot source is no hot task): a ratio may lie as
far beyond its outer quantile as REACH times the way from the median to there. The outer quantiles (RATIOS) are the
only settings; no limit is a constant. Shares are estimated with one more of either kind, (n + 1) / (of + 1), so that
where nearly all documents have none the limit follows from how long a group's documents are, and isn't zero. The share of
repeated lines is one of documents of SEVERAL lines or more, and judges those alone.
A group's limit is drawn towards its language's, and that towards the limit of all documents: each counts as its
documents do, the wider one as WEIGHT more. So a small group follows its language and a large one itself, and no
number of documents makes a jump. A document is kept if it meets the base rules and each ratio lies within the limits, which are
joined back on the group.

Null and empty texts have no words and fail the base rules. Null languages and sources form groups of their
own. Groups without a document that meets the base rules need no limits. Ties and repeated rows count as often
as they stand; a ratio equal to its limit is within.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import BLANKS, WORD, pick, reliable, small

#: Fixed values of the contract.
SYMBOLS, SPAN, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 8, 20, 30
#: Ratio: its inner and outer quantiles. Repetition has outer ones farther out, as the base rules have judged it already.
RATIOS = {"symbols_per_word": (0.5, 0.9), "dup_line_share": (0.5, 0.98), "repeat_share": (0.5, 0.98), "chars_per_word": (0.5, 0.9), "chars_per_word_least": (0.5, 0.1)}
#: How far beyond; documents that the wider group's limit counts as; accuracy of the summaries (relative rank error 1 / ACCURACY).
REACH, WEIGHT, ACCURACY = 4.0, 200, 10_000
#: Lines from which on the share of repeated ones tells something.
SEVERAL = 5
_word = re.compile(WORD)
_MIX = np.random.default_rng(9).integers(1, 2**63, SPAN, np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of SPAN words found twice or more."""
    if len(words) <= SPAN:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64) + np.uint64(1)
    if len(number) > len(words) - SPAN // 2:
        return 0  # fewer repeated words than a second window needs
    n = len(ids) - SPAN + 1
    h = np.zeros(n, np.uint64)
    for k in range(SPAN):
        x = ids[k : k + n] * _MIX[k]
        h += (x ^ (x >> np.uint64(29))) * _MIX[-1 - k]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + SPAN, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = _word.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [measure(t or "") for t in b.column(3).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * len(NAMES)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "lang", "source", *NAMES])

    return pick(docs, doc_id=id_col, lang=lang_col, source=source_col, text=text_col).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def limits(passing: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """of_lang, of_source and a limit for each of RATIOS, from rows with the ratios (of documents that meet the base rules); null where no document of any group has the ratio."""
    columns = {r: r.removesuffix("_least") for r in RATIOS}
    quantiles = [F.percentile_approx(columns[r], list(levels), ACCURACY).alias(r) for r, levels in RATIOS.items()]
    sets = passing.groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    found = sets.agg(F.grouping_id().alias("level"), F.struct(*[F.count(c).cast("double").alias(r) for r, c in columns.items()]).alias("n"), *quantiles)
    found = reliable(found.select("level", "lang", "source", "n", F.struct(*[(F.col(r)[1] + REACH * (F.col(r)[1] - F.col(r)[0])).alias(r) for r in RATIOS]).alias("own")))
    every = found.filter("level = 3").first()  # one row, or none without passing documents

    def drawn(wider: Column, r: str) -> Column:
        own, n = F.col("own")[r], F.col("n")[r]
        return F.when(own.isNull(), wider).when(wider.isNull(), own).otherwise((n * own + F.lit(float(weight)) * wider) / (n + F.lit(float(weight))))

    of_all = {r: F.lit(every["own"][r] if every else None).cast("double") for r in RATIOS}
    by_lang = found.filter("level = 1").select(F.col("lang").alias("l"), F.struct(*[drawn(of_all[r], r).alias(r) for r in RATIOS]).alias("of_lang_limits"))
    groups = found.filter("level = 0").join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    chosen = F.struct(*[drawn(F.col("of_lang_limits")[r], r).alias(r) for r in RATIOS])
    return groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), chosen.alias("limits"))


def apply(measured: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Adds base_failed, the ratios, their limits and kept to the rows of counts()."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    share = lambda n, of: (F.col(n) + 1) / (F.col(of) + 1)
    rows = reliable(
        measured.withColumns(
            {
                "base_failed": base,
                "symbols_per_word": share("n_symbols", "n_words"),
                "dup_line_share": F.when(F.col("n_lines") >= SEVERAL, share("n_dup_lines", "n_lines")),
                "repeat_share": share("n_repeat_words", "n_words"),
                "chars_per_word": share("word_chars", "n_words"),
            }
        )
    )
    found = limits(rows.filter(~F.col("base_failed")), weight)
    joined = rows.join(found, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    within = F.col("limits").isNotNull()
    for r in RATIOS:
        inside = F.col("chars_per_word") >= F.col("limits")[r] if r.endswith("_least") else F.col(r) <= F.col("limits")[r]
        within &= F.coalesce(inside, F.lit(True))
    return joined.drop("of_lang", "of_source").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
