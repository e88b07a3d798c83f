"""Rerank scores and the selection of passages under a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.lexemes import positions_of


def overlap_score(question: str, text: str) -> float:
    """The default scorer: the share of the question's lexemes that the text holds, and how often."""
    wanted = positions_of(question)
    held = positions_of(text)
    if not wanted:
        return 0.0
    return sum(min(3, len(held.get(w, ()))) for w in wanted) / len(wanted)


def rerank(pool: DataFrame, scorer: Callable[[str, str], float] = overlap_score) -> DataFrame:
    """pool with rerank_score of (question, text), a batch at a time; the scorer stands in for a cross-encoder."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for question, text in batches:
            yield pd.Series([float(scorer(q or "", t or "")) for q, t in zip(question, text, strict=True)], dtype="float64")

    return pool.withColumn("rerank_score", score("question", "text"))


def ranked_pairs(scored: DataFrame, floor: int, cap: int, by: list[str]) -> DataFrame:
    """scored (by, chunk_id, ticker, period_year, score) with each row's rank in its pair, the pair's rank, the number of pairs, and the floor that holds."""
    best = [F.desc("score"), F.col("chunk_id")]
    in_pair = scored.withColumn("in_pair", F.row_number().over(Window.partitionBy(*by, "ticker", "period_year").orderBy(*best)))
    tops = in_pair.filter("in_pair = 1")
    everything = Window.partitionBy(*by)
    pairs = tops.select(*by, "ticker", "period_year", F.row_number().over(everything.orderBy(*best)).alias("pair_rank"), F.count("*").over(everything).alias("n_pairs"))
    effective = F.when(F.col("n_pairs") * floor <= cap, F.lit(floor)).when(F.col("n_pairs") <= cap, F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("n_pairs")).cast("int"))).otherwise(F.lit(1))
    # a pair is a row of `pairs`; only its rank decides whether it is kept
    return in_pair.join(pairs, [*by, "ticker", "period_year"]).withColumns({"effective": effective, "kept": (F.col("n_pairs") <= cap) | (F.col("pair_rank") <= cap)})


def select_with_floor(scored: DataFrame, floor: int = 2, cap: int = 8, by: list[str] | None = None) -> DataFrame:
    """The chosen passages with their place, best first: every kept pair has its floor, the rest goes by score."""
    by = by or []
    rows = ranked_pairs(scored, floor, cap, by).filter("kept")
    chosen = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy((F.col("in_pair") > F.col("effective")).cast("int"), F.desc("score"), "chunk_id"))).filter(F.col("turn") <= cap)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    return chosen.withColumn("place", place).drop("turn", "in_pair", "pair_rank", "n_pairs", "effective", "kept")


def dropped_pairs(scored: DataFrame, floor: int = 2, cap: int = 8, by: list[str] | None = None) -> DataFrame:
    """Pairs for which the budget had no room."""
    by = by or []
    return ranked_pairs(scored, floor, cap, by).filter("not kept").select(*by, "ticker", "period_year").distinct()
