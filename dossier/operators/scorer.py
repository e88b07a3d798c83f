"""A fitted scorer of (question, text): pairwise logistic ranking over idf, cover and proximity.

Training needs no labels: a question is some neighbouring words of a passage, its own passage is to rank above others that share
the question's rarest words. Each such pair is one row, the difference of the two texts' features. Newton's steps fit the weights: every task
sums its rows' gradient and curvature, tasks' sums meet in two levels, and a step brings one row to the driver.

The scorer keeps a weight for each feature and the idf of the `most` commonest words; other words count as the
rarest. Passages are chosen by the hash of their id, so the same passages give the same scorer; `held_out` of 100 take no part, for measuring.
Null and empty texts have no questions, and score by zero features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.lexemes import cover_density_of, positions_of, query_lexemes, to_lexemes
from dossier.operators.retrieval import rank_within
from dossier.plans.settle import store

FEATURES = ["idf", "found", "often", "cover", "near", "adjacent", "length"]


@dataclass
class FittedScorer:
    idf: dict[str, float]
    rarest: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))

    def features(self, question: str | None, text: str | None) -> np.ndarray:
        wanted, held = positions_of(question), positions_of(text)
        if not wanted or not held:
            return np.zeros(len(FEATURES))
        value = {w: self.idf.get(w, self.rarest) for w in wanted}
        found = [w for w in wanted if w in held]
        total = sum(value.values())
        often = sum(value[w] * math.log1p(len(held[w])) for w in found)
        order = sorted(wanted, key=lambda w: wanted[w][0])
        pairs = list(zip(order, order[1:], strict=False))
        adjacent = sum(any(p + 1 in set(held[b]) for p in held[a]) for a, b in pairs if a in held and b in held)
        cover = cover_density_of([held[w] for w in found]) if found else 0.0
        return np.array([sum(value[w] for w in found) / total, len(found) / len(wanted), often / total, math.log1p(10 * cover), self._near([held[w] for w in found]), adjacent / max(1, len(pairs)), math.log1p(sum(map(len, held.values())))])

    def _near(self, positions: list[list[int]]) -> float:
        """The found terms' number over the length of the shortest stretch that holds one of each."""
        if not positions:
            return 0.0
        events = sorted((at, k) for k, own in enumerate(positions) for at in own)
        last: dict[int, int] = {}
        best = math.inf
        for at, k in events:
            last[k] = at
            if len(last) == len(positions):
                best = min(best, at - min(last.values()) + 1)
        return len(positions) / best

    def __call__(self, question: str | None, text: str | None) -> float:
        return float(self.features(question, text) @ self.weights)


def part_of(key: Column, held_out: int) -> Column:
    """Whether a passage is held out, by its id."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(100)) < held_out


def questions(passages: DataFrame, words: int = 8) -> DataFrame:
    """q, question: neighbouring words of each passage (chunk_id, text) without each fourth, from a place that its id's hash chooses."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = passages.select(F.col("chunk_id").alias("q"), w.alias("w")).filter(F.size("w") >= words)
    at = F.pmod(F.xxhash64("q", F.lit(5)), F.size("w") - words + 1).cast("int")
    return rows.select("q", F.array_join(F.filter(F.slice("w", at + 1, words), lambda _, i: i % 4 != 3), " ").alias("question"))


def pools(asked: DataFrame, passages: DataFrame, counts: DataFrame, size: int = 8, terms: int = 4) -> DataFrame:
    """q, chunk_id: for each question its own passage and up to `size` others that share most of its `terms` rarest lexemes."""
    each = asked.select("q", F.explode(query_lexemes("question")).alias("term")).join(counts, "term")
    rare = rank_within(each, ["q"], [F.col("n"), F.col("term")], terms, "nth").select("q", "term")
    held = passages.select("chunk_id", F.explode(F.map_keys(to_lexemes("text"))).alias("term"))
    met = held.join(rare, "term").filter("chunk_id <> q").groupBy("q", "chunk_id").agg(F.count("*").alias("n"))
    others = rank_within(met, ["q"], [F.desc("n"), F.col("chunk_id")], size).select("q", "chunk_id")
    return others.unionByName(asked.select("q", F.col("q").alias("chunk_id")))


def fit(passages: DataFrame, most: int = 50_000, held_out: int = 20, rounds: int = 8, ridge: float = 1e-2) -> FittedScorer:
    """The scorer of passages (chunk_id, text)."""
    rows = store(passages.select("chunk_id", "text").filter("text is not null"))
    counts = store(rows.select(F.explode(F.map_keys(to_lexemes("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    n = rows.count()
    common = counts.orderBy(F.desc("n"), "term").limit(most).collect()
    scorer = FittedScorer({r["term"]: math.log((n + 1) / (r["n"] + 0.5)) for r in common}, math.log((n + 1) / 1.5) if n else 1.0)
    asked = store(questions(rows.filter(~part_of(F.col("chunk_id"), held_out))))
    pool = pools(asked, rows, counts).join(asked, "q").join(rows, "chunk_id")

    @F.pandas_udf("array<double>")
    def features(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([scorer.features(q, t).tolist() for q, t in zip(question, text, strict=True)])

    seen = store(pool.select("q", (F.col("q") == F.col("chunk_id")).alias("own"), features("question", "text").alias("f")))
    own = seen.filter("own").select("q", F.col("f").alias("g"))
    pairs = store(seen.filter("not own").join(own, "q").select(F.zip_with("g", "f", lambda a, b: a - b).alias("d")))
    k = len(FEATURES)

    def sums(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                x = b.column("d").flatten().to_numpy().reshape(-1, k)
                p = 1 / (1 + np.exp(np.clip(x @ weights, -30, 30)))
                total += np.concatenate([x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"s{j}" for j in range(len(total))])

        return run

    names = [f"s{j}" for j in range(k + k * k)]
    for _ in range(rounds):
        parts = pairs.mapInArrow(sums(scorer.weights), ", ".join(f"{c} double" for c in names))
        halfway = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("branch")).agg(*[F.sum(c).alias(c) for c in names])
        total = halfway.agg(*[F.sum(c).alias(c) for c in names]).first()
        s = np.array([total[c] or 0.0 for c in names])
        gradient = s[:k] - ridge * scorer.weights
        scorer.weights = scorer.weights + np.linalg.solve(s[k:].reshape(k, k) + (ridge + 1e-9) * np.eye(k), gradient)
    return scorer
