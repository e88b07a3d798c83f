"""The fitted scorer against term overlap, on passages that took no part in fitting."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators.scorer import FEATURES, FittedScorer, fit, part_of, pools, questions
from dossier.operators.selection import overlap_score, rerank


@pytest.fixture(scope="module")
def passages(spark):
    """Passages of common and rarer words; long ones hold many common words by chance."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(800)]
    weights = [1 / (k + 3) for k in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([20, 40, 300])))) for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, "")], "chunk_id long, text string")


def mean_reciprocal_rank(pool, scorer):
    rows = rerank(pool, scorer).collect()
    own = {}
    for r in rows:
        own.setdefault(r["q"], []).append((r["rerank_score"], r["q"] != r["chunk_id"]))
    # Equal scores count against the right passage.
    return np.mean([1 / (1 + sum(s >= max(x for x, other in scores if not other) and other for s, other in scores)) for scores in own.values()])


def test_beats_term_overlap_on_held_out_passages(spark, passages):
    scorer = fit(passages)
    held = questions(passages.filter("text is not null").filter(part_of(F.col("chunk_id"), 20)))
    counts = passages.filter("text is not null").select(F.explode(F.array_distinct(F.split("text", " "))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    pool = pools(held, passages, counts, 20).join(held, "q").join(passages, "chunk_id").cache()
    fitted, overlap = mean_reciprocal_rank(pool, scorer), mean_reciprocal_rank(pool, overlap_score)
    assert fitted > overlap + 0.05 and fitted > 0.9
    again = fit(passages.repartition(3))
    assert np.allclose(again.weights, scorer.weights) and again.idf == scorer.idf


def test_features_by_hand():
    s = FittedScorer({"alpha": 1.0, "beta": 3.0}, 5.0)
    f = dict(zip(FEATURES, s.features("alpha beta gamma", "beta x alpha beta"), strict=True))
    assert f["idf"] == pytest.approx(4 / 9) and f["found"] == pytest.approx(2 / 3) and f["near"] == 1.0 and f["adjacent"] == 0.5
    assert f["cover"] == pytest.approx(np.log1p(10 * (0.05 + 0.1))) and f["often"] == pytest.approx((np.log(2) + 3 * np.log(3)) / 9)
    assert not s.features("", "a").any() and not s.features("alpha", None).any() and s("alpha", "alpha") == 0.0


def test_no_passages(spark):
    scorer = fit(spark.createDataFrame([], "chunk_id long, text string"))
    assert not scorer.weights.any() and scorer("a", "b") == 0.0
