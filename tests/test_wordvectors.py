"""The learned embedder: related texts nearer than unrelated ones, better than hashing, the same at each run."""

from __future__ import annotations

import random

import numpy as np
import pytest

from dossier.operators.embedding import hashed_embedder
from dossier.operators.wordvectors import fit


def topic_texts(n, seed):
    """Texts of 12 words out of their topic's 40, among common words: two of one topic share few words."""
    rng = random.Random(seed)
    make = random.Random(1)
    topics = [["".join(make.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(8)]
    common = ["the", "of", "and", "in", "to"]
    return [(k % 8, " ".join(rng.choice([*rng.sample(topics[k % 8], 1), rng.choice(common)]) for _ in range(24))) for k in range(n)]


def precision(vectors, labels, k=5):
    near = vectors @ vectors.T
    np.fill_diagonal(near, -9)
    best = near.argsort(1)[:, ::-1][:, :k]
    return (labels[best] == labels[:, None]).mean()


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.createDataFrame([*topic_texts(600, 2), (0, None), (0, ""), (0, "12 34")], "label int, text string").repartition(3), dim=16, vocabulary=300, buckets=8)


def test_related_texts_rank_first_on_held_out_texts(model):
    rows = topic_texts(160, 77)
    labels = np.array([label for label, _ in rows])
    learned, hashed = (precision(e([t for _, t in rows]), labels) for e in (model, hashed_embedder(16)))
    assert learned > 0.9 and hashed < 0.6


def test_the_same_texts_give_the_same_vectors(spark, model):
    again = fit(spark.createDataFrame([*topic_texts(600, 2)[::-1], (0, "34 12")], "label int, text string").repartition(2), dim=16, vocabulary=300, buckets=8)
    texts = [t for _, t in topic_texts(20, 5)]
    twice = fit(spark.createDataFrame([*topic_texts(600, 2)[::-1], (0, "34 12")], "label int, text string").repartition(2), dim=16, vocabulary=300, buckets=8)
    assert np.array_equal(again(texts), twice(texts))
    # Signs of directions are free; inner products aren't.
    assert np.allclose(again(texts) @ again(texts).T, model(texts) @ model(texts).T, atol=0.05)


def test_unknown_words_and_empty_texts(spark, model):
    v = model(["", "zzzz qqqq", "the zzzz", None])
    assert not v[0].any() and not v[3].any() and np.allclose(np.linalg.norm(v[1:3], axis=1), 1)
    empty = fit(spark.createDataFrame([], "text string"), dim=4, vocabulary=10, buckets=4)
    assert empty(["a b"]).shape == (1, 4)
