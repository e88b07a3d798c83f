"""A learned embedder: word vectors from co-occurrence by randomised block power iteration, texts as weighted means.

Word pairs within a window are counted over all texts (each task sums its own before anything moves), turned into
positive pointwise mutual information, and the matrix's main directions are found by multiplying a block of random
vectors with it some times: a product is one job over the stored matrix, dealt by row, and only the block (rows of the
vocabulary by `dim`) comes back to the driver to be made orthogonal. The vocabulary's size is a parameter; all other words share `buckets` rows by hash,
so no word of a text is without a vector. Sums run in one order, so the same texts give the same vectors.

Null and empty texts count nothing and embed as zero vectors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.plans.settle import store

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class WordVectors:
    """An embedder (texts to unit vectors): the vocabulary's words first, then rows shared by hash."""

    words: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    buckets: int
    _rows: dict[str, int] = field(default_factory=dict, repr=False)

    def row(self, word: str) -> int:
        if not self._rows:
            self._rows.update((w, i) for i, w in enumerate(self.words))
        found = self._rows.get(word)
        return len(self.words) + zlib.crc32(word.encode()) % self.buckets if found is None else found

    def ids(self, text: str | None) -> np.ndarray:
        return np.array([self.row(w) for w in words_of(text)], np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for k, text in enumerate(texts):
            ids = self.ids(text)
            if len(ids):
                v = self.weights[ids] @ self.vectors[ids]
                out[k] = v / (np.linalg.norm(v) or 1.0)
        return out


def _pairs(model: WordVectors, window: int):
    """(i, j, n) of a task's pairs of rows, i <= j, each as often as it stands, by nearness."""
    size = len(model.words) + model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, np.int64)
            keys, weights = [], []
            for d in range(1, window + 1):
                a, b = ids[:-d], ids[d:]
                near = (a >= 0) & (b >= 0)
                for gap in range(1, d):
                    near &= ids[gap : len(ids) - d + gap] >= 0
                keys.append(np.minimum(a, b)[near] * size + np.maximum(a, b)[near])
                weights.append(np.full(near.sum(), window + 1 - d))
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(weights), len(own)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((own // size).astype(np.int32)), pa.array((own % size).astype(np.int32)), pa.array(total)], names=["i", "j", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                ids = model.ids(text)
                held += [ids, np.array([-1])]  # no pair spans two texts
                n += len(ids)
                if n >= 500_000:
                    yield flush()
                    held, n = [], 0
        yield flush()

    return run


def _product(block: np.ndarray):
    """Rows of matrix times block; a task holds whole rows, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            i, j, w = (b.column(c).to_numpy() for c in ("i", "j", "w"))
            if not len(i):
                continue
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            for row, v in zip(i[start].tolist(), np.add.reduceat(block[j] * w[:, None], start), strict=True):
                out[row] = out[row] + v if row in out else v
        rows = sorted(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([out[r].tolist() for r in rows], pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    out = np.zeros_like(block)
    for r in matrix.mapInArrow(_product(block), "i int, v array<double>").collect():
        out[r["i"]] = r["v"]
    return out


def fit(texts: DataFrame, dim: int = 64, vocabulary: int = 20_000, buckets: int = 1024, window: int = 5, rounds: int = 4, seed: int = 3) -> WordVectors:
    """Vectors of the words of texts (text). The driver holds blocks of (vocabulary + buckets) x dim numbers."""
    rows = texts.select("text").filter("text is not null")
    split = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    counts = rows.select(F.explode(F.array_distinct(split)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    n_texts = rows.count()
    idf = np.log((1 + n_texts) / (1 + np.array([r["n"] for r in top], float))) if top else np.zeros(0)
    # Rows shared by hash stand for rare words.
    weights = np.concatenate([idf, np.full(buckets, idf.max() if len(idf) else 1.0)])
    model = WordVectors([r["word"] for r in top], np.zeros((len(weights), dim)), weights, buckets)
    pairs = rows.mapInArrow(_pairs(model, window), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    half = store(pairs)
    both = half.union(half.filter("i <> j").select("j", "i", "n"))
    sums = np.zeros(len(weights))
    for r in both.groupBy("i").agg(F.sum("n").alias("n")).collect():
        sums[r["i"]] = r["n"]
    own = texts.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(sums) if x], "k int, s double")
    total = float(sums.sum())
    known = both.join(own.withColumnsRenamed({"k": "i", "s": "si"}), "i").join(own.withColumnsRenamed({"k": "j", "s": "sj"}), "j")
    ppmi = known.withColumn("w", F.log(F.col("n") * F.lit(total) / (F.col("si") * F.col("sj")))).filter("w > 0").select("i", "j", "w")
    # Dealt by row and sorted, so that every product sums in the same order.
    matrix = store(ppmi.repartition("i").sortWithinPartitions("i", "j")).repartition("i").sortWithinPartitions("i", "j")
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(weights), dim)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(_times(matrix, block))[0]
    values, turned = np.linalg.eigh(block.T @ _times(matrix, block))
    model.vectors = (block @ turned) * np.sqrt(np.abs(values))
    return model
