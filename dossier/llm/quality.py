"""Operator 1: quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is cut into blocks, each
block is compressed with either dictionary, and the normalised difference of the sums (with the ratio that
both reach) goes through a logistic calibration fitted in two folds on labelled texts that the fold's
dictionaries have not seen. Blocks keep the dictionaries' share alike in short and long texts; all blocks of a text count.

Only the labelled sample is bounded, by PER_CLASS ids of each label, with texts of SAMPLE_CHARS characters at most;
it is what the driver holds. Scoring is one pass without a shuffle. Null and empty texts get the
calibration's score for no difference. If a label is missing altogether, all scores are the share of
label 1. Ties, repeated rows and further columns don't matter; conflicting labels of one document all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import pick, small

PER_CLASS, SAMPLE_CHARS, BLOCK, DICT_BYTES, LEVEL = 3000, 20_000, 4096, 64_000, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def _sizes(data: bytes, compressors: tuple) -> tuple[int, int]:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
    return good, bad


def features(n_bytes: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """1, the normalised difference and its weight by evidence, and how far texts compress at all, which repeated words push down."""
    total = np.maximum(good + bad, 1)
    diff = (bad - good) / total
    size, ratio = np.log1p(n_bytes) / 5, np.log(np.maximum(total, 8) / np.maximum(2 * n_bytes, 8))
    return np.stack([np.ones(len(total)), 10 * diff, diff * size * 5, ratio, ratio**2, size, size**2, ratio * size], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)), x.T @ (y - p) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """docs: texts; labels: id and label 0 or 1, of the rows that may be learned from.

    The sample is chosen among the labels, the first per_class ids of each by a hash; these few ids alone go to the
    documents' tasks, so no text is shuffled and only the sample's texts (SAMPLE_CHARS at most, the
    first in order where an id repeats) come back.
    """
    known = pick(labels, doc_id=id_col, label=label_col)
    ids = [known.filter(F.col("label") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = ids[0].unionAll(ids[1])  # 2 x per_class rows at most
    rows = pick(docs, doc_id=id_col, text=text_col).filter(F.length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "label"])
    sample = [rows["text"][rows["label"] == y].tolist() for y in (0, 1)]
    bad, good = ([t.encode() for t in own] for own in sample)
    if len(bad) < 2 or len(good) < 2:
        share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * 7))
    seen, label = [], []
    for fold in (0, 1):  # sizes for the calibration come from dictionaries that have not seen the text
        compressors = tuple(_compressor(_train(own[1 - fold :: 2])) for own in (good, bad))
        for own, y in ((good, 1.0), (bad, 0.0)):
            seen += [(len(t), *_sizes(t, compressors)) for t in own[fold::2]]
            label += [y] * len(own[fold::2])
    n, g, b = np.array(seen, float).T
    return Model(_train(good), _train(bad), tuple(_logistic(features(n, g, b), np.array(label)).tolist()))


def _train(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their text itself is the dictionary
        return b"".join(texts)[-DICT_BYTES:]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every row, and the columns in keep as they are."""
    fields = {f.name: f for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = (_compressor(model.good), _compressor(model.bad)) if model.good else None
        w = np.array(model.weights)
        for b in small(batches):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            n = np.array([len(t) for t in texts], float)
            sizes = np.array([_sizes(t, compressors) if compressors else (0, 0) for t in texts], float).reshape(-1, 2)
            s = 1 / (1 + np.exp(-np.clip(features(n, sizes[:, 0], sizes[:, 1]) @ w, -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *b.columns[2:]], ["doc_id", "score", "predicted", *(f"keep_{c}" for c in keep)])

    chosen = pick(docs, doc_id=id_col, text=text_col, **{f"keep_{c}": c for c in keep})
    out = chosen.mapInArrow(run, "doc_id long, score double, predicted int" + "".join(f", `keep_{c}` {fields[c].dataType.simpleString()}" for c in keep))
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep if c not in ("doc_id",)})
