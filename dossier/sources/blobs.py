"""Filing documents: a write-through cache of blobs in Parquet, keyed by where they belong."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import blob_key

RETRIED = frozenset({429, 500, 502, 503, 504})
Fetch = Callable[[str], bytes]


class StatusError(RuntimeError):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def retrying(fetch: Fetch, attempts: int = 3, least_s: float = 2.0, most_s: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """fetch, tried again on lost connections, timeouts and passing statuses, after a random wait that doubles its bound."""

    def run(url: str) -> bytes:
        for k in range(attempts):
            try:
                return fetch(url)
            except (StatusError, ConnectionError, TimeoutError) as e:
                passing = not isinstance(e, StatusError) or e.status in RETRIED
                if not passing or k == attempts - 1:
                    raise
                sleep(max(least_s, random.uniform(0, min(most_s, least_s * 2**k))))
        raise AssertionError

    return run


def fetch_documents(wanted: DataFrame, cache: DataFrame, fetch: Fetch, lanes: int = 2, per_second: float = 10.0) -> DataFrame:
    """wanted: cik, accession_number, primary_doc_url. r2_key, body, error of the documents that cache (r2_key, body) lacks.

    The origin's limit holds for all: the lanes, a partition each, share it evenly. An error is a row, not a failed job.
    """
    keyed = wanted.withColumn("r2_key", blob_key(F.col("cik"), F.col("accession_number")))
    missing = keyed.join(cache.select("r2_key"), "r2_key", "left_anti").select("r2_key", "primary_doc_url").repartition(lanes, "r2_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, gap = retrying(fetch), lanes / per_second
        for b in batches:
            out = []
            for key, url in zip(b["r2_key"], b["primary_doc_url"], strict=True):
                began = time.monotonic()
                try:
                    if url is None:
                        raise ValueError("no document url")
                    out.append((key, get(url), None))
                except Exception as e:  # noqa: BLE001
                    out.append((key, None, type(e).__name__))
                time.sleep(max(0.0, gap - (time.monotonic() - began)))
            yield pd.DataFrame(out, columns=["r2_key", "body", "error"])

    return missing.mapInPandas(run, "r2_key string, body binary, error string")


def write(blobs: DataFrame, folder: str) -> None:
    """Bodies by key; a key that is written again is read as its latest body by read()."""
    blobs.filter("body is not null").select("r2_key", "body", F.current_timestamp().alias("at")).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.groupBy("r2_key").agg(F.max_by("body", "at").alias("body"))


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """path, html of files that lie in a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("content").cast("string").alias("html"))
