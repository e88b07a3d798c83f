"""Streams: ingest of landed documents, and stateful pacing and breaking by service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators.chunking import Packer, chunk_sections, number_chunks
from dossier.operators.embedding import Embedder, embed_documents, hashed_embedder
from dossier.operators.merges import Table, upsert_chunks
from dossier.operators.sections import detect

LANDED = "doc_id string, form_type string, html string"


def ingest_stream(spark: SparkSession, folder: str, chunks: Table, checkpoint: str, model: str = "hashed-64", embedder: Embedder | None = None, packer: Packer | None = None, schema: str = LANDED) -> StreamingQuery:
    """Documents that land as Parquet in folder are chunked, embedded and merged once each; ends when all there is has been read.

    Each micro-batch commits one version of the table with its id, so that a batch which is tried again after a failure changes nothing twice.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        numbered = embed_documents(number_chunks(chunk_sections(detect(batch), packer)), embedder or hashed_embedder(), model)
        rows = numbered.select(F.sha2(F.concat_ws("/", "doc_id", F.col("chunk_index").cast("string")), 256).alias("chunk_id"), F.col("doc_id").alias("filing_id"), "chunk_index", "section", "text", "embedding", "embedding_model_version", "token_count", F.current_timestamp().alias("created_at"), "section_order", "metadata")
        chunks.update(lambda now: upsert_chunks(now, rows), f"{checkpoint}-{batch_id}")

    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Fold = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def stateful(rows: DataFrame, by: str, fold: Callable, output: str, state: str) -> DataFrame:
    """fold(state or None, rows in order) -> (state, output rows) for each key's rows of a micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values(["at", "seq"])
        now, out = fold(held.get if held.exists else None, own)
        held.update(now)
        out.insert(0, by, key[0])
        yield out

    return rows.groupBy(by).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def breaker_stream(outcomes: DataFrame, threshold: int = 3, reset_s: float = 30.0) -> DataFrame:
    """outcomes: service, seq, at (seconds), outcome. service, seq, state, served, as dossier.operators.folds.breaker_states, for streams without end."""

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        streak, opened = held or (0, -1.0)
        out = []
        for seq, at, outcome in zip(rows["seq"], rows["at"], rows["outcome"], strict=True):
            state = "closed" if opened < 0 else "half_open" if at - opened >= reset_s else "open"
            served = "fallback"
            if state != "open":
                if outcome == "ok":
                    streak, opened, served = 0, -1.0, "model"
                elif outcome in ("hard", "hard_midstream"):
                    streak += 1
                    opened = float(at) if streak >= threshold else opened
                    served = "fallback" if outcome == "hard" else "error"
                else:
                    served = "error"
            out.append((seq, state, served))
        return (int(streak), float(opened)), pd.DataFrame(out, columns=["seq", "state", "served"])

    return stateful(outcomes, "service", fold, "service string, seq long, state string, served string", "streak int, opened double")


def pacing_stream(requests: DataFrame, capacity: float, rate: float, start_full: bool = False) -> DataFrame:
    """requests: service, seq, at, tokens. service, seq, wait: how long each request of a stream waits at its service's token bucket."""

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        level, clock = held or (capacity if start_full else 0.0, 0.0)
        out = []
        for seq, at, tokens in zip(rows["seq"], rows["at"], rows["tokens"], strict=True):
            if tokens > capacity:
                raise ValueError("a request exceeds the bucket's capacity")
            now = max(clock, float(at))
            level = min(capacity, level + (now - clock) * rate)
            wait = max(0.0, (tokens - level) / rate)
            level, clock = level + wait * rate - tokens, now + wait
            out.append((seq, clock - float(at)))
        return (float(level), float(clock)), pd.DataFrame(out, columns=["seq", "wait"])

    return stateful(requests, "service", fold, "service string, seq long, wait double", "level double, clock double")


def landed_requests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
