"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and are stripped from line ends (fixed values of the contracts).
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a longest run of other characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: computed once, and safe when executors go."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: as reliable(), in Parquet's size."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that further columns of df can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many, so that few texts at a time become Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int, size: str | None = None) -> Iterator[pa.Table]:
    """Tables of about so many rows (or bytes of column size) of sorted batches, that don't part rows equal in by.

    Each batch is looked at once; a group larger than that is one table.
    """
    held: list[pa.RecordBatch] = []
    weight, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        ends = [v[-1] for v in values]
        if weight >= rows:  # until the first border from here on
            new = np.logical_or.reduce([np.r_[v[0] != x, v[1:] != v[:-1]] for v, x in zip(values, last, strict=True)])
            if new.any():
                cut = int(new.argmax())
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held, weight, b = [], 0, b.slice(cut)
        held.append(b)
        weight += b.column(size).nbytes if size else b.num_rows
        last = ends
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the start and length of each value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], np.diff(offsets)
