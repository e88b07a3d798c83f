"""Server-sent frames: bytes as they arrive to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = ("meta", "token", "citations", "done", "error")


def split_frames(arrivals: DataFrame) -> DataFrame:
    """arrivals: stream_id, seq, bytes. stream_id, at, frame for each complete frame.

    Line ends are made alike over the whole stream, so that a CR and LF that arrive apart stay one; what follows the last blank line is not complete yet.
    """
    joined = arrivals.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "bytes"))), lambda r: r["bytes"]), "").alias("text"))
    parts = joined.select("stream_id", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n\n").alias("parts"))
    complete = parts.select("stream_id", F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("at", "frame"))
    return complete.filter(F.length("frame") > 0)


def parse_frames(frames: DataFrame) -> DataFrame:
    """stream_id, at, event, data: known events with data; comments and pings are gone, data lines are joined by a line end."""
    lines = frames.withColumn("lines", F.split("frame", "\n"))
    value = lambda prefix: F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.regexp_replace(F.substr(x, F.lit(len(prefix) + 1)), "^ ", ""))
    rows = lines.select("stream_id", "at", F.try_element_at(value("event:"), F.lit(-1)).alias("event"), F.array_join(value("data:"), "\n").alias("data"))
    return rows.filter(F.col("event").isin(*EVENTS) & (F.col("data") != ""))
