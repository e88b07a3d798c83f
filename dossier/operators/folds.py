"""Folds over an order: batches, paces, quotas, breakers.

Over tables they are segmented scans (dossier.operators.scans), for groups of any length. Over a short array within a
row, batch_numbers(), bucket_waits() and breaker_states() are aggregate expressions; streams without end have state
in dossier.streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.scans import Batches, Breaker, Bucket, Quota, scan


def batch_numbers(counts: Column, most: int) -> Column:
    """counts: array of token counts in order. The number of each one's batch, from 0: a new one begins where the sum would exceed most; a count above most stands alone."""
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("bigint").alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, n: Column) -> Column:
        new = (s["batch"] < 0) | (s["sum"] + n > most)
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(new, n.cast("bigint")).otherwise(s["sum"] + n).alias("sum"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(counts, start, step, lambda s: s["out"])


def numbered_batches(rows: DataFrame, by: list[str], order: list[str], tokens: str, most: int) -> DataFrame:
    """rows with `batch` as batch_numbers() counts it, in order of `order` and tokens within each group of `by`, of any length; null tokens count as 0."""
    return scan(rows, by, order, Batches(tokens, most))


def waits(requests: DataFrame, by: list[str], order: list[str], at: str, tokens: str, capacity: float, rate: float, start_full: bool = True, debt: bool = False) -> DataFrame:
    """requests with `wait` as bucket_waits() finds it, within each group of `by`, of any length; debt serves requests above the capacity too."""
    return scan(requests, by, order, Bucket(at, tokens, capacity, rate, start_full, debt))


def replay(outcomes: DataFrame, by: list[str], order: list[str], at: str, outcome: str, threshold: int = 3, reset_s: float = 30.0) -> DataFrame:
    """outcomes with `state` and `served` as breaker_states() finds them, within each group of `by`, of any length."""
    return scan(outcomes, by, order, Breaker(at, outcome, threshold, reset_s))


def bucket_waits(requests: Column, capacity: float, rate: float, start_full: bool = True) -> Column:
    """requests: array of struct<at: double, tokens: double> in order. The seconds each waits at a token bucket of the capacity, refilled at rate a second.

    A request above the capacity can never be served and fails the job.
    """
    start = F.struct(F.lit(float(capacity) if start_full else 0.0).alias("level"), F.lit(0.0).alias("clock"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, r: Column) -> Column:
        now = F.greatest(s["clock"], r["at"])
        level = F.least(F.lit(float(capacity)), s["level"] + (now - s["clock"]) * rate)
        need = F.when(r["tokens"] > capacity, F.raise_error(F.lit("a request exceeds the bucket's capacity")).cast("double")).otherwise(r["tokens"])
        wait = F.greatest(F.lit(0.0), (need - level) / rate)
        return F.struct((level + wait * rate - need).alias("level"), (now + wait).alias("clock"), F.concat(s["out"], F.array(now + wait - r["at"])).alias("out"))

    return F.aggregate(requests, start, step, lambda s: s["out"])


def tokens_per_second(per_minute: int) -> float:
    return per_minute / 60


def breaker_states(outcomes: Column, threshold: int = 3, reset_s: float = 30.0) -> Column:
    """outcomes: array of struct<at: double, outcome: string> in order; outcome is ok, soft, hard, or hard_midstream.

    For each: struct<state (before it), served>: what the breaker was, and whether the answer came from the model, the
    fallback, or not at all (error). An open breaker asks nobody; after reset_s one probe goes through.
    """
    start = F.struct(F.lit(0).alias("streak"), F.lit(None).cast("double").alias("opened"), F.expr("cast(array() as array<struct<state: string, served: string>>)").alias("out"))

    def step(s: Column, o: Column) -> Column:
        state = F.when(s["opened"].isNull(), "closed").when(o["at"] - s["opened"] >= reset_s, "half_open").otherwise("open")
        hard = o["outcome"].isin("hard", "hard_midstream")
        asked = state != "open"
        streak = F.when(~asked, s["streak"]).when(hard, s["streak"] + 1).when(o["outcome"] == "ok", F.lit(0)).otherwise(s["streak"])
        opened = F.when(~asked, s["opened"]).when(hard & (streak >= threshold), o["at"]).when(o["outcome"] == "ok", F.lit(None)).otherwise(s["opened"])
        served = F.when(~asked | (o["outcome"] == "hard"), "fallback").when(o["outcome"] == "ok", "model").otherwise("error")
        return F.struct(streak.cast("int").alias("streak"), opened.cast("double").alias("opened"), F.concat(s["out"], F.array(F.struct(state.alias("state"), served.alias("served")))).alias("out"))

    return F.aggregate(outcomes, start, step, lambda s: s["out"])


def is_hard(status: Column, kind: Column) -> Column:
    """5xx, timeouts and lost connections count against the breaker; 429 and other 4xx don't."""
    return F.coalesce(kind.isin("timeout", "connection"), F.lit(False)) | F.coalesce(status.between(500, 599), F.lit(False))


def running_quota(rows: DataFrame, tokens: str, order: list[str], grant: int, by: list[str] | None = None) -> DataFrame:
    """rows with the tokens used so far and whether they have reached 80 % of the grant."""
    return scan(rows, by or [], order, Quota(tokens, int(0.8 * grant)))
