"""The retry ledger: attempts and the status of filings, derived from job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.numbers import backoff_s

REAPED = "reaped: left running by an earlier run"


def attempts(jobs: DataFrame) -> DataFrame:
    """filing_id, attempts, last_failed."""
    return jobs.groupBy("filing_id").agg(F.count("*").alias("attempts"), F.max(F.when(F.col("status") == "failed", F.col("completed_at"))).alias("last_failed"))


def status_of(n_attempts: Column, last_status: Column, most: int = 3) -> Column:
    """A filing's status from its attempts and its last job's status."""
    return F.when(last_status == "done", "processed").when(last_status.isNull(), "pending").when((last_status == "failed") & (n_attempts >= most), "failed").otherwise("processing")


def statuses(filings: DataFrame, jobs: DataFrame, most: int = 3) -> DataFrame:
    """filing_id, attempts, status, from the ledger alone."""
    last = jobs.groupBy("filing_id").agg(F.count("*").alias("attempts"), F.max_by("status", F.struct("started_at", "job_id")).alias("last_status"))
    rows = filings.select("filing_id").join(last, "filing_id", "left")
    return rows.select("filing_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), status_of(F.col("attempts"), F.col("last_status"), most).alias("status"))


def startable(filings: DataFrame, jobs: DataFrame, most: int = 3) -> DataFrame:
    """filings with attempts and may_start."""
    counted = filings.join(attempts(jobs).select("filing_id", "attempts"), "filing_id", "left").fillna(0, ["attempts"])
    return counted.withColumn("may_start", F.col("attempts") < most)


def start(claimed: DataFrame, jobs: DataFrame, at: Column, most: int = 3) -> DataFrame:
    """Rows to add to the ledger: a running job for each claimed filing that has attempts left."""
    rows = startable(claimed.select("filing_id").distinct(), jobs, most).filter("may_start")
    n = F.col("attempts") + 1
    return rows.select(F.sha2(F.concat_ws("/", "filing_id", n.cast("string")), 256).alias("job_id"), "filing_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), at.alias("created_at"), F.lit(None).cast("string").alias("step"))


def record_step(job: DataFrame, step: str) -> DataFrame:
    return job.withColumn("step", F.lit(step))


def complete(job: DataFrame, at: Column) -> DataFrame:
    return job.withColumns({"status": F.lit("done"), "completed_at": at})


def fail(job: DataFrame, error: Column, at: Column) -> DataFrame:
    """The jobs as failed at their step; the error is cut to 2000 characters."""
    return job.withColumns({"status": F.lit("failed"), "error": F.left(error, F.lit(2000)), "completed_at": at})


def reap(jobs: DataFrame, at: Column) -> DataFrame:
    """jobs with those left running failed; their step stays."""
    stale = F.col("status") == "running"
    return jobs.withColumns({"error": F.when(stale, REAPED).otherwise(F.col("error")), "completed_at": F.when(stale, at).otherwise(F.col("completed_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def claim(filings: DataFrame, jobs: DataFrame, now: Column, limit: int, most: int = 3, base_s: float = 2.0, max_s: float = 300.0, limit_first: bool = False) -> DataFrame:
    """At most limit filings to work on: pending ones first, then those whose backoff has passed, oldest first.

    limit_first restores the reference's order, in which filings that still wait use up the limit.
    """
    rows = filings.filter(F.col("status").isin("pending", "processing")).join(attempts(jobs), "filing_id", "left").fillna(0, ["attempts"])
    pending = F.col("status") == "pending"
    wait = F.col("last_failed") + F.make_dt_interval(secs=backoff_s(F.greatest(F.col("attempts"), F.lit(1)), base_s, max_s).cast("decimal(18,6)"))
    ready = F.col("last_failed").isNull() | (wait <= now)
    alive = rows.filter(pending | ((F.col("attempts") > 0) & (F.col("attempts") < most)))
    order = [(~pending).cast("int"), F.col("created_at"), F.col("filing_id")]
    if limit_first:
        return alive.orderBy(*order).limit(limit).filter(pending | ready)
    return alive.filter(pending | ready).orderBy(*order).limit(limit)
