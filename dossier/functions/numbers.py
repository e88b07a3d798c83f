"""Number, date and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repair_years(years: Column) -> Column:
    """Numbers that are several four-digit years written together are split; then the first of each is kept, in order."""

    def split(y: Column) -> Column:
        digits = y.cast("string")
        n = F.length(digits)
        merged = (n > 4) & (n % 4 == 0) & digits.rlike(r"^\d+$")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(4)), lambda at: F.substring(digits, at, F.lit(4)).try_cast("int"))
        return F.when(merged, pieces).otherwise(F.array(y.try_cast("int")))

    return F.array_distinct(F.flatten(F.transform(years, split)))


def backoff_s(attempt: Column, base: float = 2.0, most: float = 300.0) -> Column:
    """Seconds to wait after an attempt, counted from 1: doubling, up to most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def retry_at(failed_at: Column, attempts: Column, base: float = 2.0, most: float = 300.0) -> Column:
    """When a failed filing may be tried again; at once if it is not known when it failed."""
    return failed_at + F.make_dt_interval(secs=backoff_s(attempts, base, most).cast("decimal(18,6)"))


def effective_floor(n_pairs: Column, floor: int, cap: int) -> Column:
    return F.when(n_pairs * floor <= cap, floor).when(n_pairs <= cap, F.greatest(F.lit(1), F.floor(F.lit(cap) / n_pairs).cast("int"))).otherwise(1)


def quota_threshold(grant: Column) -> Column:
    """The share of a token grant at which the fallback takes over."""
    return (grant * 0.8).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def rrf(rank: Column, c: int) -> Column:
    """A ranking's share in reciprocal rank fusion, in double precision."""
    return F.lit(1.0) / (F.lit(float(c)) + rank)
