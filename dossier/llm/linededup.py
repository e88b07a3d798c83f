"""Operator 10 [native]: line dedup over levelled sorted runs of line hashes.

An index of line hashes is kept as runs: tables of (h1, h2, n_docs), bucketed and sorted by hash, all alike, so that
runs meet each other and a new batch without a shuffle. Documents come in batches. A batch counts its lines (summed
on the map side, so that a line in a third of all documents is a row for each task) and merge-anti-joins the
lines that the runs already hold often enough, which need no further counting; what is left is its own run on
level 0. When a level holds `fanout` runs, they are merged and summed into one run of the next level. Lines
counted in `min_docs` documents or more are then taken out of every document that holds them. Only DataFrame
operations.

Texts are hashed once; a document's line hashes stand in a table in the order of its lines, and what goes is told by
line numbers, so that a document of very many lines costs in proportion to them.

Keys are 128 bits of hash of the stripped, lower-cased line. Null and empty texts are one empty line; lines
without a key are never dropped. Rows that repeat a doc_id are documents of their own, null ids too.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import BLANKS, partitions, pick, shared_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(BLANKS))
    # lower() is the same for ASCII text, and much faster
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def line_hash(line: Column) -> Column:
    """h1, h2 of a line's key; null if the key is empty."""
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")))


class LineRuns:
    """Runs of (h1, h2, n_docs) in one shared folder, by level."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2) -> None:
        self.spark, self.folder, self.fanout, self.buckets = spark, folder, fanout, partitions(spark)
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        """Two runs meet bucket by bucket, without a shuffle; further ones need one, as keys then come from either side."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return a.join(b.withColumnRenamed("n_docs", "more"), ["h1", "h2"], "full_outer").select("h1", "h2", n.alias("n_docs"))

        return reduce(both, map(self.spark.table, names))

    def counts(self) -> DataFrame:
        """n_docs of every line of all runs."""
        names = [name for own in self.levels for name in own]
        return self._merge(names) if names else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")

    def unseen(self, lines: DataFrame, least: int = 1) -> DataFrame:
        """The merge-anti-join: rows of lines (h1, h2, ...) that the runs together don't hold `least` times.

        By outer joins, as Spark would push an anti-join below the aggregation that gives lines, and so shuffle every
        copy of a common line.
        """
        held = F.lit(0)
        for k, name in enumerate(name for own in self.levels for name in own):
            lines = lines.join(self.spark.table(name).withColumnRenamed("n_docs", f"_held{k}"), ["h1", "h2"], "left")
            held += F.coalesce(f"_held{k}", F.lit(0))
        return lines.filter(held < least).drop(*[c for c in lines.columns if c.startswith("_held")])

    def add(self, lines: DataFrame, frequent: int | None = None) -> None:
        """lines: h1, h2 once for each document. Lines that runs hold `frequent` times are left out."""
        run = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        if frequent and any(self.levels):
            run = self.unseen(run, frequent)
        self.levels[0].append(self._write(run, 0))
        for level, own in enumerate(self.levels):
            if len(own) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merge(own), level + 1))
                own.clear()


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, and the hashes of its lines in order, null where a line has no key."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return pick(docs, doc_id=id_col, text=text_col).select(row_key(), F.transform(lines, line_hash).alias("lines"))


def row_key() -> Column:
    """Tells apart rows of one doc_id with different texts; equal rows lose the same lines."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("t")).alias("row")


def once(rows: DataFrame) -> DataFrame:
    """h1, h2 of each of a row's lines once; by sorting within the row."""
    ordered = rows.select(F.sort_array(F.filter("lines", lambda h: h.isNotNull())).alias("s"))
    first = F.filter("s", lambda h, i: F.when(i == 0, True).otherwise(h != F.get(F.col("s"), i - 1)))
    return ordered.select(F.explode(first).alias("h")).select("h.h1", "h.h2")


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of docs, and the columns in keep as they are."""
    spark = docs.sparkSession
    runs = LineRuns(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}")
    keys = stored(hashed(docs, id_col, text_col))
    for k in range(batches):
        runs.add(once(keys.filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(batches)) == k)), frequent=min_docs)
    # Stored, so that its size is known when Spark chooses how to join it.
    frequent = stored(runs.counts().filter(F.col("n_docs") >= min_docs).select("h1", "h2"))
    marks = keys.select("row", F.posexplode("lines").alias("at", "h")).select("row", "at", "h.h1", "h.h2").join(frequent, ["h1", "h2"])
    dropped = marks.groupBy(F.col("row").alias("of_row")).agg(F.collect_set("at").alias("dropped"))
    rows = pick(docs, doc_id=id_col, text=text_col, **{f"keep_{c}": c for c in keep}).withColumn("row", row_key())
    joined = rows.join(dropped, F.col("row") == F.col("of_row"), "left")
    names = [f"keep_{c}" for c in keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1
    parts = joined.select("doc_id", n_lines.cast("long").alias("n_lines"), text.alias("text"), F.when(F.col("dropped").isNotNull(), F.split(text, "\n", -1)).alias("lines"), "dropped", *names)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    gone = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long")
    return parts.select("doc_id", "n_lines", gone.alias("n_dropped"), kept.alias("text"), *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])
