"""Filing listings: columnar JSON to rows, pruning of overflow pages, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import bare
from dossier.operators.retrieval import first_of_each

BLOCK = "struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>"
PAGE = "struct<name: string, filingFrom: string, filingTo: string>"
SUBMISSIONS = f"cik string, filings struct<recent: {BLOCK}, files: array<{PAGE}>>"
FIELDS = ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument"]
FORMS, FROM, TO = ("10-K", "10-Q"), "2022-01-01", "2026-12-31"
# Fixed value: where the archive keeps documents.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Landed submissions files, one document in each."""
    return spark.read.schema(SUBMISSIONS).json(path, multiLine=True)


def unnest(blocks: DataFrame, forms: tuple[str, ...] = FORMS, date_from: str = FROM, date_to: str = TO) -> DataFrame:
    """blocks: cik, block, and any order columns. Filings of the forms within the dates; arrays are read up to the shortest, a missing one is empty."""
    arrays = {f: F.coalesce(F.col(f"block.{f}"), F.expr("cast(array() as array<string>)")) for f in FIELDS}
    n = F.least(*[F.size(a) for a in arrays.values()])
    cut = [F.slice(a, F.lit(1), n).alias(f) for f, a in arrays.items()]
    rows = blocks.select(*[c for c in blocks.columns if c != "block"], F.posexplode(F.arrays_zip(*cut)).alias("at", "r"))
    flat = rows.select(*[c for c in rows.columns if c != "r"], *[F.col("r").getField(f).alias(f) for f in FIELDS])
    filed = F.try_to_date("filingDate")
    # a row with an unreadable date is out of every window
    kept = flat.filter(F.col("form").isin(*forms) & filed.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    period = F.try_to_date(F.coalesce(F.nullif("reportDate", F.lit("")), "filingDate"))
    url = F.concat(F.lit(ARCHIVE), F.col("cik").cast("bigint").cast("string"), F.lit("/"), bare(F.col("accessionNumber")), F.lit("/"), F.col("primaryDocument"))
    return kept.select(*[c for c in blocks.columns if c != "block"], "at", F.col("form").alias("filing_type"), filed.alias("filing_date"), period.alias("period_end"), F.col("accessionNumber").alias("accession_number"), url.alias("primary_doc_url"))


def overlaps(page_from: Column, page_to: Column, date_from: str = FROM, date_to: str = TO) -> Column:
    """Whether a page may hold filings of the window, both ends included; pages with unusable bounds are kept."""
    lo, hi = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    return F.coalesce((F.try_to_date(page_to) >= lo) & (F.try_to_date(page_from) <= hi), F.lit(True))


def pages(submissions: DataFrame, date_from: str = FROM, date_to: str = TO) -> DataFrame:
    """cik, page_no, name of the overflow pages to fetch."""
    rows = submissions.select("cik", F.posexplode("filings.files").alias("page_no", "p"))
    return rows.filter(overlaps(F.col("p.filingFrom"), F.col("p.filingTo"), date_from, date_to)).select("cik", "page_no", "p.name")


def list_filings(submissions: DataFrame, overflow: DataFrame, forms: tuple[str, ...] = FORMS, date_from: str = FROM, date_to: str = TO) -> DataFrame:
    """All filings of the window, recent ones first, each accession once. overflow: cik, name, block of landed pages."""
    recent = submissions.select("cik", F.lit(-1).alias("page_no"), F.col("filings.recent").alias("block"))
    more = pages(submissions, date_from, date_to).join(overflow, ["cik", "name"]).select("cik", "page_no", "block")
    return first_of_each(unnest(recent.unionByName(more), forms, date_from, date_to), ["cik", "accession_number"], ["page_no", "at"])
