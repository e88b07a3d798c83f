"""Schemas of the tables and records, and their constraints as checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANIES = "ticker string, name string, cik string, sector string, created_at timestamp, sic_code string, fiscal_year_end string"
FILINGS = "filing_id string, ticker string, filing_type string, filing_date date, period_end date, accession_number string, status string, created_at timestamp, cik string, r2_key string, primary_doc_url string"
CHUNKS = "chunk_id string, filing_id string, chunk_index int, section string, text string, embedding array<float>, embedding_model_version string, token_count int, created_at timestamp, section_order int, metadata map<string,string>"
JOBS = "job_id string, filing_id string, status string, error string, started_at timestamp, completed_at timestamp, created_at timestamp, step string"
#: The log of questions; events of ask() are written to it.
QUERIES = "query_id string, user_id string, question string, answer string, retrieved_chunk_ids array<string>, latency_ms int, tokens_used int, created_at timestamp, request_id string, tickers array<string>, intent string, confidence string, status string, error string, trace_id string, metadata map<string,string>"
SECTION = "struct<name: string, item_key: string, section_order: int, text: string, char_count: int, metadata: map<string,string>>"
CHUNK = "struct<text: string, token_count: int, section: string, section_order: int, chunk_index: int, metadata: map<string,string>>"
PLAN = "struct<tickers: array<string>, intent: string, time_range: struct<years: array<int>>, sub_questions: array<string>, entities: array<string>, unresolved_companies: array<string>>"
VERDICT = "struct<reasoning: string, sufficient: boolean>"

#: Domains of the tables' columns.
DOMAINS = {
    ("filings", "filing_type"): ("10-K", "10-Q"),
    ("filings", "status"): ("pending", "processing", "processed", "failed"),
    ("jobs", "status"): ("queued", "running", "done", "failed"),
    ("jobs", "step"): ("download", "parse", "chunk", "embed", "upsert"),
    ("queries", "confidence"): ("low", "high"),
    ("queries", "intent"): ("comparative", "temporal", "factual", "qualitative"),
    ("queries", "status"): ("ok", "error"),
}
KEYS = {"companies": [["cik"], ["ticker"]], "filings": [["filing_id"], ["accession_number"]], "chunks": [["chunk_id"], ["filing_id", "chunk_index"]], "jobs": [["job_id"]]}
PARENTS = {"filings": ("cik", "companies"), "chunks": ("filing_id", "filings"), "jobs": ("filing_id", "filings")}
CIK, ACCESSION = r"^\d{10}$", r"^\d{10}-\d{2}-\d{6}$"


def in_domain(table: str, column: str) -> Column:
    """Null is in every domain, as in SQL's CHECK."""
    return F.coalesce(F.col(column).isin(*DOMAINS[table, column]), F.lit(True))


def violations(table: str, df: DataFrame, parent: DataFrame | None = None) -> DataFrame:
    """constraint, n: the constraints of a table that rows break, and how many do."""
    checks = [(f"{c} in domain", df.filter(~in_domain(t, c))) for t, c in DOMAINS if t == table]
    if table == "filings":
        checks += [("cik format", df.filter(~F.col("cik").rlike(CIK))), ("accession format", df.filter(~F.col("accession_number").rlike(ACCESSION)))]
    for key in KEYS.get(table, []):
        checks.append((f"unique {', '.join(key)}", df.groupBy(*key).count().filter("count > 1")))
    if parent is not None and table in PARENTS:
        column = PARENTS[table][0]
        checks.append((f"{column} has a parent", df.join(parent.select(column), column, "left_anti")))
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("constraint"), "n") for name, rows in checks]
    return reduce(DataFrame.unionAll, counted).filter("n > 0")
