"""Discovery and ingest of filings as batch jobs over the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.config import Settings
from dossier.functions.text import blob_key
from dossier.operators import ledger
from dossier.operators.chunking import Packer, chunk_sections, number_chunks
from dossier.operators.embedding import Embedder, embed_documents, hashed_embedder
from dossier.operators.merges import Table, check_models, outcomes, upsert_chunks, upsert_filings
from dossier.operators.sections import detect
from dossier.plans.settle import settle
from dossier.sources.submissions import list_filings


def discover(submissions: DataFrame, overflow: DataFrame, companies: DataFrame, filings: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged filings and a report of outcomes."""
    now = F.current_timestamp() if now is None else now
    found = list_filings(submissions.join(companies.select("cik"), "cik", "left_semi"), overflow).join(companies.select("cik", "ticker"), "cik")
    source = found.select(
        F.sha2("accession_number", 256).alias("filing_id"), "ticker", "filing_type", "filing_date", "period_end", "accession_number", F.lit("pending").alias("status"), now.alias("created_at"), "cik", blob_key(F.col("cik"), F.col("accession_number")).alias("r2_key"), "primary_doc_url",
    )
    merged = upsert_filings(filings, source)
    return merged.drop("outcome"), outcomes(merged)


def parse_documents(claimed: DataFrame, blobs: DataFrame, packer: Packer, embedder: Embedder, model: str) -> DataFrame:
    """Chunks of the claimed filings whose document is there."""
    docs = claimed.join(blobs, "r2_key").select(F.col("filing_id").alias("doc_id"), F.col("filing_type").alias("form_type"), F.col("body").cast("string").alias("html"))
    numbered = number_chunks(chunk_sections(detect(docs), packer))
    rows = embed_documents(numbered, embedder, model)
    return rows.select(F.sha2(F.concat_ws("/", "doc_id", F.col("chunk_index").cast("string")), 256).alias("chunk_id"), F.col("doc_id").alias("filing_id"), "chunk_index", "section", "text", "embedding", "embedding_model_version", "token_count", F.current_timestamp().alias("created_at"), "section_order", "metadata")


@dataclass
class Ingest:
    filings: Table
    jobs: Table
    chunks: Table
    settings: Settings = Settings()
    embedder: Embedder = hashed_embedder()
    model: str = "hashed-64"

    def _packer(self) -> Packer:
        s = self.settings
        return Packer(s.chunk_target, s.chunk_overlap, s.chunk_max)

    def reap(self, now: Column | None = None) -> None:
        self.jobs.update(lambda jobs: ledger.reap(jobs, F.current_timestamp() if now is None else now))

    def run_batch(self, blobs: DataFrame, limit: int, now: Column | None = None) -> dict[str, int]:
        """Claim, start, parse, embed and merge up to limit filings at once; claimed, processed and failed.

        A filing without a document URL, document or chunk fails with its step; its attempt is in the ledger, so that it
        is not claimed for ever.
        """
        s, now = self.settings, F.current_timestamp() if now is None else now
        filings, jobs = self.filings.read(), self.jobs.read()
        claimed = ledger.claim(filings, jobs, now, limit, s.max_attempts, s.backoff_base_s, s.backoff_max_s).select("filing_id", "filing_type", "r2_key", "primary_doc_url")
        started = ledger.start(claimed, jobs, now, s.max_attempts)
        # Settled, as a merge that meets another writer's is made again.
        new = settle(parse_documents(claimed, blobs.filter("body is not null"), self._packer(), self.embedder, self.model))
        check_models(new, self.chunks.read())
        self.chunks.update(lambda chunks: upsert_chunks(chunks, new))
        done = self.chunks.read().select("filing_id").distinct().withColumn("has", F.lit(True))
        state = started.join(claimed.join(blobs.select("r2_key", F.lit(True).alias("landed")), "r2_key", "left").join(done, "filing_id", "left").select("filing_id", "landed", "has", "primary_doc_url"), "filing_id")
        error = F.when(F.col("has"), F.lit(None)).when(F.col("primary_doc_url").isNull(), "no document url").when(F.col("landed").isNull(), "no document").otherwise("no chunks")
        step = F.when(F.col("has"), "upsert").when(F.col("landed").isNull(), "download").otherwise("chunk")
        ended = state.withColumns({"error": error, "step": step}).withColumns({"status": F.when(F.col("error").isNull(), "done").otherwise("failed"), "completed_at": now})
        ended = settle(ended.select(jobs.columns))
        self.jobs.update(lambda rows: rows.unionByName(ended))

        def with_status(rows: DataFrame) -> DataFrame:
            now = ledger.statuses(rows, self.jobs.read(), s.max_attempts).select("filing_id", F.col("status").alias("now"))
            return rows.join(now, "filing_id").withColumn("status", F.col("now")).drop("now")

        self.filings.update(with_status)
        report = self.jobs.read().join(started.select("job_id"), "job_id", "left_semi").agg(F.count("*").alias("claimed"), F.count_if(F.col("status") == "done").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed")).first()
        return report.asDict()

    def run(self, blobs: DataFrame, limit: int | None = None) -> dict[str, int]:
        """Batches until nothing is left to claim or limit is reached."""
        self.reap()
        total = {"claimed": 0, "processed": 0, "failed": 0}
        while limit is None or total["claimed"] < limit:
            n = self.settings.claim_batch if limit is None else min(self.settings.claim_batch, limit - total["claimed"])
            report = self.run_batch(blobs, n)
            total = {k: total[k] + report[k] for k in total}
            if not report["claimed"]:
                break
        return total
