"""The registered queries: SQL where there is some, the stated columns, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from dossier.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_nearest": {"query_id", "rank", "vec_id", "score"},
    "op5_main_text": {"page_id", "url", "text", "n_chars"},
    "op6_suffix": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op10_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    found = df.toPandas()
    assert len(found)
    if name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        wanted = db.sql(queries.ORACLE_SQL[name]).df()
        rows = lambda d: sorted(map(str, d[sorted(d)].itertuples(index=False, name=None)))
        assert sorted(found) == sorted(wanted) and rows(found) == rows(wanted)


def test_pipeline_stages_narrow_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.dtypes) == sorted(spark.read.parquet(f"{SF}/documents.parquet").dtypes), name
        out.write.mode("overwrite").parquet(f"{spark.sparkContext.getCheckpointDir()}/test-{name}")
        docs = spark.read.parquet(f"{spark.sparkContext.getCheckpointDir()}/test-{name}")
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
