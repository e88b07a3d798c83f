"""The engine, ingest and streams, end to end on small inputs."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators.embedding import embed_documents, hashed_embedder
from dossier.operators.merges import Table
from dossier.operators.postingindex import PostingIndex
from dossier.operators.vectorindex import VectorIndex
from dossier.plans.engine import Engine, lexeme_index
from dossier.plans.ingest import Ingest, discover
from dossier.sources import submissions
from dossier.streaming import pipelines
from tests.test_operators import filing


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(f"{t}{y}{i}", f"{name} revenue grew in the year. Passage {i}.", "Item 7", t, y, "10-K") for t, name in (("AAPL", "Apple"), ("MSFT", "Microsoft")) for y in (2023, 2024) for i in range(4) if (t, y) != ("MSFT", 2024)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, section string, ticker string, period_year int, filing_type string").withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    chunks = embed_documents(chunks, hashed_embedder(), "hashed-64").cache()
    roster = spark.createDataFrame([("AAPL", "Apple Inc."), ("MSFT", "Microsoft Corporation")], "ticker string, name string")
    return Engine(chunks, roster, lexeme_index(chunks), "hashed-64")


def test_plans(spark, engine):
    asked = spark.createDataFrame([("1", "Compare Apple and Microsoft revenue 20232024"), ("2", "Revenue of Coca-Cola in 2019"), ("3", "")], "request_id string, question string")
    plans = {r["request_id"]: r for r in engine.plan(asked).collect()}
    assert set(plans) == {"1", "2"}
    assert sorted(plans["1"]["tickers"]) == ["AAPL", "MSFT"] and plans["1"]["years"] == [2023, 2024] and plans["1"]["intent"] == "comparative"
    assert plans["2"]["unavailable_companies"] == ["Coca-Cola"] and plans["2"]["unavailable_years"] == [2019] and plans["2"]["tickers"] == []


def test_ask(spark, engine):
    asked = spark.createDataFrame([("1", "Compare Apple and Microsoft revenue in 2023"), ("2", "Compare Apple and Microsoft revenue in 2024"), ("3", "What does Coca-Cola sell")], "request_id string, question string")
    events = engine.ask(asked).orderBy("request_id", "seq").collect()
    own = lambda k: [r for r in events if r["request_id"] == k]
    for k in "123":
        names = [r["event"] for r in own(k)]
        assert names[0] == "meta" and names[-2:] == ["citations", "done"] and set(names[1:-2]) == {"token"}
    meta = {k: json.loads(own(k)[0]["data"]) for k in "123"}
    assert (meta["1"]["confidence"], meta["1"]["confidence_reason"]) == ("high", "none")
    assert meta["2"]["confidence_reason"] == "coverage" and meta["2"]["coverage_gaps"] == [{"ticker": "MSFT", "year": 2024}]
    assert meta["3"]["confidence"] == "low" and meta["3"]["unavailable_companies"] == ["Coca-Cola"]
    cited = json.loads(own("1")[-2]["data"])
    assert {c["ticker"] for c in cited} == {"AAPL", "MSFT"} and len(cited) == 8
    assert json.loads(own("3")[-2]["data"]) == []
    assert json.loads(own("1")[-1]["data"])["token_count"] == len(own("1")) - 3


def test_ask_with_stored_indexes(spark, engine, tmp_path):
    vectors, postings = VectorIndex(spark, str(tmp_path / "vectors")), PostingIndex(spark, str(tmp_path / "postings"), buckets=4)
    vectors.build(engine.chunks, 3)
    postings.insert(engine.index, "all")
    asked = spark.createDataFrame([("1", "Compare Apple and Microsoft revenue in 2023")], "request_id string, question string")
    events = [tuple(r) for r in replace(engine, vectors=vectors, postings=postings).ask(asked).collect()]
    # With so few chunks a cell, the index finds what exact search finds.
    assert sorted(events) == sorted(tuple(r) for r in engine.ask(asked).collect())


def test_discover(spark):
    block = {"form": ["10-K"], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "accessionNumber": ["0000000001-24-000001"], "primaryDocument": ["a.htm"]}
    subs = spark.createDataFrame([("0000000001", {"recent": block, "files": []})], submissions.SUBMISSIONS)
    companies = spark.createDataFrame([("0000000001", "AAA")], "cik string, ticker string")
    none = spark.createDataFrame([], f"cik string, name string, block {submissions.BLOCK}")
    filings, report = discover(subs, none, companies, spark.createDataFrame([], schemas.FILINGS))
    row = filings.first()
    assert (row["ticker"], row["status"], row["r2_key"]) == ("AAA", "pending", "filings/0000000001/0000000001-24-000001.html")
    assert [tuple(r) for r in report.collect()] == [("inserted", 1)]
    assert schemas.violations("filings", filings).count() == 0
    again, report = discover(subs, none, companies, filings)
    assert again.count() == 1 and [tuple(r) for r in report.collect()] == [("untouched", 1)]


def test_ingest(spark, tmp_path):
    filings, jobs, chunks = (Table(spark, str(tmp_path / n), s) for n, s in (("filings", schemas.FILINGS), ("jobs", schemas.JOBS), ("chunks", schemas.CHUNKS)))
    rows = spark.createDataFrame([("f1", "10-K", "k1", "/u"), ("f2", "10-K", "k2", None)], "filing_id string, filing_type string, r2_key string, primary_doc_url string")
    columns = spark.createDataFrame([], schemas.FILINGS)
    filings.replace(columns.unionByName(rows, allowMissingColumns=True).withColumns({"status": F.lit("pending"), "created_at": F.current_timestamp()}))
    blobs = spark.createDataFrame([("k1", filing(["1", "1A", "7"]).encode())], "r2_key string, body binary")
    report = Ingest(filings, jobs, chunks).run(blobs, 2)
    assert report == {"claimed": 2, "processed": 1, "failed": 1}
    assert {r["filing_id"]: r["status"] for r in filings.read().collect()} == {"f1": "processed", "f2": "processing"}
    assert {(r["filing_id"], r["status"], r["step"]) for r in jobs.read().collect()} == {("f1", "done", "upsert"), ("f2", "failed", "download")}
    assert chunks.read().filter("filing_id = 'f1'").count() >= 3


def test_ingest_stream_is_exactly_once(spark, tmp_path):
    spark.createDataFrame([("d1", "10-K", filing(["1", "1A", "7"]))], pipelines.LANDED).write.parquet(str(tmp_path / "in"))
    chunks = Table(spark, str(tmp_path / "chunks"), schemas.CHUNKS)
    for _ in range(2):
        q = pipelines.ingest_stream(spark, str(tmp_path / "in"), chunks, str(tmp_path / "cp"))
        q.awaitTermination(120)
    first = chunks.read().count()
    assert first >= 3
    spark.createDataFrame([("d2", "10-K", "<p>plain text</p>")], pipelines.LANDED).write.mode("append").parquet(str(tmp_path / "in"))
    pipelines.ingest_stream(spark, str(tmp_path / "in"), chunks, str(tmp_path / "cp")).awaitTermination(120)
    assert chunks.read().count() == first + 1


def test_stateful_streams(spark, tmp_path):
    schema = "service string, seq long, at double, outcome string, tokens double"
    rows = [("s", i, float(i), o, 5.0) for i, o in enumerate(["hard", "hard", "hard", "ok"])] + [("t", 0, 0.0, "ok", 10.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in (("breaker", pipelines.breaker_stream), ("pace", lambda d: pipelines.pacing_stream(d, 10.0, 1.0))):
        q = make(pipelines.landed_requests(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["state"] for r in spark.table("breaker").filter("service = 's'").orderBy("seq").collect()] == ["closed", "closed", "closed", "open"]
    assert [r["wait"] for r in spark.table("pace").filter("service = 's'").orderBy("seq").collect()] == [5.0, 9.0, 13.0, 17.0]
