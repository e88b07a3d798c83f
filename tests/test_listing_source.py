"""Listings as a source, over a transport that fails at first."""

from __future__ import annotations

import time

import pytest

from dossier.sources import listing_source, submissions


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(listing_source.FilingListings)
    return spark.read.format("filing_listings").option("transport", "tests.fake_listings:make").option("per_second", "1000").option("least_s", "0.01")


def test_batch_read_with_retries(spark, source):
    rows = source.option("ciks", "0000000001, 0000000002,0000000003,0000000002").load()
    assert rows.rdd.getNumPartitions() == 3
    found = rows.collect()
    assert sorted((r["cik"], r["name"]) for r in found if r["name"]) == [("0000000001", "0000000001-more"), ("0000000001", "0000000001-odd")]
    assert sorted(r["cik"] for r in found if not r["name"]) == ["0000000001", "0000000002", "0000000003"]
    filings = submissions.list_filings(*listing_source.landed(spark.createDataFrame(found, rows.schema))).collect()
    # Two annual reports in each listing, one more in the pages of 2022, which tell the same ones.
    assert sorted((r["cik"], r["accession_number"]) for r in filings) == sorted([(f"000000000{k}", f"000000000{k}-2024-{i}") for k in (1, 2, 3) for i in (0, 2)] + [("0000000001", "0000000001-2022-0")])


def test_failures_and_no_filers(source):
    assert source.option("ciks", "").load().collect() == []
    with pytest.raises(Exception, match="404"):
        source.option("ciks", "0000000009").load().collect()


def test_stream_by_offsets(spark, source, tmp_path):
    def run():
        stream = spark.readStream.format("filing_listings").option("transport", "tests.fake_listings:make").option("per_second", "1000").option("least_s", "0.01").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["cik"] for r in spark.read.parquet(str(tmp_path / "out")).filter("name is null").collect())

    want = [f"000000000{k}" for k in (1, 2, 3, 4)]
    assert run() == want
    assert run() == want  # a restart goes on from its offset


def test_requests_keep_their_distance():
    listing_source._last[0] = 0.0
    began = time.monotonic()
    for _ in range(4):
        listing_source.paced(0.05)
    assert 0.14 <= time.monotonic() - began < 1
