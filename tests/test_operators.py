"""Truth tables of the operators, each as a small frame."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dossier.config import Settings
from dossier.functions import numbers, text
from dossier.functions.lexemes import cover_density_of, positions_of, stem
from dossier.operators import answer, coverage, folds, ledger, merges, rails, retrieval, selection
from dossier.operators.chunking import Packer, chunk_sections, count_words, number_chunks, split_lines
from dossier.operators.embedding import assemble, embed_with_fallback, hashed_embedder
from dossier.operators.sections import detect
from dossier.sources import blobs, frames, submissions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ints(*values):
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<bigint>)")


@pytest.mark.parametrize(
    ("page_from", "page_to", "kept"),
    [
        ("2023-01-01", "2023-06-30", True), ("2020-01-01", "2027-12-31", True), ("2021-06-01", "2022-06-01", True), ("2026-06-01", "2027-06-01", True),
        ("2020-01-01", "2022-01-01", True), ("2026-12-31", "2027-06-01", True), ("2022-01-01", "2026-12-31", True), ("2020-01-01", "2021-12-31", False),
        ("2027-01-01", "2027-12-31", False), (None, None, True), ("2023-01-01", None, True), ("", "", True), ("soon", "later", True),
    ],
)
def test_page_overlap(spark, page_from, page_to, kept):
    row = spark.createDataFrame([(page_from, page_to)], "a string, b string").select(submissions.overlaps(F.col("a"), F.col("b")).alias("k")).first()
    assert row["k"] is kept


def test_listing_merges_pages_and_reads_to_the_shortest(spark):
    block = lambda rows, n=None: {"form": [r[0] for r in rows], "filingDate": [r[1] for r in rows], "reportDate": [r[2] for r in rows][:n], "accessionNumber": [r[3] for r in rows], "primaryDocument": [r[4] for r in rows]}
    recent = block([("10-K", "2025-02-13", "", "0000019617-25-000123", "a.htm")])
    page = block([("10-K", "2025-02-13", "", "0000019617-25-000123", "a.htm"), ("10-K", "2023-02-21", "2022-12-31", "0000019617-23-000456", "b.htm"), ("10-K", "2021-02-23", "", "0000019617-21-000001", "c.htm"), ("424B2", "2023-03-01", "", "0000019617-23-000777", "d.htm"), ("10-K", "2023-05-01", "", "0000019617-23-000999", "e.htm")], 4)
    subs = spark.createDataFrame([("0000019617", {"recent": recent, "files": [{"name": "p1", "filingFrom": "2021-01-01", "filingTo": "2025-03-01"}, {"name": "p2", "filingFrom": "2001-01-01", "filingTo": "2002-01-01"}]})], submissions.SUBMISSIONS)
    overflow = spark.createDataFrame([("0000019617", "p1", page), ("0000019617", "p2", page)], f"cik string, name string, block {submissions.BLOCK}")
    rows = submissions.list_filings(subs, overflow).orderBy("page_no", "at").collect()
    assert [r["accession_number"] for r in rows] == ["0000019617-25-000123", "0000019617-23-000456"]
    assert str(rows[0]["period_end"]) == "2025-02-13"
    assert rows[1]["primary_doc_url"].endswith("/19617/000001961723000456/b.htm")


def test_years(spark):
    r = one(spark, a=numbers.repair_years(ints(2023, 20232024)), b=numbers.repair_years(ints(20232024, 2023, 20245)), c=numbers.repair_years(ints()))
    assert (r["a"], r["b"], r["c"]) == ([2023, 2024], [2023, 2024, 20245], [])
    kept, dropped = rails.split_years(ints(2020, 2021, 2026, 2027), 2021, 2026)
    r = one(spark, k=kept, d=dropped)
    assert (r["k"], r["d"]) == ([2021, 2026], [2020, 2027])


def test_company_rail(spark):
    roster = F.array(*map(F.lit, ["Apple Inc.", "Visa Inc.", "Alphabet Inc.", "JPMorgan Chase & Co."]))
    outside, inside = rails.split_companies(F.array(*map(F.lit, ["Apple", "Coca-Cola", "V", "Google", "JP Morgan", "Alpha", ""])), roster)
    r = one(spark, o=outside, i=inside)
    assert r["o"] == ["Coca-Cola", "V", "Google", "JP Morgan", ""]
    assert r["i"] == ["Apple", "Alpha"]


def test_ticker_rail_keeps_order(spark):
    kept, dropped = rails.split_allowed(F.array(*map(F.lit, ["B", "X", "A"])), F.array(*map(F.lit, ["A", "B"])))
    r = one(spark, k=kept, d=dropped)
    assert (r["k"], r["d"]) == (["B", "A"], ["X"])


def test_backoff(spark):
    r = spark.createDataFrame([(1,), (2,), (3,), (100,)], "n int").select(numbers.backoff_s(F.col("n"), 2.0, 10.0).alias("w")).collect()
    assert [x["w"] for x in r] == [2.0, 4.0, 8.0, 10.0]


def test_cells(spark):
    plans = spark.createDataFrame([("r", ["A", "B"], [2023], ["q1", "q2", "q1"]), ("none", ["A"], [], ["q"])], "request_id string, tickers array<string>, years array<int>, sub_questions array<string>")
    rows = retrieval.cells(plans).orderBy("cell").collect()
    assert [(x["ticker"], x["period_year"], x["sub_question"], x["cell"]) for x in rows] == [("A", 2023, "q1", 0), ("A", 2023, "q2", 1), ("B", 2023, "q1", 2), ("B", 2023, "q2", 3)]


def test_rrf(spark):
    ranked = lambda ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "q string, chunk_id string, rank int")
    rows = retrieval.fuse(ranked("abc"), ranked("bd"), 10, 60, ["q"]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a", "d", "c"]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_merge_cells(spark):
    rows = spark.createDataFrame([("r", 0, "c1", 1), ("r", 0, "c2", 2), ("r", 1, "c2", 1), ("r", 1, "c3", 2)], "request_id string, cell int, chunk_id string, rank int")
    assert [(r["chunk_id"], r["cell"]) for r in retrieval.merge_cells(rows).orderBy("cell", "rank").collect()] == [("c1", 0), ("c2", 0), ("c3", 1)]


def test_a_query_without_terms_matches_nothing_and_zero_vectors_stay_out(spark):
    index = spark.createDataFrame([("c", "a", 2, [1, 2])], "chunk_id string, term string, tf int, positions array<int>")
    asked = spark.createDataFrame([(0, ["a"]), (1, []), (2, ["a", "b"])], "q int, terms array<string>")
    assert [r["q"] for r in retrieval.match_all(asked, index, ["q"]).collect()] == [0]
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q int, query_vector array<float>")
    assert [r["chunk_id"] for r in retrieval.vector_rank(q, chunks, 9, ["q"]).orderBy("rank").collect()] == ["a", "b"]


def test_other_model_fails(spark):
    corpus = spark.createDataFrame([("m1",), (None,)], "embedding_model_version string")
    asked = spark.createDataFrame([(1,)], "q int")
    assert retrieval.check_model(asked, "m1", corpus).count() == 1
    with pytest.raises(Exception, match="embedded by m2"):
        retrieval.check_model(asked, "m2", corpus).collect()


def scored(spark, pairs):
    return spark.createDataFrame([(f"{t}{y}-{i}", t, y, float(s)) for t, y, own in pairs for i, s in enumerate(own)], "chunk_id string, ticker string, period_year int, score double")


@pytest.mark.parametrize(
    ("floor", "cap", "pool", "per_ticker", "dropped"),
    [
        (2, 20, [("AAPL", 2023, [9, 8, 7, 6, 5]), ("MSFT", 2023, [3, 2, 1])], {"AAPL": 5, "MSFT": 3}, []),
        (3, 6, [("AAPL", 2023, [9, 8, 7, 6, 5]), ("MSFT", 2023, [4])], {"AAPL": 5, "MSFT": 1}, []),
        (5, 6, [("A", 2023, [9, 8, 7, 6, 5]), ("B", 2023, [4, 3, 2, 1, 0]), ("C", 2023, [4, 3, 2, 1, 0])], {"A": 2, "B": 2, "C": 2}, []),
        (2, 2, [("AAPL", 2023, [9]), ("MSFT", 2023, [8]), ("GOOGL", 2023, [7]), ("AMZN", 2023, [6])], {"AAPL": 1, "MSFT": 1}, ["AMZN", "GOOGL"]),
        (2, 4, [("A", 2023, [1, 1, 1, 1, 1, 1])], {"A": 4}, []),
    ],
)
def test_select_with_floor(spark, floor, cap, pool, per_ticker, dropped):
    rows = scored(spark, pool)
    found = selection.select_with_floor(rows, floor, cap).orderBy("place").collect()
    count: dict = {}
    for r in found:
        count[r["ticker"]] = count.get(r["ticker"], 0) + 1
    assert count == per_ticker
    assert [(-r["score"], r["chunk_id"]) for r in found] == sorted((-r["score"], r["chunk_id"]) for r in found)
    assert sorted(r["ticker"] for r in selection.dropped_pairs(rows, floor, cap).collect()) == dropped


def test_select_with_floor_at_random(spark):
    """Against an independent restatement, many pools as requests of one job."""
    rng = random.Random(5)
    rows = [(str(k), f"c{i}", f"t{rng.randrange(4)}", rng.randrange(4), float(rng.randrange(6))) for k in range(60) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "request_id string, chunk_id string, ticker string, period_year int, score double")
    found: dict = {}
    for r in selection.select_with_floor(df, 2, 8, ["request_id"]).orderBy("request_id", "place").collect():
        found.setdefault(r["request_id"], []).append(r["chunk_id"])
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1]))
        pairs: dict = {}
        for r in own:
            pairs.setdefault((r[2], r[3]), []).append(r)
        n = len(pairs)
        eff = 2 if n * 2 <= 8 else max(1, 8 // n)
        kept = list(pairs)[:8]
        chosen = [r for p in kept for r in pairs[p][: eff if n <= 8 else 1]]
        rest = [r for r in own if (r[2], r[3]) in kept and r not in chosen]
        chosen += rest[: 8 - len(chosen)]
        assert found[k] == [r[1] for r in sorted(chosen, key=lambda r: (-r[4], r[1]))], k


def test_verdicts(spark):
    plans = spark.createDataFrame([("gap", ["A"], [1]), ("cap", ["A"], [1]), ("bad", ["A"], [1]), ("good", ["A"], [1]), ("none", [], [1])], "request_id string, tickers array<string>, years array<int>")
    missing = spark.createDataFrame([("gap", "A", 1, "coverage"), ("gap", "B", 1, "capacity"), ("cap", "A", 1, "capacity")], "request_id string, ticker string, period_year int, cause string")
    enough = spark.createDataFrame([("gap", True), ("cap", True), ("bad", False), ("good", True), ("none", True)], "request_id string, sufficient boolean")
    got = {r["request_id"]: (r["confidence"], r["confidence_reason"], len(r["coverage_gaps"]), len(r["capacity_drops"])) for r in coverage.verdicts(plans, missing, enough).collect()}
    assert got == {"gap": ("low", "coverage", 1, 1), "cap": ("high", "none", 0, 1), "bad": ("low", "llm", 0, 0), "good": ("high", "none", 0, 0), "none": ("low", "coverage", 0, 0)}
    strict = {r["request_id"]: r["confidence"] for r in coverage.verdicts(plans, missing, enough, True).collect()}
    assert strict["none"] == "high"


@pytest.mark.parametrize(("counts", "most", "batches"), [([2000, 2000], 5000, [0, 0]), ([3000, 3000, 3000], 6000, [0, 0, 1]), ([9000], 6000, [0]), ([], 6000, []), ([1, 9000, 1], 6000, [0, 1, 2])])
def test_batches(spark, counts, most, batches):
    assert spark.createDataFrame([(counts,)], "c array<int>").select(folds.batch_numbers(F.col("c"), most).alias("b")).first()["b"] == batches


def test_numbered_batches(spark):
    cases = {"a": ([2000, 2000], [0, 0]), "b": ([3000, 3000, 3000], [0, 0, 1]), "c": ([9000], [0]), "d": ([1, 9000, 1], [0, 1, 2]), None: ([None, 6000, 1], [0, 0, 1])}
    rows = [(g, k, n) for g, (counts, _) in cases.items() for k, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(3)
    got = {(r["g"], r["k"]): r["batch"] for r in folds.numbered_batches(df, ["g"], ["k"], "n", 6000).collect()}
    assert got == {(g, k): b for g, (_, batches) in cases.items() for k, b in enumerate(batches)}
    assert folds.numbered_batches(df.limit(0), ["g"], ["k"], "n", 6000).count() == 0


def test_bucket(spark):
    df = spark.createDataFrame([([(0.0, 10.0), (0.0, 5.0), (100.0, 10.0)],)], "r array<struct<at: double, tokens: double>>")
    assert df.select(folds.bucket_waits(F.col("r"), 10, 1.0).alias("w")).first()["w"] == [0.0, 5.0, 0.0]
    assert df.select(folds.bucket_waits(F.col("r"), 10, 1.0, start_full=False).alias("w")).first()["w"] == [10.0, 15.0, 0.0]
    with pytest.raises(Exception, match="capacity"):
        df.select(folds.bucket_waits(F.col("r"), 9, 1.0)).collect()


def test_breaker(spark):
    log = [(0.0, "hard"), (1.0, "soft"), (2.0, "hard_midstream"), (3.0, "hard"), (4.0, "ok"), (40.0, "hard"), (41.0, "ok"), (80.0, "ok"), (81.0, "hard")]
    df = spark.createDataFrame([(log,)], "r array<struct<at: double, outcome: string>>")
    got = [(x["state"], x["served"]) for x in df.select(folds.breaker_states(F.col("r")).alias("s")).first()["s"]]
    assert got == [("closed", "fallback"), ("closed", "error"), ("closed", "error"), ("closed", "fallback"), ("open", "fallback"), ("half_open", "fallback"), ("open", "fallback"), ("half_open", "model"), ("closed", "fallback")]


def test_packer():
    words = lambda n, w="w": " ".join([w] * n)
    p = Packer(10, 3, 512, count_words, split_lines)
    assert list(p.pack(words(12))) == [(words(12), 12, True)]
    assert [c[0] for c in p.pack("a\nb\n" + words(11, "x"))] == ["a b", "b", words(11, "x")]
    same = lambda t: [t]
    assert all(n <= 20 for _, n, _ in Packer(10, 50, 20, count_words, same).pack(words(100)))
    assert all(big for _, _, big in Packer(10, 50, 15, count_words, same).pack(words(30)))
    got = [c[0] for c in Packer(8, 4, 512, count_words, split_lines).pack("\n".join(f"{i} b c d" for i in range(4)))]
    assert got[0].endswith("1 b c d") and got[1].startswith("1 b c d")
    assert list(p.pack("")) == [] and list(p.pack("  \n ")) == []
    long = Packer(4, 0, 4, len, same)
    assert all(n <= 4 for _, n, _ in long.pack("abcdefghij klm"))


def filing(items, body="lorem ipsum dolor " * 20):
    toc = "".join(f"<tr><td>Item {i}.</td></tr>" for i in items)
    return f"<html><head><style>x</style><script>Item 9.</script></head><body><table>{toc}</table>" + "".join(f"<p>Item {i}.</p>" for i in items) + "".join(f"<h2>Item&nbsp;{i}. </h2><p>{body}{i}</p>" + ("<table><tr><td>5</td></tr></table>" if i == "7" else "") for i in items) + "</body></html>"


def test_sections(spark):
    docs = spark.createDataFrame([("k", "10-K", filing(["1", "1A", "1B", "2", "7", "7a", "8"])), ("u", "10-K", "<p>nothing here</p>"), ("n", "10-K", None)], "doc_id string, form_type string, html string")
    rows = detect(docs).orderBy("doc_id", "section_order").collect()
    own = [r for r in rows if r["doc_id"] == "k"]
    assert [r["item_key"] for r in own] == ["1", "1A", "1B", "2", "7", "7A", "8"]
    assert [r["section_order"] for r in own] == list(range(7))
    assert own[4]["metadata"]["tables_stripped"] == "1" and own[0]["metadata"]["tables_stripped"] == "0"
    assert all(r["char_count"] == len(r["text"]) >= 200 and "  " not in r["text"] and "\xa0" not in r["text"] and "\0" not in r["text"] for r in own)
    assert [(r["item_key"], r["metadata"]) for r in rows if r["doc_id"] == "u"] == [("unstructured", {"detection": "fallback_unstructured"})]
    q = filing(["1", "2"]).replace("<body>", "<body><p>PART I</p>").replace("</body>", "<p>PART II</p>" + filing(["1", "1A"]) + "</body>")
    quarter = detect(spark.createDataFrame([("q", "10-Q", q)], "doc_id string, form_type string, html string")).orderBy("section_order").collect()
    assert [(r["item_key"], r["metadata"]["part"]) for r in quarter] == [("PI-1", "I"), ("PI-2", "I"), ("PII-1", "II"), ("PII-1A", "II")]
    with pytest.raises(Exception, match="unsupported form"):
        detect(spark.createDataFrame([("q", "8-K", q)], "doc_id string, form_type string, html string")).collect()


def test_chunks_of_sections(spark):
    sections = spark.createDataFrame([("d", "S1", "1", 0, "A b c. D e f. G h i.", {"part": "I"}), ("d", "S2", "2", 1, "One two.", {})], "doc_id string, name string, item_key string, section_order int, text string, metadata map<string,string>")
    rows = number_chunks(chunk_sections(sections, Packer(6, 3, 9))).orderBy("chunk_index").collect()
    assert [(r["section"], r["text"], r["metadata"]["section_chunk_index"]) for r in rows] == [("S1", "A b c. D e f.", "0"), ("S1", "D e f. G h i.", "1"), ("S2", "One two.", "0")]
    assert rows[0]["metadata"]["part"] == "I" and "part" not in rows[2]["metadata"]


def test_ledger(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    jobs = spark.createDataFrame([("j1", "a", "failed", "embed", None, t(0), t(1)), ("j2", "b", "failed", "embed", None, t(0), t(1)), ("j3", "b", "failed", "embed", None, t(2), t(3)), ("j4", "b", "failed", "parse", None, t(4), t(5)), ("j5", "c", "running", "chunk", None, t(0), None), ("j6", "d", "done", "upsert", None, t(0), t(1))], "job_id string, filing_id string, status string, step string, error string, started_at timestamp, completed_at timestamp")
    filings = spark.createDataFrame([("a", "processing", t(0)), ("b", "processing", t(0)), ("c", "processing", t(1)), ("d", "processed", t(0)), ("e", "pending", t(9))], "filing_id string, status string, created_at timestamp")
    assert {r["filing_id"]: r["status"] for r in ledger.statuses(filings, jobs).collect()} == {"a": "processing", "b": "failed", "c": "processing", "d": "processed", "e": "pending"}
    assert {r["filing_id"]: r["may_start"] for r in ledger.startable(filings, jobs).collect()} == {"a": True, "b": False, "c": True, "d": True, "e": True}
    at = lambda s: F.lit(t(s)).cast("timestamp")
    assert [r["filing_id"] for r in ledger.claim(filings, jobs, at(2), 9).collect()] == ["e", "c"]
    assert [r["filing_id"] for r in ledger.claim(filings, jobs, at(3), 9).collect()] == ["e", "a", "c"]
    assert [r["filing_id"] for r in ledger.claim(filings, jobs, at(2), 2).collect()] == ["e", "c"]
    assert [r["filing_id"] for r in ledger.claim(filings, jobs, at(2), 2, limit_first=True).collect()] == ["e"]
    reaped = {r["job_id"]: (r["status"], r["step"]) for r in ledger.reap(jobs, at(9)).collect()}
    assert reaped["j5"] == ("failed", "chunk") and reaped["j6"] == ("done", "upsert")
    started = ledger.start(filings, jobs, at(9))
    assert {r["filing_id"] for r in started.collect()} == {"a", "c", "d", "e"}
    assert ledger.fail(ledger.record_step(started, "parse"), F.lit("x" * 3000), at(9)).select(F.max(F.length("error"))).first()[0] == 2000


def test_filings_upsert(spark):
    schema = "accession_number string, filing_date string, primary_doc_url string, status string"
    target = spark.createDataFrame([("a", "1", None, "processed"), ("b", "1", "/b", "pending"), ("z", "1", None, "pending")], schema)
    source = spark.createDataFrame([("a", "2", "/a", "pending"), ("b", "2", "/other", "pending"), ("c", "2", "/c", "pending"), ("c", "3", "/c2", "pending")], schema)
    rows = {r["accession_number"]: (r["primary_doc_url"], r["status"], r["outcome"]) for r in merges.upsert_filings(target, source).collect()}
    assert rows == {"a": ("/a", "processed", "backfilled"), "b": ("/b", "pending", "untouched"), "c": ("/c", "pending", "inserted"), "z": (None, "pending", None)}


def test_chunk_upsert_and_guards(spark):
    schema = "chunk_id string, filing_id string, chunk_index int, text string, embedding_model_version string"
    target = spark.createDataFrame([("i0", "f", 0, "old", "m"), ("i1", "f", 1, "old", "m"), ("i2", "g", 5, "old", "m")], schema)
    source = spark.createDataFrame([("n0", "f", 0, "new", "m")], schema)
    rows = {(r["filing_id"], r["chunk_index"]): (r["chunk_id"], r["text"]) for r in merges.upsert_chunks(target, source).collect()}
    assert rows == {("f", 0): ("i0", "new"), ("g", 5): ("i2", "old")}
    assert merges.upsert_chunks(target, source, replace_filings=False).count() == 3
    merges.check_models(source, target)
    merges.check_models(source.limit(0), target)
    with pytest.raises(ValueError, match="corpus"):
        merges.check_models(source.withColumn("embedding_model_version", F.lit("x")), target)
    with pytest.raises(ValueError, match="mixes"):
        merges.check_models(source.unionByName(source.withColumn("embedding_model_version", F.lit("x"))), target)


def test_table_versions(spark, tmp_path):
    t = merges.Table(spark, str(tmp_path / "t"), "a int, b string")
    assert t.read().count() == 0
    t.replace(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert t.replace(t.read().withColumn("a", F.col("a") + 1), "batch-0") == 2
    # The same batch again changes nothing, and makes no version.
    assert t.replace(spark.createDataFrame([("y", 5)], "b string, a int"), "batch-0") == 2
    assert t.update(lambda now: now.withColumn("a", F.col("a") + 1), "batch-0") == 2
    assert [tuple(r) for r in t.read().collect()] == [(2, "x")]
    assert t.update(lambda now: now.withColumn("a", F.col("a") * 10)) == 3
    assert t.vacuum(1) == 2 and t.commits() == [3] and [tuple(r) for r in t.read().collect()] == [(20, "x")]
    assert t.update(lambda now: now, "batch-0") == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    """One writer commits while the other merges: the later one is told, and merges again."""
    one, two = (merges.Table(spark, str(tmp_path / "t"), "k int, v string") for _ in range(2))
    given = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    put = lambda rows: lambda now: merges.upsert(now, rows, ["k"], ["v"])
    one.replace(given((1, "a"), (2, "a")))
    calls = []

    def slow(now):
        if not calls:
            two.update(put(given((2, "two"), (3, "two"))), "two-0")
        calls.append(1)
        return put(given((1, "one"), (4, "one")))(now)

    assert one.update(slow, "one-0") == 3 and len(calls) == 2
    assert sorted(map(tuple, two.read().collect())) == [(1, "one"), (2, "two"), (3, "two"), (4, "one")]
    with pytest.raises(merges.Conflict):
        two.replace(given((9, "late")), base=2)
    assert one.commits() == [1, 2, 3] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 3


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        table = merges.Table(spark, str(tmp_path / "t"), "k int, v string")
        return table.update(lambda now: now.unionByName(spark.createDataFrame([(i, "x")], "k int, v string")), f"w-{i}")

    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(write, range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["k"] for r in merges.Table(spark, str(tmp_path / "t"), "k int, v string").read().collect()) == list(range(6))


def test_lexemes():
    assert [stem(w) for w in "running filings caresses ponies relational generously hopping hoping happy".split()] == ["run", "file", "caress", "poni", "relat", "generous", "hop", "hope", "happi"]
    assert positions_of("The risks of the Risk") == {"risk": [2, 5]}
    assert cover_density_of([[1], [2]]) == pytest.approx(0.1)
    assert cover_density_of([[1, 9], [3]]) == pytest.approx(0.05 + 0.1 / 6)
    assert cover_density_of([[1], []]) == 0


def test_text_columns(spark):
    r = one(spark, n=text.normalize(F.lit("a\xa0 b\0TABLE\0c\u200bd \n e ")), k=text.blob_key(F.lit("1"), F.lit("2-3")), w=text.word_count(F.lit(" a b\n c ")), z=text.word_count(F.lit("  ")), m=text.merge_metadata(text.decode_metadata(F.lit('{"a": 1, "b": "x"}')), F.create_map(F.lit("b"), F.lit("y"))), e=text.decode_metadata(F.lit(None).cast("string")))
    assert r["n"] == "a b cd e" and r["k"] == "filings/1/2-3.html" and r["w"] == 3 and r["z"] == 0 and r["m"] == {"a": "1", "b": "y"} and r["e"] == {}
    assert text.normalize_text("a\xa0 b\0TABLE\0c\u200bd \n e ") == "a b cd e"


def test_embedding(spark):
    chunks = spark.createDataFrame([("d", 0, "alpha beta", 2), ("d", 1, "gamma", 1)], "doc_id string, chunk_index int, text string, token_count int")
    e = hashed_embedder(8)
    first = embed_with_fallback(chunks, e, e, ("p", "f"), 0, 10)
    assert {r["embedding_model_version"] for r in first.collect()} == {"p"}
    assert {r["embedding_model_version"] for r in embed_with_fallback(chunks, e, e, ("p", "f"), 8, 10).collect()} == {"f"}
    vectors = first.select("doc_id", "chunk_index", "embedding")
    assert assemble(chunks, vectors, "m", 8).count() == 2
    for wrong, dim in ((vectors.limit(1), 8), (vectors, 9), (vectors.unionByName(vectors.limit(1).withColumn("chunk_index", F.lit(7))), 8)):
        with pytest.raises(Exception, match="vector"):
            assemble(chunks, wrong, "m", dim).collect()


def test_answers(spark):
    req = spark.createDataFrame([("r",), ("s",)], "request_id string")
    sel = spark.createDataFrame([("r", 1, "c1", "A", "10-K", 2023, None, "t1"), ("r", 2, "c2", "B", "10-K", 2024, "S", "t2")], "request_id string, place int, chunk_id string, ticker string, filing_type string, period_year int, section string, text string")
    ev = {r["request_id"]: r["evidence"] for r in answer.evidence(req, sel).collect()}
    assert ev == {"r": "[1] A 10-K FY2023 | section=N/A\nt1\n\n[2] B 10-K FY2024 | section=S\nt2", "s": "(no passages retrieved)"}
    told = answer.extractive(req, sel)
    assert told.filter("request_id = 's'").count() == 2 and told.filter("request_id = 'r'").count() == 3
    verdict = spark.createDataFrame([("r", "low"), ("s", "high")], "request_id string, confidence string")
    assert answer.with_caveat(told, verdict).filter("seq = -1").count() == 1
    links = answer.marker_links(spark.createDataFrame([("r", "x [2] y [9] [2]")], "request_id string, text string"), answer.citations(sel))
    assert {(r["place"], r["chunk_id"]) for r in links.collect()} == {(2, "c2"), (9, None)}


def test_frames(spark):
    parts = [(": ping\n\nevent: token\nda", 0), ("ta: a\ndata: b\r", 1), ("\n\r\nevent: nope\ndata: x\n\nevent: done\ndata:\n\nevent: error\ndata: cut", 2)]
    df = spark.createDataFrame([("s", i, b) for b, i in parts], "stream_id string, seq int, bytes string")
    assert [(r["event"], r["data"]) for r in frames.parse_frames(frames.split_frames(df)).orderBy("at").collect()] == [("token", "a\nb")]


def test_fetch_caches_and_retries(spark):
    wanted = spark.createDataFrame([("1", "a", "u1"), ("1", "b", "bad"), ("1", "c", None), ("1", "d", "u4")], "cik string, accession_number string, primary_doc_url string")
    cache = spark.createDataFrame([("filings/1/d.html", b"old")], "r2_key string, body binary")

    def fetch(url):
        if url == "bad":
            raise KeyError(url)
        return url.encode()

    rows = {r["r2_key"]: (r["body"] and bytes(r["body"]), r["error"]) for r in blobs.fetch_documents(wanted, cache, fetch, per_second=1000).collect()}
    assert rows == {"filings/1/a.html": (b"u1", None), "filings/1/b.html": (None, "KeyError"), "filings/1/c.html": (None, "ValueError")}
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise blobs.StatusError(503)
        return b"ok"

    assert blobs.retrying(flaky, sleep=waits.append)("u") == b"ok" and len(waits) == 2 and all(2 <= w <= 30 for w in waits)
    with pytest.raises(blobs.StatusError):
        blobs.retrying(lambda u: (_ for _ in ()).throw(blobs.StatusError(404)), sleep=waits.append)("u")


def test_settings():
    Settings()
    for wrong in ({"floor_per_pair": 0}, {"floor_per_pair": 9}, {"min_year": 2030}, {"tokens_per_minute": 99_000}, {"user_agent": "x"}):
        with pytest.raises(ValueError):
            Settings(**wrong)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Item 1. Business", ["1"]),
        ("ITEM\xa07A\u2014 Risk", ["7A"]),
        ("x\nitem 10 : y", ["10"]),
        ("Item1b", ["1B"]),
        ("Item    9C -", ["9C"]),
        ("Item     9C", ["9C"]),
        ("Item" + " " * 50 + "9C", []),
        ("Item\n\n9C", []),
        ("Item 8.\u2014 Statements", ["8"]),
        ("Item 16. Summary", []),
        ("Line-item 1.", []),
        ("subitem 1", []),
        ("Item 123", []),
        ("Item 1.5", []),
        ("Item 1AB", []),
        ("Items 1 and 2", []),
        ("Part II Item 2.", ["2"]),
    ],
)
def test_item_headings(text, found):
    from dossier.operators.sections import outline_of

    assert [h["item"] for h in outline_of(text)] == found


@pytest.mark.parametrize(("text", "part"), [("PART II", "II"), ("part\xa0iv.", "IV"), ("Part III, ", "III"), ("Part IIII", "I"), ("counterpart II", "I"), ("Part IIa", "I"), ("PartII", "I"), ("Part\nII", "II"), ("Part\n\nII", "I"), ("Part" + " " * 50 + "II", "I"), ("PART II \u2014", "II")])
def test_part_headings(text, part):
    from dossier.operators.sections import outline_of

    assert [h["part"] for h in outline_of(f"{text}\nItem 1.")] == [part]


def test_headings_keep_their_places():
    from dossier.operators.sections import outline_of

    text = "\u0130\u017f part i\nitem 1. x\npart ii item 1a \u2013 y item7: z ITEM\xa099."
    found = outline_of(text)
    assert [(h["part"], h["item"]) for h in found] == [("I", "1"), ("II", "1A"), ("II", "7")]
    assert [text[h["at"] :].split(None, 2)[0] for h in found] == ["item", "item", "item7:"]
