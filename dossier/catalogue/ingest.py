"""Listings, merges, the ledger and folds, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.catalogue.base import table
from dossier.operators import folds, ledger, merges
from dossier.schemas import violations
from dossier.sources import submissions

FORMS, FROM, TO = ("F", "O"), "1994-01-01", "1996-12-31"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as columnar blocks, without the last report date and without most documents' last names."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority"))).alias("r"))
    at = lambda f: F.transform("r", f)
    block = F.struct(
        at(lambda x: x["o_orderstatus"]).alias("form"),
        at(lambda x: x["d"]).alias("filingDate"),
        F.slice(at(lambda x: F.when(x["o_orderkey"] % 3 == 0, "").otherwise(x["d"])), F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))).alias("reportDate"),
        at(lambda x: F.concat(F.lit("0000-00-"), x["o_orderkey"].cast("string"))).alias("accessionNumber"),
        at(lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(".htm"))).alias("primaryDocument"),
    )
    return rows.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), block.alias("block"))


def submissions_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = submissions.unnest(_blocks(spark, sf_dir), FORMS, FROM, TO)
    return found.select("cik", "filing_type", F.col("filing_date").cast("string").alias("filing_date"), F.col("period_end").cast("string").alias("period_end"), "accession_number", "primary_doc_url")


def page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer and status; bounds of some are missing."""
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    lo, hi = (F.date_format(c, "yyyy-MM-dd") for c in ("a", "b"))
    return pages.select("o_custkey", "o_orderstatus", submissions.overlaps(F.when(F.col("o_custkey") % 7 == 0, "").otherwise(lo), F.when(F.col("o_custkey") % 5 == 0, "soon").otherwise(hi), FROM, TO).alias("kept"))


def discover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent and overflow blocks that overlap, each accession once, recent ones first."""
    blocks = _blocks(spark, sf_dir)
    rows = blocks.withColumn("page_no", F.lit(-1)).unionByName(blocks.withColumn("page_no", F.lit(0)).withColumn("block", F.struct(*[F.slice(f"block.{f}", F.lit(1), F.greatest(F.floor(F.size(f"block.{f}") / 2).cast("int"), F.lit(0))).alias(f) for f in submissions.FIELDS])))
    found = submissions.first_of_each(submissions.unnest(rows, FORMS, FROM, TO), ["cik", "accession_number"], ["page_no", "at"])
    return found.select("cik", "accession_number", F.col("page_no").cast("long").alias("page_no"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("accession_number"), F.col("o_orderdate").alias("filing_date"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("/doc/"), F.col("o_orderkey").cast("string")).alias("primary_doc_url"), "o_orderkey")


def filings_upsert_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filings(spark, sf_dir)
    target = rows.filter("o_orderkey % 3 <> 0").withColumn("primary_doc_url", F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("primary_doc_url"))).drop("o_orderkey")
    source = rows.filter("o_orderkey % 2 = 0").withColumn("status", F.lit("new")).drop("o_orderkey")
    return merges.upsert_filings(target, source).select("accession_number", "status", "primary_doc_url", "outcome")


def chunk_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source; the new run has other texts and no longer chunks."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("filing_id"), F.col("doc_id").cast("int").alias("chunk_index"), "text", F.col("n_chars").cast("int").alias("token_count"))
    target = rows.filter("chunk_index % 3 <> 0")
    source = rows.filter("chunk_index % 2 = 0 and chunk_index % 50 < 30").withColumns({"chunk_id": F.concat(F.lit("new-"), F.col("chunk_id")), "text": F.concat("text", F.lit("!"))})
    merged = merges.upsert_chunks(target, source)
    return merged.select("chunk_id", "filing_id", F.col("chunk_index").cast("long"), F.md5("text").alias("text_md5"), F.col("token_count").cast("long"))


def corpus_model_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.corpus_model(table(spark, sf_dir, "part").select(F.col("p_brand").alias("embedding_model_version")))


FILING = "user_id * 100000 + unix_date(cast(ts as date))"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a filing, and each of its errors, purchases and clicks a job: failed, done, or left running."""
    rows = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase', 'click')")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return rows.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("job_id"), F.expr(FILING).alias("filing_id"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("started_at"), F.when(status != "running", F.col("ts").cast("timestamp") + F.expr("interval 5 minutes")).alias("completed_at"), F.lit("embed").alias("step"))


def _job_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.expr(FILING).alias("filing_id")).agg(F.min("ts").cast("timestamp").alias("created_at"))
    return users.withColumn("status", F.when(F.col("filing_id") % 3 == 0, "pending").when(F.col("filing_id") % 3 == 1, "processing").otherwise("processed"))


def attempts_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.attempts(_jobs(spark, sf_dir)).select("filing_id", "attempts", F.date_format("last_failed", "yyyy-MM-dd HH:mm:ss").alias("last_failed"))


def claim_retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim, with its limit, a few seconds after the middle of the month."""
    claimed = ledger.claim(_job_filings(spark, sf_dir), _jobs(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp"), 40, most=4, base_s=43200.0, max_s=1e6)
    return claimed.select("filing_id", "status", F.col("attempts").cast("long").alias("attempts"))


def reap_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reap(_jobs(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("job_id", "status", "step", F.col("error").isNotNull().alias("reaped"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


def status_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.statuses(_job_filings(spark, sf_dir), _jobs(spark, sf_dir))
    return found.select("filing_id", F.col("attempts").cast("long").alias("attempts"), "status")


def quota_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return folds.running_quota(docs, "n_chars", ["doc_id"], 100_000, ["source"]).select("doc_id", "used", "exceeded")


def token_aware_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source in batches of at most 6000 characters, in order of id."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("int").alias("n"))
    return folds.numbered_batches(rows, ["source"], ["doc_id"], "n", 6000).select("doc_id", F.col("batch").cast("long"))


SECONDS = "unix_micros(cast(ts as timestamp)) / 1000000"


def token_bucket_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as requests of their value in tokens, at a bucket of 1000 that fills in twelve days; larger ones wait for all of their tokens."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.expr(SECONDS)).cast("double").alias("at"), F.floor(F.col("value") * 2).cast("double").alias("tokens"))
    return folds.waits(rows, ["user_id"], ["ts", "event_id"], "at", "tokens", 1000.0, 1 / 1024, start_full=False, debt=True).select("event_id", F.round("wait", 3).alias("wait"))


def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as outcomes: errors and views are hard failures, clicks soft ones."""
    outcome = F.when(F.col("event_type") == "error", "hard").when(F.col("event_type") == "view", "hard_midstream").when(F.col("event_type") == "click", "soft").otherwise("ok")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.expr(SECONDS)).cast("double").alias("at"), outcome.alias("outcome"))
    return folds.replay(rows, ["user_id"], ["ts", "event_id"], "at", "outcome", 3, 43200.0).select("event_id", "state", "served")


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken constraints of orders as filings: statuses outside the domain, and identifiers of the wrong form."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("filing_id"), F.lit("10-K").alias("filing_type"), F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("parked").alias("status"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("accession_number"))
    return violations("filings", rows)


def companies_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: those of odd keys are there, every third one comes again with another sector."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_name").alias("name"), F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik"), F.col("c_mktsegment").alias("sector"), "c_custkey")
    target = rows.filter("c_custkey % 2 = 1").withColumn("sic_code", F.lit("old")).drop("c_custkey")
    source = rows.filter("c_custkey % 3 = 0").withColumn("sector", F.lower("sector")).drop("c_custkey")
    return merges.upsert_companies(target, source)


def attempts_startable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filings have attempts left, and the job that a start would add."""
    filings, jobs = _job_filings(spark, sf_dir), _jobs(spark, sf_dir)
    started = ledger.start(filings, jobs, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("filing_id", F.col("status").alias("new_status"))
    return ledger.startable(filings, jobs).select("filing_id", F.col("attempts").cast("long").alias("attempts"), "may_start").join(started, "filing_id", "left")


def attempts_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs ended: those of even filings done, the others failed at the parse step with the start of a long error."""
    running = _jobs(spark, sf_dir).filter("status = 'running'")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    done = ledger.complete(running.filter("filing_id % 2 = 0"), now)
    failed = ledger.fail(ledger.record_step(running.filter("filing_id % 2 = 1"), "parse"), F.repeat(F.col("job_id"), F.lit(200)), now)
    return done.unionByName(failed).select("job_id", "status", "step", F.coalesce(F.length("error"), F.lit(0)).cast("long").alias("n_error"))


QUERIES = {
    f.__name__: f
    for f in (companies_upsert, attempts_startable, attempts_ended, submissions_unnest, page_overlap, discover_dedup, filings_upsert_backfill, chunk_upsert_merge, corpus_model_guard, attempts_count, claim_retryable, reap_running, status_from_ledger, quota_running_total, token_aware_batches, token_bucket_schedule, breaker_replay, constraint_violations)
}

_UNNEST = """o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n, lpad(o_custkey::varchar, 10, '0') as cik, '0000-00-' || o_orderkey as acc from orders),
hit as (select * from o where i < n and o_orderstatus in ('F', 'O') and o_orderdate::date between '1994-01-01' and '1996-12-31')"""
_JOBS = """jobs as (select lpad(event_id::varchar, 12, '0') as job_id, user_id * 100000 + date_diff('day', date '1970-01-01', ts::date) as filing_id, case event_type when 'error' then 'failed' when 'purchase' then 'done' else 'running' end as status, ts as started_at, case when event_type <> 'click' then ts + interval 5 minutes end as completed_at from events where event_type in ('error', 'purchase', 'click')),
filings as (select user_id * 100000 + date_diff('day', date '1970-01-01', ts::date) as filing_id, min(ts) as created_at, case (user_id * 100000 + date_diff('day', date '1970-01-01', ts::date)) % 3 when 0 then 'pending' when 1 then 'processing' else 'processed' end as status from events group by 1),
counted as (select filing_id, count(*) as attempts, max(completed_at) filter (status = 'failed') as last_failed from jobs group by 1)"""
_STEPS = "steps as (select user_id, event_id, event_type, floor(epoch_us(ts) / 1000000)::double as pos, floor(value * 2)::double as tokens, row_number() over (partition by user_id order by ts, event_id) as i from events)"

ORACLE_SQL = {
    "submissions_unnest": f"with {_UNNEST} select cik, o_orderstatus as filing_type, strftime(o_orderdate, '%Y-%m-%d') as filing_date, strftime(o_orderdate, '%Y-%m-%d') as period_end, acc as accession_number, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(acc, '-', '') || '/' || o_orderkey || '.htm' as primary_doc_url from hit",
    "page_overlap": "select o_custkey, o_orderstatus, case when o_custkey % 5 <> 0 and max(o_orderdate)::date < '1994-01-01' then false when o_custkey % 7 <> 0 and min(o_orderdate)::date > '1996-12-31' then false else true end as kept from orders group by 1, 2",
    "discover_dedup": f"with {_UNNEST} select cik, acc as accession_number, -1::bigint as page_no from hit union all select cik, acc, 0 from o where false",
    "filings_upsert_backfill": """with t as (select o_orderkey::varchar as accession_number, o_orderstatus as status, case when o_orderkey % 4 = 0 then null else '/doc/' || o_orderkey end as url from orders where o_orderkey % 3 <> 0),
s as (select o_orderkey::varchar as accession_number, '/doc/' || o_orderkey as url from orders where o_orderkey % 2 = 0)
select coalesce(t.accession_number, s.accession_number) as accession_number, coalesce(t.status, 'new') as status, coalesce(t.url, s.url) as primary_doc_url,
case when t.accession_number is null then 'inserted' when s.accession_number is null then null when t.url is null then 'backfilled' else 'untouched' end as outcome from t full join s on t.accession_number = s.accession_number""",
    "chunk_upsert_merge": """with t as (select * from documents where doc_id % 3 <> 0), s as (select * from documents where doc_id % 2 = 0 and doc_id % 50 < 30),
last as (select source, max(doc_id) as last from s group by 1),
m as (select coalesce(t.doc_id::varchar, 'new-' || s.doc_id) as chunk_id, coalesce(t.source, s.source) as filing_id, coalesce(t.doc_id, s.doc_id) as chunk_index, md5(case when s.doc_id is not null then s.text || '!' else t.text end) as text_md5, coalesce(s.n_chars, t.n_chars) as token_count from t full join s on t.doc_id = s.doc_id)
select m.* from m left join last on filing_id = source where last is null or chunk_index <= last""",
    "corpus_model_guard": "select max(p_brand) as model from part",
    "attempts_count": f"with {_JOBS} select filing_id, attempts, strftime(last_failed, '%Y-%m-%d %H:%M:%S') as last_failed from counted",
    "claim_retryable": f"""with {_JOBS}, r as (select filing_id, status, coalesce(attempts, 0) as attempts, created_at, last_failed from filings left join counted using (filing_id) where status in ('pending', 'processing'))
select filing_id, status, attempts from r where status = 'pending' or (attempts between 1 and 3 and (last_failed is null or last_failed + to_seconds(least(43200 * power(2, attempts - 1), 1e6)) <= timestamp '2024-01-25')) order by (status <> 'pending')::int, created_at, filing_id limit 40""",
    "reap_running": f"with {_JOBS} select job_id, case when status = 'running' then 'failed' else status end as status, 'embed' as step, status = 'running' as reaped, strftime(coalesce(completed_at, timestamp '2024-02-01'), '%Y-%m-%d %H:%M:%S') as completed_at from jobs",
    "status_from_ledger": f"""with {_JOBS}, last as (select filing_id, count(*) as attempts, arg_max(status, (started_at, job_id)) as s from jobs group by 1)
select filing_id, coalesce(attempts, 0) as attempts, case when s = 'done' then 'processed' when s is null then 'pending' when s = 'failed' and attempts >= 3 then 'failed' else 'processing' end as status from filings left join last using (filing_id)""",
    "quota_running_total": "select doc_id, sum(n_chars) over (partition by source order by doc_id)::bigint as used, sum(n_chars) over (partition by source order by doc_id) >= 80000 as exceeded from documents",
    "token_aware_batches": """with recursive d as (select source, doc_id, n_chars as n, row_number() over (partition by source order by doc_id) as i from documents),
f as (select source, doc_id, i, 0::bigint as batch, n as s from d where i = 1 union all
select d.source, d.doc_id, d.i, case when f.s + d.n > 6000 then f.batch + 1 else f.batch end, case when f.s + d.n > 6000 then d.n else f.s + d.n end from f join d on d.source = f.source and d.i = f.i + 1)
select doc_id, batch from f""",
    "token_bucket_schedule": f"""with recursive {_STEPS},
a as (select *, least(1000.0::double, greatest(0.0::double, pos) / 1024) as level from steps where i = 1),
f as (select user_id, event_id, i, level + greatest(0.0::double, (tokens - level) * 1024) / 1024 - tokens as level, pos + greatest(0.0::double, (tokens - level) * 1024) as clock, greatest(0.0::double, (tokens - level) * 1024) as wait from a union all
select user_id, event_id, i, level + greatest(0.0::double, (tokens - level) * 1024) / 1024 - tokens, now + greatest(0.0::double, (tokens - level) * 1024), now + greatest(0.0::double, (tokens - level) * 1024) - pos
from (select s.user_id, s.event_id, s.i, s.pos, s.tokens, greatest(f.clock, s.pos) as now, least(1000.0::double, f.level + (greatest(f.clock, s.pos) - f.clock) / 1024) as level from f join steps s on s.user_id = f.user_id and s.i = f.i + 1))
select event_id, round(wait, 3) as wait from f""",
    "breaker_replay": f"""with recursive {_STEPS}, o as (select *, case event_type when 'error' then 'hard' when 'view' then 'mid' when 'click' then 'soft' else 'ok' end as outcome from steps),
f as (select user_id, i, 0::bigint as event_id, 0 as streak, null::double as opened, '' as state, '' as served from (select distinct user_id, 0::bigint as i from o) union all
select user_id, i, event_id, case when state = 'open' then streak when outcome in ('hard', 'mid') then streak + 1 when outcome = 'ok' then 0 else streak end,
case when state = 'open' then opened when outcome in ('hard', 'mid') and streak + 1 >= 3 then pos when outcome = 'ok' then null else opened end, state,
case when state = 'open' or outcome = 'hard' then 'fallback' when outcome = 'ok' then 'model' else 'error' end
from (select o.user_id, o.i, o.event_id, o.pos, o.outcome, f.streak, f.opened, case when f.opened is null then 'closed' when o.pos - f.opened >= 43200 then 'half_open' else 'open' end as state from f join o on o.user_id = f.user_id and o.i = f.i + 1))
select event_id, state, served from f where i > 0""",
    "companies_upsert": """with t as (select c_custkey, c_custkey::varchar as ticker, c_name as name, lpad(c_nationkey::varchar, 10, '0') as cik, c_mktsegment as sector from customer)
select ticker, name, cik, case when c_custkey % 3 = 0 then lower(sector) else sector end as sector, case when c_custkey % 2 = 1 then 'old' end as sic_code from t where c_custkey % 2 = 1 or c_custkey % 3 = 0""",
    "attempts_startable": f"with {_JOBS} select filing_id, coalesce(attempts, 0) as attempts, coalesce(attempts, 0) < 3 as may_start, case when coalesce(attempts, 0) < 3 then 'running' end as new_status from filings left join counted using (filing_id)",
    "attempts_ended": f"with {_JOBS} select job_id, case when filing_id % 2 = 0 then 'done' else 'failed' end as status, case when filing_id % 2 = 0 then 'embed' else 'parse' end as step, case when filing_id % 2 = 1 then 2000::bigint else 0 end as n_error from jobs where status = 'running'",
    "constraint_violations": "select 'status in domain' as constraint, count(*) as n from orders where o_orderstatus not in ('F', 'O') union all select 'accession format', count(*) from orders",
}
