"""Selection, coverage, verdicts and answers.

A request of the answers is a source and three years, so that every chunk belongs to one; its question is the vector of
its source's first chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.catalogue.base import REQUESTS_SQL, SCORED_SQL, corpus, likeness, scored, table
from dossier.config import Settings
from dossier.functions.numbers import effective_floor
from dossier.operators import answer, coverage
from dossier.operators.embedding import embed_documents, hashed_embedder
from dossier.operators.selection import dropped_pairs, select_with_floor
from dossier.plans.engine import Engine, lexeme_index
from dossier.plans.settle import settle

#: Each query's chunks in parts of two languages and two years (4 pairs), or three (6), or all together.
NORMAL, GRADUATED, WHOLE = ("concat(ticker in ('en', 'de'), '-', period_year div 2)", "concat(ticker in ('en', 'de'), '-', period_year div 3)", "'all'")


def _chosen(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    rows = settle(scored(spark, sf_dir, 8).withColumn("part", F.expr(part)))
    return select_with_floor(rows, 2, 8, ["q", "part"]).select("q", "part", "chunk_id", "ticker", "period_year", "score", F.col("place").cast("long"))


def select_with_floor_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, NORMAL)


def select_with_floor_graduated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, GRADUATED)


def select_with_floor_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, WHOLE)


def capacity_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_pairs(settle(scored(spark, sf_dir, 1)), 2, 8, ["q"])


REQUEST = "concat(section, '-', period_year div 3)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir).filter("embedding is not null")
    questions = chunks.groupBy("section").agg(F.min_by("embedding", "chunk_id").alias("query_vector"))
    rows = chunks.join(questions, "section").withColumn("score", likeness(F.col("embedding"), F.col("query_vector")))
    return rows.withColumn("request_id", F.expr(REQUEST)).drop("embedding", "query_vector")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus(spark, sf_dir).groupBy(F.expr(REQUEST).alias("request_id"))
    return pairs.agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set("period_year")).alias("years"))


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pool = settle(_pool(spark, sf_dir))
    chosen = select_with_floor(pool.drop("metadata"), 2, 8, ["request_id"]).withColumn("filing_type", F.lit("10-K"))
    return chosen, dropped_pairs(pool, 2, 8, ["request_id"]), coverage.needed_pairs(_plans(spark, sf_dir))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _, needed = _selected(spark, sf_dir)
    return needed.join(selected.select(*coverage.PAIR).distinct(), coverage.PAIR, "left_anti")


def coverage_capacity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, dropped, needed = _selected(spark, sf_dir)
    return coverage.gaps(needed, selected, dropped)


def evaluate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, dropped, needed = _selected(spark, sf_dir)
    found = coverage.verdicts(_plans(spark, sf_dir), coverage.gaps(needed, selected, dropped), coverage.has_passages(selected, 5))
    return found.select("request_id", "confidence", "confidence_reason", F.size("coverage_gaps").cast("long").alias("n_gaps"), F.size("capacity_drops").cast("long").alias("n_drops"))


def pair_closure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed pairs by request, and how many of them are neither cited nor named; the latter must be 0."""
    selected, dropped, needed = _selected(spark, sf_dir)
    named = coverage.gaps(needed, selected, dropped)
    left = coverage.open_pairs(needed, selected, named).groupBy("request_id").agg(F.count("*").alias("n_open"))
    return needed.groupBy("request_id").agg(F.count("*").alias("n_needed")).join(left, "request_id", "left").fillna(0, ["n_open"])


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _, _ = _selected(spark, sf_dir)
    return answer.citations(selected).withColumn("place", F.col("place").cast("long"))


def evidence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _, _ = _selected(spark, sf_dir)
    return answer.evidence(_plans(spark, sf_dir), selected)


def degraded_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _, _ = _selected(spark, sf_dir)
    return answer.extractive(_plans(spark, sf_dir).select("request_id"), selected).withColumn("seq", F.col("seq").cast("long"))


def meta_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' order and kinds; data of meta and done are read back from their JSON."""
    selected, dropped, needed = _selected(spark, sf_dir)
    plans = _plans(spark, sf_dir)
    verdicts = coverage.verdicts(plans, coverage.gaps(needed, selected, dropped), coverage.has_passages(selected, 5))
    none = F.expr("cast(array() as array<string>)")
    known = plans.withColumns({"plan_tickers": F.col("tickers"), "unavailable_tickers": none, "unavailable_companies": none, "unavailable_years": none})
    events = answer.events(answer.meta(known, verdicts), answer.with_caveat(answer.extractive(plans.select("request_id"), selected), verdicts), answer.citations(selected))
    return events.select("request_id", F.col("seq").cast("long"), "event", F.get_json_object("data", "$.confidence").alias("confidence"), F.coalesce(F.get_json_object("data", "$.token_count").cast("long"), F.lit(-1)).alias("token_count"))


def ask_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine: questions made of benchmark passages, answered from the corpus as events."""
    roster = spark.createDataFrame([("EN", "English Holdings"), ("DE", "Deutsche Company"), ("FR", "French Inc."), ("ES", "Spanish Corp")], "ticker string, name string")
    chunks = corpus(spark, sf_dir).withColumns({"ticker": F.upper("ticker"), "period_year": F.col("period_year") % 6 + 2021, "embedding_model_version": F.lit("hashed-64")}).drop("embedding")
    embedder = hashed_embedder(64)
    chunks = settle(embed_documents(chunks, embedder, "hashed-64"))
    engine = Engine(chunks, roster, settle(lexeme_index(chunks)), "hashed-64", Settings(), embedder)
    first = F.substring_index(F.regexp_replace("text", r"[^\p{L} ]", ""), " ", 2)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), F.concat(F.lit("Compare English and Deutsche "), first, F.lit(" in 2023 versus 2024")).alias("question"))
    return engine.ask(questions)


def roster_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.roster_lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name")))


def synthesis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, dropped, _ = _selected(spark, sf_dir)
    plans = _plans(spark, sf_dir)
    pairs = dropped.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ticker", F.col("period_year").alias("year")))).alias("dropped"))
    rows = answer.evidence(plans, selected).join(plans, "request_id").join(pairs, "request_id", "left").withColumn("dropped", F.coalesce("dropped", F.expr("cast(array() as array<struct<ticker: string, year: int>>)")))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("request_id", answer.synthesis_prompt(F.col("request_id"), F.col("evidence"), F.col("tickers"), none, F.col("years"), F.col("dropped")).alias("prompt"))


def marker_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite the first, third and twelfth passage, and where their markers lead."""
    selected, _, _ = _selected(spark, sf_dir)
    answers = _plans(spark, sf_dir).select("request_id", F.lit("As told [1], and again [3][1], but not [12].").alias("text"))
    return answer.marker_links(answers, answer.citations(selected)).select("request_id", F.col("place").cast("long"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), "ticker")


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers as server-sent frames of token events."""
    selected, _, _ = _selected(spark, sf_dir)
    told = answer.extractive(_plans(spark, sf_dir).select("request_id"), selected.withColumn("text", F.col("chunk_id").cast("string")))
    return answer.frames(told.select("request_id", F.col("seq").cast("long").alias("seq"), F.lit("token").alias("event"), F.to_json(F.struct("text")).alias("data")))


def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor that each source's number of pairs leaves of a floor of 3 under a cap of 20."""
    pairs = corpus(spark, sf_dir).select(F.col("section").alias("request_id"), "ticker", "period_year").distinct().groupBy("request_id").agg(F.count("*").alias("n_pairs"))
    return pairs.select("request_id", "n_pairs", effective_floor(F.col("n_pairs"), 3, 20).cast("long").alias("floor"))


QUERIES = {
    f.__name__: f
    for f in (marker_links, wire_events, floors, select_with_floor_normal, select_with_floor_graduated, select_with_floor_overflow, capacity_dropped, coverage_gaps, coverage_capacity_split, evaluate_verdict, pair_closure_check, citations, evidence_render, degraded_answer, meta_event, ask_events, roster_render, synthesis_prompts)
}

# By is the request's column and a comma, or nothing.
_RANKS = """p as (select *, row_number() over (partition by {by}ticker, period_year order by score desc, chunk_id) as in_pair from pool),
pairs as (select {by}ticker, period_year, row_number() over ({over}order by score desc, chunk_id) as pair_rank, count(*) over ({over}) as n from p where in_pair = 1),
r as (select p.*, pair_rank, n, case when n * 2 <= 8 then 2 when n <= 8 then greatest(1, 8 // n) else 1 end as eff from p join pairs using ({by}ticker, period_year)),
turns as (select *, row_number() over ({over}order by (in_pair > eff)::integer, score desc, chunk_id) as turn from r where n <= 8 or pair_rank <= 8),
chosen as (select *, row_number() over ({over}order by score desc, chunk_id) as place from turns where turn <= 8)"""
_ONE = _RANKS.format(by="q, part, ", over="partition by q, part ")
_EACH = _RANKS.format(by="request_id, ", over="partition by request_id ")
_PLAN = f"""with {REQUESTS_SQL}, {_EACH},
needed as (select distinct request_id, t.ticker, y.period_year from (select distinct request_id, ticker from parts) t join (select distinct request_id, period_year from parts) y using (request_id)),
dropped as (select distinct request_id, ticker, period_year from r where n > 8 and pair_rank > 8),
gaps as (select n.*, case when d.ticker is not null then 'capacity' else 'coverage' end as cause from needed n anti join chosen c using (request_id, ticker, period_year) left join dropped d using (request_id, ticker, period_year)),
requests as (select distinct request_id from parts),
counts as (select request_id, coalesce(n_gaps, 0) as n_gaps, coalesce(n_drops, 0) as n_drops, coalesce(n_chosen, 0) as n_chosen from requests
  left join (select request_id, count(*) filter (cause = 'coverage') as n_gaps, count(*) filter (cause = 'capacity') as n_drops from gaps group by 1) using (request_id)
  left join (select request_id, count(*) as n_chosen from chosen group by 1) using (request_id)),
verdict as (select counts.request_id, case when n_gaps > 0 or n_chosen < 5 or v.request_id is null then 'low' else 'high' end as confidence,
  case when n_gaps > 0 or v.request_id is null then 'coverage' when n_chosen < 5 then 'llm' else 'none' end as confidence_reason, n_gaps, n_drops, n_chosen from counts left join (select distinct request_id from needed) v using (request_id))"""
_EVIDENCE = "select request_id, string_agg('[' || place || '] ' || ticker || ' 10-K FY' || period_year || ' | section=' || section || chr(10) || text, chr(10) || chr(10) order by place) as evidence from chosen group by 1"
_NORMAL = f"with {SCORED_SQL}, pool as (select *, {{part}} as part from scored), {_ONE} select q, part, chunk_id, ticker, period_year, score, place from chosen"

ORACLE_SQL = {
    "select_with_floor_normal": _NORMAL.format(part=NORMAL.replace(" div ", " // ")),
    "select_with_floor_graduated": _NORMAL.format(part=GRADUATED.replace(" div ", " // ")),
    "select_with_floor_overflow": _NORMAL.format(part=WHOLE),
    "capacity_dropped": f"with {SCORED_SQL}, pool as (select *, 'all' as part from scored), {_ONE} select distinct q, ticker, period_year from r where n > 8 and pair_rank > 8",
    "coverage_gaps": f"{_PLAN} select request_id, ticker, period_year from gaps",
    "coverage_capacity_split": f"{_PLAN} select request_id, ticker, period_year, cause from gaps",
    "evaluate_verdict": f"{_PLAN} select request_id, confidence, confidence_reason, n_gaps, n_drops from verdict",
    "pair_closure_check": f"{_PLAN} select request_id, count(*) as n_needed, 0::bigint as n_open from needed group by 1",
    "citations": f"{_PLAN} select request_id, place, chunk_id, ticker, '10-K' as filing_type, period_year, section from chosen",
    "evidence_render": f"{_PLAN} select request_id, coalesce(evidence, '(no passages retrieved)') as evidence from requests left join ({_EVIDENCE}) using (request_id)",
    "degraded_answer": f"""{_PLAN} select request_id, 0::bigint as seq, '_Synthesis is temporarily unavailable; showing the most relevant source excerpts directly._' || chr(10) as text from requests
union all select request_id, 1, chr(10) || 'No relevant filing excerpts were retrieved for this query.' || chr(10) from counts where n_chosen = 0
union all select request_id, place, chr(10) || '[' || ticker || ' 10-K ' || period_year || ' · ' || section || ']' || chr(10) || text || chr(10) from chosen""",
    "meta_event": f"""{_PLAN}, tokens as (select request_id, -1 as pos from verdict where confidence = 'low' union all select request_id, 0 from requests union all select request_id, 1 from counts where n_chosen = 0 union all select request_id, place from chosen),
told as (select request_id, 0 as stage, 0 as pos, 'meta' as event, confidence, null::bigint as token_count from verdict union all select request_id, 1, pos, 'token', null, null from tokens
union all select request_id, 2, 0, 'citations', null, null from requests union all select request_id, 3, 0, 'done', null, count(*) from tokens group by 1)
select request_id, row_number() over (partition by request_id order by stage, pos) - 1 as seq, event, confidence, coalesce(token_count, -1) as token_count from told""",
    "marker_links": f"{_PLAN} select request_id, place, coalesce(chunk_id, -1) as chunk_id, ticker from (select request_id, unnest([1, 3, 12])::bigint as place from requests) left join chosen using (request_id, place)",
    "wire_events": f"""{_PLAN}, told as (select request_id, 0::bigint as seq, '_Synthesis is temporarily unavailable; showing the most relevant source excerpts directly._' || chr(10) as text from requests
union all select request_id, 1, chr(10) || 'No relevant filing excerpts were retrieved for this query.' || chr(10) from counts where n_chosen = 0
union all select request_id, place, chr(10) || '[' || ticker || ' 10-K ' || period_year || ' · ' || section || ']' || chr(10) || chunk_id || chr(10) from chosen)
select request_id, seq, 'event: token' || chr(10) || 'data: ' || to_json({{'text': text}})::varchar || chr(10) || chr(10) as frame from told""",
    "floors": f"with {SCORED_SQL}, n as (select section as request_id, count(distinct (ticker, period_year)) as n_pairs from corpus group by 1) select request_id, n_pairs, (case when n_pairs * 3 <= 20 then 3 when n_pairs <= 20 then greatest(1, 20 // n_pairs) else 1 end)::bigint as floor from n",
    "roster_render": "select string_agg('- ' || s_suppkey || ' — ' || s_name, chr(10) order by s_suppkey::varchar) as roster from supplier",
    "synthesis_prompts": f"""{_PLAN}, rows as (select request_id, coalesce(evidence, '(no passages retrieved)') as evidence from requests left join ({_EVIDENCE}) using (request_id)),
t as (select request_id, string_agg(ticker, ', ' order by ticker) as tickers from (select distinct request_id, ticker from parts) group by 1),
y as (select request_id, string_agg(period_year::varchar, ', ' order by period_year) as years from (select distinct request_id, period_year from parts) group by 1),
d as (select request_id, string_agg(ticker || ' ' || period_year, ', ' order by ticker, period_year) as pairs from dropped group by 1)
select request_id, 'User question:' || chr(10) || request_id || chr(10) || chr(10) || 'Unavailable (out-of-corpus) tickers: ' || tickers || chr(10) || 'Unavailable (out-of-corpus) companies: (none)' || chr(10) || 'Unavailable (out-of-coverage) years: ' || coalesce(years, '(none)') || chr(10) ||
coalesce('Omitted for context capacity (evidence existed but exceeded the context budget -- NOT missing data): ' || pairs || chr(10), '') || chr(10) || 'Retrieved evidence:' || chr(10) || evidence as prompt
from rows join t using (request_id) left join y using (request_id) left join d using (request_id)""",
}
