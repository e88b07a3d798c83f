"""Vector, lexical and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.catalogue.base import CORPUS_SQL, DISTANCE_SQL, TERMS_SQL, asked_cells, corpus, sizes, table, term_index, topics
from dossier.functions.lexemes import query_lexemes, to_lexemes, words
from dossier.operators import retrieval as R
from dossier.operators import scorer
from dossier.operators.postingindex import PostingIndex
from dossier.operators.selection import overlap_score, ranked_pairs, rerank
from dossier.operators.vectorindex import VectorIndex
from dossier.plans.engine import lexeme_index
from dossier.plans.settle import shared_folder, store

CELL = ["ticker", "period_year", "q"]
FUSED = "select {by}, chunk_id, sum(1.0::double / (60 + rank)) as score from (select {by}, chunk_id, rank from vec union all select {by}, chunk_id, rank from lex) group by all"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.vector_rank(topics(spark, sf_dir), corpus(spark, sf_dir).drop("ticker", "period_year"), 20, ["q"])
    return found.select("q", "chunk_id", "distance", F.col("rank").cast("long"))


def vector_topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    found = R.vector_rank(asked_cells(spark, sf_dir, chunks), chunks, 20, CELL)
    return found.select(*CELL, "chunk_id", "distance", F.col("rank").cast("long"))


def lexical_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = topics(spark, sf_dir).drop("query_vector")
    return R.matches(asked, term_index(spark, sf_dir, asked).drop("ticker", "period_year"), ["q"])


def lexical_topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    found = R.lexical_rank(asked_cells(spark, sf_dir, chunks), term_index(spark, sf_dir, topics(spark, sf_dir)), 20, CELL)
    return found.select(*CELL, "chunk_id", "score", F.col("rank").cast("long"))


def lexical_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages' first words as queries, stemmed, ranked by cover density."""
    chunks = corpus(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.substring_index("text", " ", 4).alias("sub_question")).withColumn("terms", query_lexemes("sub_question"))
    return R.lexical_rank(asked, lexeme_index(chunks).drop("ticker", "period_year"), 20, ["q"], cover=True).select("q", "chunk_id", "score", F.col("rank").cast("long"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    q = topics(spark, sf_dir)
    fused = R.fuse(R.vector_rank(q, chunks.drop("ticker", "period_year"), 20, ["q"]), R.lexical_rank(q, term_index(spark, sf_dir, q).drop("ticker", "period_year"), 20, ["q"]), 10, 60, ["q"])
    return fused.select("q", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long"))


def hybrid_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    found = R.hybrid_search(asked_cells(spark, sf_dir, chunks), chunks, term_index(spark, sf_dir, topics(spark, sf_dir)), CELL)
    # Of the text only its length is returned, so no text is moved.
    rows = found.join(sizes(spark, sf_dir), ["chunk_id", "ticker", "period_year"])
    return rows.select(*CELL, "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long"), "section", "n_chars")


def cells_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each source: its languages, its labels and two topics."""
    chunks = corpus(spark, sf_dir)
    plans = chunks.groupBy(F.col("section").alias("request_id")).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set("period_year")).alias("years")).withColumn("sub_questions", F.array(F.lit("income"), F.lit("costs"), F.lit("income")))
    return R.cells(plans).withColumn("cell", F.col("cell").cast("long"))


def merge_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.first_of_each(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def enrich_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("chunk_index"), "l_partkey", "l_suppkey")
    filings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("filing_type"), F.col("o_orderdate").alias("period_end"))
    return R.with_filing(items, filings)


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question: the best 20 chunks with its first two words in each (ticker, year), scored against it."""
    chunks = corpus(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    asked = items.select("q", F.slice(words(F.col("question")), 1, 2).alias("terms"))
    cells = asked.crossJoin(chunks.select("ticker", "period_year").distinct())
    found = R.lexical_rank(cells, term_index(spark, sf_dir, asked), 20, CELL).select("q", "chunk_id")
    return rerank(R.enrich(found, chunks).join(items, "q")).select("q", "chunk_id", "rerank_score")


def fitted_scorer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fitted scorer ranks the benchmark's held-out passages above others, for parts of themselves, no worse than term overlap does."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text").filter("text is not null")
    fitted = scorer.fit(passages)
    counts = passages.select(F.explode(F.map_keys(to_lexemes("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    asked = scorer.questions(passages.filter(scorer.part_of(F.col("chunk_id"), 20)))
    pool = store(scorer.pools(asked, passages, counts).join(asked, "q").join(passages, "chunk_id"))
    ranks = []
    for name, score in (("fitted", fitted), ("overlap", overlap_score)):
        rows = rerank(pool, score).select("q", (F.col("q") == F.col("chunk_id")).alias("own"), "rerank_score")
        best = rows.filter("own").select("q", F.col("rerank_score").alias("best"))
        # Others with the same score count as better.
        above = rows.join(best, "q").groupBy("q").agg(F.count_if(~F.col("own") & (F.col("rerank_score") >= F.col("best"))).alias("n"))
        ranks.append(above.agg(F.sum(1 / (1 + F.col("n"))).alias(name)))
    total = passages.agg(F.count("*").alias("passages"))  # one row each
    return total.crossJoin(ranks[0]).crossJoin(ranks[1]).select("passages", F.coalesce(F.col("fitted") >= F.col("overlap"), F.lit(True)).alias("no_worse"))


def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 20 of the inverted-file search against exact search, for every 20th vector."""
    chunks = corpus(spark, sf_dir).filter("embedding is not null").select("chunk_id", "embedding")
    asked = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("q"), F.transform("embedding", lambda x: x.cast("double")).alias("query_vector"))
    index, centres = R.ivf_lists(chunks, 16)
    found = R.ivf_search(asked, index, centres, 8, 20, ["q"]).select("q", "chunk_id", F.lit(1).alias("hit"))
    exact = R.vector_rank(asked, chunks, 20, ["q"]).select("q", "chunk_id")
    return exact.join(found, ["q", "chunk_id"], "left").groupBy("q").agg((F.count("hit") / F.count("*")).alias("recall"))


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors, half of them built at first and half inserted; and every 20th vector as a query."""
    chunks = corpus(spark, sf_dir)
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    index = VectorIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", most=100_000)
    index.build(chunks.filter(half == 0), 16)
    index.insert(chunks.filter(half == 1), "second")
    return index, topics(spark, sf_dir).select("q", "query_vector")


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index, with the probes that it chose, finds nine tenths of the exact neighbours of all queries."""
    index, asked = _vector_index(spark, sf_dir)
    exact = R.vector_rank(asked, corpus(spark, sf_dir).drop("ticker", "period_year"), 20, ["q"]).select("q", "chunk_id")
    found = index.search(asked, 20, ["q"]).select("q", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["q", "chunk_id"], "left").agg(F.countDistinct("q").alias("queries"), F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_met"))


def vector_index_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the index probed, which is exact search."""
    index, asked = _vector_index(spark, sf_dir)
    return index.search(asked, 20, ["q"], probes=0).select("q", "chunk_id", "distance", F.col("rank").cast("long"))


def _posting_index(spark: SparkSession, sf_dir: str) -> PostingIndex:
    """Postings of all words of all documents, stored in two inserts."""
    rows = store(R.postings(corpus(spark, sf_dir), words(F.coalesce("text", F.lit(""))), ["ticker", "period_year"]))
    index = PostingIndex(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", buckets=8)
    for part in range(2):
        index.insert(rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part), f"part-{part}")
    return index


def postings_topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexical_topk_per_cell from stored postings."""
    asked = asked_cells(spark, sf_dir, corpus(spark, sf_dir)).drop("query_vector").filter("terms is not null")
    return _posting_index(spark, sf_dir).search(asked, 20, CELL).select(*CELL, "chunk_id", "score", F.col("rank").cast("long"))


def postings_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of every query by cover density, from stored postings; ranks by scores to nine digits."""
    asked = topics(spark, sf_dir).select("q", "terms").filter("terms is not null")
    found = _posting_index(spark, sf_dir).search(asked, 20, ["q"], cover=True)
    # Covers are summed in another order elsewhere: the last chunk's score is compared, not which of equal ones it is.
    return found.groupBy("q").agg(F.count("*").alias("n"), F.round(F.max("score"), 9).alias("best"), F.round(F.min("score"), 9).alias("last"), F.round(F.sum("score"), 6).alias("total"))


def pool_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by (ticker, year), with the rank of each in its pair by length."""
    rows = corpus(spark, sf_dir).select("ticker", "period_year", "chunk_id", F.length("text").alias("score"))
    return ranked_pairs(rows, 2, 8, []).select("ticker", "period_year", "chunk_id", F.col("in_pair").cast("long"))


QUERIES = {f.__name__: f for f in (hybrid_cell_search, vector_topk, vector_topk_per_cell, lexical_match_and, lexical_topk_per_cell, lexical_cover_density, rrf_fusion, cells_cross_product, merge_dedup_first, enrich_join, rerank_scores, fitted_scorer_rank, ann_ivf_recall, vector_index_recall, vector_index_full, postings_topk_per_cell, postings_cover_topk, pool_by_pair)}

_VEC = "vec as (select * from (select {by}, chunk_id, row_number() over (partition by {by} order by distance, chunk_id) as rank from (select {keys} as q, {extra}chunk_id, " + DISTANCE_SQL + " as distance from corpus, topics where e is not null)) where rank <= 20)"
_LEX = "hits as (select {by}, chunk_id, sum(tf) as score from postings join asked using (term) group by {by}, chunk_id, n having count(*) = n), lex as (select * from (select {by}, chunk_id, row_number() over (partition by {by} order by score desc, chunk_id) as rank from hits) where rank <= 20)"
_ALL = {"by": "q", "keys": "q", "extra": ""}
_CELL = {"by": "ticker, period_year, q", "keys": "q", "extra": "ticker, period_year, "}

_TOPK = f"with {CORPUS_SQL}, d as (select q, chunk_id, {DISTANCE_SQL} as distance from corpus, topics where e is not null) select * from (select q, chunk_id, distance, row_number() over (partition by q order by distance, chunk_id) as rank from d) where rank <= 20"

_LEXICAL = f"with {CORPUS_SQL}, {TERMS_SQL}, hits as (select ticker, period_year, q, chunk_id, sum(tf)::bigint as score from postings join asked using (term) group by ticker, period_year, q, chunk_id, n having count(*) = n) select * from (select *, row_number() over (partition by ticker, period_year, q order by score desc, chunk_id) as rank from hits) where rank <= 20"
# A stretch is a cover where its first place is later than that of the one before; at most two terms are asked.
_COVER = f"""with {CORPUS_SQL}, {TERMS_SQL},
listed as (select chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as ws from corpus),
placed as (select chunk_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos from listed),
numbered as (select q, term, n, row_number() over (partition by q order by term) as k from asked),
events as (select q, n, chunk_id, k, pos from placed join numbered using (term)),
begun as (select *, case when n = 1 then pos else nullif(least(coalesce(max(pos) filter (k = 1) over w, 0), coalesce(max(pos) filter (k = 2) over w, 0)), 0) end as b from events window w as (partition by q, chunk_id order by pos)),
covers as (select *, b > coalesce(lag(b) over (partition by q, chunk_id order by pos), 0) as is_new from begun),
scores as (select q, chunk_id, sum(case when is_new then 0.1::double / (1 + greatest(0, pos - b - (n - 1))) else 0 end) as score from covers group by q, chunk_id, n having count(distinct k) = n),
ranked as (select *, row_number() over (partition by q order by score desc, chunk_id) as r from scores)
select q, count(*) as n, round(max(score), 9) as best, round(min(score), 9) as last, round(sum(score), 6) as total from ranked where r <= 20 group by q"""

ORACLE_SQL = {
    "fitted_scorer_rank": "select count(*) as passages, true as no_worse from benchmark where text is not null",
    "vector_index_full": _TOPK,
    "vector_index_recall": f"select count(distinct q) as queries, count(*) as pairs, true as recall_met from ({_TOPK})",
    "vector_topk": _TOPK,
    "vector_topk_per_cell": f"with {CORPUS_SQL}, d as (select ticker, period_year, q, chunk_id, {DISTANCE_SQL} as distance from corpus, topics where e is not null) select * from (select *, row_number() over (partition by ticker, period_year, q order by distance, chunk_id) as rank from d) where rank <= 20",
    "lexical_match_and": f"with {CORPUS_SQL}, {TERMS_SQL} select q, chunk_id, sum(tf)::bigint as score from postings join asked using (term) group by q, chunk_id, n having count(*) = n",
    "lexical_topk_per_cell": _LEXICAL,
    "postings_topk_per_cell": _LEXICAL,
    "postings_cover_topk": _COVER,
    "rrf_fusion": f"with {CORPUS_SQL}, {TERMS_SQL}, {_VEC.format(**_ALL)}, {_LEX.format(**_ALL)}, fused as ({FUSED.format(**_ALL)}) select q, chunk_id, round(score, 9) as score, rank from (select *, row_number() over (partition by q order by score desc, chunk_id) as rank from fused) where rank <= 10",
    "hybrid_cell_search": f"with {CORPUS_SQL}, {TERMS_SQL}, {_VEC.format(**_CELL)}, {_LEX.format(**_CELL)}, fused as ({FUSED.format(**_CELL)}), top as (select * from (select *, row_number() over (partition by ticker, period_year, q order by score desc, chunk_id) as rank from fused) where rank <= 10) select ticker, period_year, q, chunk_id, round(score, 9) as score, rank, section, length(text) as n_chars from top join corpus using (chunk_id, ticker, period_year)",
    "cells_cross_product": f"""with {CORPUS_SQL}, t as (select distinct section as request_id, ticker from corpus), y as (select distinct section as request_id, period_year from corpus),
s as (select * from (values (0, 'income'), (1, 'costs')) as v(k, sub_question))
select request_id, row_number() over (partition by request_id order by ticker, period_year, k) - 1 as cell, ticker, period_year, sub_question from t join y using (request_id), s""",
    "merge_dedup_first": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1",
    "enrich_join": "select l_orderkey as filing_id, l_linenumber as chunk_index, l_partkey, l_suppkey, o_orderpriority as ticker, o_orderstatus as filing_type, year(o_orderdate)::integer as period_year from lineitem join orders on l_orderkey = o_orderkey",
    "pool_by_pair": f"with {CORPUS_SQL} select ticker, period_year, chunk_id, row_number() over (partition by ticker, period_year order by length(text) desc, chunk_id) as in_pair from corpus",
}
