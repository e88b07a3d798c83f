"""Rails and scalar operators, over nations, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.catalogue.base import table
from dossier.functions import numbers, text
from dossier.operators import rails
from dossier.operators.scans import LastSeen, scan


def _long(column: str) -> F.Column:
    return F.transform(column, lambda x: x.cast("bigint"))


def ticker_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as asked for; those with even keys are in the corpus."""
    nations = table(spark, sf_dir, "nation")
    asked = nations.groupBy(F.col("n_regionkey").alias("request_id")).agg(F.array_sort(F.collect_list("n_name")).alias("tickers"))
    allowed = nations.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(True).alias("known"))
    found = rails.split_by(asked, "request_id", "tickers", allowed)
    return found.select("request_id", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


def _asked_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the years of its orders, in order of date and key, and the first and last written together."""
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.year("o_orderdate").alias("y")))).alias("rows"))
    listed = years.withColumn("years", F.transform("rows", lambda r: r["y"].cast("bigint")))
    return listed.select("o_custkey", F.concat("years", F.array(F.element_at("years", 1) * 10000 + F.element_at("years", -1))).alias("years"))


def year_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = numbers.repair_years(F.col("years"))
    return _asked_years(spark, sf_dir).select("o_custkey", F.array_join(repaired.cast("array<string>"), ",").alias("years"))


def year_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = rails.split_years(F.col("years"), 1995, 1997)
    return _asked_years(spark, sf_dir).select("o_custkey", F.array_join(kept.cast("array<string>"), ",").alias("kept"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped"))


def company_rail_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of part names against the legal names of all brands and types."""
    parts = table(spark, sf_dir, "part")
    names = parts.select("p_partkey", F.array(F.upper(F.substring("p_brand", 1, 7)), F.substring("p_brand", 1, 2), "p_type", F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias("names"))
    known = rails.in_roster_of(names.select(F.explode("names").alias("name")), parts.select(F.col("p_brand").alias("name")))
    found = rails.split_by(names, "p_partkey", "names", known)
    return found.select("p_partkey", F.array_join("dropped", "|").alias("outside"), F.array_join("kept", "|").alias("inside"))


def backoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait after each user's attempts, one for each error."""
    n = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return n.select("user_id", "attempts", numbers.backoff_s(F.col("attempts")).alias("wait_s"), F.least(F.lit(10.0), numbers.backoff_s(F.col("attempts"), 2.0, 10.0)).alias("capped_s"))


def json_metadata_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props as a map, merged with a right-hand map that wins."""
    decoded = text.decode_metadata(F.col("props"))
    right = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.when(F.col("event_type") == "error", "0").otherwise(decoded["k"]))
    merged = text.merge_metadata(decoded, right)
    return table(spark, sf_dir, "events").select("event_id", merged["k"].alias("k"), merged["kind"].alias("kind"), F.size(merged).cast("long").alias("n"))


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of failed requests: kind and phase, and the ledger's cut error text."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.safe_message(F.initcap("role"), F.lit("graph")).alias("message"), text.error_text(F.col("text")).alias("error"))


def blob_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("accession"))
    key = text.blob_key(F.col("cik"), F.col("accession"))
    return rows.select("o_orderkey", key.alias("r2_key"), text.bare(F.col("accession")).alias("bare"), text.basename(key).alias("name"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup or purchase before each event of a user, as parts carry over headings."""
    part = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", part.alias("part"))
    return scan(rows, ["user_id"], ["ts", "event_id"], LastSeen("part")).select("event_id", F.coalesce("seen", F.lit("none")).alias("part"))


def toc_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that stand for an hour or more before the next one; the last stands for the rest."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("next", F.lead("event_id").over(order)).withColumn("later", F.lead("ts").over(order))
    return rows.filter(F.col("later").isNull() | (F.col("later") >= F.col("ts") + F.expr("interval 1 hour"))).select("event_id", F.coalesce("next", F.lit(-1)).alias("next"))


def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rails.valid_question(F.col("text")).alias("valid"))


QUERIES = {f.__name__: f for f in (ticker_rail, year_repair, year_rail, company_rail_prefix, backoff_table, json_metadata_decode, error_messages, blob_keys, carry_forward, toc_guard, question_validation)}

_YEARS = """asked as (select o_custkey, list(year(o_orderdate) order by o_orderdate, o_orderkey) as ys from orders group by 1),
flat as (select o_custkey, y, i from (select o_custkey, unnest(list_concat(ys, [ys[1], ys[-1]])) as y, generate_subscripts(list_concat(ys, [ys[1], ys[-1]]), 1) as i from asked)),
firsts as (select o_custkey, y, min(i) as i from flat group by 1, 2)"""

ORACLE_SQL = {
    "ticker_rail": "select n_regionkey as request_id, coalesce(string_agg(n_name, ',' order by n_name) filter (n_nationkey % 2 = 0), '') as kept, coalesce(string_agg(n_name, ',' order by n_name) filter (n_nationkey % 2 <> 0), '') as dropped from nation group by 1",
    "year_repair": f"with {_YEARS} select o_custkey, string_agg(y::varchar, ',' order by i) as years from firsts group by 1",
    "year_rail": f"with {_YEARS} select o_custkey, coalesce(string_agg(y::varchar, ',' order by i) filter (y between 1995 and 1997), '') as kept, coalesce(string_agg(y::varchar, ',' order by i) filter (y not between 1995 and 1997), '') as dropped from firsts group by 1",
    "company_rail_prefix": """with n as (select p_partkey, unnest([1, 2, 3, 4]) as i, unnest([upper(substr(p_brand, 1, 7)), substr(p_brand, 1, 2), p_type, ' ' || p_brand || ' ']) as name from part),
distinct_names as (select distinct name from n), roster as (select distinct lower(trim(p_brand)) as legal from part),
f as (select name, exists (select 1 from roster where case when length(trim(name)) < 3 then legal = lower(trim(name)) else starts_with(legal, lower(trim(name))) end) as known from distinct_names)
select p_partkey, coalesce(string_agg(name, '|' order by i) filter (not known), '') as outside, coalesce(string_agg(name, '|' order by i) filter (known), '') as inside from n join f using (name) group by 1""",
    "backoff_table": "select user_id, count(*) as attempts, least(2.0 * power(2.0, count(*) - 1), 300.0)::double as wait_s, least(2.0 * power(2.0, count(*) - 1), 10.0)::double as capped_s from events where event_type = 'error' group by 1",
    "json_metadata_decode": "select event_id, case when event_type = 'error' then '0' else json_extract_string(props, '$.k') end as k, event_type as kind, 2::bigint as n from events",
    "error_messages": "select conv_id, turn, upper(role[1]) || role[2:] || ' during graph' as message, left(text, 2000) as error from conversations",
    "blob_keys": "with o as (select o_orderkey, lpad(o_custkey::varchar, 10, '0') as cik, lpad(o_custkey::varchar, 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(o_orderkey::varchar, 6, '0') as acc from orders) select o_orderkey, 'filings/' || cik || '/' || acc || '.html' as r2_key, replace(acc, '-', '') as bare, acc || '.html' as name from o",
    "carry_forward": "select event_id, coalesce(last_value(case when event_type in ('signup', 'purchase') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'none') as part from events",
    "toc_guard": "select event_id, coalesce(next, -1) as next from (select event_id, ts, lead(event_id) over w as next, lead(ts) over w as later from events window w as (partition by user_id order by ts, event_id)) where later is null or later >= ts + interval 1 hour",
    "question_validation": "select doc_id, coalesce(length(text) between 1 and 2000, false) as valid from documents",
}
