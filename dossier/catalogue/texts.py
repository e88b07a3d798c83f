"""Text structuring, embedding and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.catalogue.base import table
from dossier.functions import text
from dossier.operators import sentences
from dossier.operators.chunking import Packer, chunk_sections, number_chunks
from dossier.operators.embedding import assemble, embed_column, embed_documents, hashed_embedder, in_order, request_batches
from dossier.operators.retrieval import vector_rank
from dossier.operators.sections import detect
from dossier.operators.wordvectors import fit
from dossier.sources.frames import parse_frames, split_frames


def html_strip_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text, by expressions alone; entities stay."""
    cleaned = text.normalize(text.strip_html_native(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(cleaned).alias("text_md5"), F.length(cleaned).cast("long").alias("n_chars"))


def html_strip_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text, by a parser that also decodes entities."""
    cleaned = text.normalize(text.strip_html("html"))
    return table(spark, sf_dir, "pages").select("page_id", cleaned.alias("text"))


#: The headings of made filings: the part's, the item's, and the key and name that the form gives them.
HEADS = {
    "10-K": [("", "Item 1. Business", "1", "Item 1. Business"), ("", "Item 1A. Risk Factors", "1A", "Item 1A. Risk Factors"), ("", "Item 7. Discussion", "7", "Item 7. Management's Discussion and Analysis"), ("", "Item 8. Statements", "8", "Item 8. Financial Statements and Supplementary Data")],
    "10-Q": [("PART I ", "Item 1. Statements", "PI-1", "Item 1. Financial Statements"), ("", "Item 2. Discussion", "PI-2", "Item 2. Management's Discussion and Analysis"), ("PART II ", "Item 1. Proceedings", "PII-1", "Item 1. Legal Proceedings"), ("", "Item 1A. Risk Factors", "PII-1A", "Item 1A. Risk Factors")],
}


def _filings(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Every document as a filing: a table of contents, and its own text (marks of markup blanked) under each of the form's headings."""
    heads = [part + head for part, head, _, _ in HEADS[form]]
    contents = "".join(f"<p>{h}</p>" for h in heads)
    body = [x for h in heads for x in (F.lit(f"<h2>{h}</h2><table><tr><td>1</td></tr></table><p>"), F.translate(F.coalesce("text", F.lit("")), "<>&", "   "), F.lit("</p>"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(form).alias("form_type"), F.concat(F.lit(f"<html><body>{contents}"), *body, F.lit("</body></html>")).alias("html"))


def section_detect_10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_filings(spark, sf_dir, "10-K")).withColumn("metadata", F.to_json("metadata"))


def section_detect_10q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_filings(spark, sf_dir, "10-Q")).withColumn("metadata", F.to_json("metadata"))


def _as_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("text").alias("name"), F.lit("1").alias("item_key"), F.lit(0).alias("section_order"), text.normalize(F.col("text")).alias("text"), F.create_map(F.lit("part"), F.lit("I")).alias("metadata"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_chunks(chunk_sections(_as_sections(spark, sf_dir))).withColumn("metadata", F.to_json("metadata"))


def oversized_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one sentence each, so that the long ones are divided."""
    return chunk_sections(_as_sections(spark, sf_dir), Packer(sentences=lambda t: [t])).withColumn("metadata", F.to_json("metadata"))


def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sentence splitter learns from: every word that has a period somewhere, with its counts and score."""
    rows = sentences.scored(sentences.word_counts(table(spark, sf_dir, "documents")))
    return rows.select("word", "total", "with_period", "before_number", "small", F.round("score", 6).alias("score"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_tokens"), F.md5(text.with_task("document", F.col("text"))).alias("prefixed_md5"))


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which request each document of a source goes into, at most 6000 characters in one."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("int").alias("token_count"))
    found = request_batches(rows, ["source"], ["doc_id"], 6000)
    return found.groupBy("source", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def embedding_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vectors, checked for one-to-one and dimension."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    docs = table(spark, sf_dir, "documents").join(vectors.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    done = assemble(docs, vectors.join(docs.select("doc_id"), "doc_id", "left_semi"), "given", 64)
    return done.select("doc_id", "embedding_model_version", F.size("embedding").cast("long").alias("dim"), F.md5("text").alias("text_md5"))


def response_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a response put in the order of its request: their first components by label."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list(F.struct(F.col("vec_id").alias("index"), F.element_at("embedding", 1).alias("embedding"))).alias("data"))
    return rows.select(F.col("label").cast("long").alias("label"), F.posexplode(in_order(F.col("data"))).alias("at", "first")).select("label", F.col("at").cast("long").alias("at"), F.col("first").cast("double").alias("first"))


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_embedder(64), "hashed-64").select("doc_id", "embedding", "embedding_model_version")


def embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th document without each third of its words, a copy that training did not see: whether the learned embedder ranks the originals no worse than hashing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").filter("text <> ''")
    left = F.filter(F.split("text", " "), lambda w, i: i % 3 != 2)
    copies = docs.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("q"), F.md5("text").alias("original"), F.array_join(left, " ").alias("copy"))
    held = docs.select("chunk_id", F.md5("text").alias("original"))
    scores = []
    for name, embedder in (("learned", fit(docs)), ("hashed", hashed_embedder(64))):
        asked = copies.select("q", embed_column(F.col("copy"), embedder).alias("query_vector"))
        found = vector_rank(asked, docs.select("chunk_id", embed_column(F.col("text"), embedder).alias("embedding")), 10, ["q"])
        hits = found.join(held, "chunk_id").join(copies.select("q", "original"), ["q", "original"]).groupBy("q").agg((F.lit(1.0) / F.min("rank")).alias("share"))
        scores.append(hits.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias(name)))
    return copies.agg(F.count("*").alias("queries")).crossJoin(scores[0]).crossJoin(scores[1]).select("queries", (F.col("learned") >= F.col("hashed")).alias("no_worse"))


def wire_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as frames in pieces that part CR from LF, with pings and unknown events between, read back."""
    rows = table(spark, sf_dir, "conversations")
    data = F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\r\ndata: ")))
    frame = F.concat(F.lit(": ping\r\n\r\nevent: token\r\n"), data, F.lit("\r\n\r\nevent: other\r\ndata: 1\r\n\r"))
    arrivals = rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 2).alias("seq"), frame.alias("bytes")).unionByName(rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 2 + 1).alias("seq"), F.lit("\n").alias("bytes")))
    return parse_frames(split_frames(arrivals)).select("stream_id", "event", "data")


QUERIES = {
    f.__name__: f
    for f in (html_strip_normalize, html_strip_parsed, section_detect_10k, section_detect_10q, sentence_chunks, oversized_split, abbreviation_scores, token_counts, embedding_batches, embedding_assemble, response_order, hashed_vectors, embedding_near_copies, wire_frames)
}

def _sections_sql(form: str) -> str:
    """Sections of the made filings by their places: a heading counts if 200 characters or more lie before the next one, and takes what follows until the next that counts.

    A table is a sentinel of seven characters between two blanks; a part's heading ends the section before it.
    """
    heads = HEADS[form]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(head)}, {quoted(heads[k + 1][0] if k + 1 < len(heads) else '')}, {quoted(key)}, {quoted(name)}, {quoted('II' if key.startswith('PII') else 'I')})" for k, (_, head, key, name) in enumerate(heads))
    contents = quoted(" ".join(part + head for part, head, _, _ in heads) + " " + heads[0][0])
    metadata = """'{"tables_stripped":"' || count(*) || '"}'""" if form == "10-K" else """'{"tables_stripped":"' || count(*) || '","part":"' || arg_min(in_part, k) || '"}'"""
    space = "trim(regexp_replace(translate(@, chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"
    return f"""with d as (select doc_id, translate(coalesce(text, ''), '<>&', '   ') as t from documents), h(k, head, next_part, item_key, name, in_part) as (values {values}),
b as (select *, head || '  ' || t || ' ' || next_part as body, length(head) + 8 + (case when t <> '' then 1 + length(t) else 0 end) + (case when k < 3 then 1 + length(next_part) else 0 end) >= 200 as counts from d, h),
g as (select *, sum(counts::integer) over (partition by doc_id order by k) as nth, bool_and(counts or k > 2) over (partition by doc_id) as whole from b),
s as (select doc_id, arg_min(name, k) as name, arg_min(item_key, k) as item_key, (nth - 1)::integer as section_order, {space.replace("@", "string_agg(body, ' ' order by k)")} as text, {metadata} as metadata from g where whole and nth > 0 group by doc_id, nth
union all select doc_id, 'unstructured', 'unstructured', 0, {space.replace("@", f"{contents} || string_agg(body, ' ' order by k)")}, '{{"detection":"fallback_unstructured"}}' from g where not whole group by doc_id)
select *, length(text)::integer as char_count from s"""


_SPACED = r"trim(regexp_replace(translate(@, chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' '), '[\s\x0b\x1c-\x1f\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
# The references that the pages have; one pass, so that of &amp;quot; the first is decoded alone.
_DECODED = "replace(replace(replace(replace(replace(replace(@, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_STRIPPED = r"regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"

ORACLE_SQL = {
    "html_strip_parsed": f"select page_id, {_SPACED.replace('@', _DECODED.replace('@', _STRIPPED))} as text from pages",
    "oversized_split": f"""with w as (select doc_id, string_split({_SPACED.replace("@", "coalesce(text, '')")}, ' ') as ws from documents),
p as (select doc_id, ws, len(ws) as n, unnest(range(0, len(ws), 512)) as o from w where ws <> [''])
select doc_id, 'text' as section, 0 as section_order, (o // 512)::integer as chunk_index, array_to_string(ws[o + 1 : o + 512], ' ') as text, least(512, n - o)::integer as token_count,
  '{{"item_key":"1","part":"I"' || case when n > 400 then ',"oversized":"true"' else '' end || '}}' as metadata from p""",
    # Sentences end where a token closes and the next begins anew; then one step of the recursion for each chunk.
    "sentence_chunks": f"""with recursive w as (select doc_id, string_split({_SPACED.replace("@", "coalesce(text, '')")}, ' ') as ws from documents),
t as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from w where ws <> ['']),
e as (select *, i < n and regexp_matches(w, '[.!?]["'')\\]]*$') and regexp_matches(lead(w) over o, '^["''(\\[]*[A-Z0-9À-Þ]') as ends from t window o as (partition by doc_id order by i)),
g as (select *, coalesce(sum(ends::integer) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from e),
sentences as (select doc_id, s, string_agg(case when ends then regexp_replace(w, '["'')\\]]*$', '') else w end, ' ' order by i) as text from g group by all),
l as (select doc_id, list(text order by s) as texts, list(len(string_split(text, ' ')) order by s) as cs from sentences group by 1),
m as (select *, list_transform(range(0, len(cs) + 1), lambda k: coalesce(list_sum(cs[1:k]), 0)) as sums from l),
f as (select doc_id, texts, cs, sums, 0::bigint as a, 0::bigint as b, false as big, false as done, -1::bigint as step from m union all
select doc_id, texts, cs, sums, a2, b2, big2, b2 = len(cs), step + 1 from (select *, case when big2 then a2 + 1 else a2 + coalesce(list_position(list_transform(range(a2, len(cs)), lambda k: cs[k + 1] > 400 or sums[k + 2] - sums[a2 + 1] > 400), true), len(cs) - a2 + 1) - 1 end as b2
 from (select *, cs[a2 + 1] > 400 as big2 from (select *, case when step < 0 then 0 when big then b else greatest(a + 1, b - coalesce(list_position(list_transform(range(1, b - a + 1), lambda k: sums[b + 1] - sums[b + 1 - k] > 50), true), b - a + 1) + 1) end as a2 from f where not done)))),
c as (select doc_id, step, big, array_to_string(texts[a + 1 : b], ' ') as text from f where step >= 0),
p as (select doc_id, step, big, string_split(text, ' ') as ws from c),
o as (select doc_id, step, big, unnest(case when big then range(0, len(ws), 512) else [0] end) as x, ws from p),
r as (select doc_id, row_number() over (partition by doc_id order by step, x) - 1 as nth, big, case when big then ws[x + 1 : x + 512] else ws end as ws from o)
select doc_id, 'text' as section, 0 as section_order, nth::integer as chunk_index, array_to_string(ws, ' ') as text, len(ws)::integer as token_count,
  '{{"item_key":"1","part":"I"' || case when big then ',"oversized":"true"' else '' end || ',"section_chunk_index":"' || nth || '"}}' as metadata from r""",
    "section_detect_10k": _sections_sql("10-K"),
    "section_detect_10q": _sections_sql("10-Q"),
    "html_strip_normalize": r"""with s as (select page_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'gis'), '<[^>]*>', ' ', 'g'), chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' '), '\s+', ' ', 'g')) as t from pages)
select page_id, md5(t) as text_md5, length(t) as n_chars from s""",
    "token_counts": r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::bigint as n_tokens, md5('search_document: ' || text) as prefixed_md5 from documents",
    "embedding_batches": """with recursive d as (select source, n_chars as n, row_number() over (partition by source order by doc_id) as i from documents),
f as (select source, i, 0::bigint as batch, n, n as s from d where i = 1 union all
select d.source, d.i, case when f.s + d.n > 6000 then f.batch + 1 else f.batch end, d.n, case when f.s + d.n > 6000 then d.n else f.s + d.n end from f join d on d.source = f.source and d.i = f.i + 1)
select source, batch, count(*) as n, sum(n)::bigint as tokens from f group by all""",
    "embedding_assemble": "select doc_id, 'given' as embedding_model_version, len(embedding) as dim, md5(text) as text_md5 from documents join embeddings on doc_id = vec_id",
    "response_order": "select label::bigint as label, row_number() over (partition by label order by vec_id) - 1 as at, embedding[1]::double as first from embeddings",
    "abbreviation_scores": r"""with t as (select list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^["''(\[{«“„¿¡]+', ''), '["'')\]}»”,;:]+$', '')), lambda w: w <> '') as ws from documents),
p as (select unnest(ws) as w, unnest(list_append(ws[2:], '')) as nxt from t where len(ws) > 0),
d as (select *, w like '%.' and length(w) > 1 as dotted from p),
c as (select lower(case when dotted then w[:-2] else w end) as word, count(*) as total, count(*) filter (dotted) as with_period, count(*) filter (dotted and regexp_matches(nxt, '^[0-9]')) as before_number, count(*) filter (w = lower(w)) as small from d group by 1),
s as (select *, (select sum(with_period) / sum(total) from c) as p, total - with_period as bare, length(word) - length(replace(word, '.', '')) as dots from c where with_period > 0 and regexp_matches(word, '^\p{L}'))
select word, total, with_period, before_number, small, round(-2 * (with_period * ln(p) + bare * ln(1 - p) - with_period * ln(0.99) - bare * ln(0.01)) * exp(-(length(word) - dots)) * (dots + 1) / power(length(word) - dots, bare), 6) + 0.0::double as score from s""",
    "embedding_near_copies": "select count(*) as queries, true as no_worse from documents where text <> '' and doc_id % 20 = 0",
    "wire_frames": "select conv_id as stream_id, 'token' as event, text as data from conversations where text <> ''",
}
