"""The registered queries of the training-data operators: thin digests over the operators' real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import ann, bpe, chat, clusters, html, linededup, packing, phrases, quality, rules, secretscan, simhash, suffix
from dossier.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "participant", "part", "n_segments", "text", F.array_join(F.col("segment_chars").cast("array<string>"), ",").alias("segment_chars"), F.array_join(F.col("loss_mask").cast("array<string>"), ",").alias("loss_mask"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply(rules.counts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    counts = [secretscan.count(F.col("base"), k).alias(f"n_{k}") for k in secretscan.BASE]
    return found.select("doc_id", *counts, F.sha2(secretscan.named(F.col("base")), 256).alias("base_sha256"), secretscan.named(F.array_sort(F.concat("base", "found"))).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Each round as two common tables: every vector's cluster, then the centroids."""
    parts = [f"""
v as materialized (select row_number() over () as i, vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) as e from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
c0 as materialized (select row_number() over (order by h, e) - 1 as c, e from (select sha256('2:' || vec_id::varchar) as h, e from v order by h, e limit {k}))"""]  # fmt: skip
    distance = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)"
    for r in range(rounds + 1):
        parts.append(f"""
a{r} as materialized (select i, min({{'d': ({distance})::bigint, 'c': c}}) as m from v, c{r} c group by i)""")
        if r < rounds:
            sums = ", ".join(f"sum(v.e[{d}]::bigint)" for d in range(1, dims + 1))
            parts.append(f"""
n{r} as materialized (select m.c as c, count(*) as n, [{sums}] as s from a{r} join v using (i) group by m.c),
c{r + 1} as materialized (select c, case when n is null then e else list_transform(s, lambda x: (x - ((x % n) + n) % n) / n)::double[] end as e from c{r} left join n{r} using (c))""")
    return f"""
with {",".join(parts)}
select vec_id, m.c::integer as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia,
  sha256(array_to_string(list_transform(c{rounds}.e, lambda x: x::bigint), ',')) as centroid_sha256
from a{rounds} join v using (i) join c{rounds} on c{rounds}.c = m.c"""


def secrets_sql(alpha: float = 0.001, limit: float = 3.5) -> str:
    """Spans by splitting at the patterns; the battery from each token's characters as rows; the rule by counts of bins."""
    assign = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY".lower())
    patterns = {"assign": f"""({assign})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "run": "[A-Za-z0-9+/_-]{12,}"}
    matches = " union all ".join(f"select r, {k} as ord, '{kind}' as kind, regexp_extract_all(t, '{p}') as ms, regexp_split_to_array(t, '{p}') as gs from docs" for k, (kind, p) in enumerate(patterns.items()))
    fits = " ".join(f"when regexp_full_match(m, '[{a.replace('-', chr(92) + '-')}]+') then '{name}'" for name, a in secretscan.ALPHABETS.items())
    alphabets = ", ".join(f"('{name}', '{a}', {len(a)}::double)" for name, a in secretscan.ALPHABETS.items())
    pair, triple, change = secretscan.USUAL
    sums = "sum(pairs) as pairs, sum(n * (n - 1) / 2) as of_pairs, sum(triples) as triples, sum(n * (n - 1) * (n - 2) / 6) as of_triples, sum(changes) as changes, sum(n - 1) as of_changes"
    rate = lambda x, usual: f"(coalesce(f.{x}, 0) + 1000 * coalesce(w.{x} / nullif(w.of_{x}, 0), {usual})) / (coalesce(f.of_{x}, 0) + 1000)"
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as materialized ({matches}),
placed as (select r, ord, kind, m, sum(length(g) + length(m)) over (partition by r, ord order by i) as e from (select r, ord, kind, unnest(ms) as m, unnest(gs[: len(ms)]) as g, generate_subscripts(ms, 1) as i from found where len(ms) > 0)),
spans as materialized (select *, e - length(m) as s from placed),
base as (select * from spans where ord in (1, 2) or ord = 0 and length(regexp_extract(m, '{patterns["assign"]}', 2)) >= 12),
alphabets(encoding, a, size) as (values {alphabets}),
tokens as (select row_number() over () as k, r, s, e, m, case when regexp_full_match(m, '[0-9]+') then null {fits} end as encoding, length(m) >= 16 as long from spans x where ord = 3
  and (length(m) >= 16 and not exists (select 1 from base b where b.r = x.r and b.s < x.e and b.e > x.s) or length(m) < 16 and regexp_full_match(m, '[A-Za-z]+'))),
chars as (select k, encoding, size, c, i, strpos(a, c)::double as v, case when c between '0' and '9' then 1 when c between 'A' and 'Z' then 2 when c between 'a' and 'z' then 3 else 0 end as kind
  from (select k, encoding, size, a, unnest(string_split(m, '')) as c, generate_subscripts(string_split(m, ''), 1) as i from tokens join alphabets using (encoding))),
counted as (select k, sum(n * (n - 1) / 2)::double as pairs, sum(n * (n - 1) * (n - 2) / 6)::double as triples from (select k, c, count(*)::double as n from chars group by all) group by 1),
means as (select k, sum(v) / count(*) as mean from chars group by 1),
steps as (select k, size, v, v > size / 2 as up, lag(v > size / 2) over o as up_before, v - mean as d, lag(v - mean) over o as d_before, kind, lag(kind) over o as kind_before from chars join means using (k) window o as (partition by k order by i)),
sums as (select k, any_value(size) as size, count(*)::double as n, sum(up::integer)::double as high, coalesce(sum((up <> up_before)::integer), 0)::double as turns, coalesce(sum(d * d_before), 0) as product, sum(d * d) as spread, coalesce(sum((kind <> kind_before)::integer), 0)::double as changes from steps group by 1),
tested as (select *, 2 * high * (n - high) / n + 1 as mu from sums join counted using (k) join tokens using (k)),
judged as materialized (select *, case when high > 1 and n - high > 1 and spread > 0 then
  abs((size * (n + 2 * pairs) / n - n - (size - 1)) / sqrt(2 * (size - 1) * (n - 1) / n)) <= {limit} and abs((1 + turns - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1))) <= {limit} and abs((product / spread + 1 / n) * sqrt(n)) <= {limit} else false end as passed from tested),
w as (select {sums} from judged where not long),
f as (select encoding, {sums} from judged where long and not passed group by 1),
rates as (select alphabets.encoding, {rate("pairs", pair)} as p2, {rate("triples", triple)} as p3, {rate("changes", change)} as p1 from alphabets left join f using (encoding), w),
scores as (select *, (n * (n - 1) / 2 * p2 - pairs) / sqrt(n * (n - 1) / 2 * (p2 * (1 - p2) + 2 * (n - 2) * greatest(p3 - p2 * p2, 0.0))) as fewer, (changes - (n - 1) * p1) / sqrt((n - 1) * p1 * (1 - p1)) as oftener from judged join rates using (encoding) where long),
zs as (select *, case when encoding in ('lower', 'upper') then fewer else (fewer + oftener) / sqrt(2) end as z from scores),
bins as materialized (select *, floor(2 * log2(n)) as band, case when passed and z > 0 then least(floor(10 * ((z * z / 2 - ln(2) + ln(2 * pi()) / 2 + ln(z + sqrt(z * z + 8 / pi()))) / ln(10))), {secretscan.BINS}) else 0 end as bin from zs),
bars as (select encoding, band, min(bin) as bar from (select distinct encoding, band, bin, count(*) over (partition by encoding, band) as tested, count(*) over (partition by encoding, band order by bin desc) as found from bins) where bin > 0 and tested * power(10, -bin / 10) <= {alpha} * found group by 1, 2),
every as (select r, ord, kind, s, e from base union all select r, 3, '{secretscan.METHOD}', s, e from bins join bars using (encoding, band) where bin >= bar),
listed as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3) as own, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans from every group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans from docs left join listed using (r)"""


QUERIES = {f.__name__: f for f in (pipeline, op1_quality, op2_simhash, op3_nearest, op4_chat, op5_main_text, op6_suffix, op7_bpe, op8_packing, op9_rules, op10_line_dedup, op11_clusters, op12_phrases, op13_secrets)}

ORACLE_SQL = {
    "op12_phrases": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from lists group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from lists, range(1, 5) t(k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
halves as materialized (select c.*, j, array_to_string(w[:j], ' ') as p, array_to_string(w[j + 1 :], ' ') as q from c, range(1, 4) t(j) where j < k),
cuts as (select h.*, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score from halves h join f x on x.lang = h.lang and x.phrase = h.p join f y on y.lang = h.lang and y.phrase = h.q),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select distinct c.lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as most from c, range(2, 4) t(m), range(1, 4) s(i) where m < k and i + m - 1 <= k group by all),
ranked as (select lowest.*, row_number() over (partition by lowest.lang order by score desc, a desc, lowest.phrase) as rank from lowest
  left join inside on inside.lang = lowest.lang and inside.phrase = lowest.phrase where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""",
    "op11_clusters": clusters_sql(),
    "op13_secrets": secrets_sql(),
    "op3_nearest": """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) = 64),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as s from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from pairs)
select query_id, rank::integer as rank, vec_id, s as score from ranked where rank <= 20""",
    "op4_chat": """
with turns as (select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text, turn, coalesce(floor(turn / 256), 0)::bigint as part from conversations),
speakers as (select distinct conv_id, role as participant from turns where role <> 'system'),
segments as (select t.conv_id, participant, part, turn, role, text,
  '<|im_start|>' || case when role = participant then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) || text || '<|im_end|>' || chr(10) as segment
  from turns t join speakers s on t.conv_id is not distinct from s.conv_id)
select conv_id, participant, part, count(*)::bigint as n_segments, string_agg(segment, '' order by turn, role, text) as text,
  string_agg(length(segment)::varchar, ',' order by turn, role, text) as segment_chars,
  string_agg(case when role = participant then '1' else '0' end, ',' order by turn, role, text) as loss_mask
from segments group by conv_id, participant, part""",
    "op10_line_dedup": """
with rows as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select r, unnest(ls) as line, generate_subscripts(ls, 1) as k from rows),
keyed as (select r, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (select key from keyed where key <> '' group by key having count(distinct r) >= 10),
kept as (select r, string_agg(line, chr(10) order by k) as text, count(*) as n from keyed where key not in (select key from hot) group by r)
select doc_id, len(ls)::bigint as n_lines, (len(ls) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(text, '')) as kept_sha256
from rows left join kept using (r)"""
}
