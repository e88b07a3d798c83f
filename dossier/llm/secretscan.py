"""Operator 13 [native]: secrets by patterns, and by a battery of randomness tests with false-discovery control.

Patterns give the base spans. The method looks at further tokens: longest runs of 16 or more of `A-Za-z0-9+/_-` outside base spans.
The smallest alphabet that holds all of a token's characters is its encoding (digits alone have none: a
number is as random as a key of digits). A token passes the battery if none of three tests tells it from uniform
symbols of its encoding: chi-squared of the symbols' counts, runs above and below the alphabet's middle, and serial correlation of
neighbours; each as a standard score of at most `limit` on either side.

Short texts pass such tests by chance, so what passes must also be unlike ordinary text of its length: it holds fewer pairs of
equal symbols, and changes more often between digits, capitals, small letters and signs, than text does. The rates of
text are counted over all documents: words of 12 to 15 letters, and those tokens of the encoding that fail the
battery. Both scores, whose spread is that of the token's length, make one probability (Stouffer). Within an encoding and a band of lengths
(a factor of about 1.4), Benjamini and Hochberg's rule on these probabilities, tokens that fail the battery counting as 1, keeps the
share of false discoveries at `alpha`: many tokens of a length that can't tell text from keys raise the bar for
that length alone. Probabilities are binned by tenths of their negative logarithm, so the rule needs counts only.

A text is read once; spans and scores stand in a small table from there on. Only counts by encoding, band and bin come
to the driver, some thousands at most. All of it is DataFrame functions. Positions are code points; they come from the
lengths of what a pattern splits, summed in two levels within the row, so that a text of very many matches costs in
proportion. Null texts are empty; empty texts have no spans, empty tables no rows. Rows that repeat an id, null
ids among them, are documents of their own.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import pick, stored

#: Fixed values of the contract: the base patterns, in the order of their kinds. Where a match's length is in the pattern,
#: shorter matches could not have hidden others; what looks ahead or behind only spares vain attempts.
ASSIGN = r"""(?=[pstaPSTA])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
ASSIGNED = 12
METHOD = "random"
#: Runs of 12 characters or more; tokens are those of 16 or more, ordinary words the others if all are letters.
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
LEAST = 16
DIGITS, SMALL, LARGE = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings from the smallest alphabet on; the first that fits counts.
ALPHABETS = {
    "hex": DIGITS + "abcdef", "hex_capitals": DIGITS + "ABCDEF", "lower": SMALL, "upper": LARGE, "base32": LARGE + "234567", "base36": DIGITS + SMALL,
    "base36_capitals": DIGITS + LARGE, "letters": LARGE + SMALL, "base62": DIGITS + LARGE + SMALL, "base64": LARGE + SMALL + DIGITS + "+/", "base64_url": LARGE + SMALL + DIGITS + "-_", "mixed": LARGE + SMALL + DIGITS + "+/-_",
}
#: Where a corpus has no ordinary words: rates of equal pairs and triples of letters and of changes of class in European text, about.
USUAL = (0.07, 0.007, 0.01)
#: Ordinary words count as so many pairs, triples and neighbours beside an encoding's own tokens.
WEIGHT = 1000
BINS = 400


def running(values: Column) -> Column:
    """The sums of an array's values up to and with each."""
    step = 256
    empty = F.array().cast("array<long>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    grow = lambda acc, x: F.concat(acc, F.array(last(acc) + x))
    within = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda c: F.aggregate(F.slice(values, c * step + 1, step), empty, grow))
    # One level up: what stands before each stretch.
    whole = F.aggregate(within, F.struct(F.array().cast("array<array<long>>").alias("done"), F.lit(0).cast("long").alias("sum")), lambda acc, w: F.struct(F.concat(acc["done"], F.array(F.transform(w, lambda x: x + acc["sum"]))).alias("done"), (acc["sum"] + last(w)).alias("sum")))
    return F.when(F.size(values) > 0, F.flatten(whole["done"])).otherwise(empty)


def located(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """docs with a column for each pattern: its matches in order, as (start, end, match)."""
    n = lambda c: F.char_length(c).cast("long")
    found = docs.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    gaps = found.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)) for k, p in patterns.items()})
    sizes = gaps.withColumns({f"s_{k}": F.coalesce(F.zip_with(f"m_{k}", F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), lambda m, g: n(m) + n(g)), F.array().cast("array<long>")) for k in patterns})
    ends = sizes.withColumns({f"e_{k}": F.when(F.size(f"s_{k}") > 0, running(F.col(f"s_{k}"))).otherwise(F.array().cast("array<long>")) for k in patterns})
    whole = {k: F.zip_with(f"m_{k}", f"e_{k}", lambda m, e: F.struct((e - n(m)).alias("start"), e.alias("end"), m.alias("match"))) for k in patterns}
    return ends.withColumns(whole).drop(*[f"{x}_{k}" for x in "mgse" for k in patterns])


def counts_of(chars: Column) -> Column:
    """How often each symbol stands in an array of symbols."""
    return F.transform(F.array_distinct(chars), lambda s: (F.size(chars) - F.size(F.array_remove(chars, s))).cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def kind_of(symbol: Column) -> Column:
    at = F.position(symbol, F.lit(DIGITS + LARGE + SMALL))
    return (at > 0).cast("int") + (at > 10).cast("int") + (at > 36).cast("int")


def neighbours(values: Column, f) -> Column:
    """The sum of f over neighbouring values."""
    return total(F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), f))


def sums_of(t: Column) -> list[Column]:
    """Of a token (chars, counts, kinds): its size, pairs and triples of equal symbols, and changes of class."""
    c = t["counts"]
    return [
        F.size(t["chars"]).cast("double").alias("n"),
        total(F.transform(c, lambda x: x * (x - 1) / 2)).alias("pairs"),
        total(F.transform(c, lambda x: x * (x - 1) * (x - 2) / 6)).alias("triples"),
        neighbours(t["kinds"], lambda a, b: (a != b).cast("double")).alias("changes"),
    ]


def prepared(t: Column, *more: Column) -> Column:
    return F.struct(*more, t["chars"].alias("chars"), counts_of(t["chars"]).alias("counts"), F.transform(t["chars"], kind_of).alias("kinds"))


def battery(t: Column, limit: float) -> Column:
    """Whether no test tells a token (n, pairs, values, size) from uniform symbols."""
    n, size = t["n"], t["size"]
    chi = (size * (n + 2 * t["pairs"]) / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    high = t["high"]
    expected = 2 * high * (n - high) / n + 1
    runs = (1 + t["turns"] - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    serial = (t["product"] / t["spread"] + 1 / n) * F.sqrt(n)
    sure = (high > 1) & (n - high > 1) & (t["spread"] > 0)
    return F.when(sure, (F.abs(chi) <= limit) & (F.abs(runs) <= limit) & (F.abs(serial) <= limit)).otherwise(False)


def encoding_of(token: Column) -> Column:
    fits = [F.when(token.rlike("^[" + a.replace("-", "\\-") + "]+$"), F.lit(name)) for name, a in ALPHABETS.items()]
    return F.when(~token.rlike("^[0-9]+$"), F.coalesce(*fits))


def as_spans(found: Column, kind: str) -> Column:
    order = [*BASE, METHOD].index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scanned(docs: DataFrame, limit: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the base spans, tokens with their statistics, and the sums of ordinary words; from one reading of the texts."""
    given = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = located(given, BASE | {METHOD: RUN}).drop("text")
    rows = rows.withColumn("words", F.filter(METHOD, lambda m: (F.char_length(m["match"]) < LEAST) & m["match"].rlike("^[A-Za-z]+$")))
    lengthy = F.filter("assign", lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGNED)
    spans = [as_spans(lengthy if kind == "assign" else F.col(kind), kind) for kind in BASE]
    rows = rows.withColumn("base", F.array_sort(F.concat(*spans))).drop(*BASE)
    free = F.filter(METHOD, lambda m: (F.char_length(m["match"]) >= LEAST) & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    named = F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), encoding_of(m["match"]).alias("encoding"), F.split(m["match"], "").alias("chars")))
    rows = rows.withColumn("t", F.filter(named, lambda t: t["encoding"].isNotNull()))
    alphabet = F.create_map(*[F.lit(x) for item in ALPHABETS.items() for x in item])
    own = lambda t: [t[c].alias(c) for c in ("start", "end", "encoding")]
    value = lambda t: F.transform(t["chars"], lambda c: F.position(c, alphabet[t["encoding"]]).cast("double"))
    rows = rows.withColumn("t", F.transform("t", lambda t: prepared(t, *own(t), F.char_length(alphabet[t["encoding"]]).cast("double").alias("size"), value(t).alias("values"))))
    rows = rows.withColumn("t", F.transform("t", lambda t: F.struct(*own(t), t["size"].alias("size"), t["values"].alias("values"), (total(t["values"]) / F.size(t["values"])).alias("mean"), *sums_of(t))))
    above = lambda t, v: v > t["size"] / 2
    measured = F.transform("t", lambda t: F.struct(
        *own(t), *[t[c].alias(c) for c in ("size", "n", "pairs", "triples", "changes")],
        total(F.transform(t["values"], lambda v: above(t, v).cast("double"))).alias("high"),
        neighbours(t["values"], lambda a, b: (above(t, a) != above(t, b)).cast("double")).alias("turns"),
        neighbours(t["values"], lambda a, b: (a - t["mean"]) * (b - t["mean"])).alias("product"),
        total(F.transform(t["values"], lambda v: (v - t["mean"]) * (v - t["mean"]))).alias("spread"),
    ))
    rows = rows.withColumn("t", measured)
    rows = rows.withColumn("t", F.transform("t", lambda t: F.struct(*own(t), *[t[c].alias(c) for c in ("n", "pairs", "triples", "changes")], battery(t, limit).alias("passed"))))
    rows = rows.withColumn("w", F.transform("words", lambda w: F.struct(F.split(w["match"], "").alias("chars")))).withColumn("w", F.transform("w", lambda w: prepared(w))).withColumn("w", F.transform("w", lambda w: F.struct(*sums_of(w))))
    of_words = lambda f: total(F.transform("w", f))
    return rows.select("doc_id", "base", "t", F.struct(*[of_words(f).alias(name) for name, f in SUMS.items()]).alias("words"))


#: What the rates of text are made of, for a token or word.
SUMS = {
    "pairs": lambda t: t["pairs"], "of_pairs": lambda t: t["n"] * (t["n"] - 1) / 2,
    "triples": lambda t: t["triples"], "of_triples": lambda t: t["n"] * (t["n"] - 1) * (t["n"] - 2) / 6,
    "changes": lambda t: t["changes"], "of_changes": lambda t: t["n"] - 1,
}


def rates_of_text(found: DataFrame) -> dict[str, tuple[float, float, float]]:
    """For each encoding, the rates of equal pairs and triples and of changes in text."""
    words = found.agg(*[F.sum(F.col("words")[c]).alias(c) for c in SUMS]).first()
    tokens = found.select(F.explode("t").alias("t")).filter(~F.col("t.passed"))
    failed = {r["encoding"]: r for r in tokens.groupBy("t.encoding").agg(*[F.sum(f(F.col("t"))).alias(c) for c, f in SUMS.items()]).collect()}
    rates = {}
    for encoding in ALPHABETS:
        own = []
        for rate, usual in zip(("pairs", "triples", "changes"), USUAL, strict=True):
            base = words[rate] / words[f"of_{rate}"] if words[f"of_{rate}"] else usual
            r = failed.get(encoding)
            own.append(((r[rate] if r else 0.0) + WEIGHT * base) / ((r[f"of_{rate}"] if r else 0.0) + WEIGHT))
        rates[encoding] = tuple(own)
    return rates


def with_bins(found: DataFrame, rates: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Tokens with their band of lengths and the bin of their probability under text."""
    known = F.create_map(*[x for name, r in rates.items() for x in (F.lit(name), F.array(*map(F.lit, r)))])

    def score(t: Column) -> Column:
        pair, triple, change = (known[t["encoding"]][k] for k in range(3))
        many, steps = t["n"] * (t["n"] - 1) / 2, t["n"] - 1
        spread = many * (pair * (1 - pair) + 2 * (t["n"] - 2) * F.greatest(triple - pair * pair, F.lit(0.0)))
        fewer = (many * pair - t["pairs"]) / F.sqrt(spread)
        oftener = (t["changes"] - steps * change) / F.sqrt(steps * change * (1 - change))
        return F.when(t["encoding"].isin("lower", "upper"), fewer).otherwise((fewer + oftener) / math.sqrt(2))

    scored = F.transform("t", lambda t: F.struct(*[t[c].alias(c) for c in ("start", "end", "encoding", "n", "passed")], score(t).alias("z")))
    # An upper bound of the normal distribution's tail, as a negative logarithm.
    tail = lambda z: (z * z / 2 - F.log(F.lit(2.0)) + math.log(2 * math.pi) / 2 + F.log(z + F.sqrt(z * z + 8 / math.pi))) / math.log(10)
    bins = lambda t: F.when(t["passed"] & (t["z"] > 0), F.least(F.floor(10 * tail(t["z"])), F.lit(BINS))).otherwise(F.lit(0))
    binned = F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), F.floor(2 * F.log2(t["n"])).alias("band"), bins(t).alias("bin")))
    return found.select("doc_id", "base", scored.alias("t")).withColumn("t", binned)


def least_bins(counts: dict[tuple[str, int], dict[int, int]], alpha: float) -> dict[tuple[str, int], int]:
    """Benjamini and Hochberg's rule on binned probabilities: the lowest bin of each group whose tokens all count as found."""
    least = {}
    for group, own in counts.items():
        tested, found, bar = sum(own.values()), 0, None
        for b in sorted((b for b in own if b), reverse=True):
            found += own[b]
            if tested * 10 ** (-b / 10) <= alpha * found:
                bar = b
        if bar is not None:
            least[group] = bar
    return least


def scan(docs: DataFrame, alpha: float = 0.001, limit: float = 3.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and found of every row: arrays of (start, order, end, kind), base spans by patterns, found ones by tests."""
    table = stored(scanned(docs, limit, id_col, text_col))
    binned = with_bins(table, rates_of_text(table))
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in binned.select(F.explode("t").alias("t")).groupBy("t.encoding", "t.band", "t.bin").count().collect():
        counts.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
    least = least_bins(counts, alpha)
    bars = F.create_map(*[x for (e, band), b in least.items() for x in (F.lit(f"{e} {band}"), F.lit(b))]) if least else F.lit(None).cast("map<string,int>")
    taken = F.filter("t", lambda t: F.coalesce(t["bin"] >= F.try_element_at(bars, F.concat_ws(" ", t["encoding"], t["band"].cast("string"))), F.lit(False)))
    return binned.select("doc_id", "base", as_spans(taken, METHOD).alias("found"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def named(spans: Column) -> Column:
    """kind:start:end of sorted spans, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
