"""Operator 12: phrase collocations from count streams in prefix and suffix order.

Counts are kept as streams sorted by words, and all that a phrase needs is read off neighbours in such a stream:

1. Every word starts a window of up to `longest` words of its piece. A task sorts the windows of some megabytes of text
   and stores them as one run of (window, count), so a repeated passage is counted before anything moves.
2. Runs are cut at common borders, and the parts of a range meet in one task, which merges them. In prefix order, the
   windows that begin with a phrase stand together, so the runs of equal first words give the count of every phrase of
   every length. Borders are whole windows: a very common first word is spread over many tasks, and the counts of the few
   phrases that reach a border are summed afterwards.
3. Phrases of `least` occurrences (with them all their parts, which are no rarer) are walked in prefix order. The phrases that the current
   one continues are the ones last seen, shortest first: their counts are those of its first parts, and the last of
   them may lose its place to the current one, its extension to the right.
4. The same walk in suffix order (words reversed) gives the counts of the rests and the extensions to the left.
   Any longer phrase that covers a candidate holds one that is longer by a single word and covers it no less, so these two suffice.

Walks are distributed: a range of the order begins with copies of the phrases that its first one continues.

The driver holds one border, of 100 bytes a word at most, for every `part` windows. Null texts are empty, a null lang is
`und` (and one with that name). Empty texts and tables give no phrases. Repeated rows and ids count as often as
they stand. Ties in rank go by count and phrase, which is unique in its lang. Texts of any length are cut in
segments of some megabytes that share the words at their border.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import partitions, pick, small, stored

#: Every character that ends a piece as one line feed (fixed values of the contract).
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
SEGMENT = 2 << 20
PART = 1 << 20

Run = tuple[list[bytes], np.ndarray, np.ndarray]


def segments(data: bytes, ahead: re.Pattern, size: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of data and how far windows start in each; what follows serves to fill the last windows."""
    at = 0
    while at < len(data):
        cut = data.rfind(b"\n", at, at + size) + 1
        if at + size >= len(data):
            cut = len(data)
        elif cut <= at:  # a piece longer than that: at the end of a word
            blank = re.compile(rb"[ \t\n]").search(data, at + size)
            cut = blank.start() if blank else len(data)
        end = ahead.match(data, cut).end()
        yield data[at:end], cut - at
        at = cut


def windows(data: bytes, upto: int, longest: int) -> tuple[Run, int]:
    """The sorted, counted windows that start before upto, and the number of words there."""
    a = np.frombuffer(data, np.uint8)
    inside = (a != 32) & (a != 9) & (a != 10)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = int(np.searchsorted(begin, upto))
    if not n:
        return ([], np.zeros((0, longest), np.int32), np.zeros(0, np.int64)), 0
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    ids = place[words.indices.to_numpy()]
    piece = np.cumsum(a == 10)[begin]
    w = np.zeros((n, longest), np.int32)
    for k in range(longest):
        m = max(0, min(n, len(ids) - k))
        w[:m, k] = np.where(piece[k : k + m] == piece[:m], ids[k : k + m], 0)
    return (words.dictionary.take(pa.array(order)).to_pylist(), *merged(w, np.ones(n, np.int64))), n


def merged(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of w in order, equal ones summed."""
    width = w.shape[1]
    keys = [w[:, k].astype(np.int64) << 32 | (w[:, k + 1] if k + 1 < width else 0) for k in range(0, width, 2)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(order) else order
    return w[order[first]], np.add.reduceat(counts[order], first) if len(order) else counts


def pack(run: Run) -> bytes:
    """A run of its own words alone, compressed; columns one after the other."""
    words, w, counts = run
    own = np.unique(w)
    own = own[own > 0]
    used = b"\n".join([words[k - 1] for k in own])
    ids = np.where(w > 0, np.searchsorted(own, w) + 1, 0).T.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
    few = counts.astype(np.uint8 if counts.max() < 256 else np.int64)
    head = struct.pack("<QQBBB", len(used), len(w), w.shape[1], ids.itemsize, few.itemsize)
    return zstandard.compress(head + used + np.ascontiguousarray(ids).tobytes() + few.tobytes(), 1)


def unpack(block: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A run with its words joined by line feeds."""
    data = zstandard.decompress(block)
    size, n, width, id_bytes, count_bytes = struct.unpack_from("<QQBBB", data)
    at = struct.calcsize("<QQBBB")
    words = data[at : at + size]
    ids = np.frombuffer(data, np.dtype(f"u{id_bytes}"), n * width, at + size).reshape(width, n).T.astype(np.int32)
    return words, ids, np.frombuffer(data, np.dtype("u1" if count_bytes == 1 else "i8"), n, at + size + n * width * id_bytes).astype(np.int64)


def split_words(joined: bytes) -> pa.Array:
    """Words joined by line feeds, without an object for each."""
    a = np.frombuffer(joined, np.uint8)
    inside = a != 10
    offsets = np.concatenate([[0], np.cumsum(inside)[~inside], [inside.sum()]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])


def named(words: list[bytes], row: np.ndarray) -> list[bytes]:
    return [words[k - 1][:100] for k in row if k]


def runs_of(longest: int, step: int):
    """Runs of the texts of a task, by lang: lang, n_words, weight, marks (windows that may serve as borders) and run."""
    ahead = re.compile(rb"(?:[ \t]*[^ \t\n]+){0,%d}" % (longest - 1))
    names = ["lang", "n_words", "weight", "marks", "run"]
    types = [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.binary())), pa.binary()]

    def flush(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for data, upto in segments(b"\n".join(texts), ahead, SEGMENT):
            run, n = windows(data, upto, longest)
            if n:
                block, size = pack(run), len(run[1])
                # From a place that differs from run to run, so that marks of short runs spread as those of long ones.
                at = range(zlib.crc32(block) % min(step, size), size, step)
                row = [lang, n, size / len(at), [named(run[0], run[1][k]) for k in at], block]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in small(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                data = text.encode().lower().translate(ENDS)
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                # However many langs there are, four segments of text are held at most.
                for full in [lang] if sizes[lang] >= SEGMENT else list(held) if sum(sizes.values()) >= 4 * SEGMENT else []:
                    sizes.pop(full)
                    yield from flush(full, held.pop(full))
        for lang, texts in held.items():
            yield from flush(lang, texts)

    return run


def cut(borders: dict[str, list[tuple[int, list[bytes]]]], firsts: dict[str, int]):
    """Each run's stretches between borders, as part, lang and run."""

    def place(words: list[bytes], keys: tuple[np.ndarray, np.ndarray], border: list[bytes]) -> int:
        """The first window not before the border; twice a word's number stands for it, odd numbers for words between."""
        row = []
        for x in border:
            k = bisect_left(words, x)
            here = k < len(words) and words[k] == x
            row.append(2 * k + (2 if here else 1))
            if not here:
                break
        row = (row + [0, 0, 0, 0])[:4]
        high, low = row[0] << 32 | row[1], row[2] << 32 | row[3]
        lo, hi = np.searchsorted(keys[0], high), np.searchsorted(keys[0], high, "right")
        return int(lo + np.searchsorted(keys[1][lo:hi], low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            lang = b.column("lang")[0].as_py()
            joined, w, counts = unpack(b.column("run")[0].as_py())
            words = joined.split(b"\n")
            wide = np.zeros((len(w), 4), np.int64)
            wide[:, : w.shape[1]] = 2 * w
            keys = wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]
            own = borders.get(lang, [])
            places = [0, *(place(words, keys, x) for _, x in own), len(w)]
            parts = [firsts.get(lang, 0), *(p for p, _ in own)]
            found = [(p, pack((words, w[i:j], counts[i:j]))) for p, i, j in zip(parts, places[:-1], places[1:], strict=True) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([lang] * len(found)), pa.array([x for _, x in found], pa.binary())], names=["part", "lang", "run"])

    return run


def counted(least: int):
    """Phrases of a part's merged runs: all of `least` windows, and those at its ends whatever their count."""

    def together(lang: str, blocks: list[bytes]) -> pa.RecordBatch:
        runs = [unpack(x) for x in blocks]
        every = split_words(b"\n".join(words for words, _, _ in runs)).dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1)
        codes, at, ids = place[every.indices.to_numpy()], 0, []
        for words, w, _ in runs:
            n = words.count(b"\n") + 1
            ids.append(np.r_[np.int32(0), codes[at : at + n]][w])
            at += n
        given, counts = np.concatenate(ids), np.concatenate([c for _, _, c in runs])
        del runs, ids
        w, n = merged(given, counts)
        del given, counts
        dictionary = every.dictionary.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
        new = np.zeros(len(w), bool)
        new[0] = True
        flat, sizes, totals = [], [], []
        for k in range(w.shape[1]):
            new[1:] |= w[1:, k] != w[:-1, k]
            start = np.flatnonzero(new)
            f = np.add.reduceat(n, start)
            keep = f >= least
            keep[[0, -1]] = True
            keep &= w[start, k] > 0
            flat.append(w[start[keep], : k + 1].ravel() - 1)
            sizes.append(np.full(keep.sum(), k + 1))
            totals.append(f[keep])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        phrases = pa.ListArray.from_arrays(pa.array(offsets), dictionary.take(pa.array(np.concatenate(flat))))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases, pa.array(np.concatenate(totals))], names=["lang", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            for part, lang, block in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "run")), strict=True):
                if held and (part, lang) != key:
                    yield together(key[1], held)
                    held = []
                key = part, lang
                held.append(block)
        if held:
            yield together(key[1], held)

    return run


def phrase_counts(docs: DataFrame, longest: int, least: int, part: int = PART, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of every phrase of 1 to `longest` words and `least` occurrences, and (lang, n) of all words."""
    spark = docs.sparkSession
    given = pick(docs, text=text_col, lang=lang_col).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    runs = stored(given.mapInArrow(runs_of(longest, part // 8), "lang string, n_words long, weight double, marks array<array<binary>>, run binary"))
    # One mark for each eighth of a part: what the driver sorts grows with parts alone.
    marks = sorted((r["lang"], [bytes(x) for x in r["m"]], r["weight"]) for r in runs.select("lang", F.explode("marks").alias("m"), "weight").collect())
    borders: dict[str, list[tuple[int, list[bytes]]]] = {}
    firsts: dict[str, int] = {}
    n, weight = 0, 0.0
    for lang, mark, more in marks:
        firsts.setdefault(lang, n)
        weight += more
        if weight >= part:
            n, weight = n + 1, 0.0
            borders.setdefault(lang, []).append((n, mark))
    parts = runs.select("lang", "run").mapInArrow(cut(borders, firsts), "part int, lang string, run binary")
    met = parts.repartitionById(n + 1, F.col("part")).sortWithinPartitions("part", "lang")
    found = met.mapInArrow(counted(least), "lang string, words array<string>, f long")
    whole = found.repartitionByRange(partitions(spark), "lang", "words").groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return stored(whole.filter(F.col("f") >= least)), runs.groupBy("lang").agg(F.sum("n_words").alias("n"))


def in_order(phrases: DataFrame, backwards: bool) -> DataFrame:
    """Phrases with part and key, sorted by key (words, reversed if backwards) within parts that are ranges of the order.

    Each part begins with copies of the phrases in earlier parts that its first key continues: fewer than a key's words.
    """
    n = partitions(phrases.sparkSession)
    key = F.reverse("words") if backwards else F.col("words")
    placed = stored(phrases.withColumn("key", key).repartitionByRange(n, "lang", "key").withColumn("part", F.spark_partition_id()))
    first = placed.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("b")).filter(F.size("b.key") > 1)
    heads = first.select(F.col("part").alias("into"), F.col("b.lang").alias("lang"), F.explode(F.transform(F.sequence(F.lit(1), F.size("b.key") - 1), lambda k: F.slice("b.key", F.lit(1), k))).alias("key"))
    copies = placed.join(heads, ["lang", "key"]).drop("part").withColumnRenamed("into", "part").withColumn("copy", F.lit(True))
    return placed.withColumn("copy", F.lit(False)).unionByName(copies).repartitionById(n, F.col("part")).sortWithinPartitions("part", "lang", "key")


def walked(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[int], tuple]]:
    """Each row of an ordered stream that isn't a copy, and the counts of the phrases that its key continues, shortest first."""
    open_keys: list[list[str]] = []
    counts: list[int] = []
    where = None
    for b in small(batches, 4096):
        for part, lang, key, f, copy, *rest in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "key", "f", "copy", *columns)), strict=True):
            if (part, lang) != where:
                where = part, lang
                open_keys.clear()
                counts.clear()
            while open_keys and key[: len(open_keys[-1])] != open_keys[-1]:
                open_keys.pop()
                counts.pop()
            if not copy:
                yield list(counts), (lang, key, f, *rest)
            open_keys.append(key)
            counts.append(f)


def left_counts(share: int):
    """Counts of the first parts, and whether the phrase without its last word stands in it in `share` of 100 cases or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for parts, (lang, key, f) in walked(batches, []):
            rows.append((lang, key, f, parts, len(key) > 2 and 100 * f >= share * parts[-1]))
            if len(rows) == 4096:
                yield as_batch(rows, LEFT)
                rows = []
        yield as_batch(rows, LEFT)

    return run


def right_counts(share: int):
    """Counts of both parts at the cut with the lowest score, and the same of the phrase without its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for rests, (lang, key, f, firsts, right) in walked(batches, ["firsts", "right"]):
            if len(key) < 2:
                continue
            score, _, l, r = min((2_000_000 * f // (l + r), k, l, r) for k, (l, r) in enumerate(zip(firsts, rests[::-1], strict=True)))
            rows.append((lang, key[::-1], f, l, r, score, right, len(key) > 2 and 100 * f >= share * rests[-1]))
            if len(rows) == 4096:
                yield as_batch(rows, SCORED)
                rows = []
        yield as_batch(rows, SCORED)

    return run


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)


LEFT = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("firsts", pa.list_(pa.int64())), ("right", pa.bool_())])
SCORED = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64()), ("right", pa.bool_()), ("left", pa.bool_())])


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, part: int = PART, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's `top` phrases."""
    counts, totals = phrase_counts(docs, longest, least, part, text_col, lang_col)
    lefts = in_order(counts, False).mapInArrow(left_counts(share), "lang string, words array<string>, f long, firsts array<long>, right boolean")
    scored = stored(in_order(lefts, True).mapInArrow(right_counts(share), "lang string, words array<string>, a long, l long, r long, score long, right boolean, left boolean"))
    inner = F.size("words") - 1
    covered = scored.filter("right").select("lang", F.slice("words", F.lit(1), inner).alias("words")).union(scored.filter("left").select("lang", F.slice("words", F.lit(2), inner).alias("words")))
    joined = lambda df: df.withColumn("phrase", F.array_join("words", " "))
    kept = joined(scored).join(joined(covered).select("lang", "phrase").hint("merge"), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
