"""Operator 8: best-fit packing with Martello-Toth dominance reduction.

Texts become token ids plus a closing id; longer documents are cut into pieces of the capacity, the first
of which may be shorter. All that packing depends on is how many pieces there are of each length, so the
driver gets that histogram alone: at most `capacity` rows, whatever the corpus. On it, sets that dominate
every other set for their largest piece are fixed, a whole class of equal bins at a time; the rest is
packed by best fit, longest first. The plan, again of a size that only the capacity bounds, is joined back
to the pieces by their rank within their length. Ranks come from counts per length and bucket, and a length has
a bucket for every BUCKET_ROWS pieces, so that no task holds all pieces of one length, however many there are.

Null texts are empty documents, of the closing id alone. Rows that repeat a doc_id are documents of their
own (told apart by their token checksum where they differ; equal rows are interchangeable). An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.bpe import grouped, tokenizer
from dossier.llm.common import pick, small, stored

#: Pieces of one length that are ranked together; a length has as many buckets as it needs.
BUCKET_ROWS = 2000


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for b in small(batches):
            ids, at = b.column(0).to_pylist(), 0
            rows: list[tuple] = []
            for texts in grouped([t or "" for t in b.column(1).to_pylist()]):
                for doc_id, x in zip(ids[at:], bpe.encode_many(texts), strict=False):
                    data = x + end
                    n = len(data) // 4
                    first = n % capacity or min(n, capacity)
                    start = 0
                    for k, stop in enumerate(range(first, n + 1, capacity)):
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                        start = stop
                at += len(texts)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, SCHEMA.types, strict=True)], SCHEMA.names)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix the sets that dominate all others with their longest piece; (set, how often) and the counts left.

    For the longest piece j: alone if nothing fits beside it; with i if both fill the bin; with the longest
    i that fits if no two others fit; and with that i if it is as long as any two others that fit, where
    three don't.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []
    kept: dict[int, int] = {}  # pieces for which nothing was proved: best fit's
    lengths = sorted(left)

    def take(n: int, c: int) -> None:
        left[n] -= c
        if not left[n]:
            del left[n]
            lengths.pop(bisect_left(lengths, n))

    while lengths:
        j = lengths[-1]
        room = capacity - j
        if room in left and room != j:
            c = min(left[j], left[room])
            fixed.append(((j, room), c))
            take(j, c)
            take(room, c)
            continue
        if room == j:
            c = left[j] // 2
            if c:
                fixed.append(((j, j), c))
                take(j, 2 * c)
                continue
        if lengths[0] > room or (lengths[0] == j and left[j] == 1):
            fixed.append(((j,), left[j]))
            take(j, left[j])
            continue
        small = [n for n in lengths[:3] for _ in range(min(3, left[n]))][:3]
        fits = lengths[: bisect_left(lengths, room + 1)]
        i = fits[-1]
        spare = left[i] - (i == j)
        proved = len(small) < 2 or small[0] + small[1] > room
        if not proved and spare and (len(small) < 3 or sum(small) > room):
            proved = i >= best_pair(fits, left, room)
        if proved and spare:
            c = min(left[j], left[i]) if i != j else left[j] // 2
            if i != j:  # the proof holds while j stays the longest and i the longest that fits
                fixed.append(((j, i), c))
                take(j, c)
                take(i, c)
            else:
                fixed.append(((j, j), c))
                take(j, 2 * c)
        else:
            kept[j] = left[j]
            take(j, left[j])
    return fixed, kept


def best_pair(fits: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fit into room together."""
    best, hi = 0, len(fits) - 1
    for lo, a in enumerate(fits):
        while hi >= 0 and a + fits[hi] > room:
            hi -= 1
        if hi < lo:
            break
        if hi > lo or left[a] > 1:
            best = max(best, a + fits[hi])
    return best


def best_fit(counts: dict[int, int], capacity: int, fixed: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest bin with room, all bins of like content at once; also fills fixed bins."""
    room: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], count: int) -> None:
        r = capacity - sum(content)
        if r not in bins:
            bins[r] = []
            insort(room, r)
        bins[r].append((content, count))

    for content, count in fixed:
        put(content, count)
    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            k = bisect_left(room, n)
            if k == len(room):
                per = capacity // n
                full, rest = divmod(c, per)
                if full:
                    put((n,) * per, full)
                if rest:
                    put((n,) * rest, 1)
                break
            content, count = bins[room[k]].pop()
            r = room[k]
            if not bins[r]:
                del bins[r]
                room.pop(k)
            per = r // n
            full = min(count, c // per)
            if full:
                put(content + (n,) * per, full)
            c -= full * per
            count -= full
            if count and c < per:
                if c:
                    put(content + (n,) * c, 1)
                    count -= 1
                c = 0
            if count:
                put(content, count)
    return [x for own in bins.values() for x in own]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """For ranges of ranks within a length: length, first rank, ranks, pieces a bin, first bin, offset."""
    fixed, kept = reduce_by_dominance(counts, capacity)
    used = dict.fromkeys(counts, 0)
    rows, first_bin = [], 0
    for content, count in best_fit(kept, capacity, fixed):
        offset, k = 0, 0
        while k < len(content):
            n = content[k]
            per = 1
            while k + per < len(content) and content[k + per] == n:
                per += 1
            rows.append((n, used[n], per * count, per, first_bin, offset))
            used[n] += per * count
            offset += per * n
            k += per
        first_bin += count
    assert used == counts
    return rows


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """cut (of pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = stored(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # For each length its buckets and the plan's ranges: capacity rows, and at most 4 x capacity ranges in all.
    own: dict[int, list[tuple[int, ...]]] = {n: [] for n in histogram}
    for length, *r in plan(histogram, capacity):
        own[length].append(tuple(r))
    rows = [(length, -(-histogram[length] // BUCKET_ROWS), sorted(r)) for length, r in own.items()]
    ranges = spark.createDataFrame(rows, "length long, buckets long, ranges array<struct<low: long, ranks: long, per: long, bin: long, at: long>>")
    cut = cut.join(F.broadcast(ranges), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    # Ranks within a bucket, and what the buckets before it hold; both are dealt by length and bucket.
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.withColumn("r", F.expr("filter(ranges, r -> rank >= r.low and rank < r.low + r.ranks)[0]"))
    k = F.col("rank") - F.col("r.low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r.bin") + F.floor(k / F.col("r.per"))).cast("long").alias("sequence_id"), (F.col("r.at") + (k % F.col("r.per")) * F.col("length")).cast("long").alias("offset"))
