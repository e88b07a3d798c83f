"""Operator 3: nearest neighbours by shifted space-filling curves.

Each of several curves projects the normalised vectors to a few dimensions, shifts them, and orders them by
a Hilbert key. Projections are random rotations of the data's principal axes, taken from the second moments that
Spark sums over all vectors. The rows of each curve are range-partitioned and sorted by key in Spark; a task slides
over its rows in order and compares each query with the `window` rows before and after it, so that it holds a few
windows at a time whatever the range's size. Rows at a range's ends meet those of the next range in a second pass. The
windows of all curves are merged and reranked by the inner product in double precision.

Windows alone miss neighbours where vectors have no neighbourhoods, as in nearly isotropic data. With
complete=True the merged windows only give each query a threshold, its k-th best so far; it then visits all blocks of
rows of the first curve whose bound (centre and radius) can still beat that. Results are then exact. On
clustered data few blocks are visited; on isotropic data nearly all are, in pieces of bounded size, which is the
stated query set against all rows.

Vectors that are null, zero, of a rare length, or hold null or non-finite components take no part. Ties go to
the smaller id. Vectors that repeat an id are candidates of their own, told apart by their components; a
query's own id is never its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import partitions, pick, stored

CURVES, DIMS, BITS, WINDOW = 4, 6, 8, 1024
#: For the completion: rows of a block, queries that meet a block's rows together, products formed at once.
BLOCK_ROWS, QUERY_ROWS, AT_ONCE = 8192, 16_384, 4_000_000
#: Products computed in another order differ by less.
MARGIN = 1e-9
FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows of coordinates below 2 ** bits), by Skilling's published transform."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def projections(rows: DataFrame, dim: int, curves: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each curve: axes, the deviation along each, and a shift. Axes are random rotations of the main directions of all vectors.

    The second moments are dim x dim numbers for each task, summed in Spark; nothing else comes to the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            if b.num_rows:
                u = unit(_matrix(b.column("v"), dim))
                total += u.T @ u
                n += len(u)
        at = np.arange(dim * dim)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()), pa.array(np.full(len(at), n))], ["at", "total", "n"])

    summed = rows.select("v").mapInArrow(moments, "at long, total double, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas().sort_values("at")
    values, vectors = np.linalg.eigh(summed["total"].to_numpy().reshape(dim, dim) / max(1, summed["n"].iloc[0]))
    spread = np.sqrt(np.maximum(values, 0))
    rng = np.random.default_rng(3)
    out = []
    for _ in range(curves):
        # Directions of much variance weigh more in each axis, those without any not at all.
        axes = np.linalg.qr(vectors @ (spread[:, None] * rng.standard_normal((dim, min(DIMS, dim)))))[0]
        along = np.sqrt(np.maximum(((vectors.T @ axes) ** 2 * np.maximum(values, 0)[:, None]).sum(0), 1e-12))
        out.append((axes, along, rng.uniform(-0.5, 0.5, axes.shape[1])))
    return out


def curve_keys(vectors: np.ndarray, ids: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """A key for each row and curve; its low 15 bits spread rows of one cell."""
    u = unit(vectors)
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    out = []
    for axes, along, shift in planes:
        share = 1 / (1 + np.exp(-1.7 * np.clip(u @ axes / along + shift, -20, 20)))
        cells = np.minimum((share * 2**BITS).astype(np.int64), 2**BITS - 1)
        out.append(((hilbert(cells, BITS) << np.uint64(15)) | spread).astype(np.int64))
    return np.stack(out, 1)


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """query, vec, score of each query's k best candidates that reach its threshold; ties at the k-th place included as far as ids decide."""
    products = q @ c.T
    products[q_ids[:, None] == c_ids[None, :]] = -np.inf
    if allowed is not None:
        products[~allowed] = -np.inf
    if len(c) > k:
        kth = np.partition(products, len(c) - k, axis=1)[:, len(c) - k]
        least = np.maximum(least, kth)
    row, col = np.nonzero((products >= (least - MARGIN)[:, None]) & (products > -np.inf))
    score = np.zeros(len(row))
    for j in range(q.shape[1]):  # in one order of additions for every pair
        score += q[row, j] * c[col, j]
    return first_of_each(q_ids[row], c_ids[col], score, k)


def first_of_each(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    begin = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1] if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
    return query[place < k], vec[place < k], score[place < k]


def _found(a: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in a], ["query_id", "vec_id", "score"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, the same vector found twice counted once."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


def within(m: np.ndarray, ids: np.ndarray, asks: np.ndarray, lo: int, hi: int, window: int, k: int) -> tuple[np.ndarray, ...]:
    """For the queries among rows lo..hi of rows in order: the best of the `window` rows on either side."""
    at = np.flatnonzero(asks[lo:hi]) + lo
    a, b = max(0, lo - window), min(len(m), hi + window)
    allowed = np.abs(np.arange(a, b)[None, :] - at[:, None]) <= window
    return best(m[at], ids[at], np.full(len(at), -np.inf), m[a:b], ids[a:b], k, allowed)


def windows(keyed: DataFrame, dim: int, curves: int, window: int, k: int) -> DataFrame:
    """query_id, vec_id, score from the windows of all curves. keyed: vec_id, v, ask, keys."""
    spark = keyed.sparkSession
    # Ranges of several windows, so that a window reaches over one border at most.
    n = max(1, min(max(8, partitions(spark)), keyed.count() * curves // (4 * window)))
    on_curves = keyed.select("vec_id", "v", "ask", F.posexplode("keys").alias("c", "key")).select("c", "key", "vec_id", "v", "ask")
    ordered = on_curves.repartitionByRange(n, "c", "key", "vec_id").sortWithinPartitions("c", "key", "vec_id")
    kind = keyed.schema["v"].dataType.simpleString()

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows within the range; and, as rows with v, the ends of each curve's rows here, for the next range."""
        part = TaskContext.get().partitionId()
        held = None  # rows not done with: a window of done ones, then those that wait for what follows
        done = 0

        def ends(rows: pa.Table, last: bool) -> pa.RecordBatch:
            near = rows.slice(max(0, rows.num_rows - window)) if last else rows.slice(0, window)
            near = near.combine_chunks().to_batches()[0]
            count = near.num_rows
            order = np.arange(count) + (0 if last else window)
            none = pa.nulls(count)
            return pa.record_batch([none.cast(pa.int64()), none.cast(pa.float64()), near.column("vec_id"), near.column("v"), near.column("ask"), near.column("c"), pa.array(np.full(count, part if last else part - 1, np.int32)), pa.array(order.astype(np.int32))], OUT)

        def told(rows: pa.Table, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
            m, ids, asks = _matrix(rows["v"], dim), rows["vec_id"].to_numpy(), rows["ask"].to_numpy().astype(bool)
            for a in range(lo, hi, window):
                query, vec, score = within(m, ids, asks, a, min(hi, a + window), window, k)
                if len(query):
                    none = pa.nulls(len(query))
                    yield pa.record_batch([pa.array(query), pa.array(score), pa.array(vec), none.cast(rows.schema.field("v").type), none.cast(pa.bool_()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int32())], OUT)

        def by_curve(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            c = b.column("c").to_numpy()
            borders = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                yield b.slice(lo, hi - lo)

        for whole in batches:
            for b in by_curve(whole) if whole.num_rows else ():
                if held is not None and held["c"][0] != b.column("c")[0]:
                    yield from told(held, done, held.num_rows)
                    yield ends(held, True)
                    held = None
                if held is None:
                    held, done = pa.Table.from_batches([b]), 0
                    fresh = True
                else:
                    held = pa.concat_tables([held, pa.Table.from_batches([b])])
                if fresh and held.num_rows >= window:
                    yield ends(held, False)
                    fresh = False
                if held.num_rows - done >= 4 * window:
                    stop = held.num_rows - window
                    yield from told(held, done, stop)
                    keep = max(0, stop - window)
                    held, done = held.slice(keep).combine_chunks(), stop - keep
        if held is not None:
            if fresh:
                yield ends(held, False)
            yield from told(held, done, held.num_rows)
            yield ends(held, True)

    def across(t: pa.Table) -> pa.Table:
        """The last rows of a range and the first of the next, in order: what a window of either side reaches over the border."""
        t = t.sort_by("place")
        m, ids, asks = _matrix(t["v"], dim), t["vec_id"].to_numpy(), t["ask"].to_numpy().astype(bool)
        parts = [within(m, ids, asks, lo, min(len(m), lo + window), window, k) for lo in range(0, len(m), window)]
        return pa.Table.from_batches([_found(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))])

    out = stored(ordered.mapInArrow(slide, f"query_id long, score double, vec_id long, v {kind}, ask boolean, c int, border int, place int"))
    inner = out.filter("query_id is not null").select("query_id", "vec_id", "score")
    edges = out.filter("query_id is null").groupBy("c", "border").applyInArrow(across, FOUND)
    return inner.unionAll(edges)


OUT = ["query_id", "score", "vec_id", "v", "ask", "c", "border", "place"]


def completed(keyed: DataFrame, near: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score of all that a query's k best so far (near) leave open: blocks of the first curve whose bound still beats them."""
    spark = keyed.sparkSession
    kind = keyed.schema["v"].dataType.simpleString()
    first = keyed.select("vec_id", "v", F.col("keys")[0].alias("key")).repartitionByRange(max(8, partitions(spark)), "key", "vec_id").sortWithinPartitions("key", "vec_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of BLOCK_ROWS rows in order."""
        part, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            block = part + (n + np.arange(b.num_rows)) // BLOCK_ROWS
            n += b.num_rows
            yield pa.record_batch([pa.array(block), b.column("vec_id"), b.column("v")], ["block", "vec_id", "v"])

    blocks = stored(first.mapInArrow(number, f"block long, vec_id long, v {kind}"))

    def summary(t: pa.Table) -> pa.Table:
        m = _matrix(t["v"], dim)
        centre = m.mean(0)
        return pa.table({"block": t["block"].slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [float(np.linalg.norm(m - centre, axis=1).max())]})

    # A row for each block, joined with the queries in pieces: a share of the queries, and a share of the blocks.
    bounds = stored(blocks.groupBy("block").applyInArrow(summary, "block long, centre array<double>, radius double"))
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asked = stored(keyed.filter("ask").select("vec_id", "v").join(kth, "vec_id", "left").fillna(float("-inf"), ["least"]))
    shares = max(1, -(-asked.count() // QUERY_ROWS))
    parts = max(1, -(-bounds.count() // QUERY_ROWS))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("s")
    q = asked.select("vec_id", "v", "least", share, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    b = bounds.select("block", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"))

    def open_blocks(q: pa.Table, b: pa.Table) -> pa.Table:
        rows, at = [], []
        if q.num_rows and b.num_rows:
            m, least = _matrix(q["v"], dim), q["least"].to_numpy()
            centre, radius = _matrix(b["centre"], dim), b["radius"].to_numpy()
            step = max(1, AT_ONCE // len(centre))
            for lo in range(0, len(m), step):
                part = m[lo : lo + step]
                row, col = np.nonzero(part @ centre.T + np.linalg.norm(part, axis=1)[:, None] * radius[None, :] >= least[lo : lo + step, None] - MARGIN)
                rows.append(row + lo)
                at.append(col)
        row, col = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, at))
        return pa.table({"vec_id": q["vec_id"].take(pa.array(row)), "v": q["v"].take(pa.array(row)), "least": q["least"].take(pa.array(row)), "block": b["block"].take(pa.array(col)), "s": q["s"].take(pa.array(row))})

    visits = q.groupBy("s", "p").cogroup(b.groupBy("s", "p")).applyInArrow(open_blocks, f"vec_id long, v {kind}, least double, block long, s int")
    everyone = blocks.select("block", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"))

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and c.num_rows:
            m, ids = _matrix(c["v"], dim), c["vec_id"].to_numpy()
            step = max(1, AT_ONCE // len(m))
            for lo in range(0, q.num_rows, step):
                own = q.slice(lo, step)
                parts.append(best(_matrix(own["v"], dim), own["vec_id"].to_numpy(), own["least"].to_numpy(), m, ids, k))
        return pa.Table.from_batches([_found(tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))])

    return visits.groupBy("block", "s").cogroup(everyone.groupBy("block", "s")).applyInArrow(compare, FOUND)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, window: int = WINDOW, complete: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on vec_id."""
    spark = embeddings.sparkSession
    rows = pick(embeddings, vec_id=id_col, v=vector_col).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["n"]
    rows = rows.filter(F.size("v") == dim)
    planes = projections(rows, dim, curves)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = curve_keys(_matrix(b.column("v"), dim), b.column("vec_id").to_numpy(), planes)
                yield pa.record_batch([b.column("vec_id"), b.column("v"), b.column("ask"), pa.array(list(keys), pa.list_(pa.int64()))], ["vec_id", "v", "ask", "keys"])

    kind = rows.schema["v"].dataType.simpleString()
    keyed = stored(rows.withColumn("ask", F.coalesce(is_query, F.lit(False))).mapInArrow(key, f"vec_id long, v {kind}, ask boolean, keys array<long>"))
    near = _merge(windows(keyed, dim, curves, window, k), k)
    if complete:
        near = stored(near)
        near = _merge(completed(keyed, near, dim, k).unionByName(near.select("query_id", "vec_id", "score")), k)
    return near.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
