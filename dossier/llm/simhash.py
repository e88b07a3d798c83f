"""Operator 2: SimHash near-dedup by a binary trie self-join.

Every whole text gets a 64-bit fingerprint; equal fingerprints become one node with its smallest id and its
members counted, so that thousands of copies cost no pairs. Two fingerprints within `budget` bits agree on
one of budget + 1 blocks of their bits, so the fingerprints are rotated to bring each block in front and
dealt by that block: the top of the trie. Below it each task walks its binary trie with itself (trie.py): it
holds pairs of nodes, goes to their children together, adds the bits in which the paths differ, and drops a pair
once it is over the budget. A task takes whole subtrees of a bounded number of rows at a time and returns a spanning
forest of its links, not the links, so that a dense ball of near copies gives as many rows as it has members.
Components grow over these links by large-star and small-star steps in Spark.

near_copies() is the form for pipelines: five-word shingles and a similarity of 0.8 or more, which 3 bits of 64
would miss for the most part. Its fingerprints are longer and of distinct shingles; bands of them go through the
same trie join, which only proposes pairs. A pair is a link when the exact Jaccard similarity of its shingle sets
says so. By independent bits, 99.7 % of the pairs at 0.8 have one of the 16 bands of 32 bits with 4 errors at most
and none in one of its two blocks of 8; and of these pairs 97.7 % differ in few enough of all 512 bits to be proposed
(99.9 % of those at 0.85). In a dense group a forest of likely pairs is compared, and other pairs only as
far as its links fail, so that a group of near copies costs about as many comparisons as it has members. Of those other
pairs, the sets' sizes by slice of the hash space bound the similarity from above, and pairs whose bound is too low are
left out, which loses no link. Texts whose similarities all lie a little below 0.8 are compared each with each.

Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows share their component.
Null ids take part, but name a component only if all its ids are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import WORD, flat_bytes, partitions, pick, reliable, small, stored, whole_groups
from dossier.llm.trie import close_pairs

BITS, SEED = 64, 42
_word = re.compile(WORD.encode().replace(b"\\x20", b" "))
#: Long fingerprints: words of 64 bits, bands that don't overlap, and the odd numbers that mix the words.
WORDS = 8
BAND = 32
BANDS = WORDS * BITS // BAND
_ODD = np.random.default_rng(2).integers(1, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: A band is dealt by BLOCKS blocks of BLOCK bits, in which a pair has no error; it has ERRORS at most in the band.
BLOCKS, BLOCK, ERRORS = 2, 8, 4
#: Pairs are proposed whose fingerprints differ in as many bits as expected at the similarity, and so many deviations more.
DEVIATIONS = 2
#: Pairs between trees or components that a text proposes in each place where it is dealt: at first, then, and last.
CLOSEST, FURTHER, ALL = 1, 2, 1 << 40
#: Slices of the hash space whose sizes bound a pair's similarity, and the pairs that are bounded at once.
SLICES, BOUNDED = 256, 20_000
#: Rows of whole groups that are taken together; pairs that wait for a sort.
PART_ROWS, AT_ONCE = 200_000, 2_000_000


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; none without words."""
    words = _word.findall(data.lower())  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Bits that are set in over half the hashes, as one 64-bit word."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprint(data: bytes, width: int) -> int:
    return int(majority(shingle_hashes(data, width))[0])


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """XXH64 of the distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(data, width))


def long_fingerprint(h: np.ndarray) -> bytes:
    """WORDS words of bits, each from the hashes of distinct shingles mixed anew."""
    out = []
    for odd in _ODD:
        x = h * odd
        out.append(majority((x ^ (x >> np.uint64(32))) * odd))
    return np.concatenate(out).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = np.array([fingerprint(t or b"", width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes is linked to, over any number of links."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]) is not None and (up != label).any():
                label = up
    return label


def links(nodes: DataFrame, budget: int = 3) -> DataFrame:
    """a, b: links (a spanning forest for each part of the trie) between the ids of nodes (fp, id; fp unique)."""
    blocks = budget + 1
    width = BITS // blocks
    dealt = nodes.select("fp", "id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by = f"cast(block * {width} as int)"
    dealt = dealt.withColumn("key", F.expr(f"if(block = 0, fp, shiftleft(fp, {by}) | shiftrightunsigned(fp, {BITS} - {by}))"))
    dealt = dealt.withColumn("front", F.shiftrightunsigned("key", BITS - width)).select("block", "front", "key", "id")
    # Keys of one front have one sign, so that their order is that of their bits.
    dealt = dealt.repartition(max(8, partitions(nodes.sparkSession)), "block", "front").sortWithinPartitions("block", "front", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block", "front"], PART_ROWS):
            block, key, ids = (t.column(c).to_numpy() for c in ("block", "key", "id"))
            borders = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                keys, own = key[lo:hi].view(np.uint64), ids[lo:hi]
                label = forest(len(keys), close_pairs(keys, width, budget, leaf=1))
                linked = np.flatnonzero(label != np.arange(len(keys)))
                yield pa.record_batch([pa.array(own[linked]), pa.array(own[label[linked]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b)."""
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = stored(edges.select(pair(F.col("a"), F.col("b")).alias("e")).select("e.*").filter("u <> v").distinct())
    for _ in range(rounds):
        # Settled once every id has one link, to an id that has none itself.
        tied = now.groupBy("u").agg(F.count("*").alias("n"))
        if tied.filter("n > 1").select("u").unionAll(now.select("v").distinct().join(tied, F.col("u") == F.col("v"), "left_semi")).isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.filter("u <> v").distinct())
    raise RuntimeError(f"components not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = reliable(fingerprints(docs, width, id_col, text_col))
    nodes = reliable(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # Ids may repeat over fingerprints, and be null: nodes go by their fingerprint, components then take the smallest id.
    found = components(links(nodes.select("fp", F.col("fp").alias("id")), budget))
    grouped = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    by_fp = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def slice_sizes(h: np.ndarray) -> bytes:
    """How many hashes of a set lie in each slice of the hash space, modulo 256."""
    return np.bincount(h.view(np.uint64) >> np.uint64(56), minlength=SLICES).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these slice_sizes (rows of a and b), and with `sizes` elements together, can be as similar.

    Two sets differ by at least as many elements as their sizes do in each slice; sizes modulo 256 differ by no more than
    the sizes themselves when taken the short way around. So no pair that is as similar is refused.
    """
    differ = np.abs((a - b).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
    return sizes - differ >= similarity * (sizes + differ) - 1e-9 * sizes


def most_differing(similarity: float, bits: int, deviations: float = 4) -> int:
    """Bits of so many in which shingle sets of this Jaccard similarity differ at most, so many deviations above what is expected."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(p * bits + deviations * np.sqrt(p * (1 - p) * bits)))


def settled(label: np.ndarray) -> np.ndarray:
    """Each node's root, of pointers without a cycle."""
    while ((up := label[label]) != label).any():
        label = up
    return label


def chosen(ids: np.ndarray, near: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], likely: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, more: the pairs to compare, of all that near() gives with their distances.

    Pairs within `likely` are spanned by a forest: every node is tied to the first one by id that is near it, which the
    members of a dense group have in common, and what this leaves apart by further pairs. Of pairs between trees, each node has its
    `most` closest ones, and `more` tells that it has others.
    """
    n = len(ids)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    hub, root = np.full(n, n), np.arange(n)
    for a, b, d in near() if likely >= 0 else ():
        a, b = a[d <= likely], b[d <= likely]
        np.minimum.at(hub, a, rank[b])
        np.minimum.at(hub, b, rank[a])
    tied = np.flatnonzero(hub < rank)
    root[tied] = by_id[hub[tied]]
    left, right = [tied], [root[tied].copy()]
    root = settled(root)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    i, j, d = (np.zeros(0, np.int64) for _ in range(3))
    more = np.zeros(n, bool)

    def settle() -> None:
        nonlocal i, j, d
        i, j, d = (np.concatenate(x) for x in zip((i, j, d), *waiting, strict=True))
        waiting.clear()
        i, j, d = (x[root[i] != root[j]] for x in (i, j, d))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        more[i[place >= most]] = True
        i, j, d = (x[place < most] for x in (i, j, d))

    for a, b, x in near():
        other = (x > likely) & (root[a] != root[b])
        waiting += [(a[other], b[other], x[other]), (b[other], a[other], x[other])]
        if sum(len(w[0]) for w in waiting) > AT_ONCE:
            settle()
        a, b = a[x <= likely], b[x <= likely]
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            _, one = np.unique(high, return_index=True)  # each tree joins one with a lower root
            left.append(a[one])
            right.append(b[one])
            root[high[one]] = low[one]
            root = settled(root)
    settle()
    i, j = np.concatenate([*left, i]), np.concatenate([*right, j])
    pairs = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    return pairs // n, pairs % n, more


class Kept:
    """A generator's items, held for a second pass while they have few rows; else it runs again."""

    def __init__(self, run: Callable[[], Iterator[tuple[np.ndarray, ...]]], rows: int = AT_ONCE) -> None:
        self.run, self.rows = run, rows
        self.items: list[tuple[np.ndarray, ...]] | None = None

    def __call__(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.items is not None:
            yield from self.items
            return
        items, n = [], 0
        for item in self.run():
            n += len(item[0])
            if n <= self.rows:
                items.append(item)
            yield item
        if n <= self.rows:
            self.items = items


def dealt(nodes: DataFrame) -> DataFrame:
    """nodes (fp, id, component, size and slices of the set) under the blocks of each band of their fingerprints, with the fingerprint.

    key: the place (band and block), and the band's bits from that block on. The bands are the same for every number of
    nodes, so that a pair found in a small table is found in a large one.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = flat_bytes(b.column("fp"))[0].view("<u8").reshape(-1, WORDS)
            for band in range(BANDS):
                word, off = divmod(band * BAND, BITS)
                x = (fp[:, word] >> np.uint64(off)) & np.uint64((1 << BAND) - 1)
                for k in range(BLOCKS):
                    by = k * BAND // BLOCKS
                    key = ((x << np.uint64(by)) | (x >> np.uint64(BAND - by))) & np.uint64((1 << BAND) - 1)
                    key |= np.uint64((band * BLOCKS + k) << BAND)
                    yield pa.record_batch([pa.array(key.view(np.int64)), *(b.column(c) for c in columns)], ["key", *columns])

    columns = ["id", "component", "size", "slices", "fp"]
    return nodes.select(*columns).mapInArrow(deal, "key long, id long, component long, size int, slices binary, fp binary")


def with_slices(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """nodes with the slice_sizes of their sets, null where shingles (id, shingles) lacks the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            held = [slice_sizes(np.array(h, np.int64)) for h in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(held, pa.binary())], ["id", "slices"])

    wanted = shingles.join(nodes.select("id"), "id", "left_semi").select("id", "shingles")
    return nodes.join(wanted.mapInArrow(run, "id long, slices binary"), "id", "left")


def first_place(x: np.ndarray) -> np.ndarray:
    """The first place where two fingerprints meet, by the bits in which they differ; so that one place alone tells of them."""
    bands = x.view("<u4").reshape(-1, BANDS)
    agree = [(bands >> np.uint32(BAND - BLOCK - k * BAND // BLOCKS)) & np.uint32((1 << BLOCK) - 1) == 0 for k in range(BLOCKS)]
    return ((np.bitwise_count(bands) <= ERRORS)[:, :, None] & np.stack(agree, 2)).reshape(-1, BANDS * BLOCKS).argmax(1)


def proposed(dealt: DataFrame, most: int, similarity: float, spanned: bool) -> DataFrame:
    """id, other, more: pairs of ids of dealt() to compare, as chosen() in each place; and the ids that have more of them, with null others."""
    place_bits = (BANDS * BLOCKS - 1).bit_length()
    unused = BITS - BAND - place_bits
    likely = most_differing(similarity, WORDS * BITS, 0) if spanned else -1
    far = most_differing(similarity, WORDS * BITS, DEVIATIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["front"], PART_ROWS):
            key, ids, component, size = (t.column(c).to_numpy() for c in ("key", "id", "component", "size"))
            fp = flat_bytes(t.column("fp"))[0].view("<u8").reshape(len(ids), -1)
            known = t.column("slices").is_valid().to_numpy()
            slices = np.zeros((len(ids) if known.any() else 0, SLICES), np.uint8)
            slices[known[: len(slices)]] = flat_bytes(t.column("slices").drop_null())[0].reshape(-1, SLICES)

            def able(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                out = np.ones(len(a), bool)
                both = np.flatnonzero(known[a] & known[b])  # noqa: B023
                for k in range(0, len(both), BOUNDED):
                    at = both[k : k + BOUNDED]
                    i, j = a[at], b[at]
                    out[at] = may_be_similar(slices[i], slices[j], size[i].astype(np.int64) + size[j], similarity)  # noqa: B023
                return out

            def near() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for a, b in close_pairs(key.view(np.uint64) << np.uint64(unused), place_bits + BLOCK, ERRORS, place_bits + BAND):  # noqa: B023
                    # Sets of such sizes can be as similar, and the nodes aren't in one component.
                    open_ = (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])) & (component[a] != component[b])  # noqa: B023
                    a, b = a[open_], b[open_]
                    x = fp[a] ^ fp[b]  # noqa: B023
                    d = np.bitwise_count(x).sum(1, dtype=np.int64)
                    a, b, d, x = (y[d <= far] for y in (a, b, d, x))
                    here = first_place(x) == key[a] >> BAND  # noqa: B023
                    here[here] = able(a[here], b[here])  # noqa: B023
                    if here.any():
                        yield a[here], b[here], d[here]

            i, j, more = chosen(ids, Kept(near), likely, most)
            others = np.flatnonzero(more)
            flag = np.r_[np.zeros(len(i), bool), np.ones(len(others), bool)]
            yield pa.record_batch([pa.array(np.r_[ids[i], ids[others]]), pa.array(np.r_[ids[j], ids[others]], mask=flag), pa.array(flag)], ["id", "other", "more"])

    front = F.shiftright("key", BAND - BLOCK).alias("front")
    rows = dealt.select(front, "key", "id", "component", "size", "slices", "fp")
    return rows.repartition(max(8, partitions(dealt.sparkSession)), "front").sortWithinPartitions("front", "key").mapInArrow(run, "id long, other long, more boolean")


def similar_components(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """id, component of the linked ids of nodes (fp, id, size): proposed pairs whose shingle sets are similar are links.

    sets(ids) gives id and shingles (their set) of the wanted ids. At first a forest of likely pairs is compared. A pair
    that isn't proposed lies within one tree of it, whose links may have failed, or has nearer ones on both sides; nodes
    of which one or the other is so are dealt again, propose more of the pairs that still lie between components, and in
    the third round all of them.
    """
    spark = nodes.sparkSession
    tried = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "id long, component long")
    shingles = spark.createDataFrame([], "id long, shingles array<long>")

    def component(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(found.toDF(of, name), of, "left").withColumn(name, F.coalesce(name, of))

    active, most, spanned = nodes.withColumn("slices", F.lit(None).cast("binary")), CLOSEST, True
    while True:
        told = stored(proposed(dealt(component(active.select("fp", "id", "size", "slices"), "id", "component")), most, similarity, spanned))
        pairs = told.filter("not more").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(shingles.select("id"), "id", "left_anti"))
        if not ids.isEmpty():
            shingles = shingles.unionAll(stored(sets(ids)))
        held = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        held = stored(held.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared) >= similarity).alias("linked")))
        tried = tried.unionAll(pairs)
        new = held.filter("linked").select("a", "b")
        if not new.isEmpty():
            found = components(found.toDF("a", "b").unionAll(new))
        again = told.filter("more").select("id").distinct()
        if spanned:  # all nodes of components that a failed link of a tree would have joined
            failed = component(component(held.filter("not linked").select("a", "b"), "a", "ca"), "b", "cb").filter("ca <> cb")
            touched = failed.select(F.explode(F.array("ca", "cb")).alias("component")).distinct()
            again = again.unionAll(component(nodes.select("id"), "id", "component").join(touched, "component", "left_semi").select("id")).distinct()
        again = stored(again)
        if again.isEmpty():
            return found
        active = stored(with_slices(nodes.join(again, "id", "left_semi"), shingles))
        most, spanned = FURTHER if spanned else ALL, False


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row: groups over links between texts whose sets of five-word shingles are similar."""
    return _groups(docs, width, similarity, id_col, text_col).select("doc_id", F.col("first.doc_id").alias("component_id"))


def _groups(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text_key (which tell a row), and the first row of its group: the smallest id, null ids last, then the smallest text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            held = [shingle_set(t or b"", width) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in held], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([long_fingerprint(h) for h in held], pa.binary()), pa.array(node), pa.array([len(h) for h in held], pa.int32())], ["doc_id", "text_key", "fp", "node", "size"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            held = [shingle_set(t or b"", width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(held, pa.list_(pa.int64()))], ["id", "shingles"])

    def sets(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids.withColumnRenamed("id", "node"), "node").select(F.col("node").alias("id"), F.col("first.doc_id").alias("of_doc"), F.col("first.text_key").alias("of_text"))
        held = texts.join(wanted, (F.col("text_key") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("id", "text")
        return held.mapInArrow(shingles, "id long, shingles array<long>").dropDuplicates(["id"])

    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))
    rows = reliable(texts.mapInArrow(run, "doc_id long, text_key long, fp binary, node long, size int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key"))
    nodes = reliable(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), first.alias("first")))
    found = similar_components(nodes.select("fp", F.col("node").alias("id"), "size"), sets, similarity)
    grouped = nodes.select("node", "first").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("first").alias("first"))
    return rows.join(grouped.drop("first").join(least, "component").select("node", "first"), "node").select("doc_id", "text_key", "first")


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of docs of each group of near copies, as by id and text; one of them where the same row repeats."""
    key = lambda doc_id, text_key: (F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text_key, doc_id.isNull()).alias("_text"))
    first = _groups(docs, width, similarity, id_col, text_col).select(*key(F.col("first.doc_id"), F.col("first.text_key")))
    rows = docs.select("*", *key(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))))
    return rows.join(first.distinct(), ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).drop("_id", "_text")
