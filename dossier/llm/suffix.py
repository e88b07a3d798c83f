"""Operator 6: suffix-array dedup with a run-length index.

Every byte that is covered by a string of `size` bytes which starts at another place too is marked; matches
never cross documents.

Candidates. Of the K-byte grams in a window of `size` bytes the leftmost with the least hash is its anchor,
so equal windows have equal anchors at equal offsets, and only stretches around equal anchors need to be
compared. A stretch holds all windows of one anchor. Stretches that are equal as a whole are settled by
their hash, most of them within the map task that finds them; of those only one goes on, so that a passage
with very many copies sends a row for each task and not for each copy.

Index. Unequal stretches around equal anchors are gathered by anchor. Each task lays them out as one text of
bounded size at a time and builds its Burrows-Wheeler transform in runs, with the suffix-array samples
of each run's head and its predecessor. Matching statistics are streamed over the text from the samples:
at a head the match with its predecessor is measured, and from there on it loses a byte at each step while
its partner moves along. Where it is `size` or longer, both places are repeated.

The exact way for the rest: anchors with over GROUP unequal stretches are dealt by the hashes of all their
windows and counted in Spark, so that no task has to hold them. Very frequent anchors, which a mergeable sketch
finds, go there at once, by their stretches, and are gathered nowhere.

Null texts are empty. Texts below `size` bytes are kept whole. Rows that repeat a doc_id are documents of
their own, and equal ones are repeated throughout. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import flat_bytes, partitions, pick, small, stored, whole_groups

K, GROUP, BLOCK, SLICE, INDEX_BYTES = 32, 2000, 16, 1_000_000, 1_000_000
PLACE_BITS = 26
#: An anchor with more rows than HOT_ROWS is dealt by its stretches, if it is among the TOP most frequent of a sketch of TRACKED.
HOT_ROWS, TOP, TRACKED = 20_000, 1000, 65_536
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)
_BYTE = np.random.default_rng(6).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MOVE = np.uint64(32)


def _grams(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of so many bytes (powers of 2) from each place on."""
    h, width, out = _BYTE[data], 1, {}
    while width < max(widths) and len(h) > width:
        left = h[:-width] * _M[width.bit_length() - 1]
        left += h[width:]
        left ^= left >> _MOVE
        h = left
        width *= 2
        if width in widths:
            out[width] = h
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the next width values at each place."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - w :]) if width > w else m


def anchors(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """data: documents of size bytes or more, end to end. For each run of windows with one anchor: document, first window, windows, anchor's offset in the first, anchor's hash, hash of the stretch."""
    grams = _grams(data, (K, 128))
    h = grams[K]
    bits = max(PLACE_BITS, int(len(h)).bit_length())  # the same for every text, but for one of over 64 MB
    low = np.uint64((1 << bits) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (_least(key, size - K + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), lengths)[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) <= (starts + lengths - size)[doc])
    at = at[valid]
    new = np.r_[True, at[1:] != at[:-1]]
    first = valid[new]
    p = at[new]
    n = np.diff(np.r_[np.flatnonzero(new), len(valid)])
    end = first + n - 1 + size
    h128 = grams[128]
    whole = h128[first] * _M[0] + h128[end - 128] * _M[1] + h128[(first + end) // 2 - 64] * _M[2] + n.astype(np.uint64) * _M[3] + (p - first).astype(np.uint64) * _M[4]
    whole ^= whole >> _MOVE
    own = doc[first]
    return own, first - starts[own], n, p - first, h[p], whole * _M[5]


#: done: 1 if the windows of the row are known to be repeated and need no further look; more: the row stands for several equal ones.
ROWS = pa.schema([("h", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("more", pa.int32())])
DDL = "h long, whole long, doc_id long, t long, first int, n int, off int, more int"
KINDS = "kind string, h long, doc_id long, t long, first int, n int, off int, more int"


def find_anchors(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, t, data. Rows as ROWS; more is 2 for those that a row with more 1 of the same task stands for."""

    def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, total = 0, 0
        for hi, n in enumerate(lengths.tolist()):
            if total and total + n > SLICE:
                yield lo, hi
                lo, total = hi, 0
            total += n
        if total:
            yield lo, len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, lengths = flat_bytes(b.column("data"))
            ids, ts = b.column("doc_id"), b.column("t")
            found = []
            for lo, hi in slices(lengths):
                base = starts[lo]
                own, first, n, off, h, whole = anchors(data[base : starts[hi - 1] + lengths[hi - 1]], starts[lo:hi] - base, lengths[lo:hi], size)
                found.append((own + lo, first, n, off, h.view(np.int64), whole.view(np.int64)))
            if not found:
                continue
            own, first, n, off, h, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            _, inverse, counts = np.unique(h ^ (whole * np.int64(31)), return_inverse=True, return_counts=True)
            copies = counts[inverse]
            # one of several equal stretches goes on for all; the others are settled here
            order = np.argsort(inverse, kind="stable")
            lead = np.zeros(len(order), bool)
            lead[order] = np.r_[True, inverse[order][1:] != inverse[order][:-1]]
            more = np.where(copies == 1, 0, np.where(lead, 1, 2))
            take = pa.array(own)
            yield pa.record_batch([pa.array(h), pa.array(whole), ids.take(take), ts.take(take), *(pa.array(x.astype(np.int32)) for x in (first, n, off, more))], schema=ROWS)

    return docs.filter(F.octet_length("data") >= size).mapInArrow(run, DDL)


def hot_anchors(rows: DataFrame, most: int) -> list[int]:
    """Hashes of anchors with over `most` rows, from a mergeable sketch of frequent items: TOP at most."""
    found = rows.agg(F.expr(f"approx_top_k(h, {TOP}, {TRACKED})").alias("top")).first()["top"]
    return [r["item"] for r in found or [] if r["count"] > most]


#: kind: M its windows are repeated; D compare by the index; H compare by counting windows.
def settle(rows: DataFrame, group: int = GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Marks and what is left to compare, as KINDS. Stretches around an anchor that stands once are gone.

    rows (a stored table) that are settled already don't move. A very frequent anchor's rows are dealt by their whole
    stretches, and compared by counting windows: no task gathers them.
    """
    names = [x.split()[0] for x in KINDS.split(", ")[1:]]
    settled = rows.filter("more = 2").select(F.lit("M").alias("kind"), *names)
    hot = hot_anchors(rows.filter("more < 2"), hot_rows)
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    opened = rows.filter("more < 2").withColumn("hot", is_hot).withColumn("key", F.when(F.col("hot"), F.xxhash64("h", "whole")).otherwise(F.col("h")))
    opened = opened.select("key", "whole", "hot", *names).repartition(max(8, partitions(rows.sparkSession)), "key").sortWithinPartitions("key", "h", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "h"], 200_000):
            key, h, whole, more, hot = (t.column(c).to_numpy() for c in ("key", "h", "whole", "more", "hot"))
            new_h = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])]
            new_w = new_h | np.r_[True, whole[1:] != whole[:-1]]
            of_h, of_w = np.cumsum(new_h) - 1, np.cumsum(new_w) - 1
            in_w = np.bincount(of_w)[of_w]
            kinds = np.bincount(of_h[new_w])[of_h]  # unequal stretches around the anchor
            by_count = hot.astype(bool) | (kinds > group)
            for at, what in (((in_w > 1) | (more == 1), "M"), (new_w & (kinds > 1) & ~by_count, "D"), (new_w & by_count, "H")):
                if at.any():
                    out = t.select(names).take(pa.array(np.flatnonzero(at))).combine_chunks()
                    for b in out.to_batches():
                        yield pa.record_batch([pa.array([what] * b.num_rows, pa.string()), *b.columns], ["kind", *names])

    return settled.unionAll(opened.mapInArrow(run, KINDS))


def suffix_order(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places of data in the order of the strings from there to stop (the end of their stretch); ties by place.

    Prefixes of doubled width: places whose prefix stands once, or ends within it, are settled, and each round sorts
    only the others, by the rank of what follows.
    """
    n = len(data)
    bits, place = n.bit_length(), np.arange(n)
    present = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.int64)
    code[present] = np.arange(1, len(present) + 1)  # 0 stands behind the end
    wide = len(present).bit_length()
    width = (63 - bits) // wide
    padded = np.concatenate([code[data], np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << wide) | padded[k : n + k]
    behind = wide * np.maximum(width - (stop - place), 0)
    order, new = _sorted_groups((key >> behind) << behind, place, bits, wide)
    left, rank = place, np.empty(n, np.int32 if bits < 32 else np.int64)
    while True:
        first = np.flatnonzero(new)
        members = np.diff(np.r_[first, len(new)])
        group = np.repeat(left[first], members)
        rank[order[left]] = group
        several = np.repeat(members > 1, members)
        left, group = left[several], group[several]
        if not len(left):
            return order
        at = order[left]
        then = at + width
        follows = np.where(then < stop[at], rank[np.minimum(then, n - 1)] + np.int64(1), 0)
        if 3 * bits <= 63:
            order[left], new = _sorted_groups((group << bits) | follows, at, bits, bits)
        else:
            by = np.lexsort((at, follows, group))
            group, follows = group[by], follows[by]
            order[left] = at[by]
            new = np.r_[True, (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])] | (follows == 0)
        width *= 2


def _sorted_groups(key: np.ndarray, place: np.ndarray, bits: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of so many bits) by key and place, and whether each is the first of its key, or alone as the last bits of its key are 0."""
    row = np.sort((key << bits) | place)
    place, key = row & ((1 << bits) - 1), row >> bits
    return place, np.r_[True, key[1:] != key[:-1]] | (key & ((1 << last) - 1) == 0)


class RunLengthIndex:
    """The Burrows-Wheeler transform of stretches in runs, with samples at the head of each run."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self.n = data, len(data)
        self.stop = np.repeat(starts + lengths, lengths)
        order = suffix_order(data, self.stop)
        first = np.zeros(self.n, bool)
        first[starts] = True
        before = data[order - 1].astype(np.int16)
        before[first[order]] = -1  # a stretch's start: what stands before it is unlike anything else
        head = np.r_[True, (before[1:] != before[:-1]) | (before[1:] == -1)]
        at = np.flatnonzero(head)
        self.symbols, self.run_lengths = before[at], np.diff(np.r_[at, self.n])
        place, partner = order[at], np.where(at > 0, order[np.maximum(at - 1, 0)], -1)
        by = np.argsort(place)
        self.place, self.partner = place[by], partner[by]
        self.match = self._measure(self.place, self.partner)

    def _measure(self, a: np.ndarray, b: np.ndarray, step: int = 16) -> np.ndarray:
        """How many bytes from a and b on are equal, within their stretches."""
        out = np.zeros(len(a), np.int64)
        room = np.where(b >= 0, np.minimum(self.stop[a] - a, self.stop[np.maximum(b, 0)] - b), 0)
        live = np.flatnonzero(room > 0)
        reach = np.arange(step)
        while len(live):
            i, j = a[live] + out[live], b[live] + out[live]
            left = room[live] - out[live]
            same = self.data[np.minimum(i[:, None] + reach, self.n - 1)] == self.data[np.minimum(j[:, None] + reach, self.n - 1)]
            same &= reach < left[:, None]
            got = np.where(same.all(1), step, same.argmin(1))
            out[live] += got
            live = live[(got == step) & (left > step)]
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, streamed from the samples: the length of its match with the suffix before it in order, and where that is."""
        sample = np.zeros(self.n, np.int64)
        sample[self.place] = np.arange(len(self.place))
        sample = np.maximum.accumulate(sample)
        moved = np.arange(self.n) - self.place[sample]
        return self.match[sample] - moved, self.partner[sample] + moved

    def repeated(self, size: int) -> np.ndarray:
        """Whether the size bytes from each place on stand at another place too."""
        match, partner = self.statistics()
        long = match >= size
        out = long.copy()
        out[partner[long]] = True
        return out


MARKS = "doc_id long, t long, start int, stop int"


def compare(stretches: DataFrame, size: int) -> DataFrame:
    """stretches: h, doc_id, t, first, data, dealt and sorted by h. Marks as MARKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(small(batches, 1000), ["h"], INDEX_BYTES, "data"):
            data, starts, lengths = flat_bytes(t.column("data").combine_chunks())
            twice = np.flatnonzero(RunLengthIndex(data, starts, lengths).repeated(size))
            if not len(twice):
                continue
            own = np.searchsorted(starts, twice, "right") - 1
            new = np.r_[True, (twice[1:] != twice[:-1] + 1) | (own[1:] != own[:-1])]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(twice) - 1]
            own = own[new]
            base = t.column("first").to_numpy()[own] - starts[own]
            start, stop = twice[new] + base, twice[last] + base + size
            take = pa.array(own)
            columns = [t.column(c).combine_chunks().take(take) for c in ("doc_id", "t")]
            yield pa.record_batch([*columns, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "t", "start", "stop"])

    return stretches.mapInArrow(run, MARKS)


def count_windows(stretches: DataFrame, size: int) -> DataFrame:
    """stretches as for compare, of anchors with very many: marks by counting equal windows at equal places around the anchor.

    Blocks of BLOCK windows are counted first, as one string each; a block that stands twice is one mark. Only the
    windows of other blocks are counted one by one, with one of each repeated block for them to meet.
    """
    names = ["h", "rel", "n", "w", "doc_id", "t", "start", "more", "data"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, doc_id, t, first, off, more, data in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "t", "first", "off", "more", "data")), strict=True):
                k, n = 0, len(data) - size + 1
                while k < n:  # block borders lie at equal places around the anchor
                    stop = min(n, k + BLOCK - (k - off) % BLOCK)
                    own = data[k : stop - 1 + size]
                    rows.append((h, k - off, stop - k, hashlib.blake2b(own, digest_size=16).digest(), doc_id, t, first + k, more, own))
                    k = stop
            if rows:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, rel, doc_id, t, start, times, data in zip(*(b.column(c).to_pylist() for c in ("h", "rel", "doc_id", "t", "start", "times", "data")), strict=True):
                rows += [(h, rel + k, hashlib.blake2b(data[k : k + size], digest_size=16).digest(), doc_id, t, start + k, times) for k in range(len(data) - size + 1)]
            if rows:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["h", "rel", "w", "doc_id", "t", "start", "times"])

    cut = stored(stretches.mapInArrow(blocks, "h long, rel int, n int, w binary, doc_id long, t long, start int, more int, data binary"))
    key = ["h", "rel", "n", "w"]
    counted = cut.groupBy(*key).agg(F.sum(F.col("more") + 1).alias("times"), F.min(F.struct("doc_id", "t", "start")).alias("lead"))
    known = stored(cut.join(counted, key))
    whole = known.filter("times > 1 and more = 0").select("doc_id", "t", "start", (F.col("start") + F.col("n") - 1 + size).alias("stop"))
    single = known.filter((F.col("times") == 1) | (F.struct("doc_id", "t", "start") == F.col("lead")))
    each = single.select("h", "rel", "doc_id", "t", "start", "times", "data").mapInArrow(windows, "h long, rel int, w binary, doc_id long, t long, start int, times long")
    twice = each.groupBy("h", "rel", "w").agg(F.sum("times").alias("found")).filter("found > 1").drop("found")
    apart = each.filter("times = 1").join(twice, ["h", "rel", "w"], "left_semi").select("doc_id", "t", "start", (F.col("start") + size).alias("stop"))
    return whole.unionAll(apart)


def repeated_spans(docs: DataFrame, size: int = 200, group: int = GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs: doc_id, t, data. Marks as MARKS, which may overlap."""
    spark = docs.sparkSession
    n = max(8, partitions(spark))
    found = stored(settle(stored(find_anchors(docs, size)), group, hot_rows))
    marks = found.filter("kind = 'M'").select("doc_id", "t", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + size).alias("stop"))
    wanted = found.filter("kind <> 'M'").groupBy("doc_id", "t").agg(F.collect_set(F.struct("kind", "h", "first", "n", "off", "more")).alias("wanted"))
    texts = docs.join(wanted, docs["t"].eqNullSafe(wanted["t"]) & docs["doc_id"].eqNullSafe(wanted["doc_id"])).select(docs["doc_id"], docs["t"], "data", "wanted")
    # Equal rows of docs would give a stretch twice; their windows are settled, so one is enough.
    cut = texts.select("doc_id", "t", "data", F.explode("wanted").alias("s")).select("s.kind", "s.h", "doc_id", "t", "s.first", "s.off", "s.more", F.expr(f"substring(data, s.first + 1, s.n + {size - 1})").alias("data"))
    cut = stored(cut)
    by_index = compare(cut.filter("kind = 'D'").repartition(n, "h").sortWithinPartitions("h"), size)
    return marks.unionAll(by_index).unionAll(count_windows(cut.filter("kind = 'H'"), size))


def remove_repeated(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), group: int = GROUP, hot_rows: int = HOT_ROWS, whole_characters: bool = False) -> DataFrame:
    """doc_id, spans (removed runs as start and stop in bytes), kept (bytes) of every row, and the columns in keep as they are.

    whole_characters: what is left of a character that a span's border cuts goes from kept too, which then is UTF-8.
    """
    kept_names = {f"keep_{c}": c for c in keep}
    all_rows = pick(docs, doc_id=id_col, text=text_col, **kept_names).withColumn("data", F.coalesce(F.col("text"), F.lit("")).cast("binary")).withColumn("t", F.xxhash64("data")).drop("text")
    marks = repeated_spans(all_rows.select("doc_id", "t", "data"), size, group, hot_rows)
    by_doc = marks.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("marks")).withColumnsRenamed({"doc_id": "of_doc", "t": "of_t"})
    joined = all_rows.join(by_doc, F.col("t").eqNullSafe(F.col("of_t")) & F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").drop("of_doc", "of_t", "t")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in small(batches):
            spans, kept = [], []
            for data, own in zip(b.column("data"), b.column("marks"), strict=True):
                runs = union(own.values) if own.is_valid else []
                whole_text = data.as_py()
                spans.append([{"start": s, "stop": e} for s, e in runs])
                pieces = (whole_text[s:e] for s, e in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(whole_text)], strict=True))
                kept.append(b"".join(p.decode("utf-8", "ignore").encode() if whole_characters and runs else p for p in pieces))
            yield pa.record_batch([b.column("doc_id"), pa.array(spans, kind), pa.array(kept, pa.binary()), *(b.column(c) for c in kept_names)], ["doc_id", "spans", "kept", *kept_names])

    out = joined.mapInArrow(run, "doc_id long, spans array<struct<start: int, stop: int>>, kept binary" + "".join(f", `{c}` {fields[k]}" for c, k in kept_names.items()))
    return out.withColumnsRenamed({c: k for c, k in kept_names.items()})


def union(marks: pa.StructArray) -> list[tuple[int, int]]:
    """Overlapping and touching marks (start, stop) as runs."""
    start, stop = (marks.field(k).to_numpy() for k in (0, 1))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.r_[new[1:] - 1, len(start) - 1]].tolist(), strict=True))

