"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import ann, bpe, chat, common, html, linededup, packing, quality, rules, simhash, suffix, trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, row string, data string, t long, h long, kept string, score double"


def make(seed=0, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8)))
    passage = " ".join(word() for _ in range(70))
    line = "Common Line, found everywhere."
    texts = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage if i % 2 else passage[: rng.randrange(150, len(passage))])
        if i % 4 == 0:
            lines += [f"  {line.upper() if i % 8 else line}\t", ""]
        texts.append("\n".join(lines))
    texts += [texts[0], texts[1], texts[1], texts[3] + " x", texts[4].replace("a", "b", 1), "ab" * 400, "z" * 200, "z" * 201, "z" * 199, "", None, " \n\t\n ", "\n", "one two", "<|endoftext|> a", "日本語 \U0001f600 " * 30, " ".join(word() for _ in range(4000))]
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0" if i % 3 else f"src{i % 5}"), "r", "d", 1, 2, "k", 0.5) for i, t in enumerate(texts)]
    return rows + [(5, texts[5], "en", "src0", "r", "d", 1, 2, "k", 0.5), (6, "another text of the same id", None, None, "r", "d", 1, 2, "k", 0.5)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# 1


def test_quality(spark, none):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "birds"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["$$$", "%%%", "||", "!!", "CLICK", "buy"]) for _ in range(60))
    data = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)] + [(1000, None, 1), (1001, "", 0), (1002, good() * 3000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality.fit(df, df.filter("doc_id < 200").select("doc_id", "quality"))
    out = {r["doc_id"]: r for r in quality.score(df.withColumn("score", F.lit("x")), model).collect()}
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [(out[i]["predicted"], y) for i, _, y in data if 200 <= i < 300]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert out[1002]["predicted"] == 1
    assert quality.score(none, model).count() == 0
    for sample in (df.filter("quality = 1"), df.limit(0)):
        lone = quality.fit(df, sample.select("doc_id", "quality"))
        assert len({r["score"] for r in quality.score(df, lone).collect()}) == 1
    kept = quality.score(df, model, keep=("quality",))
    assert kept.columns == ["doc_id", "score", "predicted", "quality"]


# 2


def naive_fingerprint(text):
    own = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(keys, linked):
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i in range(len(keys)):
            for j in range(len(keys)):
                if label[j] < label[i] and linked(keys[i], keys[j]):
                    label[i], changed = label[j], True
    return label


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    fps = sorted({naive_fingerprint(r[1]) for r in rows})
    label = dict(zip(fps, naive_components(fps, lambda a, b: (a ^ b).bit_count() <= 3), strict=True))
    least: dict = {}
    for r in rows:
        k = label[naive_fingerprint(r[1])]
        least[k] = min(least.get(k, 1 << 60), r[0])
    wanted = Counter((r[0], f"{naive_fingerprint(r[1]):016x}", least[label[naive_fingerprint(r[1])]]) for r in rows)
    assert Counter(tuple(r) for r in got) == wanted
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies(spark, docs, none):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    data, group = [], {}
    for g in range(40):
        base = [word() for _ in range(300)]
        for k in range(4):
            own = list(base)
            for at in range(k, 300, 100):  # 3 of 300 words: similarity about 0.9
                own[at] = own[at] if k == 0 else word()
            group[len(data)] = g
            data.append((len(data), " ".join(own)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    together = [found[i] == found[j] for i in group for j in group if i < j and group[i] == group[j]]
    apart = [found[i] == found[j] for i in group for j in group if i < j and group[i] != group[j]]
    assert np.mean(together) > 0.97 and not any(apart)
    kept = simhash.representatives(docs)
    assert set(kept.columns) == set(docs.columns) and 60 < kept.count() <= docs.select("text").distinct().count()
    assert simhash.near_copies(none).count() == 0


def shingle_sets(texts):
    out = {}
    for i, t in texts:
        w = words(t.lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def test_near_copies_by_exact_similarity(spark):
    """Pairs at 0.78 to 0.82 against brute force, and texts that share only a line which each repeats."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    data = []
    for g in range(160):
        base = [word() for _ in range(300)]
        changed = 28 + g % 10
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-changed] + [word() for _ in range(changed)]))]
    data += [(1000 + k, "one and the same line " * 200 + " ".join(word() for _ in range(100))) for k in range(2)]
    sets = shingle_sets(data)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    similar = {a: len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, 320, 2)}
    assert 0.77 < min(similar.values()) < 0.79 and 0.81 < max(similar.values()) < 0.83
    joined = {a: found[a] == found[a + 1] for a in similar}
    assert not [a for a in similar if joined[a] and similar[a] < 0.8]
    assert np.mean([joined[a] for a in similar if similar[a] >= 0.8]) > 0.94
    assert found[1000] != found[1001]


def test_near_copies_of_a_dense_group(spark):
    """Links that fail within a forest's tree are made good: all components are those of brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    base = [word() for _ in range(300)]
    data = []
    for i in range(60):
        own = list(base)
        for at in range(0, 300, 300 // (1 + i % 12)):
            own[at] = word()
        data.append((i, " ".join(own)))
    sets = shingle_sets(data)
    label = naive_components(range(60), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [found[a] for a in range(60)] == label


def test_chosen_pairs_leave_nothing_out():
    """Every near pair is proposed, or in one tree of the likely ones, or has nodes with more on both sides."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = 40
        a, b = np.triu_indices(n, 1)
        some = rng.random(len(a)) < rng.choice([0.05, 0.3])
        a, b = a[some], b[some]
        d = rng.integers(0, 10, len(a))
        ids = rng.permutation(n)
        likely = int(rng.integers(-1, 8))
        i, j, more = simhash.chosen(ids, simhash.Kept(lambda: iter([(a[:50], b[:50], d[:50]), (a[50:], b[50:], d[50:])]), int(rng.choice([10, 1000]))), likely, 2)
        told = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
        near = {frozenset(p): x for p, x in zip(zip(a.tolist(), b.tolist(), strict=True), d.tolist(), strict=True)}
        assert told <= set(near)
        tree = simhash.forest(n, iter([tuple(np.array([sorted(p) for p in told if near[p] <= likely], np.int64).reshape(-1, 2).T)]))
        whole = simhash.forest(n, iter([(a[d <= likely], b[d <= likely])]))
        assert (tree == whole).all() and sum(near[p] <= likely for p in told) == n - len(set(whole.tolist()))
        for p in set(near) - told:
            x, y = p
            assert tree[x] == tree[y] or (more[x] and more[y])


def test_slice_sizes_refuse_no_similar_pair():
    """The bound by slices holds for sets of all sizes, those whose slices hold over 256 hashes too, and refuses pairs well below."""
    rng = np.random.default_rng(4)
    refused = []
    for k in range(1200):
        n = int(rng.choice([0, 1, 10, 300, 3_000, 100_000] if k % 20 == 0 else [1, 10, 300, 3_000]))
        h = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        lo, hi = int(len(h) * rng.uniform(0, 0.2)), int(len(h) * rng.uniform(0.8, 1))
        a, b = h[lo:], h[:hi]
        a, b = (rng.permutation(x)[: max(1, len(x))] for x in (a, b))
        if k % 2:  # spread what differs over all slices
            mix = rng.permutation(h)
            a, b = mix[lo:], mix[:hi]
        shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        x, y = (np.frombuffer(simhash.slice_sizes(v), np.uint8)[None] for v in (a, b))
        able = simhash.may_be_similar(x, y, np.array([len(a) + len(b)]), 0.8)[0]
        if not union or shared / union >= 0.8:
            assert able
        elif n == 300 and shared / union < 0.7:
            refused.append(not able)
    assert len(refused) > 20 and np.mean(refused) > 0.9


def test_quality_sample_of_repeated_ids(spark):
    """An id that repeats without bound brings one text to the sample."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["good", "fine", "prose"] if i % 2 else ["bad", "spam", "junk"]) + str(rng.randrange(99)) for _ in range(60))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    again = quality.fit(spark.createDataFrame(texts + [(3, "z" + texts[3][1] + str(k)) for k in range(500)], "doc_id long, text string"), labels)
    assert once == again


def test_bands_of_every_size():
    """Bands don't overlap, and 98 % of the pairs at 0.8 have a place where they are found, short texts' sets of 100 shingles too."""
    assert simhash.BANDS * simhash.BAND == simhash.WORDS * simhash.BITS and simhash.BITS % simhash.BAND == 0
    rng = np.random.default_rng(5)
    hits = []
    for _ in range(400):
        h = rng.integers(0, 2**63, 108, np.uint64)
        a, b = (np.frombuffer(simhash.long_fingerprint(x), "<u4") for x in (h[:97], h[11:]))  # 86 of 108: just below 0.8
        free = [((a ^ b) >> np.uint32(32 - by - simhash.BLOCK)) & np.uint32((1 << simhash.BLOCK) - 1) == 0 for by in range(0, 32, 32 // simhash.BLOCKS)]
        hits.append(((np.bitwise_count(a ^ b) <= simhash.ERRORS) & np.logical_or.reduce(free)).any())
    assert np.mean(hits) > 0.97


def test_representatives_by_row(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (8, e), (9, a), (None, f), (3, f), (7, d)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(9, a), (None, b), (None, c), (7, d), (7, e), (3, f)])


@pytest.mark.parametrize("leaf", [1, 16, 256])
def test_trie_finds_every_close_pair(leaf):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 12, np.uint64)
    near = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 2), np.uint64), axis=1) for c in centre])
    keys = np.unique(np.concatenate([near, rng.integers(0, 2**63, 2000, np.uint64)]))
    told: dict = {}
    got = [(i, j) for a, b in trie.close_pairs(keys, 1, 3, leaf=leaf, told=told) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    close = np.argwhere(np.triu(np.bitwise_count(keys[:, None] ^ keys[None]) <= 3, 1))
    same_top = (keys[close[:, 0]] >> np.uint64(63)) == (keys[close[:, 1]] >> np.uint64(63))
    assert sorted(got) == sorted(tuple(p) for p in close[same_top].tolist())
    assert told["opened"] > 1000 and told["dropped"] > 1000
    few = np.sort(rng.integers(0, 2**16, 800, np.uint64)) << np.uint64(48)  # 16 bits, with equal keys
    got = [(i, j) for a, b in trie.close_pairs(few, 4, 2, 16, leaf) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    wanted = [(i, j) for i in range(800) for j in range(i + 1, 800) if few[i] >> np.uint64(60) == few[j] >> np.uint64(60) and int(few[i] ^ few[j]).bit_count() <= 2]
    assert sorted(got) == wanted and not list(trie.close_pairs(few[:0], 4, 2))


def test_trie_is_walked_in_bounded_memory():
    """100,000 keys below one prefix."""
    keys = np.unique(np.random.default_rng(4).integers(0, 2**48, 100_000, np.uint64))
    told: dict = {}
    tracemalloc.start()
    pairs = sum(len(a) for a, _ in trie.close_pairs(keys, 16, 3, told=told))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and told["opened"] < 0.01 * len(keys) ** 2 and pairs < 100


def test_trie_is_walked_in_the_registered_query():
    """Subtrees of sf0.01's fingerprints are opened and dropped on the way, not only compared at their leaves."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    keys = np.unique(np.array([simhash.fingerprint((t or "").encode(), 3) for t in texts], np.uint64))
    told: dict = {}
    for k in range(4):
        list(trie.close_pairs(np.sort((keys << np.uint64(16 * k)) | (keys >> np.uint64(64 - 16 * k) if k else np.uint64(0))), 16, 3, leaf=1, told=told))
    assert told["opened"] > 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    assert {r["id"]: r["component"] for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 200: 100}


# 3


def naive_nearest(vectors, queries, k):
    out = []
    for q in queries:
        scores = sorted((-sum(float(a) * float(b) for a, b in zip(vectors[q], vectors[v], strict=True)), v) for v in vectors if v != q)
        out += [(q, i + 1, v) for i, (_, v) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest(spark, clustered, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((900, 16)).astype(np.float32)
    if clustered:
        m = (rng.standard_normal((9, 16)) * 5)[np.arange(900) % 9].astype(np.float32) + 0.1 * m
    m[50:60] = m[40]
    data = [(i, v.tolist(), 1) for i, v in enumerate(m)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0] * 3, 1), (2005, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    wanted = naive_nearest({i: v for i, v in enumerate(m)}, range(0, 900, 20), 20)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, window=40).collect())
    assert got == sorted(wanted)
    windows = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, window=100, complete=False).collect()}
    recall = len(windows & {(q, v) for q, _, v in wanted}) / len(wanted)
    assert recall > (0.9 if clustered else 0.4)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_windows_are_those_of_the_whole_order(spark):
    """The rows of a curve within so many places of each query, over the borders of ranges and batches."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((700, 8))
    keys = rng.integers(0, 500, (700, 2))
    data = [(i, m[i].tolist(), i % 7 == 0, keys[i].tolist()) for i in range(700)]
    keyed = spark.createDataFrame(data, "vec_id long, v array<double>, ask boolean, keys array<long>").repartition(3)
    found = {(r["query_id"], r["vec_id"]) for r in ann.windows(keyed, 8, 2, 30, 1000).collect()}
    wanted = set()
    for c in range(2):
        order = sorted(range(700), key=lambda i: (keys[i, c], i))
        for at, i in enumerate(order):
            if i % 7 == 0:
                wanted |= {(i, j) for j in order[max(0, at - 30) : at + 31] if j != i}
    assert found == wanted


def test_hilbert_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# 4


def test_chat(spark):
    data = [(1, 0, "system", "S", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 2, "bob", None, "x"), (1, 300, "ann", "late", "x"), (2, 0, None, "who", "x"), (3, 0, "system", "alone", "x"), (None, 0, "ann", "lost", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, participant string")
    got = {(r["conv_id"], r["participant"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (2, "unknown", 0), (None, "ann", 0)}
    r = got[1, "bob", 0]
    assert r["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    assert r["loss_mask"] == [0, 0, 1, 1] and sum(r["segment_chars"]) == len(r["text"])
    assert chat.rotate(df.limit(0)).count() == 0


# 5

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href=a>Menu</a></ul></nav><div class="cookie-notice">We use cookies<p>yes</div><div id=sidebar><p>Side %s</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First  &nbsp;para<b>graph</b> here.<br>Second line<p>Un<i>closed &lt;p&gt;<div class="ad">Buy</div>
<form><input name=q><button>Go</button></form><p>Last.</p><section class="comments"><p>Nice!</p></section></article></main><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    long = "word " * 40
    wanted = "Title & more\nFirst paragraph here.\nSecond line\nUnclosed <p>\nLast."
    assert html.main_text(PAGE % long) == wanted
    plain = f"<div><a href=x>Home</a></div><div><a href=y>About</a></div><p></p><p></p><p>{long}</p><p>short</p><p>{long}</p><p></p><p></p><p></p><div><a href=z>Next page</a></div>"
    assert html.main_text(plain) == f"{long.strip()}\nshort\n{long.strip()}"
    data = [(1, "u", PAGE % long, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<p>a <b>c", 9), (5, "u", "x < y <", 9), (1, "u", PAGE % long, 9), (6, "u", f"<article><p>{long * 3000}", 9)]
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string, n_chars int")).collect())
    texts = [(1, wanted), (1, wanted), (2, ""), (3, ""), (4, "a c"), (5, "x < y <"), (6, (long * 3000).strip())]
    assert got == Counter((i, t, len(t)) for i, t in texts)


def test_main_text_by_density():
    """Pages without article: menus, notices and copyright without any mark go by their windows alone."""
    body = [f"Sentence {k} of the body stands in a plain division and is long enough." for k in range(4)]
    menu = "".join(f"<div><a href=/{k}>Menu {k}</a></div>" for k in range(5))
    page = f"<div>Site name</div>{menu}<div>{''.join(f'<p>{x}</p>' for x in body)}</div>{menu}<div>(c) 2024 me</div>"
    assert html.main_text(page) == "\n".join(body)
    assert html.main_text(f"<div><h1>Short</h1><p>{body[0]}</p><p>Thus it is said.</p></div><div>&copy; me</div>") == f"Short\n{body[0]}\nThus it is said."
    assert html.main_text("<article><h1>T</h1><p>One.</p></article><footer>(c) a rather long footer, with words and words and words</footer>") == "T\nOne."
    assert html.main_text(f"<article><p>{body[0]}</p><div class=ad>{body[1]} {body[1]}</div><p>Two.</p></article>") == f"{body[0]}\nTwo."
    assert html.main_text("<p>Area is <math><mi>x</mi></math> squared, <object>or so</object>.") == "Area is x squared, or so."


@pytest.mark.parametrize("name", ["search", "social", "share", "related", "promo", "widget"])
def test_main_text_under_doubtful_names(name):
    """A paragraph of an article stays under such a class, a row of buttons goes; a compound is another word."""
    body = "This is what the article tells, and it stands under a class that often holds other things."
    page = f"<article><h1>Title</h1><div class='{name}'><p>{body}</p></div><div class='{name}'><p>Click it</p></div><p>End.</p></article>"
    assert html.main_text(page) == f"Title\n{body}\nEnd."
    assert html.main_text(f"<article><p>{body}</p><div class='{name}-work'><p>A short remark here.</p></div></article>") == f"{body}\nA short remark here."


@pytest.mark.parametrize("name", ["ad-hoc-group", "banner-year", "banner", "notice", "ad", "sidebar", "main-sidebar", "comments"])
def test_no_mark_empties_a_page(name):
    body = "This is what the page tells, and it stands under a class that might stand for something else."
    assert html.main_text(f"<body><div class='{name}'><p>{body}</p></div></body>") == body


def test_short_paragraphs_hidden_text_and_plain_menus():
    body = [f"Sentence {k} of the body stands in a plain division and is long enough." for k in range(3)]
    text = "".join(f"<p>{x}</p>" for x in body)
    for last in ("The end.", "Short."):
        assert html.main_text(f"<div>{text}<p>{last}</p></div><div><a href=/>Home</a></div>") == "\n".join([*body, last])
    for style in ("hidden", "style='display: none'", "aria-hidden=true"):
        assert html.main_text(f"<div>{text}<p {style}>Still part of it, if one looks.</p></div>") == "\n".join([*body, "Still part of it, if one looks."])
    menu, legal = "<ul><li>About us</li><li>Contact</li></ul>", "<ul><li>Terms of use apply here</li><li>Privacy policy for all users</li></ul>"
    assert html.main_text(f"{menu}<div>{text}</div>{legal}") == html.main_text(f"{legal}<div>{text}</div>{menu}") == "\n".join(body)
    # Within the text a list of short lines stays, and a heading before it.
    inner = f"{menu}<div><h2>Title</h2>{body[0]}</div><ul><li>One</li><li>Two</li></ul><div>{body[1]}</div>{legal}"
    assert html.main_text(inner) == "\n".join(["Title", body[0], "One", "Two", body[1]])
    # Without windows, every line of weight would stay.
    for page in (f"{menu}<div>{text}</div>{legal}", inner):
        assert html.main_text(page) != "\n".join(x.text for x in html.lines_of(page) if x.weight > 0)


def test_weights_of_lines_by_construction():
    """Pages made of blocks whose text, links, marks and elements are known."""
    rng = random.Random(8)
    for _ in range(200):
        page, wanted = "", []
        for _ in range(rng.randrange(8)):
            plain, link = "x" * rng.randrange(1, 90), "y" * rng.choice([0, 5, 40])
            mark, article = rng.choice(["", "", "ad", "share", "ad-hoc", "site-footer"]), rng.random() < 0.3
            tag = rng.choice(["p", "h2", "div"])
            block = f"<{tag}>{plain}<a href=q>{link}</a></{tag}>"
            block = f"<div class='x {mark}'>{block}</div>" if mark else f"<section>{block}</section>"
            page += f"<article>{block}</article>" if article else block
            against = {"ad": 2, "site-footer": 2, "share": 1}.get(mark, 0)
            weight = -len(plain + link) if against == 2 else len(plain) + 20 * article - 60 * (against == 1)
            wanted.append((plain + link, weight, article or tag == "h2"))
        assert [(x.text, x.weight, x.firm) for x in html.lines_of(page)] == wanted


def naive_main_text(page):
    """Line blocks by the words of the docstring: surge and dive places first, then what lies between, then the ends."""
    for words_count in (True, False):
        lines = html.lines_of(page, words_count)
        held = [max(x.weight, 0) for x in lines]
        block = [sum(held[k : k + 3]) for k in range(len(held))]
        surge = min(60, max(block, default=0) / 2)
        texts = {x.within for x in lines if x.weight >= 30}
        surges = [k for k, x in enumerate(lines) if x.weight > 0 and block[k] >= surge]
        dives = [k for k, x in enumerate(lines) if k not in surges and not (x.weight > 0 and x.within in texts) and (block[k] < min(20, surge) or (x.weight <= 0 and not block[k]))]
        inside = [max((s for s in surges if s <= k), default=-1) > max((d for d in dives if d <= k), default=-1) for k in range(len(lines))]
        sure = [x.firm or x.weight >= 30 or x.within in texts for x in lines]
        kept = []
        for k, x in enumerate(lines):
            own = [j for j in range(len(lines)) if all(inside[min(j, k) : max(j, k) + 1])] if inside[k] else []
            firm = [j for j in own if sure[j]]
            if own and x.weight >= 0 and (not firm or firm[0] <= k <= firm[-1]):
                kept.append(x.text)
        if kept:
            return "\n".join(kept)
    return ""


def test_main_text_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(0, 25)):
            text = "x" * rng.choice([1, 10, 30, 80, 200])
            parts.append(rng.choice([f"<p>{text}</p>", f"<li><a href=x>{text}</a></li>", f"<nav>{text}</nav>", f"<article><p>{text}</p></article>", f"<div class=share>{text}</div>", f"<p>{text}<a>{text}</a></p>"]))
        page = "".join(parts)
        assert html.main_text(page) == naive_main_text(page)
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        assert html.main_text(page or "") == naive_main_text(page or "")


def test_main_text_beside_teasers():
    """Teaser cards are the only articles, and blocks without text lie between short paragraphs."""
    body = [f"Sentence {k} of the body stands in a plain division and is long enough." for k in range(5)]
    cards = "".join(f"<article><h3><a href=/{k}>Teaser {k}</a></h3></article>" for k in range(3))
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in body)}</div><div><div><a href=x>More</a></div>{cards}</div></body>"
    assert html.main_text(page) == "\n".join(body)
    short = ["Thirty characters of plain text", "and thirty more come after them"]
    far = "<div><a href=x>Link</a></div>" * 4
    page = f"<div>{body[0]}</div>{far}<div><div><p>{short[0]}</p></div></div><div><div><p>{short[1]}</p></div></div>{far}"
    assert html.main_text(page) == "\n".join([body[0], *short])


# 6


@pytest.mark.parametrize(("group", "hot"), [(suffix.GROUP, suffix.HOT_ROWS), (3, suffix.HOT_ROWS), (suffix.GROUP, 4)])
def test_suffix(docs, rows, none, group, hot):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    times = Counter(x[i : i + 200] for _, x in texts for i in range(len(x) - 199))
    wanted = Counter()
    for doc_id, x in texts:
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if times[x[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        covered = np.cumsum(cover)[: len(x)] > 0
        wanted[doc_id, bytes(np.frombuffer(x, np.uint8)[~covered]), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())] += 1
    got = Counter((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in suffix.remove_repeated(docs, group=group, hot_rows=hot).collect())
    assert got == wanted
    assert suffix.remove_repeated(none).count() == 0


def test_anchors_do_not_depend_on_what_stands_around():
    """Equal windows have equal anchors in slices of any length."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 600).astype(np.uint8)
    found = []
    for n in (0, 300, 100_000, 3_000_000):
        data = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), text])
        own, first, count, off, h, whole = suffix.anchors(data, np.array([0, n]) if n else np.array([0]), np.array([n, 600]) if n else np.array([600]), 200)
        last = own == own[-1]
        found.append([x[last].tolist() for x in (first, count, off, h, whole)])
    assert all(f == found[0] for f in found)


def test_hot_anchors_are_dealt_by_their_stretches(spark):
    """A header of 100 bytes that 3000 different texts share doesn't come to one task."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    header = " ".join(word() for _ in range(10))
    data = [(i, " ".join(word() for _ in range(20)) + header + " ".join(word() for _ in range(20))) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    rows = suffix.stored(suffix.find_anchors(df.select("doc_id", F.lit(0).cast("long").alias("t"), F.col("text").cast("binary").alias("data")), 200))
    hot = suffix.hot_anchors(rows, 1000)
    assert len(hot) >= 1
    kinds = {r["kind"]: r["count"] for r in suffix.settle(rows, hot_rows=1000).filter(F.col("h").isin(hot)).groupBy("kind").count().collect()}
    assert kinds == {"H": rows.filter(F.col("h").isin(hot)).select("h", "whole").distinct().count()}
    assert suffix.remove_repeated(df, hot_rows=1000).filter("size(spans) > 0").count() == 0


def test_whole_groups():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 40, 1000))
    batches = [pa.record_batch([pa.array(values[a : a + 30]), pa.array(np.arange(a, min(a + 30, 1000)))], ["k", "i"]) for a in range(0, 1000, 30)]
    for rows in (1, 50, 10_000):
        parts = list(common.whole_groups(iter([*batches, batches[0].slice(0, 0)]), ["k"], rows))
        assert np.concatenate([t.column("i").to_numpy() for t in parts]).tolist() == list(range(1000))
        assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) == 1 if rows > 1000 else len(parts) > 10


def test_run_length_index_statistics():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 99, n, np.uint8) for n in (60, 40, 1, 90)]
    parts.append(parts[0][5:55])
    data, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    index = suffix.RunLengthIndex(data, starts, lengths)
    assert index.run_lengths.sum() == len(data) and (index.run_lengths > 0).all()
    strings = [bytes(p[i:]) for p in parts for i in range(len(p))]
    for size in (1, 7, 20):
        times = Counter(s[:size] for s in strings if len(s) >= size)
        assert index.repeated(size).tolist() == [len(s) >= size and times[s[:size]] > 1 for s in strings]


@pytest.mark.parametrize("kinds", [1, 2, 26, 256])
def test_suffix_order(kinds):
    rng = np.random.default_rng(kinds)
    text = rng.integers(0, kinds, 400).astype(np.uint8)
    parts = [text, text[100:300], text[150:250], text[150:250], text[:1]]
    data, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    stop = np.repeat(np.cumsum(lengths), lengths)
    assert suffix.suffix_order(data, stop).tolist() == sorted(range(len(data)), key=lambda p: (data[p : stop[p]].tobytes(), p))


@pytest.mark.parametrize("n", [100_000, 2_200_000])
def test_suffix_order_sorts_settled_places_once(monkeypatch, n):
    """A long repeat doesn't have all other places sorted at each width, be their numbers of up to 21 bits or longer."""
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, n).astype(np.uint8)
    lengths = np.array([n, 500, 300])
    data, stop = np.concatenate([text, text[100:600], text[200:500]]), np.repeat(np.cumsum(lengths), lengths)
    sorted_places = []
    for name in ("sort", "argsort", "lexsort"):
        monkeypatch.setattr(np, name, lambda x, *a, real=getattr(np, name), **k: sorted_places.append(len(x[0]) if isinstance(x, tuple) else len(x)) or real(x, *a, **k))
    order = suffix.suffix_order(data, stop)
    monkeypatch.undo()
    assert sum(sorted_places) < 2 * len(data)
    rank = np.argsort(order)
    assert (np.bincount(order, minlength=len(data)) == 1).all()
    for k in np.r_[rank[100:600], rank[n:], rng.integers(1, len(order), 2000)]:
        a, b = ((data[p : stop[p]].tobytes()[:1000], p) for p in order[k - 1 : k + 1]) if k else ((b"", 0), (b"", 1))
        assert a < b


def test_cut_characters(spark):
    passage = "\xe9" * 150
    df = spark.createDataFrame([(1, "a" + passage + "b"), (2, "\u0229" + passage[1:] + "c")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeated(df).collect()}
    whole = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix.remove_repeated(df, whole_characters=True).collect()}
    assert kept == {1: b"ab", 2: b"\xc8c"} and whole == {1: "ab", 2: "c"}


# 7


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(docs, rows, none):
    t = library()
    wanted = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        wanted[r[0], len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.digest_table(docs, PATH).collect()) == wanted
    assert all(r["decoded"] == (dict_text or "") for r, dict_text in [(r, next(x[1] for x in rows if x[0] == r["doc_id"])) for r in bpe.encode_table(docs.filter("doc_id <> 6"), PATH).collect()])
    assert bpe.digest_table(none, PATH).count() == 0


def test_bpe_agrees_at_random():
    own, t, rng = bpe.tokenizer(PATH), library(), random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "a", "the", "Word", "\xe9t\xe9", "\xdf", "1", "23", "'s", "'ll", ".", ",", "!!", "***", "\t", "\r\n", "\xa0", "　", "​", "\U0001f600", "日", "<|endoftext|>", "\x1c", "\x85", "x" * 30, "_"]
    for n in range(400):
        texts = ["".join(rng.choice(parts[: 17 if n % 2 else 99]) for _ in range(rng.randrange(60))) for _ in range(3)]
        wanted = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert own.encode_many(texts) == wanted
        assert own.encode_by_chunks(texts) == wanted


def test_chunks_are_shared_and_whole():
    rng = random.Random(4)
    passage = "".join(rng.choice("abc d\xe9") for _ in range(20_000)).encode()
    a, b = bpe.chunks(b"one " + passage), bpe.chunks(b"something else " + passage)
    assert b"".join(a) == b"one " + passage and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(c.decode() for c in a)
    assert bpe.chunks(b"") == [] and bpe.chunks(b"ab") == [b"ab"]


# 8


def test_packing(docs, rows, none):
    t = library()
    got = packing.pack(packing.pieces(docs, PATH, 64), 64).collect()
    wanted = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or min(64, len(ids))
        start = 0
        for k, stop in enumerate(range(first, len(ids) + 1, 64)):
            wanted[r[0], k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    check_bins([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 64) + 1
    assert packing.pack(packing.pieces(none, PATH)).count() == 0


def check_bins(placed, capacity):
    bins = defaultdict(list)
    for b, at, n in placed:
        bins[b].append((at, n))
    for own in bins.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= capacity


def fewest(items, capacity):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, [*rest, room - items[k]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_bin():
    rng = random.Random(6)
    for _ in range(120):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        counts = dict(Counter(items))
        fixed, kept = packing.reduce_by_dominance(counts, 20)
        held = Counter(kept)
        for content, n in fixed:
            assert sum(content) <= 20
            for x in content:
                held[x] += n
        assert +held == Counter(items)
        left = [n for n, c in kept.items() for _ in range(c)]
        assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) <= fewest(items, 20) + (1 if any(sum(c) + min(left, default=99) <= 20 for c, _ in fixed) else 0)
        rows = packing.plan(counts, 20)
        check_bins([(b + i // per, at + i % per * n, n) for n, _, ranks, per, b, at in rows for i in range(ranks)], 20)
        assert len({b + i // per for n, _, ranks, per, b, at in rows for i in range(ranks)}) <= fewest(items, 20) + 1


# 9


def test_rules(docs, rows, none):
    def naive(text):
        text = text or ""
        w = words(text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    got = rules.apply(rules.counts(docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r[0], *naive(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in got)
    assert rules.apply(rules.counts(none)).count() == 0
    assert rules.repeated_words("a b c d e f g h x a b c d e f g h".split()) == 16 and rules.repeated_words(["a"] * 9) == 9


def naive_limits(found, weight):
    """(lang, source) to limits by sorting each group's ratios, drawn to its language's and those to all documents'."""
    share = lambda r, n, of: (r[n] + 1) / (r[of] + 1)
    parts = {"symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "chars_per_word": ("word_chars", "n_words")}
    ratio = {k: (lambda r, k=k, v=v: None if k == "dup_line_share" and r["n_lines"] < 5 else share(r, *v)) for k, v in parts.items()}
    members = defaultdict(list)
    for r in found:
        if not r["base_failed"]:
            for key in ((r["lang"], r["source"]), (r["lang"], ...), (..., ...)):
                members[key].append(r)

    def limit(key, name):
        inner, outer = rules.RATIOS[name]
        values = sorted(v for r in members[key] if (v := ratio[name.removesuffix("_least")](r)) is not None)
        at = lambda p: values[max(0, int(np.ceil(p * len(values))) - 1)]
        own = at(outer) + 4 * (at(outer) - at(inner)) if values else None
        if key[0] is ...:
            return own
        wider = limit((..., ...) if key[1] is ... else (key[0], ...), name)
        return wider if own is None else own if wider is None else (len(values) * own + weight * wider) / (len(values) + weight)

    return {key: {name: limit(key, name) for name in rules.RATIOS} for key in list(members) if key[1] is not ...}, ratio


@pytest.mark.parametrize("weight", [0, 60, 10_000])
def test_rules_verdicts(spark, weight):
    """kept against limits by sorting, with junk in one group, a group of null names, small groups and a hot one."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda mark="": "\n".join(" ".join(word() + mark for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 8)))
    data = []
    for i in range(400):
        lang, source = ("en", "hot") if i % 3 else (("de", None, "en")[i % 4 % 3], f"s{i % 5}" if i % 7 else None)
        own = text("###" if i % 31 == 0 else "")
        data.append((i, own + ("\n" + own.split("\n")[0] if i % 9 == 0 else ""), lang, source, 0.5))
    data += [(1000, None, "xx", "lone", 0.5), (1001, "", None, None, 0.5)]
    found = rules.apply(rules.counts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, limits double").repartition(3)), weight).collect()
    of, ratio = naive_limits(found, weight)
    assert len(found) == len(data)
    wanted = {}
    for r in found:
        own = of.get((r["lang"], r["source"]))
        wanted[r["doc_id"]] = not r["base_failed"] and all(ratio[n](r) is None or ratio[n](r) <= own[n] for n in ratio) and ratio["chars_per_word"](r) >= own["chars_per_word_least"]
    assert {r["doc_id"]: r["kept"] for r in found} == wanted
    if weight == 60:  # limits that adapt: junk goes, nearly all else stays
        junk = {i for i in range(0, 400, 31)}
        passed = {r["doc_id"] for r in found if not r["base_failed"]}
        assert not any(wanted[i] for i in junk) and np.mean([wanted[i] for i in passed - junk]) > 0.97
        assert len({tuple(v.values()) for v in of.values()}) > 1


# 10


def naive_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} - {""})
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("least", "batches"), [(10, 4), (2, 1), (3, 9)])
def test_line_dedup(docs, rows, none, least, batches):
    got = Counter(tuple(r) for r in linededup.dedup_lines(docs, least, batches).collect())
    assert got == naive_lines(rows, least)
    assert linededup.dedup_lines(none, least, batches).count() == 0


def test_line_runs_are_levelled(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path), fanout=2)
    batch = lambda *h: spark.createDataFrame([(x, x) for x in h], "h1 long, h2 long")
    for own in ((1, 2), (2, 3), (3, 4), (4, 5), (9,)):
        runs.add(batch(*own))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r["h1"]: r["n_docs"] for r in runs.counts().collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 9: 1}
    assert [r["h1"] for r in runs.unseen(batch(5, 6)).collect()] == [6]


@pytest.mark.parametrize("fanout", [2, 3])
def test_line_runs_count_as_one_table(spark, fanout):
    rng = random.Random(0)
    runs = linededup.LineRuns(spark, f"{spark.sparkContext.getCheckpointDir()}/runs-{random.random()}", fanout)
    wanted = Counter()
    for n in (3, 0, 3, 20, 20, 1, 20):
        own = [rng.randrange(30) for _ in range(n)]
        wanted.update(own)
        runs.add(spark.createDataFrame([(x, x) for x in own], "h1 long, h2 long"))
        assert Counter({(r["h1"], r["n_docs"]): 1 for r in runs.counts().collect()}) == Counter({(h, n): 1 for h, n in wanted.items()})
        often = runs.unseen(spark.createDataFrame([(x, x) for x in range(30)], "h1 long, h2 long"), 3)
        assert {r["h1"] for r in often.collect()} == {h for h in range(30) if wanted[h] < 3}


def test_line_dedup_of_very_many_lines(spark):
    """12 documents of 20,000 common lines, one of 60,000 equal ones, and rows with null ids; in seconds."""
    common = [f"line {k}" for k in range(20_000)]
    rows = [(i if i else None, "\n".join([*common, f"own {i}"])) for i in range(12)] + [(20, "line 1\n" * 60_000), (21, "own 1\n" * 60_000), (None, "own 2"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.monotonic()
    got = Counter(tuple(r) for r in linededup.dedup_lines(df).collect())
    assert time.monotonic() - began < 60
    assert got == naive_lines(rows, 10)


def test_line_dedup_plan(spark, docs):
    """Texts are shuffled once, to meet their marks; runs meet without a shuffle."""
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= 3 and not re.search(r"Python|Arrow", plan)
    runs = linededup.LineRuns(spark, f"{spark.sparkContext.getCheckpointDir()}/plan-{random.random()}")
    for own in ((1, 2), (2, 3)):
        runs.add(spark.createDataFrame([(x, x) for x in own], "h1 long, h2 long"))
    batch = spark.createDataFrame([(2, 2), (7, 7)], "h1 long, h2 long").groupBy("h1", "h2").count().hint("merge")
    plan = runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
