"""Segmented scans against one sequential pass, over groups within and across parts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import folds
from dossier.operators.scans import Batches, Breaker, Bucket, Quota, scan


def batches_of(tokens, most):
    out, batch, used = [], -1, None
    for n in (max(t or 0, 0) for t in tokens):
        if used is None or used + n > most:
            batch, used = batch + 1, n
        else:
            used += n
        out.append(batch)
    return out


def waits_of(requests, capacity, rate, full):
    level, clock, out = (capacity if full else 0.0), 0.0, []
    for at, n in requests:
        now = max(clock, at)
        level = min(capacity, level + (now - clock) * rate)
        wait = max(0.0, (n - level) / rate)
        level, clock = level + wait * rate - n, now + wait
        out.append(clock - at)
    return out


def states_of(outcomes, threshold, reset_s):
    streak, opened, out = 0, None, []
    for at, outcome in outcomes:
        state = "closed" if opened is None else "half_open" if at - opened >= reset_s else "open"
        if state == "open":
            out.append((state, "fallback"))
            continue
        if outcome == "ok":
            streak, opened = 0, None
        elif outcome in ("hard", "hard_midstream"):
            streak += 1
            opened = at if streak >= threshold else opened
        out.append((state, "model" if outcome == "ok" else "fallback" if outcome == "hard" else "error"))
    return out


def made(seed, n, gap=2.0):
    rng = random.Random(seed)
    at = np.cumsum([rng.choice([0.0, 1.0, gap]) for _ in range(n)])
    return {"at": at, "tokens": np.array([rng.choice([0, 0, 1, 2, 3, 7, 12]) for _ in range(n)], float), "outcome": np.array([rng.choice(["ok", "soft", "hard", "hard", "hard_midstream", None]) for _ in range(n)], object)}


FOLDS = [Quota("tokens", 50), Batches("tokens", 9), Batches("tokens", 0), Bucket("at", "tokens", 12.0, 2.0), Bucket("at", "tokens", 16.0, 0.5, start_full=False), Breaker("at", "outcome", 3, 4.0), Breaker("at", "outcome", 1, 7.5), Breaker("at", "outcome", 2, 1000.0)]


@pytest.mark.parametrize("fold", FOLDS, ids=lambda f: type(f).__name__)
def test_summaries_map_any_state_to_the_one_after(fold):
    """Cut anywhere, the summary of the second part gives the state that running it gives."""
    for seed in range(60):
        rng = random.Random(seed)
        rows = made(seed, rng.randrange(1, 60))
        n = len(rows["at"])
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        state = fold.initial()
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            part = {c: v[lo:hi] for c, v in rows.items()}
            if lo < hi:
                want = fold.run(state, part)[1]
                assert fold.after(fold.summary(part), state) == want
                state = want
        whole = fold.run(fold.initial(), rows)
        assert whole[1] == state


def test_runs_equal_the_sequential_rules():
    for seed in range(40):
        rows = made(seed, 80)
        pairs = list(zip(rows["at"].tolist(), rows["tokens"].tolist(), strict=True))
        assert Batches("tokens", 9).run((-1, None), rows)[0][0].tolist() == batches_of(rows["tokens"], 9)
        for full in (True, False):
            fold = Bucket("at", "tokens", 12.0, 2.0, full)
            assert fold.run(fold.initial(), rows)[0][0].tolist() == pytest.approx(waits_of(pairs, 12.0, 2.0, full))
        states = list(zip(*Breaker("at", "outcome", 3, 4.0).run((0, None), rows)[0], strict=True))
        assert states == states_of(list(zip(rows["at"].tolist(), rows["outcome"], strict=True)), 3, 4.0)


def groups(spark, n):
    """One group holds most rows; others, a null one among them, are short."""
    rng = random.Random(4)
    rows, at = [], {}
    for i in range(n):
        g = "hot" if i % 5 else rng.choice(["a", "b", None, "c"])
        at[g] = at.get(g, 0.0) + rng.choice([0.0, 1.0, 3.0])
        rows.append((g, i, at[g], rng.choice([None, 0, 1, 2, 5]), rng.choice(["ok", "soft", "hard", "hard", None])))
    return rows, spark.createDataFrame(rows, "g string, i long, at double, tokens long, outcome string").repartition(5)


def test_scans_over_parts_equal_one_pass(spark):
    rows, table = groups(spark, 3000)
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    want = {}
    for rs in own.values():
        tokens, times = [r[3] or 0 for r in rs], [r[2] for r in rs]
        for r, *rest in zip(rs, np.cumsum(tokens).tolist(), batches_of(tokens, 9), waits_of(list(zip(times, tokens, strict=True)), 8.0, 0.5, True), states_of([(r[2], r[4]) for r in rs], 3, 10.0), strict=True):
            want[r[1]] = rest
    quota = {r["i"]: r for r in folds.running_quota(table, "tokens", ["i"], 100, ["g"]).collect()}
    batch = {r["i"]: r["batch"] for r in folds.numbered_batches(table, ["g"], ["i"], "tokens", 9).collect()}
    wait = {r["i"]: r["wait"] for r in folds.waits(table, ["g"], ["i"], "at", "tokens", 8.0, 0.5).collect()}
    state = {r["i"]: (r["state"], r["served"]) for r in folds.replay(table, ["g"], ["i"], "at", "outcome", 3, 10.0).collect()}
    assert set(quota) == set(batch) == set(wait) == set(state) == set(want)
    for i, (used, b, w, s) in want.items():
        assert (quota[i]["used"], quota[i]["exceeded"], batch[i], state[i]) == (used, used >= 80, b, s) and wait[i] == pytest.approx(w)
    assert scan(table.limit(0), ["g"], ["i"], Quota("tokens", 9)).count() == 0


def test_a_request_above_the_capacity_fails(spark):
    with pytest.raises(Exception, match="exceeds the bucket"):
        folds.waits(spark.createDataFrame([("a", 1, 0.0, 9.0)], "g string, i int, at double, tokens double"), ["g"], ["i"], "at", "tokens", 5.0, 1.0).collect()


def test_a_request_above_the_capacity_waits_for_its_tokens(spark):
    """In one part and over many, as the sequential pass has it."""
    requests = [(float(5 * i), float(n)) for i, n in enumerate([3, 40, 1, 0, 13, 2, 26, 5] * 4)]
    table = spark.createDataFrame([("a", i, at, n) for i, (at, n) in enumerate(requests)], "g string, i int, at double, tokens double")
    found = folds.waits(table, ["g"], ["i"], "at", "tokens", 12.0, 2.0, start_full=False, debt=True)
    assert [r["wait"] for r in found.orderBy("i").collect()] == pytest.approx(waits_of(requests, 12.0, 2.0, False))


def test_one_group_of_a_million_rows(spark):
    """Every task takes a share of the only group."""
    table = spark.range(1_000_000).select(F.lit("u").alias("g"), "id", (F.col("id") * 2).cast("double").alias("at"), (F.col("id") % 7).alias("tokens"))
    began = time.monotonic()
    found = folds.numbered_batches(table, ["g"], ["id"], "tokens", 6000).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("batch").alias("last")).collect()
    assert len(found) >= 4 and max(r["n"] for r in found) < 500_000 and max(r["last"] for r in found) == 3_000_000 // 6000
    waits = folds.waits(table, ["g"], ["id"], "at", "tokens", 10.0, 1.0).agg(F.max("wait"), F.count("*")).first()
    assert waits[1] == 1_000_000 and waits[0] > 900_000
    assert time.monotonic() - began < 60


def test_roster_by_prefix_equals_scanning_it(spark):
    from dossier.operators import rails

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aéB ") for _ in range(rng.randrange(1, 7)))
    roster = [word() for _ in range(300)] + [None, "Apple Inc.", "V", "Zebra"]
    names = [word() for _ in range(300)] + [None, "", "apple", "V", "Ze", "zeb", "zzz", " APPLE inc. ", "Zebra!"]
    legal = [r.strip(" ").lower() for r in roster if r is not None]
    want = {n: any(x == n.strip(" ").lower() if len(n.strip(" ")) < 3 else x.startswith(n.strip(" ").lower()) for x in legal) for n in names if n is not None}
    found = rails.in_roster_of(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(r,) for r in roster], "name string")).collect()
    assert {r["name"]: r["known"] for r in found} == want and len(found) == len(want)
    asked = spark.createDataFrame([(1, ["zeb", None, "zzz", "apple"]), (2, []), (3, None)], "k int, names array<string>")
    split = rails.split_by(asked, "k", "names", spark.createDataFrame([("zeb", True), ("zzz", False), ("apple", True)], "name string, known boolean"))
    assert sorted(map(tuple, split.collect())) == [(1, ["zeb", "apple"], ["zzz"]), (2, [], []), (3, [], [])]


def test_roster_of_many_names_without_a_cross_join(spark):
    from dossier.operators import rails

    names = spark.range(200_000).select(F.concat(F.lit("company "), F.hex("id")).alias("name"))
    roster = spark.range(0, 100_000, 2).select(F.concat(F.lit("Company "), F.hex("id"), F.lit(" inc")).alias("name"))
    found = rails.in_roster_of(names, roster)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert found.filter("known").count() > 50_000
