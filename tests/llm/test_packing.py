import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import packing as P


def optimum(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {r: k for k, r in enumerate(bins) if r >= lengths[i]}.values():
            bins[b] -= lengths[i]
            go(i + 1, bins)
            bins[b] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=7))
def test_bound_and_packing(lengths):
    sizes, counts = np.unique(lengths, return_counts=True)
    packs = P.best_fit_decreasing(np.array(lengths), 20)
    least = optimum(sorted(lengths, reverse=True), 20)
    assert P.lower_bound(sizes, counts, 20) <= least <= packs.max() + 1
    assert np.bincount(packs, weights=lengths).max() <= 20


def test_small_partitions_need_no_more_packs_than_one(spark):
    """The exchange wins back what partitions lose: as few packs as one partition for all, to one in a hundred."""
    rng = random.Random(5)
    rows = [(r, c, i, min(c, max(1, int(rng.lognormvariate(4.2, 0.9))))) for r, c in (("a", 512), ("b", 130)) for i in range(3000)]
    items = spark.createDataFrame(rows, "run string, capacity int, item long, length int")
    n = {size: {r["run"]: r["n"] for r in P.pack(items, size).groupBy("run").agg(F.count_distinct("pack_id").alias("n")).collect()} for size in (10_000, 150)}
    alone = P._packed(P._spread(items.where("length < capacity").withColumn("piece", F.lit(0)), items.groupBy("run").agg(F.count("*").alias("n")), 0, 150))
    lost = {r["run"]: r["n"] for r in alone.groupBy("run").agg(F.count_distinct("part", "pack").alias("n")).collect()}
    for run, capacity in (("a", 512), ("b", 130)):
        lengths = [x[3] for x in rows if x[0] == run]
        bound = P.lower_bound(*np.unique(lengths, return_counts=True), capacity)
        assert bound <= n[10_000][run] and n[150][run] <= 1.01 * n[10_000][run]
        assert n[150][run] - sum(x == capacity for x in lengths) <= lost[run]


def test_pack(spark):
    rng = random.Random(1)
    rows = [("a", 50, i, rng.choice([3, 7, 20, 26, 49, 50, 120])) for i in range(600)] + [("b", 10, 9000 + i, 6) for i in range(40)]
    rows += [("a", 50, 7001, 0), ("a", 50, 7002, None), (None, 50, 7003, 5), ("b", None, 7004, 5), ("b", 10, None, 5)]
    items = spark.createDataFrame(rows, "run string, capacity int, item long, length int").withColumns({c: F.lit(1) for c in ("part", "pack", "piece", "room", "whole")})
    for size in (50_000, 60):
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in P.pack(items, partition_items=size).collect():
            assert r["at"] == r["at"] and r["length"] > 0
            fill[(r["run"], r["pack_id"])] += r["length"]
            pieces[(r["run"], r["item"])].append((r["start"], r["length"]))
        want = {(r[0], r[2]): r[3] for r in rows if r[0] and r[1] and r[2] is not None and r[3]}
        assert set(pieces) == set(want)
        for k, ps in pieces.items():
            ps.sort()
            assert sum(n for _, n in ps) == want[k] and [s for s, _ in ps] == list(np.cumsum([0] + [n for _, n in ps])[:-1])
            assert len(ps) == 1 or want[k] > (50 if k[0] == "a" else 10)
        assert all(v <= (50 if k[0] == "a" else 10) for k, v in fill.items())
        assert sum(k[0] == "b" for k in fill) == 40  # nothing else fits beside a 6
    assert P.pack(items.limit(0)).count() == 0
