import random

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import neardup as N
from loomwright.llm.components import components


def test_masks_cover_the_radius():
    from itertools import combinations

    for positions, radius in ((9, 2), (8, 3), (12, 3)):
        masks = N.covering_masks(positions, radius)
        for bad in combinations(range(positions), radius):
            assert any(m and not set(m) & set(bad) for m in masks)
    assert N.recall(0.6) > 0.996 and N.recall(0.7) > 0.9999


def sets(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz漢字") for _ in range(rng.choice([45, 120, 600]))) for _ in range(60)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 3)):
            s = list(t)
            for _ in range(rng.randint(0, max(1, len(s) // 40))):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            texts.append("".join(s))
    texts += [texts[0]] * 30 + ["short", "", None]
    rows = [(f"r{i}", [("system", "ignored"), ("user", None if t is None else t[: len(t) // 2]), (None, None if t is None else t[len(t) // 2 :] + "!")]) for i, t in enumerate(texts)]
    rows += [rows[0], ("null", None), (None, rows[1][1]), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>").withColumn("h", F.lit(1)).withColumn("a", F.lit(2))
    links, members = N.near_duplicates(df, "id", N.conversation_text("messages"))
    of = {}
    for r in members.collect():
        of.setdefault(bytes(r["h"]), set()).add(r["key"])
    got = set()
    for r in links.collect():
        got |= {tuple(sorted((x, y))) for x in of[bytes(r["a"])] for y in of[bytes(r["b"])]}
    long = [(f"r{i}", t) for i, t in enumerate(texts) if t and len(t) >= 40]
    want = set()
    for i, (x, s) in enumerate(long):
        for y, t in long[i + 1 :]:
            a, b = sets(s), sets(t)
            if s != t and len(a & b) / len(a | b) >= 0.6:
                want.add(tuple(sorted((x, y))))
    assert got <= want and len(got) >= 0.99 * len(want)
    assert len(links.collect()) < len(want)  # copies are one row
    e, m = N.near_duplicates(df.limit(0), "id", N.conversation_text("messages"))
    assert e.count() == 0 and m.count() == 0


def test_similarity_is_exact(spark):
    a, b = "abcdefghij" * 3, "abcdefghiz" * 3
    got = spark.range(1).select(N.exact_similarity(F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert np.isclose(got, len(sets(a) & sets(b)) / len(sets(a) | sets(b)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
