import random

from pyspark.sql import functions as F

from loomwright.llm import mixing as M


def test_systematic_copies(spark):
    rng = random.Random(2)
    rows = [("s" if i % 3 else "t", i, rng.randint(1, 900), rng.choice([0.2, 1.0, 2.7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, n long, e double")
    for slices in (1, 7):
        got = M.systematic(df, ["g"], "k", "n", "e", F.lit(0.37), slices).collect()
        assert len(got) == len(rows)
        for r in got:
            assert int(r["e"]) <= r["copies"] <= int(r["e"]) + (r["e"] % 1 > 0)
        for g in "st":
            assert abs(sum(r["copies"] for r in got if r["g"] == g) - sum(x[3] for x in rows if x[0] == g)) < 1.001


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" Big", "big ", "BIG"]), rng.randint(1, 50)) for i in range(4000)] + [(10_000 + i, "small", 10) for i in range(5)]
    rows += [(20_000, None, 40), (None, "big", 10), (20_001, "big", 0)]
    docs = spark.createDataFrame(rows, "key long, source string, n_tokens long").withColumn("source", F.lower(F.trim("source")))
    docs = docs.withColumns({c: F.lit(1) for c in ("tokens", "each", "mix_name", "copies")})  # names that the operator uses
    targets = spark.createDataFrame([("m", "Big", 0.5, 1, 0.2), ("m", "small", 0.4, 3, 0.2), ("m", "gone", 0.1, 2, 0.2), ("m", None, None, None, 0.2)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    chosen, shares = M.mix(docs, targets, bucket_rows=300)
    total = sum(r[2] for r in rows)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["actual_tokens"] - 0.1 * total) < 0.01 * total
    assert got["small"]["actual_tokens"] == 150 and got["small"]["too_small"] and got["small"]["most_copies"] == 3
    assert got["gone"]["actual_tokens"] == 0 and got["gone"]["too_small"]
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-5
    assert all(r["copies"] <= 3 and r["key"] is not None for r in chosen.collect())
    empty, none = M.mix(docs.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


def test_tokens_of_long_text():
    enc = M.encoder()
    text = "word and more " * 12_000
    assert abs(M.count_tokens(text, enc) - len(enc.encode_ordinary(text))) < 10
    assert M.count_tokens(None, enc) == 0
