import random

from pyspark.sql import functions as F

from loomwright.llm.leaks import item_sketches, leaks, read_items, recall
from loomwright.llm.words import words_of


def brute(docs, items):
    found = set()
    for d, t in docs:
        w = words_of(t)
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, s in items:
            v = words_of(s)
            met = [False] * len(v)
            for i in range(len(v) - 7):
                if tuple(v[i : i + 8]) in own:
                    met[i : i + 8] = [True] * 8
            if v and d is not None and k is not None and sum(met) * 2 >= len(v):
                found.add((d, k))
    return found


def make(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))


def test_words():
    assert words_of("Ｈｅ­llo, WORLD-42 漢字カナ") == ["hello", "world", "42", "漢", "字", "カ", "ナ"]
    assert words_of(None) == []


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, make(rng, rng.choice([5, 8, 20, 60, 700]))) for i in range(30)] + [(90, None), (91, ""), (92, None)]
    items += [(93, items[3][1]), (None, items[4][1])]
    docs = []
    for d in range(80):
        _, s = rng.choice(items[:30])
        w = s.split()
        a = rng.randint(0, len(w) // 2)
        docs.append((d, make(rng, 40) + " " + " ".join(w[a : a + rng.randint(1, len(w))]).upper() + ". " + make(rng, 30)))
    docs += [(200, None), (201, ""), (202, items[2][1]), (202, items[2][1])]
    di = spark.createDataFrame(items, "item_id long, text string")
    dd = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item int")
    want = brute(docs, items)
    for sketch in (1024, 64):  # whole and sampled sketches of the long items
        got = {(r["doc"], r["item"]) for r in leaks(dd, di, sketch=sketch).collect()}
        assert got == want
    assert leaks(dd, di.limit(0)).count() == 0 and leaks(dd.limit(0), di).count() == 0


def test_sketches_are_smaller_than_long_items(spark):
    rng = random.Random(1)
    items = [(k, f"c{k}", " ".join(f"w{rng.random()}" for _ in range(n))) for k, n in enumerate((3000, 600, 100, 30, 8, 5))]
    d = spark.createDataFrame(items, "item long, cls string, words string").select("item", F.encode("cls", "utf-8").alias("cls"), "words")
    rows = {bytes(r["cls"]): r for r in item_sketches(d).groupBy("cls").agg(F.max("scale").alias("scale"), F.count("*").alias("n")).collect()}
    assert [rows[f"c{k}".encode()]["scale"] for k in range(5)] == [48, 12, 1.5, 1, 1] and b"c5" not in rows
    assert all(30 <= rows[f"c{k}".encode()]["n"] <= 100 for k in range(3)) and rows[b"c3"]["n"] == 23


def test_recall_of_sampled_sketches(spark):
    """Half of each item in runs of eight words that stand alone: the worst case for a sample."""
    rng = random.Random(8)
    items, docs = [], []
    for k in range(300):
        w = [f"i{k}w{j}" for j in range(rng.choice([90, 200, 500, 2000]))]
        n = -(-len(w) // 2)
        picks = [w[a : a + 8] + [f"x{rng.random()}"] for a in range(0, len(w) - 8, 9)]
        rng.shuffle(picks)
        docs.append((k, " ".join(" ".join(p) for p in picks[: -(-n // 8)])))
        items.append((k, " ".join(w)))
    want = brute_same(docs, items)
    got = {(r["doc"], r["item"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) == 300 and got <= want and len(got) >= 0.9 * len(want)
    assert min(recall(m) for m in range(1, 5000)) > 0.9 and recall(64) == 1


def brute_same(docs, items):
    return set().union(*(brute([d], [i]) for d, i in zip(docs, items)))


def test_a_shared_line_makes_no_candidates(spark):
    line = "read the following passage and choose the best of the answers given below it"  # 14 words, 7 shingles
    items = [(k, line + " " + " ".join(f"i{k}w{j}" for j in range(40))) for k in range(50)] + [(99, line + " now please")]
    n = [len(words_of(t)) - 7 for _, t in items]
    classes = read_items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert item_sketches(classes).count() == sum(x - 7 for x in n[:-1]) + n[-1]  # only the item it covers keeps it
    docs = [(d, f"before {line} after {d}") for d in range(20)] + [(77, items[3][1])]
    got = {(r["doc"], r["item"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, 99) for d in [*range(20), 77]} | {(77, 3)}
