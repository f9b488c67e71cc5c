import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import chat as C
from loomwright.operators import convert as CV
from loomwright.operators import decontam as D
from loomwright.operators import filters as Q
from loomwright.operators import mix as M
from loomwright.operators import prefs as P
from loomwright.operators import repetition as R
from loomwright.operators import rl
from loomwright.operators import stats as S
from loomwright.operators import tables as TB
from loomwright.plans.cache import cached
from loomwright.schema import align, as_list, concat_aligned, keep_columns, require
from loomwright.sources import files as FI

MSG = "id long, messages array<struct<role:string,content:string>>"


def test_filters_on_dirty_rows(spark):
    rows = [(1, [("user", "hi"), ("assistant", "I use ChatGPT daily.")]), (2, [("user", None), ("assistant", "x")]), (3, []), (4, None), (5, [(None, "a")]), (6, [("system", "s"), ("user", "q"), ("assistant", "中文中文")]), (7, [("user", "ChatGPT"), ("assistant", "GPTs")]), (8, [("user", "q"), ("user", "q")])]
    df = spark.createDataFrame(rows, MSG).withColumn("role", F.lit("clash"))
    got = {r["id"]: r for r in df.select("id", Q.has_keyword("messages").alias("k"), Q.has_empty_message("messages").alias("e"), Q.script_heavy("messages").alias("s"), Q.bad_alternation("messages").alias("a"), Q.mentions_identity("messages").alias("m"), Q.messages_to_text("messages").alias("t")).collect()}
    assert [i for i, r in got.items() if r["k"]] == [1]
    assert [i for i, r in got.items() if r["e"]] == [2, 4]
    assert [i for i, r in got.items() if r["s"]] == [6]
    assert [i for i, r in got.items() if r["a"]] == [4, 5, 8]
    assert got[1]["t"] == "User: hi\n\nAssistant: I use ChatGPT daily." and got[3]["t"] == ""
    assert df.limit(0).where(Q.has_keyword("messages")).count() == 0


def test_think_tags(spark):
    rows = [("<think>a</think>b",), ("<think>a</think><answer>b</answer>",), ("plain",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(Q.is_think("t").alias("a"), Q.is_think_answer("t").alias("b"), Q.add_answer_tags("t").alias("c"), Q.remove_answer_tags("t").alias("d")).collect()
    assert [r["a"] for r in got] == [True, True, False, False] and [r["b"] for r in got] == [False, True, False, False]
    assert got[0]["c"] == "<think>a</think>\n<answer>\nb\n</answer>" or got[0]["c"].endswith("b\n</answer>")
    assert got[1]["d"] == "<think>a</think>\nb"


def test_repetition():
    assert R.first_repetition(None) is None and R.first_repetition("One. Two. Three.") is None
    para = "A paragraph without marks\n\n"
    assert R.first_repetition(para * 10)[0] == "paragraph_repeated_10x"
    assert R.first_repetition("Other words\n\n".join([para] * 30))[0].startswith("paragraph_repeated")
    assert R.first_repetition("Green trees bloom. " * 4) is not None
    assert R.first_repetition("import math. " * 60) is None
    assert R.repeated(["aaaaa", "aaaaa", "b", "aaaaa"], 5) == {"aaaaa": (3, 2)}
    assert R.first_repetition("The end " * 3) is None


def test_islands(spark):
    df = spark.createDataFrame([(1, ["xxxxx", "xxxxx", "yyyyy", "xxxxx", "ab", "ab"]), (2, []), (3, None)], "k long, items array<string>")
    assert [tuple(r) for r in R.islands(df, "k", F.col("items")).collect()] == [(1, "xxxxx", 3, 2, 0)]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdef") * rng.randint(1, 2)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    items = [(i, ", ".join(word() for _ in range(rng.choice([1, 2, 3, 12])))) for i in range(20)] + [(50, None), (51, "?!")]
    dd, di = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    tok = lambda s: [x for x in s.lower().replace(",", " ").replace("?", " ").replace("!", " ").split() if x]
    want = {(d, i) for d, t in docs if t is not None for i, s in items if s and tok(s) and f" {' '.join(tok(s))} " in f" {' '.join(tok(t))} "}
    assert {tuple(r) for r in D.phrase_matches(dd, di, "doc_id", "item_id").collect()} == want
    for r in D.ngram_coverage(dd, di, "doc_id", "item_id", n=2).collect():
        assert 0 < r["score"] <= 1
    assert D.drop_contaminated(dd, D.ngram_coverage(dd, di, "doc_id", "item_id", n=2), "doc_id", 1.0).count() == len(docs)
    assert D.phrase_matches(dd, di.limit(0), "doc_id", "item_id").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [0.0] * 8), (999, None)], "vec_id long, embedding array<double>")
    got = D.vector_topk(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, query_block=4, index_block=50).collect()
    s = v @ v.T
    for q in range(0, 200, 20):
        near = [int(j) for j in np.argsort(-s[q], kind="stable") if j != q][:5]
        assert [r["hit"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == near


def test_amounts_and_fingerprint():
    assert [s.rows(100) for s in M.parse_amounts(["a", "0.5", "b", "0.25"])] == [50, 25]
    assert [s.rows(100) for s in M.parse_amounts(["a", "7"])] == [7]
    for bad in (["a", "0.5", "b", "3"], ["a", "-1"], ["a"]):
        with pytest.raises(ValueError):
            M.parse_amounts(bad)
    assert M.fingerprint({"a": 1, "b": 2}) == M.fingerprint({"b": 2, "a": 1}) != M.fingerprint({"a": 2})


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert M.exact_upsample(df, "k", 100, 250).count() == 250
    up = M.upsample(df.withColumn("f", F.lit(1.25)), "k", "f").groupBy("k").count().collect()
    assert len(up) == 100 and {r["count"] for r in up} == {1, 2}
    idx = [r["_row_idx"] for r in M.global_index(df, [M.shuffle_key(1, "k")]).collect()]
    assert sorted(idx) == list(range(100))
    assert M.global_index(df.limit(0), [F.col("k")]).count() == 0
    off = TB.running_offsets(df.withColumn("n", F.col("k") % 3), "k", "n").orderBy("k").collect()
    assert [r["stop"] for r in off] == list(np.cumsum([i % 3 for i in range(100)]))


def test_prefs(spark):
    df = spark.createDataFrame([(1, 0, 3.0, "a"), (1, 1, 3.0, "b"), (1, 2, 1.0, "c"), (1, 3, 1.0, "d"), (2, 0, 5.0, "x"), (3, 0, 1.0, "p"), (3, 1, 1.0, "q"), (4, 0, None, "n")], "g long, i int, s double, t string")
    assert [(r["g"], r["chosen"], r["rejected"]) for r in P.best_and_worst(df, ["g"], "s", "i", "t").collect()] == [(1, "a", "d")]
    assert P.all_pairs(df, ["g"], "i", "t").count() == 7
    v = spark.createDataFrame([(1, "j1", "x"), (1, "j2", "y"), (1, "j3", "y"), (2, "j1", "b"), (2, "j2", "a"), (3, "j1", None)], "g long, j string, c string")
    assert sorted((r["g"], r["c"]) for r in P.majority_vote(v, ["g"], "j", "c").collect()) == [(1, "y"), (2, "b")]
    m = spark.createDataFrame([({"a": 1.0, "b": None, "c": 3.0},), ({},)], "m map<string,double>").select(P.overall(F.col("m")).alias("o")).collect()
    assert [r["o"] for r in m] == [2.0, None]


def test_gae_and_returns(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(20):
        n = rng.integers(1, 9)
        rows.append((i, [float(x) for x in rng.normal(size=n)], [float(x) for x in rng.normal(size=n)], [int(x) for x in rng.integers(0, 2, n)]))
    df = spark.createDataFrame(rows, "i long, v array<double>, r array<double>, d array<int>")
    got = {r["i"]: r for r in df.select("i", rl.gae("v", "r", "d", 0.9, 0.8).alias("g"), rl.discounted("r", 0.5).alias("q")).collect()}
    for i, v, r, d in rows:
        g, q, out, ret = 0.0, 0.0, [], []
        for t in reversed(range(len(v))):
            nxt = v[t + 1] if t + 1 < len(v) else 0.0
            g = r[t] + 0.9 * nxt * (1 - d[t]) - v[t] + 0.9 * 0.8 * (1 - d[t]) * g
            q = r[t] + 0.5 * q
            out.insert(0, g)
            ret.insert(0, q)
        assert np.allclose(got[i]["g"], out) and np.allclose(got[i]["q"], ret)


def test_next_fit_and_collation(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([3, 4, 9, 1, 8, None, 2])], "s string, i long, n int")
    got = {r["i"]: r["pack"] for r in rl.next_fit(df, "s", "i", "n", 8).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4]
    a = spark.createDataFrame([([2, 0, 3],)], "n array<int>").select(rl.position_ids("n").alias("p"), rl.cumulative_lengths("n").alias("c"), rl.right_pad("n", F.lit(5), 9).alias("r"), rl.left_pad("n", F.lit(5), 9).alias("l"), rl.stop_at("n", 0, 7).alias("s"), rl.separate("n").alias("x")).first()
    assert a["p"] == [0, 1, 0, 1, 2] and a["c"] == [0, 2, 2, 5] and a["r"] == [2, 0, 3, 9, 9] and a["l"] == [9, 9, 2, 0, 3] and a["s"] == [2, 0, 7] and a["x"] == [-100, 0, 3]


MS = [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Yo"}, {"role": "user", "content": "Bye"}, {"role": "assistant", "content": "Ok"}]


def test_templates_agree_with_python(spark):
    rows = [(1, MS), (2, [{"role": "system", "content": "S"}, *MS]), (3, []), (4, MS[:1])]
    df = spark.createDataFrame(rows, MSG)
    for name in ("simple_chat", "zephyr", "tagged", "simple_concat_with_space", "r1_simple_chat", "assistant_message_only"):
        t = C.TEMPLATES[name]
        for r in df.withColumn("t", C.render("messages", name, "</s>")).collect():
            want = C.python_render(t, [m.asDict() for m in r["messages"]], len(r["messages"]), False, "</s>", len(r["messages"])) + t.close.replace("{eos}", "</s>")
            assert r["t"] == want


def test_masks(spark):
    df = spark.createDataFrame([(1, MS), (2, None), (3, [])], MSG)
    for keep, want in (("assistant", "Yo</s>\nOk</s>"), ("last", "Ok</s>"), ("all", None)):
        r = {x["id"]: x for x in C.tokenize_masked(df, "id", "messages", C.byte_tokenizer(), C.Masking(keep, template="tagged")).collect()}
        text = bytes(r[1]["input_ids"]).decode()
        kept = bytes(x for x in r[1]["labels"] if x != -100).decode()
        assert text == "<|user|>\nHi\n<|assistant|>\nYo</s>\n<|user|>\nBye\n<|assistant|>\nOk</s>"
        assert kept == (want if want else text) and r[2]["input_ids"] == [] and r[3]["labels"] == []
    cut = C.tokenize_masked(df, "id", "messages", C.byte_tokenizer(), C.Masking("last", 5)).where("id = 1").first()
    assert len(cut["input_ids"]) == 5 and set(cut["labels"]) == {-100}


def test_converters(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string")
    assert [m["role"] for m in CV.to_messages(df).first()["messages"]] == ["user", "assistant"]
    bad = spark.createDataFrame([(1, [("alien", "x")])], "id long, conversations array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="alien"):
        CV.to_messages(bad).collect()
    with pytest.raises(ValueError):
        CV.to_messages(df.select("id"))
    m = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nHuman: c",), ("",)], "t string").select(CV.marked_dialogue("t").alias("m")).collect()
    assert [x["content"] for x in m[0]["m"]] == ["a", "b"] and m[1]["m"] == []
    lines, letter = CV.lettered("c", "r")
    r = spark.createDataFrame([(["b", "A", "c"], "A")], "c array<string>, r string").select(lines.alias("l"), letter.alias("x")).first()
    assert r["l"] == "A. A\nB. b\nC. c" and r["x"] == "A"


def test_schema_tools(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([("2", 5)], "k string, z int")
    assert [tuple(r) for r in concat_aligned([a, b]).collect()] == [(1, "x"), (2, None)]
    assert keep_columns(a, ["t", "gone"]).columns == ["t", "gone"] and align(b, a.schema).columns == ["k", "t"]
    assert as_list(a, "t").first()["t"] == ["x"]
    with pytest.raises(ValueError):
        require(a, ["missing"])


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, list(range(i % 5)), "é") for i in range(40)], "k long, ids array<int>, t string")
    FI.write_lines(df, f"{tmp_path}/l.jsonl", per_file=7)
    assert FI.read(spark, f"{tmp_path}/l.jsonl", df.schema).count() == 40
    assert FI.read_tree(spark, str(tmp_path), "*.json", df.schema).where("folder = 'l.jsonl'").count() == 40
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert FI.read(spark, f"{tmp_path}/a.json").count() == 2
    FI.write_tsv(spark.createDataFrame([("r", 0.5)], "k string, s double"), f"{tmp_path}/m.tsv", "k")
    assert FI.read(spark, f"{tmp_path}/m.tsv").first()["s"] == "0.5000"
    FI.write_tokens(df, "k", "ids", f"{tmp_path}/tok", 300, 13)
    flat = np.concatenate(list(FI.read_tokens(f"{tmp_path}/tok", 300)))
    assert list(flat) == [x for i in range(40) for x in range(i % 5)] and flat.dtype == np.uint16
    assert FI.first_rows(df, "train[:25%]", "k").count() == 10 and FI.first_rows(df, "train[:3]", "k").count() == 3


def test_cache(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert cached(spark, str(tmp_path), {"a": 1}, build, lambda d: d.groupBy().count()).count() == 5
    assert len(made) == 1 and cached(spark, str(tmp_path), {"a": 2}, build).count() == 5 and len(made) == 2


def test_tree_and_batches(spark):
    e = spark.createDataFrame([(1, None, 0.0), (2, 1, 1.0), (3, 1, 2.0), (4, 3, 0.5), (5, 2, 9.0), (6, 99, 1.0)], "k long, p long, q double")
    assert sorted((r["k"], r["depth"]) for r in TB.best_paths(e, "k", "p", "q").collect()) == [(1, 0), (3, 1), (4, 2)]
    assert TB.same_size(e, e) and not TB.same_size(e, e.limit(3))
    lines = TB.batch_requests(spark.createDataFrame([(1, "hi"), (2, None)], "k long, t string"), "k", "t", "m").collect()
    assert len(lines) == 1 and json.loads(lines[0]["line"])["custom_id"] == "1"
    many = TB.batch_requests(spark.range(25).selectExpr("id AS k", "'x' AS t"), "k", "t", "m", per_shard=10)
    assert {r["shard"]: r["count"] for r in many.groupBy("shard").count().collect()} == {0: 10, 1: 10, 2: 5}
    twice = [(i, json.dumps({"custom_id": c, "response": {"status_code": 200, "body": {"choices": [{"finish_reason": "stop", "message": {"content": t}}], "usage": {}}}})) for i, (c, t) in enumerate([("a", "one"), ("b", "two"), ("a", "three")])]
    df = spark.createDataFrame(twice, "i int, l string")
    assert TB.batch_results(df, "l").count() == 3
    assert {r["custom_id"]: r["content"] for r in TB.batch_results(df, "l", [F.col("i")]).collect()} == {"a": "three", "b": "two"}
    first, rest = TB.id_parts("c")
    assert tuple(spark.createDataFrame([("x_1_2",)], "c string").select(first, rest).first()) == ("x", "1_2")
    assert TB.batch_results(spark.createDataFrame([("{",), ('{"custom_id":"1","response":{"status_code":500}}',), ('{"custom_id":"2","response":{"status_code":200,"body":{"choices":[]}}}',)], "l string"), "l").count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([("a", 0), ("a", 4), ("b", 10), (None, 3), (None, None)], "c string, n int")
    bins = {r["bin"]: r["n"] for r in S.fixed_bins(df, F.col("n"), 0, 10, 5).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 4: 1}
    assert {r["bin"]: r["n"] for r in S.fixed_bins(df, F.col("n"), 1, 4, 3).collect()} == {-1: 1, 2: 2, 3: 1}
    assert {r["c"]: r["count"] for r in S.merge_rare(df, "c", 2).groupBy("c").count().collect()} == {"a": 2, "Other": 1, None: 2}
    d = {r["c"]: r for r in S.describe(df, ["c"], {"n": F.col("n")}).collect()}
    assert d["a"]["n_p50"] == 2.0 and d["b"]["n_std"] is None
    assert S.describe(df.limit(0), ["c"], {"n": F.col("n")}).count() == 0


def test_pack_sequences(spark):
    rows = [("s", 0, [1, 2, 3], [10, 11, 12], [1, 0, 1], [0.1, 0.2, 0.3]), ("s", 1, [4, 5, 0], [20, 21], [0, 1], [0.4, 0.5])]
    df = spark.createDataFrame(rows, "s string, i long, q array<int>, r array<int>, m array<int>, p array<double>")
    for tools, masks in ((True, [[0, 0, 0, 1, 0, 1], [0, 0, 0, 2]]), (False, [[0, 0, 0, 1, 1, 1], [0, 0, 2, 2]])):
        got = sorted(rl.pack_sequences(df, "s", "i", "q", "r", "m", "p", 8, 0, tools).collect(), key=lambda x: x["pack"])
        assert [g["query_responses"] for g in got] == [[1, 2, 3, 10, 11, 12], [4, 5, 20, 21]]
        assert [g["response_mask"] for g in got] == masks
        assert [g["dones"] for g in got] == [[0, 0, 0, 0, 0, 1], [0, 0, 0, 2]] and got[0]["num_actions"] == [3]
        assert got[0]["logprobs"][:3] == [None] * 3 and got[0]["logprobs"][3:] == [0.1, 0.2, 0.3]
    one = rl.pack_sequences(df, "s", "i", "q", "r", "m", "p", 32, 0).first()
    assert one["attention_mask"] == [1] * 6 + [2] * 4 and one["position_ids"] == [0, 1, 2, 3, 4, 5, 0, 1, 2, 3] and one["seq_lens"] == [6, 4]
    over = rl.pack_sequences(df, "s", "i", "q", "r", "m", "p", 5, 0).collect()
    assert sorted(len(g["query_responses"]) for g in over) == [0, 4, 6]


def test_flattened(spark):
    df = spark.createDataFrame([(1, 0, [5, 6], [5, 6]), (1, 1, [7], [7])], "b long, i long, x array<int>, y array<int>")
    r = rl.flatten_batch(df, "b", "i", "x", "y").first()
    assert (r["input_ids"], r["labels"], r["position_ids"], r["seq_idx"], r["cu_seq_lens"], r["max_length"]) == ([5, 6, 7], [-100, 6, -100], [0, 1, 0], [0, 0, 1], [0, 2, 3], 2)


def test_prompts_and_queries(spark):
    df = spark.createDataFrame([(1, MS), (2, MS[:1]), (3, [{"role": "system", "content": "S"}, *MS])], MSG)
    got = {r["id"]: [m["role"] for m in r["p"]] for r in df.select("id", C.prompt_of("messages", "N").alias("p")).collect()}
    assert got == {1: ["system", "user", "assistant", "user"], 2: ["system", "user"], 3: ["system", "user", "assistant", "user"]}
    t = C.prompt_tokens(df, "id", "messages", C.byte_tokenizer(), "tagged", None, 20).collect()
    assert [(r["id"], bytes(r["input_ids_prompt"]).decode()) for r in t] == []
    texts = ["<|user|>\na\n<|assistant|>\nb</s>\n<|user|>\nq?\n<|assistant|>\n<think>x", "<|im_start|>user\nq!<|im_end|>\n<|im_start|>assistant\n<think>", "plain"]
    assert [r["q"] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(C.last_user_query("t").alias("q")).collect()] == ["q?", "q!", "plain"]
    pair = spark.createDataFrame([(1, MS, MS), (2, MS, [])], "id long, a array<struct<role:string,content:string>>, b array<struct<role:string,content:string>>")
    assert [r["id"] for r in C.preference_tokens(pair, "id", "a", "b", C.byte_tokenizer(), C.Masking("last")).collect()] == [1]


def test_tags_and_tests(spark):
    df = spark.createDataFrame([(1, ["Old"]), (2, ["x"]), (3, None), (4, [])], "k long, tags array<string>")
    assert [r["k"] for r in df.where(~Q.carries_tag("tags", ["old"], {"old": ["Old"]})).collect()] == [2, 3, 4]
    t = spark.createDataFrame([(["a", "b"], [1, 0]), (["a", "b"], [1, 1]), ([], [])], "t array<string>, r array<int>").select(Q.passed_tests("t", "r").alias("p")).collect()
    assert [r["p"] for r in t] == [None, ["a", "b"], []]
    c = spark.createDataFrame([(1, ["q1", "q2"], ["user", "bot"])], "id long, q array<string>, r array<string>").select(CV.numbered("q").alias("n"), CV.few_shot([("1+1", "2")], F.lit("2+2")).alias("f")).first()
    assert c["n"] == "1. q1\n\n2. q2" and c["f"] == "Question: 1+1\nAnswer: 2\n\nQuestion: 2+2\nAnswer:"
    with pytest.raises(ValueError):
        CV.corpus(df, "nothing")


def test_places_and_batches(spark):
    a, b = spark.createDataFrame([(i, "x") for i in range(10)], "k long, v string"), spark.createDataFrame([(i * 10, "y") for i in range(4)], "k long, w string")
    z = M.zip_rows(a, b, [F.col("k")], [F.col("k").desc()]).collect()
    assert sorted((r["k"], r["k_b"]) for r in z) == [(0, 30), (1, 20), (2, 10), (3, 0)]
    w = M.worker_batches(a, [F.col("k")], 3, 2).collect()
    assert len(w) == 6 and {r["rank"] for r in w} == {0, 1, 2} and max(r["k"] for r in w) == 5
    assert M.worker_batches(a, [F.col("k")], 3, 2, drop_last=False).count() == 10
    g = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("q", 4), (None, 5)], "g string, k long")
    assert M.sample_groups(g, "g", "k", 2).groupBy("g").count().collect()[0]["count"] == 2
    assert S.markdown_table(spark.createDataFrame([(1, 0.5)], "k long, s double"), "k") == "| k | s |\n|-|-|\n| 1 | 0.5000 |"
    cut = C.truncate_tokens("t", C.byte_tokenizer(), 3, lambda ids: bytes(ids).decode(errors="ignore"))
    assert [r["c"] for r in spark.createDataFrame([("abcdef",), ("ab",), (None,)], "t string").select(cut.alias("c")).collect()] == ["abc", "ab", None]
    assert M.by_length(a, F.length("v")).count() == 10


def test_paths_are_walked_to_their_end(spark, tmp_path):
    from loomwright.plans.corpus import tree_paths

    chain = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(35)], "k long, p long, q double")
    assert TB.best_paths(chain, "k", "p", "q").agg(F.max("depth")).first()[0] == 34
    assert TB.best_paths(chain, "k", "p", "q", depth=3).count() == 4
    with pytest.raises(ValueError, match="cycle"):
        TB.best_paths(spark.createDataFrame([(1, None, 1.0), (2, 1, 1.0), (1, 2, 1.0)], "k long, p long, q double"), "k", "p", "q")
    spark.range(1, 8193).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), (-F.col("id")).cast("double").alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(tuple(r) for r in tree_paths(spark, str(tmp_path)).collect()) == [(2**n, n, 1) for n in range(14)]


def test_phrases_of_several_fields_and_long_items(spark):
    train = spark.createDataFrame([(1, "The red fox runs; over the hill by night. What is it?"), (2, "the red fox runs"), (3, None), (4, "Over the hill by night"), (None, "the red fox runs over the hill by night")], "k long, text string")
    items = spark.createDataFrame([("a", "red fox runs", "over the hill"), ("b", "red fox runs", None), ("c", "it", "the red"), ("d", None, ""), ("e", "fox runs over the hill by night what is it", None)], "i string, q string, a string")
    got = {(r["k"], r["i"]) for r in D.phrase_matches(train, items, "k", "i", fields=["q", "a"]).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "b"), (1, "c"), (1, "e")}
    assert D.phrase_matches(train, items.limit(0), "k", "i", fields=["q"]).count() == 0
    assert D.ngram_coverage(train, items.selectExpr("i", "q AS text").limit(0), "k", "i").count() == 0


def test_final_form_in_python_and_in_columns(spark):
    from loomwright.functions import latex as L

    cases = ["The answer is $1,000$", "x = \\text{three} apples", "\\frac12", "\\sqrt3", "5 \\text{ dollars}", "12, 13", "\\boxed{7}", "", "a $b$ c", "1,234,567", "\\overline{AB}", "y = 2x = 8\\,km", "line\nbreak $3$"]
    got = [r["f"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", L.final_form_column(F.col("c")).alias("f")).orderBy("i").collect()]
    assert got == [L.final_form(c) for c in cases]
    assert got[0] == "1000" and got[2] == "\\frac{1}{2}" and got[3] == "\\sqrt{3}" and got[9] == "1234567"


def test_lowest_is_a_share_of_an_order(spark):
    assert sorted(r["id"] for r in M.lowest(spark.range(100), 37, F.col("id").desc()).collect()) == list(range(63, 100))


def test_a_missing_dependency_of_the_optional_part_leaves_the_rest():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and 'p1_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False).returncode == 0


def test_corpora(spark):
    from loomwright.operators import corpora as K

    df = spark.createDataFrame([("gpt-4-x", 1), ("gpt-3.5", 2), ("other", 3), (None, 4)], "model string, k long")
    assert {r["k"] for r in K.subset(df, "wildchat", "gpt4").collect()} == {1}
    with pytest.raises(Exception, match="no subset"):
        K.with_subset(df, K.SUBSETS["wildchat"], exhaustive=True).collect()
    assert {r["k"] for r in K.keep_models(df, ignore=["other"]).collect()} == {1, 2, 4} and K.keep_models(df, include=["other"]).count() == 1
    assert K.transform_named("rlvr_tokenize_v1") == ("rlvr_tokenize_v3", "map")
    with pytest.raises(ValueError):
        K.transform_named("none")
    got = K.rows_at(df.where("model is not null"), [F.col("k")], [0, -1]).collect()
    assert {r["k"] for r in got} == {1, 3}
    with pytest.raises(IndexError):
        K.rows_at(df, [F.col("k")], 9)
    e0, e1 = (K.epoch_batches(spark.range(50).withColumnRenamed("id", "k"), "k", 2, 0, 8, epoch=e).collect() for e in (0, 1))
    assert len(e0) == len(e1) == 24 and {r["k"] % 2 for r in e0 + e1} == {0} and [r["k"] for r in e0] != [r["k"] for r in e1]
    p = K.problems(df, "k", "model", "k", 200).where("k = 1").first()
    assert p["dataset"] == ["math", "max_length"] and 100 <= int(p["ground_truth"][1]) < 200
    assert K.questions(df.limit(0), "model", "k").count() == 0


def test_packed_advantages_restart_at_done_steps_and_queries(spark):
    rng = random.Random(3)
    v, r = [rng.random() for _ in range(9)], [rng.random() for _ in range(9)]
    done, mask = [0, 0, 1, 0, 0, 0, 1, 0, 3], [1, 1, 1, 0, 1, 2, 1, 0, 1]
    want, last = [0.0] * 9, 0.0
    for t in range(8, -1, -1):
        on = (1 - min(done[t], 1)) * min(mask[t], 1)
        nxt = v[t + 1] if t < 8 else 0.0
        last = r[t] + 0.9 * nxt * on - v[t] + 0.9 * 0.8 * last * on
        want[t] = last
    df = spark.createDataFrame([(v, r, done, mask), (None, None, None, None), ([], [], [], [])], "v array<double>, r array<double>, d array<int>, m array<int>")
    got = df.select(rl.gae("v", "r", "d", 0.9, 0.8, "m").alias("g"), rl.masked_mean("v", F.expr("transform(m, x -> int(x > 0))")).alias("x")).collect()
    assert np.allclose(got[0]["g"], want) and got[1]["g"] is None and got[2]["g"] == [] and got[2]["x"] is None
    assert np.isclose(got[0]["x"], np.mean([a for a, m in zip(v, mask) if m]))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from loomwright.streaming import queries as ST

    source = f"{tmp_path}/in"
    spark.range(10).write.parquet(source)
    assert ST.run_once(ST.stream_table(spark, source), "go_on", root=f"{tmp_path}/run").count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    seen = ST.run_once(ST.stream_table(spark, source), "go_on", root=f"{tmp_path}/run")
    assert sorted(r["id"] for r in seen.collect()) == list(range(15))  # each once


def test_thinker_rewrites_and_batch_results(spark):
    from loomwright.operators import corpora as K

    t = spark.createDataFrame([(1, [("user", "q"), ("assistant", "<|reserved_special_token_246|>so<|reserved_special_token_247|>42")]), (2, [("assistant", None)]), (3, []), (4, None)], "k long, m array<struct<role:string,content:string>>")
    got = {r["k"]: r for r in t.select("k", K.thinker_messages("m").alias("m")).select("k", "m", K.last_answer("m").alias("a")).collect()}
    assert got[1]["m"][1]["content"] == "<think>so</think><answer>42</answer>" and got[1]["a"] == "42"
    assert got[2]["a"] is None and got[3]["m"] == [] and got[4]["m"] is None
    q = spark.createDataFrame([(1, "q", "r", "a"), (2, "q", "", "a"), (3, None, "r", "a")], "k long, q string, r string, a string")
    assert [r["k"] for r in K.thoughts(q, "q", "r", "a").collect()] == [1]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, v int, level string")
    results = spark.createDataFrame([("a", "hard"), ("c", "easy"), (None, "none")], "id string, level string")
    assert [tuple(r) for r in K.with_results(rows, results, "id", [F.col("v")]).collect()] == [("a", 2, "hard")]
    notes = spark.createDataFrame([([("long",)],), ([],)], "n array<struct<long_answer:string>>")
    assert [r[0] for r in notes.select(K.first_annotation("n", "long_answer")).collect()] == ["long", None]
