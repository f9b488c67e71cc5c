"""Queries on preferences, rewards, sampling, annotations and batch preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.functions import verify as V
from loomwright.operators import mix as M
from loomwright.operators import prefs as P
from loomwright.operators import rl as R
from loomwright.operators import stats as S
from loomwright.operators import tables as TB
from loomwright.schema import concat_aligned
from loomwright.plans.datasets import _GAE
from loomwright.plans.rules import INSTRUCTIONS, _given
from loomwright.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Completions of a prompt: lineitem's lines of an order, with a score."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("score"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("answer"), "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")


_L = "SELECT l_orderkey AS prompt, l_linenumber AS idx, l_quantity AS score, concat_ws('-', l_partkey, l_suppkey) AS answer, l_returnflag, l_linestatus, l_extendedprice, l_discount FROM lineitem"


def prefs_best_worst(spark: SparkSession, d: str) -> DataFrame:
    return P.best_and_worst(_lines(spark, d), ["prompt"], "score", "idx", "answer")


def prefs_margin(spark: SparkSession, d: str) -> DataFrame:
    return P.with_margin(P.best_and_worst(_lines(spark, d), ["prompt"], "score", "idx", "answer"), 20.0).select("prompt", "chosen", "rejected", F.round("margin", 6).alias("margin"))


def prefs_vote(spark: SparkSession, d: str) -> DataFrame:
    return P.majority_vote(_lines(spark, d).withColumn("judge", F.col("idx").cast("string")), ["prompt"], "judge", "l_returnflag")


def prefs_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.all_pairs(_lines(spark, d), ["prompt"], "idx", "answer").groupBy("prompt").agg(F.count("*").alias("n_pairs"), F.max(F.concat_ws("|", "first", "second")).alias("last_pair"))


def prefs_binary(spark: SparkSession, d: str) -> DataFrame:
    b = M.binary_from_pairs(P.best_and_worst(_lines(spark, d), ["prompt"], "score", "idx", "answer").select("prompt", "chosen", "rejected"), "chosen", "rejected")
    return b.select("prompt", "completion", F.col("label").cast("int").alias("label"))


def aspect_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Aspects of each prompt side by side."""
    a = table(spark, d, "annotation_mix").where("aspect is not null")
    return S.wide(a.withColumn("v", F.md5("text")), ["prompt_hash"], "aspect", ASPECTS, "v")


ASPECTS = ["helpfulness", "honesty", "instruction_following", "truthfulness"]


def common_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that all of three models answered."""
    m = table(spark, d, "model_outputs").where("model in ('vell-70b', 'tarn-mini', 'ostra-8b')")
    return P.complete_groups(m, "prompt_hash", "model", 3).select("prompt_hash", "model").distinct()


def sampled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two models of each prompt by hash, with the first output."""
    m = table(spark, d, "model_outputs").where("size(outputs) > 0").select("prompt_hash", "model").distinct()
    return P.random_members(m, ["prompt_hash"], "model", 2).select("prompt_hash", "model", F.col("pos").cast("int").alias("pos"))


def ratings_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of jagged rating lists, position by position, from derived answers."""
    e = table(spark, d, "events").withColumn("answer", F.concat(F.lit("Rating: "), F.floor(F.col("value")).cast("string"), F.lit("\nRating: "), F.when(F.col("event_id") % 5 == 0, "N/A").otherwise((F.col("event_id") % 7).cast("string"))))
    return S.nan_mean(e.withColumn("r", P.ratings_of(F.col("answer"))), ["event_type"], "r").withColumn("pos", F.col("pos").cast("int"))


# ---- Sampling and mixing -------------------------------------------------------------------


def mix_sample(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders' keys and a third of the parts', stacked."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("text"), "p_type")
    return M.mix({"orders": o, "part": p}, M.parse_amounts(["orders", "0.5", "part", "0.25"]), "id")


def upsample(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lit(2.5).alias("f"))
    return M.upsample(p, "p_partkey", "f").groupBy("p_partkey").agg(F.count("*").alias("copies"))


def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    return M.stratified(table(spark, d, "part"), "p_brand", "p_partkey", F.lit(3)).select("p_brand", "p_partkey")


def align_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("unused"))
    return concat_aligned([c, s])


def train_test(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("split", M.split_of(42, "o_orderkey", 0.1)).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def weighted_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").withColumn("form", M.pick_weighted(F.col("p_partkey"), [("plain", 0.7), ("hint", 0.2), ("cot", 0.1)]))
    return t.groupBy("form").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def shards(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each row: the shards cover all rows once."""
    o = M.global_index(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return o.groupBy(M.shard_of(F.col("_row_idx"), 4).alias("rank")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# ---- Rewards -------------------------------------------------------------------------------


def advantages(spark: SparkSession, d: str) -> DataFrame:
    a = R.advantages(R.informative_groups(_lines(spark, d), "prompt", "score"), "prompt", "score")
    return a.select("prompt", "idx", F.round("advantage", 5).alias("advantage"))


def zero_std_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.group_report(_lines(spark, d).withColumn("r", F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)), "prompt", "r", 1.0)


def pass_rate_band(spark: SparkSession, d: str) -> DataFrame:
    return R.pass_rate(_lines(spark, d), "prompt", F.col("l_returnflag") == "N", 0.25, 0.75)


def reward_gsm8k(spark: SparkSession, d: str) -> DataFrame:
    """The last number of each document against a derived label."""
    t = table(spark, d, "documents")
    return t.select("doc_id", V.gsm8k("text", F.regexp_extract("text", r"(\d+)\D*\z", 1)).alias("score"))


def reward_f1(spark: SparkSession, d: str) -> DataFrame:
    """Token F1 of each prompt's answers against the prompt."""
    m = table(spark, d, "model_outputs").where("text is not null").select("prompt_hash", "model", "text", F.explode("outputs").alias("o"))
    m = m.select("prompt_hash", "model", "text", F.col("o.index").alias("out_index"), F.col("o.text").alias("a")).where("a is not null").distinct()
    return V.string_f1(m, "a", "text", "f1").select("prompt_hash", "model", "out_index", F.round("f1", 6).alias("f1"))


def reward_length(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokenized_sft").where("input_ids is not null").select("seq_id", F.size("input_ids").alias("n")).distinct()
    return t.select("seq_id", F.round(V.max_length("n", F.lit(100), 1024), 6).alias("near"), F.round(V.up_to_max_length("n", F.lit(100), 1024), 6).alias("up_to"))


def reward_flan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").withColumn("p", F.concat(F.lit("<think>x</think>The answer is: the "), F.lower("n_name"), F.lit(".")))
    return t.select("n_nationkey", V.flan("p", "n_name").alias("flan"), V.puzzle(F.concat(F.lit("<think>x</think> "), F.col("n_name"), F.lit("!")), "n_name").alias("puzzle"), V.string_matcher(F.concat(F.lit("<answer>"), F.col("n_name"), F.lit("</answer>")), "n_name").alias("matcher"), V.soft_format(F.concat(F.lit("a</think> <answer>"), F.col("n_name"), F.lit("</answer>"))).alias("format"))


def reward_combined(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sums over zipped labels and verifiers."""
    t = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("The answer is: "), F.col("n_name")).alias("p"), F.array(F.lower("n_name"), F.lit("7"), F.lit("x")).alias("labels"), F.array(F.lit("flan"), F.lit("GSM8K"), F.lit("unknown")).alias("names"))
    r = V.reward(t, "n_nationkey", "p", "labels", "names", {"flan": 2.0})
    return r.select("n_nationkey", F.round("reward", 6).alias("reward"), F.round(F.element_at("parts", "flan"), 6).alias("flan"))


def if_registry(spark: SparkSession, d: str) -> DataFrame:
    """Instruction checks behind the Arrow stage, on every document."""
    label = F.lit('[{"instruction_id": ["punctuation:no_comma", "length_constraints:number_words", "keywords:palindrome"], "kwargs": [{}, {"num_words": 100, "relation": "at least"}, {}]}]')
    return table(spark, d, "documents").select("doc_id", F.round(V.score_column(F.lit("ifeval"), "text", label), 6).alias("score"))


def if_checks(spark: SparkSession, d: str) -> DataFrame:
    """Native forms of checks that need only patterns and counts."""
    t = F.col("text")
    lines = F.split(t, "\n")
    return table(spark, d, "documents").select(
        "doc_id", (~t.contains(",")).alias("no_comma"), (~t.contains("!")).alias("no_exclamation"), (~t.contains(".")).alias("no_dot"),
        (X.count_matches(t, r"\[.*?\]") >= 1).alias("placeholder"), t.rlike(r"<<[^\n]+>>").alias("title"), (F.length(F.regexp_replace(t, r"[^a-zA-Z]+", "")) >= 300).alias("letters"),
        (F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[*-]"))) == 3).alias("bullets"), (F.size(F.split(t, r"\n\n")) == 3).alias("three_paragraphs"), (F.upper(t) == t).alias("upper"), (F.lower(t) == t).alias("lower"),
        t.startswith("User").alias("starts"), t.endswith(".").alias("ends"), F.lower(t).contains("filter").alias("keyword"), (X.count_matches(F.lower(t), "table") >= 2).alias("frequency"), t.contains("******").alias("two"),
        (F.length(t) - F.length(F.replace(t, F.lit("e"), F.lit(""))) >= 40).alias("letter_e"), (F.size(X.split_ws(t)) >= 100).alias("words"), (F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))).alias("quoted"),
        (X.count_matches(t, r"\*[^\n\*]*\*") >= 1).alias("highlight"), t.contains("P.S.").alias("postscript"),
    )


# ---- Batches -------------------------------------------------------------------------------


def gae(spark: SparkSession, d: str) -> DataFrame:
    """Generalised advantages over the events of each user, the last one done."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("value").cast("double").alias("v")))).alias("x"))
    v = F.transform("x", lambda x: F.coalesce(x["v"], F.lit(0.0)))
    r = F.transform("x", lambda x: (x["event_id"] % 3).cast("double"))
    done = F.transform("x", lambda x, i: (i == F.size("x") - 1).cast("int"))
    return e.select("user_id", F.round(F.aggregate(R.gae(v, r, done), F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.size("x").alias("n"))


def discounted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda x: x["l_discount"]).alias("r"))
    return e.select("l_orderkey", F.round(F.element_at(R.discounted("r", 0.5), 1), 9).alias("first_return"))


def pack_next_fit(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of each source in id order, put into open packs of 2048 tokens."""
    t = table(spark, d, "tokenized_sft").where("input_ids is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "seq_id", F.size(F.filter("attention_mask", lambda x: x == 1)).alias("n")).distinct()
    return R.next_fit(t, "source", "seq_id", "n", 2048).groupBy("source", "pack").agg(F.count("*").alias("n_seqs"), F.sum("n").alias("n_tokens"))


def position_ids(spark: SparkSession, d: str) -> DataFrame:
    """Position ids and ends of the lines of each order taken as sequences."""
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") % 5).cast("int").alias("n")))), lambda x: x["n"]).alias("n"))
    return e.select("l_orderkey", F.array_join(R.position_ids("n"), ",").alias("ids"), F.array_join(R.cumulative_lengths("n"), ",").alias("ends"))


def padded(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokenized_sft").where("input_ids is not null").select("seq_id", "input_ids").distinct()
    return t.select("seq_id", F.md5(F.array_join(R.right_pad("input_ids", F.lit(64), 0), ",")).alias("right"), F.md5(F.array_join(R.left_pad("input_ids", F.lit(64), 0), ",")).alias("left"), F.md5(F.array_join(R.stop_at("input_ids", 40, 0), ",")).alias("stopped"))


def label_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: sequences, tokens, trained tokens; sequences without a label to learn."""
    t = table(spark, d, "tokenized_sft").where("input_ids is not null")
    trained = F.size(F.filter("labels", lambda x: x != -100))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("tokens"), F.sum(trained).alias("trained"), F.count_if(trained == 0).alias("unlabelled"))


def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    r = TB.batch_requests(table(spark, d, "documents"), "doc_id", "text", "m", "_x", per_shard=300)
    return r.select("shard", F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.body.messages[0].content").alias("content"))


def batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Results parsed from derived lines, a malformed and a filtered one among them; tokens and cost."""
    n = table(spark, d, "nation")
    finish = F.when(F.col("n_nationkey") % 5 == 0, "content_filter").otherwise("stop")
    good = F.format_string('{"custom_id":"%s","response":{"status_code":200,"body":{"choices":[{"finish_reason":"%s","message":{"content":"%s"}}],"usage":{"prompt_tokens":%d,"completion_tokens":%d}}}}', F.col("n_nationkey").cast("string"), finish, "n_name", (F.col("n_nationkey") * 10).cast("bigint"), F.col("n_nationkey").cast("bigint"))
    lines = n.select(F.when(F.col("n_nationkey") % 7 == 3, "{broken").otherwise(good).alias("line"))
    return TB.batch_results(lines, "line").select("custom_id", "content", F.round(TB.cost(F.col("prompt_tokens"), F.col("completion_tokens"), 2.5, 10.0), 9).alias("cost"))


# ---- Human annotations ----------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_judgements(table(spark, d, "human_annotations"))


def human_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return S.acceptance_rates(_judged(spark, d))


def human_wins(spark: SparkSession, d: str) -> DataFrame:
    return S.win_rates(_judged(spark, d))


def human_agreement(spark: SparkSession, d: str) -> DataFrame:
    return S.agreement(_judged(spark, d))


_J = """WITH j AS (SELECT * FROM (SELECT instance_id, model_a, model_b, evaluator, annotated_at, a, b, p, row_number() OVER (PARTITION BY instance_id, model_a, model_b, evaluator ORDER BY annotated_at DESC NULLS LAST, p NULLS FIRST, a NULLS FIRST, b NULLS FIRST, instance_index NULLS FIRST) AS rn
FROM (SELECT *, lower(trim(completion_a_is_acceptable, ' ')) AS a, lower(trim(completion_b_is_acceptable, ' ')) AS b, lower(trim(preference, ' ')) AS p FROM human_annotations) WHERE instance_id IS NOT NULL AND evaluator IS NOT NULL AND model_a IS NOT NULL AND model_b IS NOT NULL) WHERE rn = 1)"""
_BW = f"WITH l AS ({_L}), g AS (SELECT prompt, max_by(answer, struct_pack(s := score, i := -idx, a := answer)) AS chosen, min_by(answer, struct_pack(s := score, i := -idx, a := answer)) AS rejected, max(score) AS chosen_score, min(score) AS rejected_score FROM l GROUP BY 1 HAVING count(*) > 1 AND max(score) > min(score))"
_HASH = "CAST(('0x' || md5({x})[1:8]) AS BIGINT) / 4294967296.0"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_MASKED = "list_filter(attention_mask, lambda x: x = 1)"
_WL = "list_filter(regexp_split_to_array({x}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}]+'), lambda s: s <> '')"


def _plain_words(x: str) -> str:
    """SQL for the words of a text lower-cased, without ASCII marks and English articles."""
    w, blank = r"\p{L}\p{N}_", r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    plain = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(3):  # neighbouring articles share a blank
        plain = f"regexp_replace({plain}, '(^|[^{w}])(?:a|an|the)($|[^{w}])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '[{blank}]+'), lambda q: q <> '')"


QUERIES = {
    "prefs_best_worst": (prefs_best_worst, _BW + " SELECT * FROM g"),
    "prefs_margin": (prefs_margin, _BW + " SELECT prompt, chosen, rejected, round(chosen_score - rejected_score, 6) AS margin FROM g WHERE chosen_score - rejected_score >= 20"),
    "prefs_vote": (prefs_vote, f"WITH c AS (SELECT prompt, l_returnflag, count(*) AS votes, min(CAST(idx AS VARCHAR)) AS f FROM ({_L}) GROUP BY ALL) SELECT prompt, l_returnflag, votes FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY votes DESC, f, l_returnflag) AS rn FROM c) WHERE rn = 1"),
    "prefs_pairs": (prefs_pairs, f"WITH l AS ({_L}) SELECT a.prompt, count(*) AS n_pairs, max(a.answer || '|' || b.answer) AS last_pair FROM l a JOIN l b ON a.prompt = b.prompt AND a.idx < b.idx GROUP BY 1"),
    "prefs_binary": (prefs_binary, _BW + " SELECT prompt, chosen AS completion, 1 AS label FROM g UNION ALL SELECT prompt, rejected, 0 FROM g"),
    "aspect_pivot": (aspect_pivot, "SELECT prompt_hash, " + ", ".join(f"coalesce(min(md5(text)) FILTER (aspect = '{a}'), '') AS {a}" for a in ASPECTS) + " FROM annotation_mix WHERE aspect IS NOT NULL GROUP BY 1"),
    "common_prompts": (common_prompts, "WITH m AS (SELECT DISTINCT prompt_hash, model FROM model_outputs WHERE model IN ('vell-70b', 'tarn-mini', 'ostra-8b')) SELECT * FROM m WHERE prompt_hash IN (SELECT prompt_hash FROM m GROUP BY 1 HAVING count(*) = 3)"),
    "sampled_answers": (sampled_answers, "WITH m AS (SELECT DISTINCT prompt_hash, model FROM model_outputs WHERE len(outputs) > 0) SELECT prompt_hash, model, CAST(rn - 1 AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY md5('42_' || prompt_hash || '_' || model), model) AS rn FROM m) WHERE rn <= 2"),
    "ratings_mean": (ratings_mean, "WITH x AS (SELECT event_type, 0 AS pos, CASE WHEN value >= 0 THEN floor(value) END AS r FROM events UNION ALL SELECT event_type, 1, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END FROM events) SELECT event_type, pos, round(avg(r), 6) AS mean FROM x GROUP BY ALL"),
    "mix_sample": (mix_sample, "SELECT * FROM (SELECT o_orderkey AS id, o_orderpriority AS text, 'orders' AS dataset_source FROM orders ORDER BY md5('42_' || o_orderkey), o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM orders)) UNION ALL SELECT * FROM (SELECT p_partkey, p_brand, 'part' FROM part ORDER BY md5('42_' || p_partkey), p_partkey LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM part))"),
    "upsample": (upsample, f"SELECT p_partkey, CAST(2 + CASE WHEN {_HASH.format(x=chr(39) + '42_' + chr(39) + ' || p_partkey')} < 0.5 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM part"),
    "stratified_quota": (stratified_quota, "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42_' || p_partkey), p_partkey) AS rn FROM part) WHERE rn <= 3"),
    "align_union": (align_union, "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier"),
    "train_test": (train_test, f"SELECT CASE WHEN {_HASH.format(x=chr(39) + '42_' + chr(39) + ' || o_orderkey')} < 0.1 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"),
    "weighted_prompts": (weighted_prompts, f"WITH t AS (SELECT p_partkey, {_HASH.format(x=chr(39) + '42_' + chr(39) + ' || p_partkey')} AS u FROM part) SELECT CASE WHEN u < 0.7 THEN 'plain' WHEN u < 0.9 THEN 'hint' ELSE 'cot' END AS form, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM t GROUP BY 1"),
    "shards": (shards, "SELECT CAST((rn - 1) % 4 AS INT) AS rank, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1"),
    "advantages": (advantages, f"WITH l AS ({_L}), w AS (SELECT prompt, idx, score, avg(score) OVER p AS m, stddev_pop(score) OVER p AS s, max(score) OVER p AS hi, min(score) OVER p AS lo FROM l WINDOW p AS (PARTITION BY prompt)) SELECT prompt, idx, round((score - m) / (s + 1e-8), 5) AS advantage FROM w WHERE hi > lo"),
    "zero_std_groups": (zero_std_groups, f"WITH g AS (SELECT prompt, min(r) AS lo, max(r) AS hi FROM (SELECT prompt, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS r FROM ({_L})) GROUP BY 1) SELECT CASE WHEN lo < hi THEN 'differs' WHEN lo >= 1 THEN 'solved' WHEN hi = 0 THEN 'zero' ELSE 'same' END AS kind, count(*) AS n_groups FROM g GROUP BY 1"),
    "pass_rate_band": (pass_rate_band, f"SELECT prompt, count(*) AS total_rollouts, count(*) FILTER (l_returnflag = 'N') AS total_correct_rollouts, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS passrate FROM ({_L}) GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') / count(*) BETWEEN 0.25 AND 0.75"),
    "reward_gsm8k": (reward_gsm8k, r"WITH t AS (SELECT doc_id, regexp_replace(text, '(\d),(\d)', '\1\2', 'g') AS p, regexp_extract(text, '(\d+)\D*$', 1) AS y FROM documents), n AS (SELECT doc_id, y, p, regexp_extract_all(p, '([-+]?\d*\.\d+|\d+)', 1) AS l FROM t) SELECT doc_id, CAST(lower(CASE WHEN len(l) > 0 THEN l[-1] ELSE p END) = lower(y) AS DOUBLE) AS score FROM n"),
    "reward_f1": (
        reward_f1,
        f"WITH o AS (SELECT DISTINCT prompt_hash, model, text, o.index AS out_index, o.text AS a FROM (SELECT prompt_hash, model, text, unnest(outputs) AS o FROM model_outputs WHERE text IS NOT NULL) WHERE o.text IS NOT NULL), w AS (SELECT prompt_hash, model, out_index, {_plain_words("string_split(a, '</think>')[-1]")} AS x, {_plain_words('text')} AS y FROM o), "
        "c AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(x), list_distinct(y)), lambda q: least(len(list_filter(x, lambda z: z = q)), len(list_filter(y, lambda z: z = q))))), 0) AS n FROM w) SELECT prompt_hash, model, out_index, round(CASE WHEN n = 0 THEN 0 ELSE 2.0 * n / (len(x) + len(y)) END, 6) AS f1 FROM c",
    ),
    "reward_length": (reward_length, "SELECT DISTINCT seq_id, round(1 - abs(len(input_ids) - 100) / 1024.0, 6) AS near, round(CASE WHEN len(input_ids) <= 100 THEN 1.0 ELSE 1 - (len(input_ids) - 100) / 1024.0 END, 6) AS up_to FROM tokenized_sft WHERE input_ids IS NOT NULL"),
    "reward_flan": (reward_flan, f"SELECT n_nationkey, CAST({_PLAIN.format(x=chr(39) + 'the ' + chr(39) + ' || lower(n_name) || ' + chr(39) + '.' + chr(39))} = {_PLAIN.format(x='n_name')} AS DOUBLE) AS flan, CAST(1 AS DOUBLE) AS puzzle, CAST(1 AS DOUBLE) AS matcher, CAST(1 AS DOUBLE) AS format FROM nation"),
    "reward_combined": (reward_combined, r"SELECT n_nationkey, CAST(2 + CASE WHEN regexp_extract_all(n_name, '(\d+)', 1)[-1] = '7' THEN 1 ELSE 0 END AS DOUBLE) AS reward, CAST(2 AS DOUBLE) AS flan FROM nation"),
    "if_registry": (
        if_registry,
        f"WITH t AS (SELECT doc_id, {_given('text')} AS text FROM documents) SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE (" + " + ".join(f"CAST(({INSTRUCTIONS[k][1]}) AS INT)" for k in ("punctuation:no_comma", "length_constraints:number_words", "keywords:palindrome")) + ") / 3.0 END, 6) AS score FROM t",
    ),
    "if_checks": (if_checks, r"""SELECT doc_id, NOT contains(text, ',') AS no_comma, NOT contains(text, '!') AS no_exclamation, NOT contains(text, '.') AS no_dot, len(regexp_extract_all(text, '(\[.*?\])', 1)) >= 1 AS placeholder,
regexp_matches(text, '<<[^\n]+>>') AS title, len(regexp_extract_all(text, '([a-zA-Z])', 1)) >= 300 AS letters, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[*-]'))) = 3 AS bullets, len(string_split(text, chr(10) || chr(10))) = 3 AS three_paragraphs,
upper(text) = text AS upper, lower(text) = text AS lower, starts_with(text, 'User') AS starts, ends_with(text, '.') AS ends, contains(lower(text), 'filter') AS keyword, len(regexp_extract_all(lower(text), '(table)', 1)) >= 2 AS frequency, contains(text, '******') AS two,
length(text) - length(replace(text, 'e', '')) >= 40 AS letter_e, len(""" + _WL.format(x="text") + r""") >= 100 AS words, starts_with(text, '"') AND ends_with(text, '"') AS quoted, len(regexp_extract_all(text, '(\*[^\n\*]*\*)', 1)) >= 1 AS highlight, contains(text, 'P.S.') AS postscript FROM documents"""),
    "gae": (gae, _GAE.format(stop="false") + " SELECT user_id, round(sum(g), 4) AS total, CAST(count(*) AS INT) AS n FROM a GROUP BY 1"),
    "discounted": (discounted, "SELECT l_orderkey, round(sum(l_discount * power(0.5, rn - 1)), 9) AS first_return FROM (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount) AS rn FROM lineitem) GROUP BY 1"),
    "pack_next_fit": (pack_next_fit, f"WITH RECURSIVE t AS (SELECT DISTINCT coalesce(source, 'none') AS source, seq_id, len({_MASKED}) AS n FROM tokenized_sft WHERE input_ids IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq_id) AS rn FROM t), r AS (SELECT source, rn, n, n AS fill, CASE WHEN n > 2048 THEN 1 ELSE 0 END AS pack FROM o WHERE rn = 1 UNION ALL SELECT o.source, o.rn, o.n, CASE WHEN r.fill + o.n > 2048 THEN o.n ELSE r.fill + o.n END, CASE WHEN r.fill + o.n > 2048 THEN r.pack + 1 ELSE r.pack END FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1) SELECT source, CAST(pack AS BIGINT) AS pack, count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY ALL"),
    "position_ids": (position_ids, "WITH l AS (SELECT l_orderkey, list(CAST(l_quantity % 5 AS INT) ORDER BY l_linenumber, CAST(l_quantity % 5 AS INT)) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(flatten(list_transform(n, lambda x: range(x))), ',') AS ids, array_to_string(list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)), ',') AS ends FROM l"),
    "padded": (padded, "WITH t AS (SELECT DISTINCT seq_id, input_ids AS x FROM tokenized_sft WHERE input_ids IS NOT NULL) SELECT seq_id, md5(array_to_string(list_concat(x, list_transform(range(0, greatest(64 - len(x), 0)), lambda i: 0)), ',')) AS \"right\", md5(array_to_string(list_concat(list_transform(range(0, greatest(64 - len(x), 0)), lambda i: 0), x), ',')) AS \"left\", md5(array_to_string(CASE WHEN list_contains(x, 40) THEN list_transform(x, lambda y, i: CASE WHEN i <= list_position(x, 40) THEN y ELSE 0 END) ELSE x END, ',')) AS stopped FROM t"),
    "label_report": (label_report, "SELECT source, count(*) AS n, CAST(sum(len(input_ids)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS trained, count(*) FILTER (len(list_filter(labels, lambda x: x <> -100)) = 0) AS unlabelled FROM tokenized_sft WHERE input_ids IS NOT NULL GROUP BY 1"),
    "batch_requests": (batch_requests, "SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS INT) AS shard, doc_id || '_x' AS custom_id, text AS content FROM documents"),
    "batch_results": (batch_results, "SELECT CAST(n_nationkey AS VARCHAR) AS custom_id, n_name AS content, round((n_nationkey * 10 * 2.5 + n_nationkey * 10.0) / 1000000, 9) AS cost FROM nation WHERE n_nationkey % 7 <> 3 AND n_nationkey % 5 <> 0"),
    "human_acceptance": (human_acceptance, _J + " SELECT model, count(*) AS n, round(avg(CASE WHEN x = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS accepted FROM (SELECT model_a AS model, a AS x FROM j UNION ALL SELECT model_b, b FROM j) WHERE x IS NOT NULL GROUP BY 1"),
    "human_wins": (human_wins, _J + ", s AS (SELECT model_a AS model, p IN ('a-is-better', 'a-is-slightly-better') AS w, p IN ('b-is-better', 'b-is-slightly-better') AS l, p = 'tie' AS t FROM j WHERE p IS NOT NULL UNION ALL SELECT model_b, p IN ('b-is-better', 'b-is-slightly-better'), p IN ('a-is-better', 'a-is-slightly-better'), p = 'tie' FROM j WHERE p IS NOT NULL) SELECT model, count(*) FILTER (w) AS wins, count(*) FILTER (l) AS losses, count(*) FILTER (t) AS ties, round(avg(CASE WHEN w THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM s GROUP BY 1"),
    "human_agreement": (human_agreement, _J + ", r AS (SELECT *, row_number() OVER (PARTITION BY instance_id, model_a, model_b ORDER BY annotated_at ASC NULLS LAST, evaluator) AS k, CASE WHEN p LIKE 'a-is%' THEN 'a' WHEN p LIKE 'b-is%' THEN 'b' WHEN p = 'tie' THEN 'tie' END AS s FROM j), q AS (SELECT max(s) FILTER (k = 1) AS s1, max(s) FILTER (k = 2) AS s2 FROM r WHERE k <= 2 GROUP BY instance_id, model_a, model_b) SELECT count(*) AS n_pairs, round(avg(CASE WHEN s1 = s2 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(CASE WHEN s1 = s2 THEN 1.0 WHEN s1 = 'tie' OR s2 = 'tie' THEN 0.5 ELSE 0.0 END), 6) AS relaxed_agreement FROM q WHERE s1 IS NOT NULL AND s2 IS NOT NULL"),
}
