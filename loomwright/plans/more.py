"""Further queries: packing with masks, flattened batches, prompts, corpora, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import chat as C
from loomwright.operators import convert as CV
from loomwright.operators import filters as Q
from loomwright.operators import mix as M
from loomwright.operators import rl as R
from loomwright.operators import stats as S
from loomwright.sources.tables import table


def _seqs(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of each source, cut into a query and a response."""
    t = table(spark, d, "tokenized_sft").where("size(input_ids) > 4").select(F.coalesce("source", F.lit("none")).alias("source"), "seq_id", "input_ids", "labels").distinct()
    n = F.floor(F.size("input_ids") / 2).cast("int")
    rest = F.slice("input_ids", n + 1, F.size("input_ids"))
    return t.select("source", "seq_id", "input_ids", "labels", F.slice("input_ids", F.lit(1), n).alias("query"), rest.alias("response"), F.transform(rest, lambda x: (x % 2).cast("int")).alias("mask"), F.transform(rest, lambda x: x.cast("double") * -0.01).alias("logprobs"))


def pack_with_masks(spark: SparkSession, d: str) -> DataFrame:
    p = R.pack_sequences(_seqs(spark, d), "source", "seq_id", "query", "response", "mask", "logprobs", 2048, 0)
    return p.select("source", "pack", F.size("query_responses").alias("n_tokens"), F.size("seq_lens").alias("n_seqs"), F.aggregate("num_actions", F.lit(0), lambda a, x: a + x).alias("n_actions"), F.array_max("position_ids").alias("last_position"))


def flattened_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of sequences by hash of their id, laid end to end."""
    s = _seqs(spark, d).withColumn("batch", F.floor(F.col("seq_id") / 16).cast("long"))
    b = R.flatten_batch(s, "batch", "seq_id", "input_ids", "labels")
    return b.select("batch", F.size("input_ids").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_labels"), F.array_join("cu_seq_lens", ",").alias("ends"), "max_length", F.md5(F.array_join("position_ids", ",")).alias("positions"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Raw prompts with the system prompt replaced."""
    c = table(spark, d, "reformat_datasets").where("id is not null and size(messages) > 0").select("id", "messages").distinct()
    p = C.prompt_of("messages", "Be brief.")
    return c.select("id", F.md5(C.raw_prompt(p)).alias("h"), F.size(p).alias("n"))


def prompt_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of at most 400 tokens, with bytes as tokens."""
    c = table(spark, d, "reformat_datasets").where("id is not null and messages is not null").select("id", "messages").distinct()
    return C.prompt_tokens(c, "id", "messages", C.byte_tokenizer(), "tagged_thinker", None, 400).select("id", F.size("input_ids_prompt").alias("n"))


def preference_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and two models' first outputs as a tokenized pair."""
    m = table(spark, d, "model_outputs").where("text is not null and size(outputs) > 0").select("prompt_hash", "model", "text", F.try_element_at("outputs", F.lit(1))["text"].alias("a")).where("a is not null").distinct()
    two = m.groupBy("prompt_hash", "text").agg(F.min(F.struct("model", "a")).alias("x"), F.max(F.struct("model", "a")).alias("y")).where("x.model < y.model")
    pair = two.select("prompt_hash", CV.turns(("user", "text"), ("assistant", F.col("x.a"))).alias("chosen"), CV.turns(("user", "text"), ("assistant", F.col("y.a"))).alias("rejected"))
    t = C.preference_tokens(pair, "prompt_hash", "chosen", "rejected", C.byte_tokenizer(), C.Masking("last", None, "tagged"))
    kept = lambda c: F.size(F.filter(c, lambda x: x != -100))
    return t.select("prompt_hash", F.size("chosen_input_ids").alias("n_chosen"), kept("chosen_labels").alias("k_chosen"), kept("rejected_labels").alias("k_rejected"))


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of a public corpus."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), F.col("p_type").alias("answer"))
    return CV.corpus(p, "codefeedback").select("id", "source", F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("text"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("tags", F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Cutoff"), "p_brand")).when(F.col("p_size") % 3 == 1, F.array("p_brand")))
    return p.where(~Q.carries_tag("tags", ["cutoff"], {"cutoff": ["Cutoff"]})).select("p_partkey")


def unfinished(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "reformat_datasets").where("id is not null and messages is not null")
    return c.where(Q.unfinished_dialogue("messages")).select("id", "source")


def kept_tests(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as tests: those passed, where enough were."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("ok")))).alias("x"))
    k = Q.passed_tests(F.transform("x", lambda z: z["l_partkey"]), F.transform("x", lambda z: z["ok"]), 0.6)
    return t.select("l_orderkey", F.size("x").alias("n"), k.alias("k")).where("k is not null").select("l_orderkey", "n", F.size("k").alias("n_kept"))


def code_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Scores from results and runtimes of tests."""
    from loomwright.functions import verify as V

    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_discount").alias("s"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("ok")))).alias("x"))
    ok, s = F.transform("x", lambda z: z["ok"]), F.transform("x", lambda z: z["s"])
    return t.select("l_orderkey", F.round(V.code_score(ok, s, 0.5, 0.2, False), 6).alias("plain"), F.round(V.code_score(ok, s, 0.5, 0.2, True), 8).alias("penalised"))


def user_messages(spark: SparkSession, d: str) -> DataFrame:
    """User messages as rows of a text index."""
    return C.messages_of(table(spark, d, "reformat_datasets").where("id is not null and messages is not null").select("id", "messages").distinct(), "id", "messages").select("id", F.col("pos").cast("int").alias("pos"), F.md5("text").alias("h"))


def zipped(spark: SparkSession, d: str) -> DataFrame:
    """Customers beside suppliers, by their places."""
    c, s = table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return M.zip_rows(c, s, [F.col("c_custkey").desc()], [F.col("s_suppkey")])


def sampled_groups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return M.sample_groups(o, "o_custkey", "o_orderkey", 4)


def worker_batches(spark: SparkSession, d: str) -> DataFrame:
    b = M.worker_batches(table(spark, d, "orders").select("o_orderkey"), [M.shuffle_key(3, "o_orderkey")], 4, 32)
    return b.groupBy("rank").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.max("batch").alias("last"))


def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and tokens per source before and after a length filter."""
    t = table(spark, d, "tokenized_sft").where("input_ids is not null").select("source", "seq_id", "input_ids", "labels").distinct()
    return S.dataset_report(t.where(C.fits("input_ids", 256) & C.has_labels("labels")), t, "source", "input_ids", "labels")


def verifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.create_map(F.lit("size"), (F.col("p_size") % 3).cast("double"), F.lit("key"), (F.col("p_partkey") % 2).cast("double")).alias("parts"))
    return S.reward_metrics(p, ["p_brand"], "parts")


_S = "(SELECT DISTINCT coalesce(source, 'none') AS source, seq_id, input_ids, labels FROM tokenized_sft WHERE len(input_ids) > 4)"
_P = "CASE WHEN len(messages) > 1 AND messages[-1].role = 'assistant' THEN messages[1:len(messages) - 1] ELSE messages END"
_C = "(SELECT DISTINCT id, messages FROM reformat_datasets WHERE id IS NOT NULL AND len(messages) > 0)"
_T = "coalesce(m.content, '')"

QUERIES = {
    "pack_with_masks": (pack_with_masks, f"WITH RECURSIVE t AS (SELECT source, seq_id, len(list_filter(input_ids, lambda x: x <> 0)) AS n, len(list_filter(input_ids[CAST(floor(len(input_ids) / 2) AS INT) + 1:], lambda x: x <> 0)) AS a FROM {_S}), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq_id) AS rn FROM t), r AS (SELECT source, rn, n, a, n AS fill, CASE WHEN n > 2048 THEN 1 ELSE 0 END AS pack FROM o WHERE rn = 1 UNION ALL SELECT o.source, o.rn, o.n, o.a, CASE WHEN r.fill + o.n > 2048 THEN o.n ELSE r.fill + o.n END, CASE WHEN r.fill + o.n > 2048 THEN r.pack + 1 ELSE r.pack END FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1), k AS (SELECT source, pack, sum(n) AS n_tokens, count(*) AS n_seqs, sum(a) AS n_actions, max(n) - 1 AS last_position FROM r GROUP BY ALL UNION ALL SELECT source, 0, 0, 0, 0, NULL FROM o WHERE rn = 1 AND n > 2048) SELECT source, CAST(pack AS INT) AS pack, CAST(n_tokens AS INT) AS n_tokens, CAST(n_seqs AS INT) AS n_seqs, CAST(n_actions AS INT) AS n_actions, CAST(last_position AS INT) AS last_position FROM k"),
    "flattened_batches": (flattened_batches, f"WITH s AS (SELECT CAST(seq_id // 16 AS BIGINT) AS batch, seq_id, input_ids, list_concat([-100], labels[2:]) AS l FROM {_S}), b AS (SELECT batch, list(len(input_ids) ORDER BY seq_id) AS n, sum(len(list_filter(l, lambda x: x <> -100))) AS k FROM s GROUP BY 1) SELECT batch, CAST(list_sum(n) AS INT) AS n_tokens, CAST(k AS INT) AS n_labels, array_to_string(list_transform(range(0, len(n) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)), ',') AS ends, CAST(list_max(n) AS INT) AS max_length, md5(array_to_string(flatten(list_transform(n, lambda x: range(x))), ',')) AS positions FROM b"),
    "prompts": (prompts, f"WITH p AS (SELECT id, {_P} AS p FROM {_C}), q AS (SELECT id, CASE WHEN p[1].role = 'system' THEN p[2:] ELSE p END AS p FROM p) SELECT id, md5(array_to_string(list_concat(['system: Be brief.'], list_transform(p, lambda m: m.role || ': ' || {_T})), chr(10))) AS h, CAST(len(p) + 1 AS INT) AS n FROM q"),
    "prompt_lengths": (prompt_lengths, f"WITH p AS (SELECT id, {_P} AS p FROM {_C}), q AS (SELECT id, strlen(array_to_string(list_transform(p, lambda m, i: '<|' || m.role || '|>' || chr(10) || {_T} || CASE WHEN m.role = 'assistant' THEN '</s>' ELSE '' END || CASE WHEN m.role = 'assistant' AND i = len(p) THEN '' ELSE chr(10) END), '') || '<|assistant|>' || chr(10) || '<think>') AS n FROM p) SELECT id, CAST(n AS INT) AS n FROM q WHERE n <= 400"),
    "preference_lengths": (preference_lengths, "WITH m AS (SELECT DISTINCT prompt_hash, model, text, outputs[1].text AS a FROM model_outputs WHERE text IS NOT NULL AND len(outputs) > 0 AND outputs[1].text IS NOT NULL), t AS (SELECT prompt_hash, text, min(struct_pack(m := model, a := a)) AS x, max(struct_pack(m := model, a := a)) AS y FROM m GROUP BY ALL) SELECT prompt_hash, CAST(9 + strlen(text) + 1 + 14 + strlen(x.a) + 4 AS INT) AS n_chosen, CAST(strlen(x.a) + 4 AS INT) AS k_chosen, CAST(strlen(y.a) + 4 AS INT) AS k_rejected FROM t WHERE x.m < y.m"),
    "corpus_rows": (corpus_rows, "SELECT 'codefeedback_' || p_partkey AS id, 'codefeedback' AS source, 'user=' || p_name || '|assistant=' || p_type AS text FROM part"),
    "tags": (tags, "SELECT p_partkey FROM part WHERE p_size % 3 <> 0"),
    "unfinished": (unfinished, r"SELECT id, source FROM reformat_datasets WHERE id IS NOT NULL AND messages IS NOT NULL AND (len(list_filter(messages, lambda m: m.content IS NULL OR regexp_replace(m.content, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', '') = '')) > 0 OR coalesce(messages[-1].role, '') <> 'assistant')"),
    "kept_tests": (kept_tests, "SELECT l_orderkey, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (l_returnflag <> 'R') AS INT) AS n_kept FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R') >= 0.6 * count(*)"),
    "code_rewards": (code_rewards, "WITH g AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS p, avg(greatest(0, 1 - l_discount / 0.2)) AS u FROM lineitem GROUP BY 1), s AS (SELECT *, CASE WHEN p < 0.5 THEN 0 ELSE p END AS s FROM g) SELECT l_orderkey, round(s, 6) AS plain, round(s * u, 8) AS penalised FROM s"),
    "user_messages": (user_messages, "WITH c AS (SELECT DISTINCT id, messages FROM reformat_datasets WHERE id IS NOT NULL AND messages IS NOT NULL), x AS (SELECT id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS pos FROM c) SELECT id, CAST(pos AS INT) AS pos, md5(m.content) AS h FROM x WHERE m.role = 'user' AND m.content IS NOT NULL"),
    "zipped": (zipped, "SELECT c_custkey, s_suppkey, s_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer) JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) USING (k)"),
    "sampled_groups": (sampled_groups, "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42_' || o_orderkey), o_orderkey) AS k FROM orders) WHERE n >= 4 AND k <= 4"),
    "worker_batches": (worker_batches, "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3_' || o_orderkey)) - 1 AS i, count(*) OVER () AS n FROM orders), y AS (SELECT o_orderkey, CAST(i % 4 AS INT) AS rank, (i // 4) // 32 AS batch, i // 4 AS place, n // 4 AS m FROM x) SELECT rank, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(batch) AS last FROM y WHERE place < m AND batch < m // 32 GROUP BY 1"),
    "dataset_report": (dataset_report, "WITH t AS (SELECT DISTINCT source, seq_id, input_ids, labels FROM tokenized_sft WHERE input_ids IS NOT NULL), f AS (SELECT source, len(input_ids) AS n, len(list_filter(labels, lambda x: x <> -100)) AS k, len(input_ids) <= 256 AND len(list_filter(labels, lambda x: x <> -100)) > 0 AS ok FROM t), g AS (SELECT source, count(*) AS initial_rows, count(*) FILTER (ok) AS final_rows, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(k) FILTER (ok), 0) AS BIGINT) AS trained_tokens, coalesce(round(avg(n) FILTER (ok), 6), 0) AS mean_tokens, count(*) FILTER (NOT ok) AS filtered_rows FROM f GROUP BY 1) SELECT *, round(100.0 * tokens / sum(tokens) OVER (), 6) AS percent FROM g"),
    "verifier_metrics": (verifier_metrics, "WITH x AS (SELECT p_brand, 'size' AS verifier, p_size % 3 AS r FROM part UNION ALL SELECT p_brand, 'key', p_partkey % 2 FROM part) SELECT p_brand, verifier, count(*) AS n, round(avg(r), 6) AS mean_reward, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS correct_rate FROM x GROUP BY ALL"),
}
