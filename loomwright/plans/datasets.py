"""Queries on what single corpora need, loaders and packed returns, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import corpora as P
from loomwright.operators import rl as R
from loomwright.sources.tables import table


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_outputs").select("prompt_hash", "model", F.explode("outputs").alias("o")).select("prompt_hash", "model", F.col("o.index").alias("out_index"), F.col("o.text").alias("response")).distinct()


def corpus_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of model_outputs in subsets by a part of the model's name, and by a pattern."""
    m = table(spark, d, "model_outputs")
    named = P.with_subset(m, {"vell": "contains(model, 'vell')", "others": "NOT contains(model, 'vell')"}, exhaustive=True).groupBy("subset").agg(F.count("*").alias("n"))
    sized = P.model_matches(P.keep_models(m, ignore=["ostra-8b-chat"]), "-[0-9]+b").groupBy(F.lit("sized").alias("subset")).agg(F.count("*").alias("n"))
    return named.unionByName(sized)


def corpus_sampled(spark: SparkSession, d: str) -> DataFrame:
    """At most so many documents of each kind, by hash."""
    return P.sampled_subsets(table(spark, d, "documents"), "kind", "doc_id", {"essay": 100, "code_help": 20, "rating": 1_000_000}).select("kind", "doc_id")


def outputs_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every output of the prompts of annotation_mix, and how many there are."""
    prompts = table(spark, d, "annotation_mix").select("prompt_hash").distinct()
    return P.with_all_outputs(prompts, _outputs(spark, d), "prompt_hash").select("prompt_hash", "model", "out_index", "num_outputs", F.md5(F.coalesce("response", F.lit("?"))).alias("h"))


def question_rows(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as questions, with one answer and with several."""
    b = table(spark, d, "benchmark").select("item_id", "text", "eval_set", F.array("eval_set", F.lit('two "words"')).alias("many"))
    one = P.questions(b.drop("many"), "text", "eval_set", "Q: ", "?")
    several = P.questions(b.drop("eval_set"), "text", "many")
    flat = lambda x, kind: x.select("item_id", F.lit(kind).alias("kind"), F.md5(F.coalesce(F.element_at("messages", 1)["content"], F.lit("null"))).alias("h"), "ground_truth", "dataset")
    return flat(one, "one").unionByName(flat(several, "several"))


def problem_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as problems with answers, plain and with a length to think."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name").alias("problem"), "p_size")
    parts = [P.problems(p, "p_partkey", "problem", "p_size"), P.problems(p, "p_partkey", "problem", "p_size", 4096), P.problems(p, "p_partkey", "problem", "p_size", 8192, solve=False)]
    flat = [x.select("p_partkey", F.element_at("messages", 1)["content"].alias("content"), F.array_join("ground_truth", "|").alias("truth"), F.array_join("dataset", "|").alias("verifiers")) for x in parts]
    return flat[0].unionByName(flat[1]).unionByName(flat[2])


def bare_prompts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    form = F.when(k == 0, F.concat(F.lit("Human: "), "p_name", F.lit(" Assistant:"))).when(k == 1, F.concat(F.lit(" Human:"), "p_name")).otherwise(F.concat("p_name", F.lit(" Assistant: ")))
    return table(spark, d, "part").select("p_partkey", P.bare_prompt(form).alias("prompt"))


def thought_rows(spark: SparkSession, d: str) -> DataFrame:
    """First and second outputs of a prompt as reasoning and answer."""
    two = _outputs(spark, d).where("prompt_hash is not null and model is not null").groupBy("prompt_hash", "model").agg(F.min("response").alias("reasoning"), F.max("response").alias("answer"))
    x = P.thoughts(two.withColumn("question", F.col("prompt_hash")), "question", "reasoning", "answer")
    return x.select("prompt_hash", "model", F.md5(F.element_at("messages", 2)["content"]).alias("h"), F.md5(P.last_answer("messages")).alias("answer"), "dataset")


def enriched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels as results of a batch over documents: a quality for each label, the document's kind beside it."""
    results = table(spark, d, "labels").where("quality is not null").select("doc_id", "quality").distinct()
    return P.with_results(table(spark, d, "documents").select("doc_id", "kind"), results, "doc_id", [F.col("kind")])


def prompt_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per prompt the first text and the lists of models and of first outputs, by model and place."""
    m = _outputs(spark, d).where("out_index = 0 and model is not null")
    x = P.lists_per_prompt(m, "prompt_hash", [F.col("model"), F.coalesce("response", F.lit(""))], ["response"], {"model": "models", "response": "responses"})
    return x.select("prompt_hash", F.md5(F.coalesce("response", F.lit("?"))).alias("first"), F.array_join("models", ",").alias("models"), F.size("responses").alias("n"))


def versus(spark: SparkSession, d: str) -> DataFrame:
    """One model's first outputs against another's, on sides by hash."""
    m = _outputs(spark, d).where("out_index = 0 and model is not null and prompt_hash is not null").groupBy("prompt_hash", "model").agg(F.min("response").alias("response"))
    x = P.against_others(m.where("model <> 'vell-7b'"), m.where("model = 'vell-7b'"), "prompt_hash", "model", "response")
    return x.select("prompt_hash", F.element_at("models", 1).alias("left"), F.element_at("models", 2).alias("right"), F.md5(F.concat_ws("|", *(F.coalesce(F.element_at("completions", k), F.lit("?")) for k in (1, 2)))).alias("h"))


def loader_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The second epoch of one of three ranks, without what is excluded."""
    docs = table(spark, d, "documents").select("doc_id")
    return P.epoch_batches(docs, "doc_id", 3, 1, 16, seed=7, epoch=2, excluded=docs.where("doc_id % 5 = 0"))


def informative_first(spark: SparkSession, d: str) -> DataFrame:
    """Events of the first twenty users whose rewards differ."""
    e = table(spark, d, "events").withColumn("reward", F.col("event_id") % 3)
    return P.first_informative(e, "user_id", "reward", "event_id", 20).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


def picked_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    o = [F.col("c_custkey").desc()]
    return P.rows_at(c, o, slice(10, 40, 7)).unionByName(P.rows_at(c, o, [0, -1])).unionByName(P.rows_at(c, o, 5))


def packed_returns(spark: SparkSession, d: str) -> DataFrame:
    """Generalised advantages of each user's events as packed sequences, cut by done steps and by queries; mean over the responses."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")))).alias("x"))
    of = lambda f: F.transform("x", f)
    mask = of(lambda x: F.when(x["event_id"] % 5 == 0, 0).otherwise(2))
    a = R.gae(of(lambda x: x["v"]), of(lambda x: x["event_id"] % 3), of(lambda x: (x["event_id"] % 7 == 0).cast("int")), response=mask)
    e = e.withColumn("a", a)
    return e.select("user_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.round(R.masked_mean("a", of(lambda x: (x["event_id"] % 5 != 0).cast("int"))), 3).alias("mean"))


_O = "(SELECT DISTINCT prompt_hash, model, o.index AS out_index, o.text AS response FROM (SELECT prompt_hash, model, unnest(outputs) AS o FROM model_outputs))"
_LEN = "CAST(100 + floor(CAST(('0x' || substr(md5('42_' || p_partkey), 1, 8)) AS BIGINT) / 4294967296.0 * ({} - 100)) AS INT)"
_STEP = P.STEP_BY_STEP.replace("'", "''")
_GAE = """WITH e AS (SELECT user_id, event_id, row_number() OVER w AS t, coalesce(CAST(value AS DOUBLE), 0) AS v, lead(coalesce(CAST(value AS DOUBLE), 0)) OVER w AS nv, {stop} AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, event_id % 3 + CASE WHEN stop OR nv IS NULL THEN 0 ELSE nv END - v AS delta, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
a AS (SELECT a.user_id, a.event_id, sum(power(0.95, b.t - a.t) * b.delta) AS g FROM d a JOIN d b ON a.user_id = b.user_id AND a.seg = b.seg AND b.t >= a.t GROUP BY 1, 2)"""

QUERIES = {
    "corpus_subsets": (corpus_subsets, "SELECT CASE WHEN contains(model, 'vell') THEN 'vell' ELSE 'others' END AS subset, count(*) AS n FROM model_outputs GROUP BY 1 UNION ALL SELECT 'sized', count(*) FROM model_outputs WHERE model <> 'ostra-8b-chat' AND regexp_matches(model, '-[0-9]+b')"),
    "corpus_sampled": (corpus_sampled, "SELECT kind, doc_id FROM (SELECT kind, doc_id, row_number() OVER (PARTITION BY kind ORDER BY md5('42_' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= CASE kind WHEN 'essay' THEN 100 WHEN 'code_help' THEN 20 WHEN 'rating' THEN 1000000 ELSE 0 END"),
    "outputs_joined": (outputs_joined, f"WITH o AS {_O}, n AS (SELECT prompt_hash, count(*) AS num_outputs FROM o GROUP BY 1) SELECT prompt_hash, model, out_index, num_outputs, md5(coalesce(response, '?')) AS h FROM o JOIN n USING (prompt_hash) WHERE prompt_hash IN (SELECT prompt_hash FROM annotation_mix)"),
    "question_rows": (question_rows, "SELECT item_id, 'one' AS kind, md5(coalesce('Q: ' || text || '?', 'null')) AS h, eval_set AS ground_truth, 're_search' AS dataset FROM benchmark UNION ALL SELECT item_id, 'several', md5(coalesce(text, 'null')), '[\"' || eval_set || '\",\"two \\\"words\\\"\"]', 're_search' FROM benchmark"),
    "problem_rows": (
        problem_rows,
        f"SELECT p_partkey, p_name || '{_STEP}' AS content, CAST(p_size AS VARCHAR) AS truth, 'math' AS verifiers FROM part UNION ALL SELECT p_partkey, p_name || '{_STEP} Think for ' || {_LEN.format(4096)} || ' tokens.', p_size || '|' || {_LEN.format(4096)}, 'math|max_length' FROM part "
        f"UNION ALL SELECT p_partkey, p_name || '{_STEP} Think for ' || {_LEN.format(8192)} || ' tokens.', CAST({_LEN.format(8192)} AS VARCHAR), 'max_length' FROM part",
    ),
    "bare_prompts": (bare_prompts, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Human:' || p_name ELSE p_name || ' Assistant:' END AS prompt FROM part"),
    "thought_rows": (
        thought_rows,
        f"WITH o AS (SELECT prompt_hash, model, min(response) AS r, max(response) AS a FROM {_O} WHERE prompt_hash IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2) SELECT prompt_hash, model, md5('<think>' || r || '</think><answer>' || a || '</answer>') AS h, "
        "md5(replace(replace(string_split('</think><answer>' || a || '</answer>', '</think>')[-1], '<answer>', ''), '</answer>', '')) AS answer, 'thinker' AS dataset FROM o WHERE r <> '' AND a <> '' AND prompt_hash <> ''",
    ),
    "enriched_rows": (enriched_rows, "SELECT doc_id, kind, quality FROM (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL) JOIN documents USING (doc_id)"),
    "prompt_lists": (prompt_lists, f"SELECT prompt_hash, md5(coalesce(list(response ORDER BY model, coalesce(response, ''))[1], '?')) AS first, string_agg(model, ',' ORDER BY model) AS models, CAST(count(*) AS INT) AS n FROM {_O} WHERE out_index = 0 AND model IS NOT NULL GROUP BY 1"),
    "versus": (
        versus,
        f"WITH m AS (SELECT prompt_hash, model, min(response) AS r FROM {_O} WHERE out_index = 0 AND model IS NOT NULL AND prompt_hash IS NOT NULL GROUP BY 1, 2), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY md5('42_' || prompt_hash || '_' || model), model) AS rn FROM m WHERE model <> 'vell-7b') WHERE rn = 1), "
        "p AS (SELECT a.prompt_hash, a.model AS am, a.r AS ar, o.model AS bm, o.r AS br, CAST(('0x' || substr(md5('43_' || a.prompt_hash), 1, 8)) AS BIGINT) < 2147483648 AS swap FROM m a JOIN o USING (prompt_hash) WHERE a.model = 'vell-7b') "
        "SELECT prompt_hash, CASE WHEN swap THEN bm ELSE am END AS \"left\", CASE WHEN swap THEN am ELSE bm END AS \"right\", md5(CASE WHEN swap THEN coalesce(br, '?') || '|' || coalesce(ar, '?') ELSE coalesce(ar, '?') || '|' || coalesce(br, '?') END) AS h FROM p",
    ),
    "loader_epoch": (loader_epoch, "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), m AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9_' || doc_id), doc_id) - 1 AS i FROM r WHERE i % 3 = 1 AND doc_id % 5 <> 0) SELECT doc_id, CAST(i // 16 AS INT) AS batch FROM m WHERE i < (SELECT count(*) // 16 * 16 FROM m)"),
    "informative_first": (informative_first, "WITH g AS (SELECT user_id FROM events GROUP BY 1 HAVING min(event_id % 3) < max(event_id % 3) ORDER BY min(event_id), user_id LIMIT 20) SELECT user_id, count(*) AS n, CAST(sum(event_id % 3) AS BIGINT) AS reward FROM events WHERE user_id IN (SELECT user_id FROM g) GROUP BY 1"),
    "picked_rows": (picked_rows, "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE i BETWEEN 10 AND 39 AND (i - 10) % 7 = 0 UNION ALL SELECT c_custkey FROM r WHERE i IN (0, n - 1) UNION ALL SELECT c_custkey FROM r WHERE i = 5"),
    "packed_returns": (packed_returns, _GAE.format(stop="event_id % 7 = 0 OR event_id % 5 = 0") + " SELECT user_id, round(sum(g), 3) AS total, round(avg(g) FILTER (event_id % 5 <> 0), 3) AS mean FROM a GROUP BY 1"),
}
