"""Queries on formats: templates, masks, converters, judges, mathematics, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import judge as J
from loomwright.functions import latex as L
from loomwright.functions import text as X
from loomwright.functions import verify as V
from loomwright.operators import chat as C
from loomwright.operators import convert as CV
from loomwright.operators import stats as S
from loomwright.plans.cache import Pipeline
from loomwright.plans.conversations import strip_sql
from loomwright.plans.rules import _strip, _words
from loomwright.sources.tables import table
from loomwright.streaming import queries as ST


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reformat_datasets").where("id is not null and messages is not null").select("id", "messages").distinct()


_C = "(SELECT DISTINCT id, messages FROM reformat_datasets WHERE id IS NOT NULL AND messages IS NOT NULL)"
_N = "len(messages)"


def _chat(name: str, generation: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _conv(spark, d).select("id", F.md5(C.render("messages", name, add_generation=generation)).alias("h"))

    return run


def label_mask(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and kept labels of each conversation, with bytes as tokens."""
    t = C.tokenize_masked(_conv(spark, d), "id", "messages", C.byte_tokenizer(), C.Masking("assistant", template="zephyr", eos="</s>"))
    return t.select("id", F.size("input_ids").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_kept"))


def label_mask_last(spark: SparkSession, d: str) -> DataFrame:
    """Only the last turn is learned; rows are cut at 512 tokens and kept when a label is left."""
    t = C.tokenize_masked(_conv(spark, d), "id", "messages", C.byte_tokenizer(), C.Masking("last", 512, "tagged"))
    return t.where(C.has_labels("labels") & C.fits("input_ids", 512)).select("id", F.size("input_ids").alias("n_tokens"))


def truncated_messages(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    t = C.truncate_messages("messages", 400, size)
    return _conv(spark, d).select("id", F.size(t).alias("n"), F.aggregate(t, F.lit(0), lambda a, m: a + size(m["content"])).alias("chars"))


def chunked_dialogues(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(X.split_ws(c)), F.lit(0))
    c = CV.chunk_dialogue("messages", size, 150)
    return _conv(spark, d).select("id", F.size(c).alias("n_chunks"), F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x)).alias("n_messages"))


def convert_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and outputs of model_outputs as conversations, dispatched by their columns."""
    m = table(spark, d, "model_outputs").where("text is not null").select("prompt_hash", "model", F.col("text").alias("prompt"), F.explode("outputs").alias("o")).select("prompt_hash", "model", "prompt", F.col("o.index").alias("out_index"), F.col("o.text").alias("completion")).distinct()
    return CV.to_messages(m).select("prompt_hash", "model", "out_index", F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws("=", x["role"], F.coalesce(x["content"], F.lit("?")))), "|")).alias("h"))


def convert_instruction(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("instruction"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("input"), F.col("p_brand").alias("output"))
    return CV.to_messages(t).select("p_partkey", F.md5(F.element_at("messages", 1)["content"]).alias("prompt"), F.element_at("messages", 2)["content"].alias("answer"))


def convert_turns(spark: SparkSession, d: str) -> DataFrame:
    """From/value turns back to roles and contents."""
    t = _conv(spark, d).where("size(messages) > 0").withColumn("conversations", F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "gpt").when(m["role"] == "user", "human").otherwise("system").alias("from"), m["content"].alias("value"))))
    return CV.to_messages(t.drop("messages")).select("id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


def marked_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Chats of documents parsed from their speaker marks."""
    t = table(spark, d, "documents").withColumn("m", CV.marked_dialogue(F.concat(F.lit("\n"), "text"), "\nUser: ", "\nAssistant: "))
    return t.select("doc_id", F.size("m").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|")).alias("h"))


def lettered_choices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.max("n_name").alias("best"))
    lines, letter = CV.lettered("names", "best")
    return t.select("n_regionkey", lines.alias("lines"), letter.alias("letter"))


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from derived judge answers."""
    k = F.col("n_nationkey")
    t = table(spark, d, "nation").select("n_nationkey", F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("/30"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("%"))).when(k % 4 == 2, F.lit("This is incorrect")).otherwise(F.lit("so bad")).alias("free"), F.concat(F.lit('```json\n{"REASONING": "a\nb", "SCORE": "'), k.cast("string"), F.lit('"}\n```')).alias("json"), F.when(k % 2 == 0, "Final Decision: Yes").otherwise("final decision: no").alias("decision"))
    return t.select("n_nationkey", F.round(J.free_score("free"), 6).alias("free"), J.json_score("json").alias("json"), J.judge_score("quality", "json").alias("of_10"), J.decision_score("decision").alias("decision"))


@F.udf(T.BooleanType(), useArrow=True)
def _equal(a: str, b: str) -> bool:
    return L.equal(a, b)


def math_equal(spark: SparkSession, d: str) -> DataFrame:
    """Two fractions made from a part's keys in several spellings: equal where cross products are."""
    p = table(spark, d, "part").where("p_size > 0").select("p_partkey", "p_size", *(F.expr(f"int(p_partkey % {n} + 1)").alias(c) for c, n in (("k", 12), ("a", 50), ("b", 6))))
    one, two = F.format_string("\\frac{%d}{%d}", "p_size", "k"), F.format_string("%d/%d", "a", "b")
    spelled = F.format_string("\\dfrac{%d}{%d}", "a", "b")
    root = F.format_string("\\sqrt{%d}", F.col("p_size") * F.col("p_size"))
    return p.select("p_partkey", _equal(one, two).alias("slash"), _equal(one, spelled).alias("display"), _equal(root, F.col("a").cast("string")).alias("root"), _equal(F.format_string("%d(x+%d)", "a", "b"), F.format_string("%dx+%d", "a", F.col("p_size") * F.col("b"))).alias("factored"))


def math_verifier(spark: SparkSession, d: str) -> DataFrame:
    """Boxed sizes against another number of the part, and with a nought behind."""
    p = table(spark, d, "part").select("p_partkey", F.format_string("So we get \\boxed{%d} in all.", "p_size").alias("a"), F.expr("string(p_partkey % 50 + 1)").alias("y"))
    return p.select("p_partkey", V.score_column(F.lit("math"), "a", "y").alias("math"), V.score_column(F.lit("gsm8k"), F.concat("a", F.lit(" 0")), F.concat("y", F.lit("0"))).alias("last"))


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The last fenced block of each text."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length(X.last_code_block("text")).alias("n"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """What reasoning texts answer: the part behind the reasoning."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(X.without_thinking("text")).alias("last"), F.md5(X.final_answer("text")).alias("first"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A registered chain of a filter, a map and pruned columns, provenance kept."""
    p = Pipeline()
    p.register("english", lambda: F.col("lang") == "en", "filter")
    p.register("measure", lambda df, scale: df.withColumn("n", F.length("text") * scale))
    docs = table(spark, d, "documents").withColumn("dataset_source", F.lit("documents"))
    return p.run(docs, ["english", "measure"], {"measure": {"scale": 2}}, ["doc_id", "text", "lang", "n"]).select("doc_id", "n", "dataset_source")


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Scores of tasks side by side, those out of 100 rescaled."""
    e = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(7)).alias("model"), "event_type").agg(F.avg("value").alias("s"))
    top = F.max("s").over(Window.partitionBy("event_type"))
    e = e.withColumn("s", F.when(top > 1, F.col("s") / 100).otherwise(F.col("s")))
    types = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy("model").pivot("event_type", types).agg(F.round(F.first("s"), 4))


# ---- Streams ---------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return ST.stream_table(spark, f"{d}/events.parquet")


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stateless filter of a stream of files."""
    s = _stream(spark, d).where("value > 10").select("event_id", "user_id", F.round("value", 6).alias("value"))
    return ST.run_once(s, "filter")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day and type as the stream's last word on them."""
    w = _stream(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = ST.run_once(w.select(F.col("w.start").alias("start"), "event_type", "n"), "tumbling", "complete")
    last = S.latest(out, ["start", "event_type"], [F.col("_batch").desc()])
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows with a watermark; windows still open at the end are not told yet."""
    return ST.run_once(ST.windowed(_stream(spark, d), "ts", ["event_type"], "2 days", "1 day", "1 day"), "sliding").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    s = ST.sessions(_stream(spark, d), "ts", "user_id", "6 hours", "1 day")
    return ST.run_once(s, "sessions").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Users whose share of purchases reaches a rate, told once, with state per user."""
    s = _stream(spark, d).withColumn("ok", (F.col("value") > 20).cast("int"))
    return ST.run_once(ST.excluded_prompts(s, "user_id", "ok", 10, 0.3), "excluded").select("user_id")


_ROLE_CAP = "upper(m.role[1]) || lower(m.role[2:])"
_TXT = "coalesce(m.content, '')"
_ZEPHYR = f"array_to_string(list_transform(messages, lambda m: '<|' || m.role || '|>' || chr(10) || {_TXT} || '</s>' || chr(10)), '')"

#: SQL for the turns of each conversation, numbered.
_TURNS = f"WITH c AS (SELECT row_number() OVER () AS rid, id, messages FROM {_C}), u AS (SELECT rid, m.role AS role, m.content AS content, i FROM (SELECT rid, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM c))"

QUERIES = {
    "chat_simple": (_chat("simple_chat"), f"SELECT id, md5(array_to_string(list_transform(messages, lambda m: {_ROLE_CAP} || ': ' || {_TXT}), chr(10) || chr(10)) || '</s>') AS h FROM {_C}"),
    "chat_concat": (_chat("simple_concat_with_space"), f"SELECT id, md5(array_to_string(list_transform(messages, lambda m: {_TXT}), ' ') || '</s>') AS h FROM {_C}"),
    "chat_assistant_only": (_chat("assistant_message_only"), f"SELECT id, md5(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: {_TXT}), '')) AS h FROM {_C}"),
    "chat_zephyr": (_chat("zephyr", True), f"SELECT id, md5({_ZEPHYR} || '<|assistant|>' || chr(10)) AS h FROM {_C}"),
    "chat_tagged": (_chat("tagged"), f"SELECT id, md5(array_to_string(list_transform(messages, lambda m, i: '<|' || m.role || '|>' || chr(10) || {_TXT} || CASE WHEN m.role = 'assistant' THEN '</s>' ELSE '' END || CASE WHEN m.role = 'assistant' AND i = {_N} THEN '' ELSE chr(10) END), '')) AS h FROM {_C}"),
    "chat_bracketed": (_chat("bracketed"), f"SELECT id, md5(CASE WHEN len(list_filter(messages, lambda m: m.role = 'system')) > 0 THEN '' ELSE '<|im_start|>system' || chr(10) || 'You are a helpful AI assistant.{C.NO_FUNCTIONS}<|im_end|>' || chr(10) END || array_to_string(list_transform(messages, lambda m, i: '<|im_start|>' || m.role || chr(10) || {_TXT} || CASE WHEN m.role = 'assistant' AND i = {_N} THEN '</s>' WHEN m.role = 'system' THEN '{C.NO_FUNCTIONS}<|im_end|>' || chr(10) ELSE '<|im_end|>' || chr(10) END), '')) AS h FROM {_C}"),
    "chat_r1": (_chat("r1_simple_chat", True), f"SELECT id, md5('{C.R1_PREAMBLE.replace(chr(10), '')}' || chr(10) || chr(10) || array_to_string(list_transform(messages, lambda m: {_ROLE_CAP} || ': ' || {_TXT} || chr(10)), chr(10) || chr(10)) || 'Assistant:') AS h FROM {_C}"),
    "label_mask": (label_mask, f"SELECT id, CAST(coalesce(list_sum(list_transform(messages, lambda m: strlen('<|' || m.role || '|>') + 1 + strlen({_TXT}) + 5)), 0) AS INT) AS n_tokens, CAST(coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: strlen({_TXT}) + 5)), 0) AS INT) AS n_kept FROM {_C}"),
    "label_mask_last": (
        label_mask_last,
        f"{_TURNS}, l AS (SELECT *, count(*) OVER (PARTITION BY rid) AS n, strlen('<|' || role || '|>') + 1 AS head, strlen(coalesce(content, '')) AS body FROM u), "
        "t AS (SELECT *, head + body + CASE WHEN role <> 'assistant' THEN 1 WHEN i = n THEN 4 ELSE 5 END AS size FROM l), "
        "g AS (SELECT rid, sum(size) AS total, coalesce(sum(size) FILTER (i < n), 0) + coalesce(sum(head) FILTER (i = n AND role = 'assistant'), 0) AS before FROM t GROUP BY 1) "
        "SELECT c.id, CAST(least(g.total, 512) AS INT) AS n_tokens FROM c JOIN g USING (rid) WHERE g.before < 512",
    ),
    "truncated_messages": (
        truncated_messages,
        f"{_TURNS}, r AS (SELECT *, sum(coalesce(length(content), 0)) OVER (PARTITION BY rid ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, i) AS s FROM u) "
        "SELECT c.id, CAST(count(r.i) FILTER (r.s <= 400) AS INT) AS n, CAST(coalesce(sum(length(r.content)) FILTER (r.s <= 400), 0) AS INT) AS chars FROM c LEFT JOIN r USING (rid) GROUP BY c.rid, c.id",
    ),
    "chunked_dialogues": (
        chunked_dialogues,
        f"{_TURNS.replace('WITH', 'WITH RECURSIVE')}, p AS (SELECT rid, (i - 1) // 2 AS j, sum(coalesce(len({_words('content')}), 0) + 6) AS w FROM u GROUP BY 1, 2 HAVING count(*) = 2), q AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY j) AS k FROM p WHERE w <= 150), "
        "g AS (SELECT rid, k, w AS n, 1 AS chunks FROM q WHERE k = 1 UNION ALL SELECT q.rid, q.k, CASE WHEN g.n + q.w <= 150 THEN g.n + q.w ELSE q.w END, g.chunks + CASE WHEN g.n + q.w <= 150 THEN 0 ELSE 1 END FROM g JOIN q ON q.rid = g.rid AND q.k = g.k + 1) "
        "SELECT c.id, CAST(coalesce(max(g.chunks), 0) AS INT) AS n_chunks, CAST(coalesce(max(g.k) * 2, 0) AS INT) AS n_messages FROM c LEFT JOIN g USING (rid) GROUP BY c.rid, c.id",
    ),
    "convert_pairs": (convert_pairs, "SELECT DISTINCT prompt_hash, model, o.index AS out_index, md5('user=' || text || '|assistant=' || coalesce(o.text, '?')) AS h FROM (SELECT prompt_hash, model, text, unnest(outputs) AS o FROM model_outputs WHERE text IS NOT NULL)"),
    "convert_instruction": (convert_instruction, "SELECT p_partkey, md5(" + "CASE WHEN p_partkey % 2 = 0 THEN '" + CV.WITH_INPUT.replace("{0}", "' || p_name || '").replace("{1}", "' || p_type || '").replace("\n", "' || chr(10) || '") + "' ELSE '" + CV.WITHOUT_INPUT.replace("{0}", "' || p_name || '").replace("\n", "' || chr(10) || '") + "' END) AS prompt, p_brand AS answer FROM part"),
    "convert_turns": (convert_turns, f"SELECT id, array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles FROM {_C} WHERE len(messages) > 0"),
    "marked_dialogues": (
        marked_dialogues,
        "WITH s AS (SELECT doc_id, string_split(replace(replace(chr(10) || text, chr(10) || 'User: ', chr(1) || 'U'), chr(10) || 'Assistant: ', chr(1) || 'A'), chr(1))[2:] AS x FROM documents), "
        f"t AS (SELECT doc_id, list_transform(list_filter(x, lambda p: p[1] = 'U'), lambda p: {_strip('p[2:]')}) AS us, list_transform(list_filter(x, lambda p: p[1] = 'A'), lambda p: {_strip('p[2:]')}) AS bs FROM s) "
        "SELECT doc_id, CAST(2 * least(len(us), len(bs)) AS INT) AS n, md5(array_to_string(list_transform(range(1, least(len(us), len(bs)) + 1), lambda i: us[i] || '|' || bs[i]), '|')) AS h FROM t",
    ),
    "lettered_choices": (lettered_choices, "WITH l AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_name) AS k FROM nation) SELECT n_regionkey, string_agg(chr(CAST(64 + k AS INT)) || '. ' || n_name, chr(10) ORDER BY k) AS lines, chr(CAST(64 + max_by(k, n_name) AS INT)) AS letter FROM l GROUP BY 1"),
    "judge_scores": (judge_scores, "SELECT n_nationkey, round(CASE n_nationkey % 4 WHEN 0 THEN n_nationkey / 30 WHEN 1 THEN n_nationkey / 100 WHEN 2 THEN 1.0 ELSE 0.0 END, 6) AS free, CAST(n_nationkey AS DOUBLE) AS json, n_nationkey / 10 AS of_10, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS decision FROM nation"),
    "math_equal": (math_equal, "SELECT p_partkey, p_size * b = a * k AS slash, p_size * b = a * k AS display, p_size = a AS root, a * b = p_size * b AS factored FROM (SELECT *, p_partkey % 12 + 1 AS k, p_partkey % 50 + 1 AS a, p_partkey % 6 + 1 AS b FROM part) WHERE p_size > 0"),
    "math_verifier": (math_verifier, "SELECT p_partkey, CAST(p_size = p_partkey % 50 + 1 AS DOUBLE) AS math, CAST(0 AS DOUBLE) AS last FROM part"),
    "code_blocks": (code_blocks, f"WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)```(?:python)?(.*?)```', 1) AS l FROM documents) SELECT doc_id, CAST(CASE WHEN len(l) > 0 THEN length({strip_sql('l[-1]')}) ELSE length(text) END AS INT) AS n FROM b"),
    "answers": (answers, f"""WITH s AS (SELECT doc_id, text, {strip_sql("replace(text, '<|assistant|>', '')")} AS t FROM documents) SELECT doc_id, md5({strip_sql("replace(replace(string_split(t, '</think>')[-1], '<answer>', ''), '</answer>', '')")}) AS last,
md5(CASE WHEN regexp_matches(text, '(?s)<answer>.*?</answer>') THEN {strip_sql("regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1)")} WHEN contains(text, '</think>') THEN {strip_sql("regexp_extract(text, '(?s)^.*?</think>(.*)$', 1)")} ELSE t END) AS first FROM s"""),
    "pipeline": (pipeline, "SELECT doc_id, CAST(length(text) * 2 AS INT) AS n, 'documents' AS dataset_source FROM documents WHERE lang = 'en'"),
    "leaderboard": (leaderboard, "WITH e AS (SELECT user_id % 7 AS model, event_type, avg(value) AS s FROM events GROUP BY ALL), t AS (SELECT model, event_type, CASE WHEN max(s) OVER (PARTITION BY event_type) > 1 THEN s / 100 ELSE s END AS s FROM e) SELECT model, " + ", ".join(f"round(max(s) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM t GROUP BY 1"),
    "stream_filter": (stream_filter, "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value > 10"),
    "stream_tumbling": (stream_tumbling, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    # The table is one file, so one micro-batch sets the watermark and an empty one closes what it passes.
    "stream_sliding": (
        stream_sliding,
        "WITH e AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY s, event_type",
    ),
    "stream_sessions": (
        stream_sessions,
        "WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b) "
        "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    ),
    "stream_excluded": (stream_excluded, "SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (value > 20) >= 0.3 * count(*)"),
}
