"""Queries on conversations and texts: filters, repetition, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import filters as Q
from loomwright.operators import repetition as R
from loomwright.sources.tables import table

#: Words that occur in these tables; the filter's own list does not.
WORDS = ["compost", "photosynthesis", "sourdough", "rental agreement"]
_WORDS_SQL = "(?i)\\b(" + "|".join(WORDS) + ")\\b"
_CONV = "reformat_datasets"


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _CONV).where("id is not null and messages is not null")


_BASE = "SELECT * FROM reformat_datasets WHERE id IS NOT NULL AND messages IS NOT NULL"
_ASSISTANT = "list_filter(messages, lambda m: m.role = 'assistant')"
_KEYWORD = f"coalesce(len(list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL AND regexp_matches(m.content, '{_WORDS_SQL}'))) > 0, false)"
_EMPTY = r"(len(list_filter(messages, lambda m: m.content IS NULL OR regexp_replace(m.content, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', '') = '')) > 0)"
_TURNS = "CASE WHEN len(messages) > 0 AND messages[1].role = 'system' THEN messages[2:] ELSE messages END"
_ALTERNATION = f"(len(list_filter(list_transform({_TURNS}, lambda m, i: coalesce(m.role, '') = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END), lambda x: NOT x)) > 0)"
_LAST = f"CASE WHEN len({_ASSISTANT}) > 0 THEN list_last({_ASSISTANT}).content ELSE '' END"
_HAN = r"[\x{4e00}-\x{9fff}]"


def _ratio_sql(x: str, cls: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN CAST(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')) AS DOUBLE) / length({x}) ELSE 0 END"


_SCRIPT = f"(regexp_matches(coalesce({_LAST}, ''), '{_HAN}') AND {_ratio_sql(f'coalesce({_LAST}, chr(97))', _HAN)} >= 0.05)"


def _reasons() -> dict:
    return {"empty": Q.has_empty_message("messages"), "alternation": Q.bad_alternation("messages"), "keyword": Q.has_keyword("messages", WORDS), "script": Q.script_heavy("messages")}


def filter_report(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of each source by the first filter that removes them, ``kept`` for the others."""
    c = _conversations(spark, d).withColumn("reason", F.coalesce(Q.first_reason(**_reasons()), F.lit("kept")))
    return c.groupBy("source", "reason").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def _flagged(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _conversations(spark, d).where(_reasons()[name]).select("id", "source")

    return run


def filter_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity claims, put into derived texts: some of the patterns' forms, and one that is none."""
    c = _conversations(spark, d).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(" "), F.when(m["content"].contains("compost"), "I am called ChatGPT by all.").when(m["content"].contains("photosynthesis"), "It was trained by the people of Mistral AI last year.").otherwise("I know what ChatGPT is.")).alias("content"))))
    return c.where(Q.mentions_identity("messages")).select("id", "source")


def last_assistant_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of the last assistant message of each conversation."""
    return _conversations(spark, d).select("id", F.length(F.coalesce(Q.last_assistant("messages"), F.lit(""))).alias("n_chars"), F.size("messages").alias("n_messages"))


def turn_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Per source: turns, and lengths of user and assistant texts."""
    c = _conversations(spark, d).select("source", F.explode("messages").alias("m"))
    return c.groupBy("source", F.col("m.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"), F.max(F.length("m.content")).alias("longest"))


def keyword_substring(spark: SparkSession, d: str) -> DataFrame:
    """The older keyword filter: plain containment, not on word borders."""
    c = _conversations(spark, d)
    hit = F.exists(Q.contents("messages"), lambda x: F.coalesce(F.lower(x).contains("compost"), F.lit(False)))
    return c.where(hit).select("id")


def cutoff_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff phrases, on a derived text for every document."""
    t = table(spark, d, "documents").withColumn("t", F.concat(F.lit("As of my last update in "), F.when(F.col("doc_id") % 2 == 0, "March ").otherwise(""), (F.col("doc_id") % 30 + 2000).cast("string"), F.lit(". Knowledge cutoff 2021. "), F.col("text")))
    return t.select("doc_id", F.array_join(Q.cutoff_mentions("t"), "|").alias("mentions"))


def drop_by_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Conversations left when every id with a mention goes, copies included."""
    c = _conversations(spark, d)
    marked = c.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["content"].contains("compost"), F.concat(m["content"], F.lit(" Knowledge cutoff 2021."))).otherwise(m["content"]).alias("content"))))
    return Q.drop_by_cutoff(marked, "id", "messages").select("id", "source")


def think_format(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning format of each text, as it is and with answer tags added and removed again."""
    t = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"\A﻿", ""))
    added = Q.add_answer_tags("text")
    return t.select("doc_id", Q.is_think("text").alias("think"), Q.is_think_answer("text").alias("think_answer"), F.md5(added).alias("added"), F.md5(Q.remove_answer_tags(added)).alias("removed"))


def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(Q.without_special_tokens("text")).alias("h"))


def messages_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("id", F.md5(Q.messages_to_text("messages")).alias("h"))


def filter_toxic(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label calls toxic; unlabelled ones stay."""
    flags = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    t = table(spark, d, "documents").join(flags, "doc_id", "left")
    return t.where(~Q.toxic("toxic")).groupBy("lang").agg(F.count("*").alias("n"))


def filter_language(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.where(~Q.other_language("lang", "EN")).groupBy("source").agg(F.count("*").alias("n"))


def length_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(~Q.outside_words("text", 20, 120)).select("doc_id", F.size(X.split_ws("text")).alias("n_words"))


def repetition_flags(spark: SparkSession, d: str) -> DataFrame:
    """The first repetition over the filter's limits in each document."""
    t = table(spark, d, "documents").select("doc_id", R.repetition("text", R.Limits(2, 4, 2)).alias("r")).where("r is not null")
    return t.select("doc_id", "r.reason", "r.block")


def repetition_planted(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of texts with repetitions planted: paragraphs and sentences, over and under the filter's limits."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    one = lambda times, sep: F.array_join(F.array_repeat(F.concat(name, F.lit(" this time")), times), sep)
    apart = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.concat(name, F.lit(" this time\n\nPlan "), i.cast("string"))), "\n\n")
    text = F.when(k == 0, one(12, "\n\n")).when(k == 1, one(9, "\n\n")).when(k == 2, one(8, ". ")).when(k == 3, one(7, "! ")).when(k == 4, apart).otherwise(one(12, "? "))
    t = table(spark, d, "part").select("p_partkey", R.repetition(text).alias("r")).where("r is not null")
    return t.select("p_partkey", "r.reason", "r.block")


def repetition_islands(spark: SparkSession, d: str) -> DataFrame:
    return R.islands(table(spark, d, "documents"), "doc_id", X.sentences("text"))


def repeated_ngrams(spark: SparkSession, d: str) -> DataFrame:
    g = R.repeated_ngrams(table(spark, d, "documents"), "doc_id", "text", 5, 2)
    return g.groupBy("doc_id").agg(F.count("*").alias("n_ngrams"), F.max("n_times").alias("most"))


def placeholder_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A name is put in for a placeholder, and a system message set where there is none."""
    c = _conversations(spark, d)
    filled = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit("compost"), F.lit("the Compost")).alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit("You help.").alias("content")))
    out = F.when(F.exists("messages", lambda m: F.coalesce(m["role"] == "system", F.lit(False))), filled).otherwise(F.concat(first, filled))
    return c.select("id", F.size(out).alias("n"), F.md5(F.array_join(F.transform(out, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("h"))


_STRIP = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_STRIP}', ''), '{_STRIP}$', '')"


_SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: " + strip_sql("s") + "), lambda s: s <> '')"
_WORDLIST = f"list_filter(regexp_split_to_array(text, '{_STRIP}'), lambda s: s <> '')"
_ADD1 = "CASE WHEN contains(text, '</think>' || chr(10)) THEN text ELSE replace(text, '</think>', '</think>' || chr(10)) END"
_ADD2 = f"CASE WHEN contains({_ADD1}, '<answer>') THEN {_ADD1} ELSE replace({_ADD1}, '</think>', '</think>' || chr(10) || '<answer>') END"
_ADD3 = f"CASE WHEN ends_with({_ADD2}, '</answer>') THEN {_ADD2} ELSE {_ADD2} || chr(10) || '</answer>' END"
_ROLE = "CASE WHEN lower(m.role) IN ('user','human') THEN 'User' WHEN lower(m.role) IN ('assistant','ai') THEN 'Assistant' ELSE upper(lower(m.role)[1]) || lower(m.role)[2:] END"
_TOKENS = "replace(replace(replace(replace({x}, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', '')"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_CUTOFF_SQL = rf"((?i)(?:as\s+(?:of\s+)?(?:my\s+)?(?:last|latest)\s+(?:update|knowledge)(?:\s+was)?\s+in|knowledge\s+cutoff|last\s+updated?\s+in)\s+(?:(?:{_MONTHS})\s+)?(?:\d{{4}}))"

QUERIES = {
    "filter_report": (filter_report, f"WITH c AS (SELECT id, source, CASE WHEN {_EMPTY} THEN 'empty' WHEN {_ALTERNATION} THEN 'alternation' WHEN {_KEYWORD} THEN 'keyword' WHEN {_SCRIPT} THEN 'script' ELSE 'kept' END AS reason FROM ({_BASE})) SELECT source, reason, count(*) AS n, count(DISTINCT id) AS n_ids FROM c GROUP BY ALL"),
    "filter_keyword": (_flagged("keyword"), f"SELECT id, source FROM ({_BASE}) WHERE {_KEYWORD}"),
    "filter_empty": (_flagged("empty"), f"SELECT id, source FROM ({_BASE}) WHERE {_EMPTY}"),
    "filter_alternation": (_flagged("alternation"), f"SELECT id, source FROM ({_BASE}) WHERE {_ALTERNATION}"),
    "filter_script": (_flagged("script"), f"SELECT id, source FROM ({_BASE}) WHERE {_SCRIPT}"),
    "filter_identity": (filter_identity, f"SELECT id, source FROM ({_BASE}) WHERE len(list_filter(messages, lambda m: m.role = 'assistant' AND (m.content IS NULL OR contains(m.content, 'compost') OR contains(m.content, 'photosynthesis')))) > 0"),
    "filter_keyword_substring": (keyword_substring, f"SELECT id FROM ({_BASE}) WHERE len(list_filter(messages, lambda m: m.content IS NOT NULL AND contains(lower(m.content), 'compost'))) > 0"),
    "last_assistant_length": (last_assistant_length, f"SELECT id, CAST(length(coalesce({_LAST}, '')) AS INT) AS n_chars, CAST(len(messages) AS INT) AS n_messages FROM ({_BASE})"),
    "turn_lengths": (turn_lengths, f"SELECT source, m.role AS role, count(*) AS n, CAST(sum(length(m.content)) AS BIGINT) AS chars, CAST(max(length(m.content)) AS INT) AS longest FROM (SELECT source, unnest(messages) AS m FROM ({_BASE})) GROUP BY ALL"),
    "cutoff_mentions": (cutoff_mentions, f"SELECT doc_id, array_to_string(regexp_extract_all('As of my last update in ' || CASE WHEN doc_id % 2 = 0 THEN 'March ' ELSE '' END || CAST(doc_id % 30 + 2000 AS VARCHAR) || '. Knowledge cutoff 2021. ' || text, '{_CUTOFF_SQL}', 1), '|') AS mentions FROM documents"),
    "drop_by_cutoff": (drop_by_cutoff, f"SELECT id, source FROM ({_BASE}) WHERE id NOT IN (SELECT id FROM ({_BASE}) WHERE len(list_filter(messages, lambda m: m.content IS NOT NULL AND contains(m.content, 'compost'))) > 0)"),
    "think_format": (think_format, f"WITH t AS (SELECT doc_id, regexp_replace(text, '^\\x{{feff}}', '') AS text FROM documents) SELECT doc_id, regexp_full_match(text, '(?s)<think>.*?</think>.*') AS think, regexp_full_match(text, '(?s)<think>.*?</think><answer>.*?</answer>') AS think_answer, md5({_ADD3}) AS added, md5((SELECT CASE WHEN contains(y, '</think>' || chr(10)) THEN y ELSE replace(y, '</think>', '</think>' || chr(10)) END FROM (SELECT {strip_sql(f'replace(replace({_ADD3}, chr(60) || chr(97) || chr(110) || chr(115) || chr(119) || chr(101) || chr(114) || chr(62), chr(0)), chr(60) || chr(47) || chr(97) || chr(110) || chr(115) || chr(119) || chr(101) || chr(114) || chr(62), chr(0))')} AS y))) AS removed FROM t".replace("chr(60) || chr(97) || chr(110) || chr(115) || chr(119) || chr(101) || chr(114) || chr(62), chr(0)", "'<answer>', ''").replace("chr(60) || chr(47) || chr(97) || chr(110) || chr(115) || chr(119) || chr(101) || chr(114) || chr(62), chr(0)", "'</answer>', ''")),
    "special_tokens": (special_tokens, f"SELECT doc_id, md5({_TOKENS.format(x='text')}) AS h FROM documents"),
    "messages_to_text": (messages_to_text, f"SELECT id, md5(array_to_string(list_transform(list_filter(messages, lambda m: m.content <> ''), lambda m: {_ROLE} || ': ' || {_TOKENS.format(x='m.content')}), chr(10) || chr(10))) AS h FROM ({_BASE})"),
    "filter_toxic": (filter_toxic, "SELECT lang, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE coalesce(toxic, 0) = 0 GROUP BY 1"),
    "filter_language": (filter_language, "SELECT source, count(*) AS n FROM documents WHERE lower(lang) = 'en' GROUP BY 1"),
    "length_band": (length_band, f"SELECT doc_id, CAST(len({_WORDLIST}) AS INT) AS n_words FROM documents WHERE len({_WORDLIST}) BETWEEN 20 AND 120"),
    "repetition_flags": (repetition_flags, None),
    "repetition_planted": (repetition_planted, "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'paragraph_repeated_12x' WHEN 2 THEN 'line_repeated_8x_consecutive_short_phrase' WHEN 4 THEN 'paragraph_repeated_31x' ELSE 'line_repeated_12x_consecutive_short_phrase' END AS reason, p_name || ' this time' AS block FROM part WHERE p_partkey % 6 IN (0, 2, 5) OR (p_partkey % 6 = 4 AND length(p_name) >= 10)"),
    "repetition_islands": (repetition_islands, f"WITH s AS (SELECT doc_id, {_SENT} AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS pos FROM s), y AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) AS g FROM x WHERE length(item) >= 5), r AS (SELECT doc_id, item, g, count(*) AS run, min(pos) AS first FROM y GROUP BY ALL) SELECT doc_id, item, CAST(sum(run) AS BIGINT) AS n, max(run) AS longest_run, CAST(min(first) AS INT) AS first_pos FROM r GROUP BY 1, 2 HAVING sum(run) > 1"),
    "repeated_ngrams": (repeated_ngrams, f"WITH w AS (SELECT doc_id, {_WORDLIST.replace('text', 'lower(text)')} AS l FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) AS ngram FROM w), c AS (SELECT doc_id, ngram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, count(*) AS n_ngrams, max(n) AS most FROM c GROUP BY 1"),
    "placeholder_rewrite": (placeholder_rewrite, f"WITH c AS (SELECT id, list_transform(messages, lambda m: {{'role': m.role, 'content': replace(m.content, 'compost', 'the Compost')}}) AS f, len(list_filter(messages, lambda m: m.role = 'system')) > 0 AS s FROM ({_BASE})), o AS (SELECT id, CASE WHEN s THEN f ELSE list_concat([{{'role': 'system', 'content': 'You help.'}}], f) END AS f FROM c) SELECT id, CAST(len(f) AS INT) AS n, md5(array_to_string(list_transform(f, lambda m: concat_ws(':', m.role, m.content)), '|')) AS h FROM o"),
}
