"""Queries on corpora: decontamination, duplicates, statistics, offsets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import decontam as D
from loomwright.operators import mix as M
from loomwright.operators import stats as S
from loomwright.operators import tables as TB
from loomwright.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark")


def decontam_exact(spark: SparkSession, d: str) -> DataFrame:
    return D.phrase_matches(_docs(spark, d), _bench(spark, d), "doc_id", "item_id")


def decontam_ngram(spark: SparkSession, d: str) -> DataFrame:
    return D.ngram_coverage(_docs(spark, d), _bench(spark, d), "doc_id", "item_id").select("doc_id", "item_id", F.round("score", 6).alias("score"))


def decontam_drop(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    kept = D.drop_contaminated(docs, D.ngram_coverage(docs, _bench(spark, d), "doc_id", "item_id"), "doc_id", 0.5)
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


SETS = ["arithqa", "codeprobe", "lawdrill", "sciprobe"]


def decontam_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of matches per source of the documents and evaluation set."""
    docs, items = _docs(spark, d), _bench(spark, d)
    m = D.ngram_coverage(docs, items, "doc_id", "item_id").join(docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("source")), "doc_id").join(items.select("item_id", "eval_set"), "item_id")
    wide = D.contamination_matrix(m, "source", "eval_set", "score", SETS)
    return wide.select("source", *[F.round(c, 4).alias(c) for c in SETS])


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest five rows of every row whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return D.vector_topk(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding").select("query", "hit", "rank", F.round("score", 6).alias("score"))


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with one text, the last added."""
    docs = _docs(spark, d).withColumn("h", F.md5("text"))
    return M.last_duplicate(docs, ["h"], [F.col("added_at").desc_nulls_last(), F.col("doc_id").desc()]).select("h", "doc_id")


def dedup_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of model_outputs that no conversation opens with."""
    opened = table(spark, d, "reformat_datasets").select(F.explode("messages").alias("m")).where("m.role = 'user' and m.content is not null").select(F.lower(F.trim("m.content")).alias("k"))
    out = table(spark, d, "model_outputs").where("text is not null").select("prompt_hash", "text").distinct()
    return M.unmatched(out, opened, F.lower(F.trim("text")), F.col("k")).select("prompt_hash")


def describe_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("n", F.length("text"))
    return S.describe(docs, ["source"], {"chars": F.col("n")})


def length_counters(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("kind").agg(F.count("*").alias("n"), *S.counts_above(F.length("text")))


def histogram_fixed(spark: SparkSession, d: str) -> DataFrame:
    return S.fixed_bins(S.merge_rare(_docs(spark, d), "source", 60), F.length("text"), 0, 4000, 16, ["source"])


def histogram_log(spark: SparkSession, d: str) -> DataFrame:
    return S.log_bins(_docs(spark, d), F.length("text"), 2, ["lang"])


def source_percent(spark: SparkSession, d: str) -> DataFrame:
    g = _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return S.with_percent(g, "chars")


def top_longest(spark: SparkSession, d: str) -> DataFrame:
    """The report of the hundred longest documents."""
    return M.first_by_key(_docs(spark, d).select("doc_id", F.length("text").alias("n")), 100, F.col("n").desc(), F.col("doc_id"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents laid end to end and cut into chunks: the stretch of each document in each chunk it touches."""
    return TB.chunk_boundaries(_docs(spark, d).select("doc_id", F.length("text").alias("n")), "doc_id", "n", 10_000)


def cube_source_lang(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).cube("kind", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))
    return c


def rollup_added(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).withColumn("day", F.to_date("added_at").cast("string"))
    return x.rollup("kind", "day").agg(F.count("*").alias("n"))


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a forest: the events of a user form a tree, walked along the best child."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("quality"))
    return TB.best_paths(TB.forest(e, "event_id", "user_id"), "event_id", "parent", "quality", top_k=1).select("event_id", "depth", "root")


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return S.latest(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_type", "event_id")


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of rows."""
    return _docs(spark, d).select("doc_id", F.sha2(F.concat("text", F.col("doc_id").cast("string")), 256).alias("sha"), F.concat_ws("_", F.lit("documents"), F.col("doc_id").cast("string"), F.lit("train")).alias("row_id"))


def row_index(spark: SparkSession, d: str) -> DataFrame:
    return M.global_index(_docs(spark, d).select("doc_id"), [M.shuffle_key(7, "doc_id")]).select("doc_id", F.col("_row_idx").alias("row_idx"))


_TOK = r'''list_filter(regexp_split_to_array(lower(text), '[ ,.?!:;()"\-\n\\]+'), lambda x: x <> '')'''
_GRAMS = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))"
_NGRAM = f"""WITH it AS (SELECT item_id, {_TOK} AS w FROM benchmark WHERE text IS NOT NULL), ig AS (SELECT item_id, len(w) AS l, unnest({_GRAMS}) AS g, generate_subscripts({_GRAMS}, 1) - 1 AS p FROM it),
il AS (SELECT item_id, l, g, max(p) AS p FROM ig GROUP BY ALL), tr AS (SELECT doc_id, {_TOK} AS w FROM documents), tg AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM tr),
m AS (SELECT doc_id, item_id, l, p FROM tg JOIN il USING (g)), c AS (SELECT DISTINCT doc_id, item_id, l, p + k AS pos FROM m, (SELECT unnest(range(8)) AS k)),
s AS (SELECT doc_id, item_id, count(*) / l AS score FROM c GROUP BY doc_id, item_id, l)"""

QUERIES = {
    "decontam_exact": (decontam_exact, f"WITH it AS (SELECT item_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS p FROM benchmark WHERE text IS NOT NULL AND len({_TOK}) > 0), tr AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents) SELECT DISTINCT doc_id, item_id FROM tr JOIN it ON contains(t, p)"),
    "decontam_ngram": (decontam_ngram, _NGRAM + " SELECT doc_id, item_id, round(score, 6) AS score FROM s"),
    "decontam_drop": (decontam_drop, _NGRAM + " SELECT kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE score > 0.5) GROUP BY 1"),
    "decontam_report": (decontam_report, _NGRAM + ", j AS (SELECT coalesce(source, 'none') AS source, eval_set, score FROM s JOIN documents USING (doc_id) JOIN benchmark USING (item_id)) SELECT source, " + ", ".join(f"round(coalesce(avg(score) FILTER (eval_set = '{x}'), 0), 4) AS {x}" for x in SETS) + " FROM j GROUP BY 1"),
    "vector_topk": (vector_topk, "WITH p AS (SELECT a.vec_id AS query, b.vec_id AS hit, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, hit) AS rank FROM p) SELECT query, hit, CAST(rank AS INT) AS rank, round((1 + s) / 2, 6) AS score FROM r WHERE rank <= 5"),
    "dedup_last": (dedup_last, "SELECT h, doc_id FROM (SELECT md5(text) AS h, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY added_at DESC NULLS LAST, doc_id DESC) AS rn FROM documents) WHERE rn = 1"),
    "dedup_prompts": (dedup_prompts, "SELECT DISTINCT prompt_hash FROM model_outputs WHERE text IS NOT NULL AND lower(trim(text, ' ')) NOT IN (SELECT lower(trim(m.content, ' ')) FROM (SELECT unnest(messages) AS m FROM reformat_datasets) WHERE m.role = 'user' AND m.content IS NOT NULL)"),
    "describe_by_source": (describe_by_source, "SELECT source, count(n) AS chars_count, round(avg(n), 6) AS chars_mean, round(stddev_samp(n), 6) AS chars_std, CAST(min(n) AS INT) AS chars_min, CAST(max(n) AS INT) AS chars_max, round(quantile_cont(n, 0.25), 6) AS chars_p25, round(quantile_cont(n, 0.5), 6) AS chars_p50, round(quantile_cont(n, 0.75), 6) AS chars_p75 FROM (SELECT source, length(text) AS n FROM documents) GROUP BY 1"),
    "length_counters": (length_counters, "SELECT kind, count(*) AS n, " + ", ".join(f"count(*) FILTER (length(text) > {m}) AS over_{m}" for m in S.LENGTH_MARKS) + " FROM documents GROUP BY 1"),
    "histogram_fixed": (histogram_fixed, "WITH k AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 60), n AS (SELECT count(*) >= 60 AS kept FROM documents WHERE source IS NULL), d AS (SELECT CASE WHEN source IN (SELECT source FROM k) OR (source IS NULL AND (SELECT kept FROM n)) THEN source ELSE 'Other' END AS source, length(text) AS v FROM documents) SELECT source, CAST(CASE WHEN v > 4000 THEN 16 ELSE least(floor(v / 250.0), 15) END AS INT) AS bin, count(*) AS n FROM d GROUP BY ALL"),
    "histogram_log": (histogram_log, "SELECT lang, CAST(CASE WHEN length(text) < 1 THEN -1 ELSE floor(round(ln(length(text)) / ln(2.0), 9)) END AS INT) AS bin, count(*) AS n FROM documents GROUP BY ALL"),
    "source_percent": (source_percent, "WITH g AS (SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1) SELECT *, round(100.0 * chars / sum(chars) OVER (), 6) AS percent FROM g"),
    "top_longest": (top_longest, "SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 100"),
    "chunk_overlap": (chunk_overlap, "WITH o AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS stop FROM documents), r AS (SELECT doc_id, stop - n AS start, stop FROM o WHERE n > 0), c AS (SELECT *, unnest(range(CAST(start // 10000 AS BIGINT), CAST((stop - 1) // 10000 + 1 AS BIGINT))) AS chunk FROM r) SELECT doc_id, chunk, CAST(greatest(start - chunk * 10000, 0) AS BIGINT) AS chunk_start, CAST(least(stop - chunk * 10000, 10000) AS BIGINT) AS chunk_end FROM c"),
    "cube_source_lang": (cube_source_lang, "SELECT kind, lang, count(*) AS n, CAST(grouping(kind, lang) AS INT) AS gid FROM documents GROUP BY CUBE (kind, lang)"),
    "rollup_added": (rollup_added, "SELECT kind, CAST(CAST(added_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM documents GROUP BY ROLLUP (kind, CAST(CAST(added_at AS DATE) AS VARCHAR))"),
    "tree_paths": (tree_paths, "WITH RECURSIVE e AS (SELECT event_id, value AS quality, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, user_id FROM events), f AS (SELECT c.event_id, c.quality, p.event_id AS parent FROM e c LEFT JOIN e p ON c.user_id = p.user_id AND p.rn = c.rn // 2), b AS (SELECT event_id, parent, row_number() OVER (PARTITION BY parent ORDER BY quality DESC NULLS LAST, event_id) AS k FROM f WHERE parent IS NOT NULL), t AS (SELECT event_id, 0 AS depth, event_id AS root FROM f WHERE parent IS NULL UNION ALL SELECT b.event_id, depth + 1, root FROM t JOIN b ON b.parent = t.event_id WHERE b.k <= 1) SELECT event_id, CAST(depth AS INT) AS depth, root FROM t"),
    "latest_event": (latest_event, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1"),
    "document_ids": (document_ids, "SELECT doc_id, sha256(text || CAST(doc_id AS VARCHAR)) AS sha, 'documents_' || doc_id || '_train' AS row_id FROM documents"),
    "row_index": (row_index, "SELECT doc_id, row_number() OVER (ORDER BY md5('7_' || doc_id)) - 1 AS row_idx FROM documents"),
}
