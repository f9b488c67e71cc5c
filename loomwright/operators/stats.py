"""Statistics of corpora and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import col

#: Fixed value: lengths that reports count above.
LENGTH_MARKS = (512, 768, 1024, 1536, 2048, 4096)


def describe(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (linear), largest of each value per group; rounded to six places."""
    aggs = []
    for name, v in values.items():
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.count(v).alias(f"{name}_count"), F.round(F.avg(v), 6).alias(f"{name}_mean"), F.round(F.stddev_samp(v), 6).alias(f"{name}_std"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
        aggs += [F.round(q[i], 6).alias(f"{name}_{p}") for i, p in enumerate(("p25", "p50", "p75"))]
    return df.groupBy(*by).agg(*aggs)


def counts_above(value: Column, marks: tuple[int, ...] = LENGTH_MARKS) -> list[Column]:
    return [F.count_if(value > m).alias(f"over_{m}") for m in marks]


def fixed_bins(df: DataFrame, value: Column, low: float, high: float, n: int, by: list[str] | None = None) -> DataFrame:
    """Histogram of ``n`` equal bins; the last one is closed on the right; values below are in bin -1, above in bin ``n``, null ones in none."""
    width = (high - low) / n
    b = F.when(value < low, -1).when(value > high, n).otherwise(F.least(F.floor((value - low) / width), F.lit(n - 1))).cast("int")
    return df.where(value.isNotNull()).groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"))


def log_bins(df: DataFrame, value: Column, base: int = 2, by: list[str] | None = None) -> DataFrame:
    """Histogram over powers of ``base``; values under one share bin -1."""
    b = F.when(value < 1, -1).otherwise(F.floor(F.round(F.log(value.cast("double")) / F.log(F.lit(float(base))), 9))).cast("int")
    return df.groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"))


def merge_rare(df: DataFrame, category: str, least: int, other: str = "Other") -> DataFrame:
    """Categories with fewer than ``least`` rows are renamed; null is a category like any other."""
    n = df.groupBy(category).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(category).alias("_c"), F.lit(True).alias("_kept"))
    j = df.join(n, df[category].eqNullSafe(n["_c"]), "left")
    return j.withColumn(category, F.when(F.col("_kept"), F.col(category)).otherwise(F.lit(other))).drop("_c", "_kept")


def with_percent(df: DataFrame, value: str, name: str = "percent") -> DataFrame:
    """Share of each row in the sum of all, in percent.  ``df`` is an aggregate, not the data."""
    return df.withColumn(name, F.round(100.0 * F.col(value) / F.sum(value).over(Window.partitionBy(F.lit(1))), 6))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the first of ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ---- Pairwise human judgements --------------------------------------------------------------
#: Answers and the point of view they are given from.
ACCEPT = "yes"
A_WINS, B_WINS, TIE = ("a-is-better", "a-is-slightly-better"), ("b-is-better", "b-is-slightly-better"), "tie"


def clean_judgements(df: DataFrame) -> DataFrame:
    """Lower-cased answers, the latest judgement of each evaluator on an instance."""
    low = df.select("instance_index", "instance_id", "model_a", "model_b", "evaluator", "annotated_at", *[F.lower(F.trim(c)).alias(c) for c in ("completion_a_is_acceptable", "completion_b_is_acceptable", "preference")])
    known = low.where("instance_id is not null and evaluator is not null and model_a is not null and model_b is not null")
    return latest(known, ["instance_id", "model_a", "model_b", "evaluator"], [F.col("annotated_at").desc_nulls_last(), F.col("preference"), F.col("completion_a_is_acceptable"), F.col("completion_b_is_acceptable"), F.col("instance_index")])


def acceptance_rates(j: DataFrame) -> DataFrame:
    """Share of judged completions of each model that are acceptable."""
    sides = j.select(F.explode(F.array(
        F.struct(F.col("model_a").alias("model"), F.col("completion_a_is_acceptable").alias("answer")),
        F.struct(F.col("model_b").alias("model"), F.col("completion_b_is_acceptable").alias("answer")),
    )).alias("x")).select("x.*")
    return sides.where("answer is not null").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg((F.col("answer") == ACCEPT).cast("double")), 6).alias("accepted"))


def win_rates(j: DataFrame) -> DataFrame:
    """Wins, losses and ties of each model; a slight preference counts as one."""
    p = F.col("preference")
    sides = j.where("preference is not null").select(F.explode(F.array(
        F.struct(F.col("model_a").alias("model"), p.isin(*A_WINS).alias("won"), p.isin(*B_WINS).alias("lost"), (p == TIE).alias("tied")),
        F.struct(F.col("model_b").alias("model"), p.isin(*B_WINS).alias("won"), p.isin(*A_WINS).alias("lost"), (p == TIE).alias("tied")),
    )).alias("x")).select("x.*")
    return sides.groupBy("model").agg(F.count_if("won").alias("wins"), F.count_if("lost").alias("losses"), F.count_if("tied").alias("ties"), F.round(F.avg(F.col("won").cast("double")), 6).alias("win_rate"))


def side(p: Column) -> Column:
    return F.when(p.isin(*A_WINS), "a").when(p.isin(*B_WINS), "b").when(p == TIE, "tie")


def agreement(j: DataFrame) -> DataFrame:
    """Agreement of the first two evaluators of an instance, exact, and relaxed: a tie against a side counts half."""
    w = Window.partitionBy("instance_id", "model_a", "model_b").orderBy(F.col("annotated_at").asc_nulls_last(), "evaluator")
    r = j.withColumn("rn", F.row_number().over(w)).where("rn <= 2").withColumn("side", side(F.col("preference")))
    pairs = r.groupBy("instance_id", "model_a", "model_b").agg(F.max(F.when(F.col("rn") == 1, F.col("side"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("side"))).alias("s2")).where("s1 is not null and s2 is not null")
    same = (F.col("s1") == F.col("s2")).cast("double")
    half = F.when(F.col("s1") == F.col("s2"), 1.0).when((F.col("s1") == TIE) | (F.col("s2") == TIE), 0.5).otherwise(0.0)
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.avg(same), 6).alias("agreement"), F.round(F.avg(half), 6).alias("relaxed_agreement"))


def nan_mean(df: DataFrame, by: list[str], ratings: str) -> DataFrame:
    """``by, pos, mean``: mean of each position of jagged rating lists; -1 (not parsed) and null do not count."""
    x = df.select(*by, F.posexplode(ratings).alias("pos", "r"))
    return x.groupBy(*by, "pos").agg(F.round(F.avg(F.when(F.col("r") >= 0, F.col("r"))), 6).alias("mean"))


def wide(df: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column per value with the first (least) entry, '' where there is none."""
    return df.groupBy(*by).pivot(column, values).agg(F.min(col(value))).na.fill("", values)


def reward_metrics(df: DataFrame, by: list[str], parts: str) -> DataFrame:
    """Per verifier of a map of rewards: mean, and share above zero."""
    x = df.select(*by, F.explode(parts).alias("verifier", "r"))
    return x.groupBy(*by, "verifier").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_reward"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("correct_rate"))


def dataset_report(kept: DataFrame, before: DataFrame, source: str, ids: str, labels: str) -> DataFrame:
    """Per dataset: rows before and after, tokens, trained tokens, mean length, and its share of all tokens in percent."""
    trained = F.size(F.filter(labels, lambda x: x != -100))
    a = kept.groupBy(source).agg(F.count("*").alias("final_rows"), F.sum(F.size(ids)).alias("tokens"), F.sum(trained).alias("trained_tokens"), F.round(F.avg(F.size(ids)), 6).alias("mean_tokens"))
    b = before.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("initial_rows"))
    j = b.join(a, b["_s"].eqNullSafe(a[source]), "left").select(F.col("_s").alias(source), "initial_rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("final_rows", "tokens", "trained_tokens", "mean_tokens")])
    return with_percent(j.withColumn("filtered_rows", F.col("initial_rows") - F.col("final_rows")), "tokens")


def markdown_table(df: DataFrame, order: str) -> str:
    """A report as a markdown table; reports are small."""
    rows = df.orderBy(order).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows])
