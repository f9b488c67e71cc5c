"""Preference data: best and worst answers, margins, votes, pairs, aspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_and_worst(df: DataFrame, by: list[str], score: str, idx: str, item: str) -> DataFrame:
    """``chosen`` and ``rejected`` of each group; of equal scores the first is chosen, the last rejected.

    Rows with one score and place go by the item itself.  Groups of fewer than two, or whose scores are all equal, are left out; null scores do not compete.
    """
    d = df.where(F.col(score).isNotNull())
    s = F.struct(F.col(score), (-F.col(idx)).alias("i"), F.col(item))
    g = d.groupBy(*by).agg(F.max_by(item, s).alias("chosen"), F.min_by(item, s).alias("rejected"), F.max(score).alias("chosen_score"), F.min(score).alias("rejected_score"), F.count("*").alias("n"))
    return g.where("n > 1 and chosen_score > rejected_score").drop("n")


def with_margin(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.withColumn("margin", F.col("chosen_score") - F.col("rejected_score")).where(F.col("margin") >= least)


def majority_vote(df: DataFrame, by: list[str], judge: str, choice: str) -> DataFrame:
    """The most frequent choice of the judges; of equally frequent ones that of the first judge by name."""
    c = df.where(F.col(choice).isNotNull()).groupBy(*by, choice).agg(F.count("*").alias("votes"), F.min(judge).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.col("votes").desc(), F.col("_first"), F.col(choice))
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_first")


def all_pairs(df: DataFrame, by: list[str], idx: str, item: str) -> DataFrame:
    """``first, second`` of every two answers to one prompt, in their order.

    The pairs are the result: a prompt has as many answers as it has models.
    """
    a = df.select(*by, F.col(idx).alias("i"), F.col(item).alias("first"))
    b = df.select(*by, F.col(idx).alias("j"), F.col(item).alias("second"))
    return a.join(b, by).where("i < j")


def complete_groups(df: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """Rows of the keys that all ``n`` members have."""
    full = df.groupBy(key).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == n).select(key)
    return df.join(full, key, "left_semi")


def random_members(df: DataFrame, by: list[str], member: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` members of each group by hash, in hash order as arrays would list them."""
    h = F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col(member)))
    w = Window.partitionBy(*by).orderBy(h, member)
    return df.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k)


def ratings_of(text: Column) -> Column:
    """Integers of ``Rating: n`` lines, -1 for one that is no number."""
    found = F.regexp_extract_all(text, F.lit(r"Rating:\s*(\S+)"), F.lit(1))
    return F.transform(found, lambda x: F.coalesce(F.try_to_number(F.regexp_extract(x, r"\A(\d{1,9})", 1), F.lit("999999999")).cast("int"), F.lit(-1)))


def overall(scores: Column) -> Column:
    """Mean of the aspect scores of a map; null ones do not count, none gives null."""
    v = F.filter(F.map_values(scores), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))
