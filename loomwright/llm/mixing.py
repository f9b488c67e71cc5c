"""Problem 6: mixing sources to target weights, by systematic sampling.

Every document of a source is expected as often as its source's target asks, at most
``max_repeats`` times.  The expected copies are summed up along an order of the source's
documents, one random offset is added, and a document is emitted once for each whole number
its stretch of the sum crosses.  A document thus comes floor or ceiling of its expectation
times, never more than the cap, and a source's tokens differ from the target by a few
documents at most, since the order goes by size.

The prefix sums are distributed: documents fall into buckets by source, class of size and
hash; the sums of the buckets (a small table) are accumulated by a window per source, and
inside a bucket a second window goes on.  The number of hash slices grows with the number of
documents, so no window holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.session import cut_lineage
from loomwright.sources.tables import table

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a bucket on average, and seed of the offsets.
BUCKET_ROWS, SEED = 100_000, 20240607
#: Expected copies are summed in whole numbers of 1/2**UNIT_BITS, so a sum is the same in any order.
UNIT_BITS = 22
#: Characters the tokenizer gets at once; a longer text goes in pieces cut at blanks.
PIECE = 1 << 16


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import base64

    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, enc) -> int:
    if not text:
        return 0
    total, at = 0, 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + PIECE // 2, at + PIECE)
        cut = cut if cut > at else at + PIECE
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def with_tokens(df: DataFrame, key: str, source: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, source, n_tokens``; the text does not travel further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "source": b["source"], "n_tokens": [count_tokens(t, enc) for t in b["text"]]})

    d = df.select(F.col(key).alias("key"), F.lower(F.trim(source)).alias("source"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, source string, n_tokens long")


def systematic(rows: DataFrame, by: list[str], key: str, size: str, expected: str, offset: Column, slices: int) -> DataFrame:
    """``rows`` with ``copies``: how many whole numbers each row's stretch of the prefix sum crosses.

    ``offset`` in [0, 1) is one number per group of ``by``.  A row starts where the one before
    ends, so every whole number is crossed once; each row crosses ``floor`` or ``ceil`` of its
    expectation (rounded to 2**-22) whole numbers.  A group holds 2**41 copies at most.
    """
    units = lambda x: F.round(x * (1 << UNIT_BITS)).cast("long")
    r = rows.withColumn("_units", units(F.col(expected))).withColumn("_class", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) * 4)).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    bucket = [*by, "_class", "_slice"]
    before = Window.partitionBy(*by).orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = r.groupBy(*bucket).agg(F.sum("_units").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*bucket).orderBy(size, key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        r.join(starts, bucket).withColumn("_end", F.col("_start") + F.sum("_units").over(inside) + units(offset))
        .withColumn("copies", (F.shiftright("_end", UNIT_BITS) - F.shiftright(F.col("_end") - F.col("_units"), UNIT_BITS)).cast("int"))
        .drop("_class", "_slice", "_start", "_end", "_units")
    )


def mix(docs: DataFrame, targets: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) from ``key, source, n_tokens`` and the targets of all mixes.

    ``chosen``: ``mix_name, source, key, n_tokens, copies`` of each record used at least once.
    ``shares``: one row per mix and source with target and actual tokens and shares.  The size
    of a mix is its ``size_factor`` of the tokens of all documents, those without a source too.
    A source too small for its target gives every record ``max_repeats`` times, an absent one
    nothing; the other sources keep their targets, so the mix is smaller then, and the actual
    shares say so.  Sources compare without case and outer blanks.  Records without tokens,
    with a null key or with a null source are never chosen.  Repeated keys count as separate
    records.  Null targets or repeats count as zero.  Other columns are not read.
    """
    docs = cut_lineage(docs.select("key", "source", "n_tokens"))
    stats = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    whole = stats.agg(F.sum("tokens").alias("t"), F.sum("n").alias("n")).first()
    total, slices = int(whole["t"] or 0), max(1, -(-int(whole["n"] or 0) // bucket_rows))
    t = targets.groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"), F.coalesce(F.max("size_factor"), F.lit(0.0)).alias("size_factor"))
    plan = (
        t.withColumn("target_tokens", F.col("target_share") * F.col("size_factor") * F.lit(total))
        .join(stats.where("source is not null"), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("each", F.when(F.col("tokens") > 0, F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    )
    u = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = docs.where("key is not null and n_tokens > 0").join(plan.select("mix_name", "source", "each").where("each > 0"), "source")
    chosen = systematic(wanted, ["mix_name", "source"], "key", "n_tokens", "each", u, slices).where("copies > 0").select("mix_name", "source", "key", "n_tokens", "copies")
    chosen = cut_lineage(chosen)
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("n_records"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    per_mix = Window.partitionBy("mix_name")
    shares = (
        plan.join(got, ["mix_name", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        .select(
            "mix_name", "source", "target_share",
            F.round(F.col("actual_tokens") / F.greatest(F.sum("actual_tokens").over(per_mix), F.lit(1)), 6).alias("actual_share"),
            F.round("target_tokens", 3).alias("target_tokens"), "actual_tokens", F.col("tokens").alias("available_tokens"), "max_repeats",
            F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            (F.col("each") * F.col("tokens") < F.col("target_tokens") - 0.5).alias("too_small"),
        )
    )
    return chosen, shares


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(with_tokens(table(spark, folder, "documents"), "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen records of every mix with their repeats."""
    return _mix(spark, folder)[0].withColumnRenamed("key", "doc_id")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source in every mix."""
    return _mix(spark, folder)[1]


QUERIES = {"p6_mix": p6_mix, "p6_shares": p6_shares}
SQL: dict[str, str] = {}
