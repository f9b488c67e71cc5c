"""Mixing, sampling and set operations on datasets.

Order is semantic in the source material, so every choice goes by an explicit key: the MD5 of
seed and key in place of a random state, which any engine can repeat.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import col
from loomwright.schema import align


@dataclass(frozen=True)
class Share:
    """How much of a dataset to take: a fraction (a dot in the amount) or a number of rows."""

    name: str
    amount: float | int

    def rows(self, available: int) -> int:
        return int(available * self.amount) if isinstance(self.amount, float) else int(self.amount)


def parse_amounts(pairs: list[str]) -> list[Share]:
    """``name amount name amount ...``; all fractions or all counts, none negative."""
    if len(pairs) % 2:
        raise ValueError("names and amounts must alternate")
    shares = [Share(n, float(a) if "." in a else int(a)) for n, a in zip(pairs[::2], pairs[1::2])]
    if len({type(s.amount) for s in shares}) > 1:
        raise ValueError("Cannot mix fractions and counts")
    if any(s.amount < 0 for s in shares):
        raise ValueError("amounts must not be negative")
    return shares


def fingerprint(config: object) -> str:
    """Ten hex digits of the SHA-256 of a configuration, whatever the order of its keys."""
    plain = asdict(config) if hasattr(config, "__dataclass_fields__") else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:10]


def shuffle_key(seed: int, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def take_per_group(df: DataFrame, by: list[str], order: list[Column], n: str | Column | int) -> DataFrame:
    """The first ``n`` rows of every group; ``n`` may be a column of the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    limit = F.lit(n) if isinstance(n, int) else col(n)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def first_by_key(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order, for a report: a top-k, whose rows pass one task's heap."""
    return df.orderBy(*order).limit(n)


def lowest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order where ``n`` is a share of the table: rows are numbered, no task holds them all."""
    return global_index(df, list(order)).where(F.col("_row_idx") < n).drop("_row_idx")


def upsample(df: DataFrame, key: str, factor: str | Column, seed: int = 42) -> DataFrame:
    """Each row ``floor(factor)`` times, and a share of ``frac(factor)`` of the rows once more.

    The rows of the remainder are those with the least hash; which copy a row is, ``copy`` tells.
    """
    f = col(factor).cast("double")
    part = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    times = (F.floor(f) + F.when(part < f - F.floor(f), 1).otherwise(0)).cast("int")
    return df.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).drop("_t")


def exact_upsample(df: DataFrame, key: str, available: int, wanted: int, seed: int = 42) -> DataFrame:
    """Exactly ``wanted`` rows: whole repeats, and the rows of least hash for the rest."""
    repeats, rest = divmod(wanted, available) if available else (0, 0)
    parts = [df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))] if repeats else []
    parts += [lowest(df, rest, shuffle_key(seed, key), col(key)).withColumn("copy", F.lit(repeats))] if rest else []
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0).withColumn("copy", F.lit(0))


def mix(frames: dict[str, DataFrame], shares: list[Share], key: str, seed: int = 42) -> DataFrame:
    """Takes each dataset's share in hash order and stacks them, in the columns of the first.

    ``dataset_source`` keeps where a row came from.
    """
    first = frames[shares[0].name].schema
    parts = []
    for s in shares:
        df = frames[s.name]
        parts.append(align(exact_upsample(df, key, n := df.count(), s.rows(n), seed).drop("copy"), first).withColumn("dataset_source", F.lit(s.name)))
    return reduce(DataFrame.unionByName, parts)


def stratified(df: DataFrame, by: str, key: str, quota: dict[str, int] | Column, seed: int = 42) -> DataFrame:
    """Rows of least hash per stratum, as many as its quota."""
    n = quota if isinstance(quota, Column) else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(by)), F.lit(0))
    return take_per_group(df, [by], [shuffle_key(seed, key), col(key)], n)


def binary_from_pairs(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Two rows per pair: the chosen side labelled true, the rejected one false."""
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    both = F.array(F.struct(F.col(chosen).alias("completion"), F.lit(True).alias("label")), F.struct(F.col(rejected).alias("completion"), F.lit(False).alias("label")))
    return df.select(*rest, F.explode(both).alias("x")).select(*rest, "x.*")


def split_of(seed: int, key: str, test_share: float) -> Column:
    """``test`` for a share of the keys by hash, else ``train``: stable when rows are added."""
    part = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.when(part < test_share, "test").otherwise("train")


def last_duplicate(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key, the last: what a dictionary filled in order would hold."""
    return take_per_group(df, by, order, 1)


def unmatched(df: DataFrame, other: DataFrame, mine: Column, theirs: Column) -> DataFrame:
    """Rows whose (cleaned) key does not occur in the other table."""
    return df.withColumn("_k", mine).join(other.select(theirs.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def shard_of(row: Column, world: int, contiguous_size: int | None = None) -> Column:
    """Rank that reads a row: round robin, or by ranges of equal size."""
    return (row % world).cast("int") if contiguous_size is None else F.least(F.floor(row / contiguous_size), F.lit(world - 1)).cast("int")


def pick_weighted(key: Column, options: list[tuple[str, float]], seed: int = 42) -> Column:
    """One of the options by weight, from a hash of the key."""
    part = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    total, at, out = sum(w for _, w in options), 0.0, F.lit(options[-1][0])
    cases = []
    for name, w in options:
        at += w
        cases.append((part < at / total, name))
    for cond, name in reversed(cases):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def global_index(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """``_row_idx`` from 0 in a global order, without a one-partition window.

    The order is range-partitioned and written down once; counts of the partitions, a small
    table, give each its offset.
    """
    from loomwright.session import cut_lineage

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = ranged.withColumn("_part", F.shiftrightunsigned(F.col("_m"), 33)).withColumn("_in", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    return placed.join(F.broadcast(before), "_part").withColumn("_row_idx", F.col("_start") + F.col("_in")).drop("_part", "_in", "_m", "_start")


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """The n-th row of one table beside the n-th of the other; a longer table's rest is left out.

    Both get their places before anything is dropped, so no row is shifted against its partner.
    Columns of ``b`` that clash carry ``_b``.
    """
    x, y = global_index(a, order_a), global_index(b, order_b)
    y = y.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c in a.columns})
    return x.join(y, "_row_idx").drop("_row_idx")


def sample_groups(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, by hash, of every group that has as many."""
    w = Window.partitionBy(by)
    full = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= n).drop("_n")
    return take_per_group(full, [by], [shuffle_key(seed, key), col(key)], n)


def worker_batches(df: DataFrame, order: list[Column], world: int, per_batch: int, drop_last: bool = True) -> DataFrame:
    """``rank`` and ``batch`` of every row: equal shares of a permuted order, then batches of each.

    With ``drop_last`` rows over a multiple of the world's size go, and so does a short last batch.
    """
    x = global_index(df, order)
    x = x.withColumn("rank", (F.col("_row_idx") % world).cast("int")).withColumn("_at", F.floor(F.col("_row_idx") / world)).withColumn("batch", F.floor(F.col("_at") / per_batch))
    if drop_last:
        n = df.count() // world
        x = x.where((F.col("_at") < n) & (F.col("batch") < n // per_batch))
    return x.drop("_at")


def by_length(df: DataFrame, length: Column, parts: int | None = None) -> DataFrame:
    """Rows of similar length side by side in each partition, for padded batches; the set of rows is the same."""
    return (df.repartition(parts) if parts else df).sortWithinPartitions(length.desc())
