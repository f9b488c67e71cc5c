"""Problem 4: filling fixed-capacity packs, by bound-certified repacking.

The items of a run are spread over partitions by hash; each partition is packed by best-fit
decreasing and certified by lower bounds from dual-feasible functions.  A partition that needs
no more packs than its bound is finished but for one pack, its emptiest, since bounds are rounded
up partition by partition.  The others have gaps: they give their emptiest packs, as many as
leave room for a whole one.  The items of all packs given are exchanged: they are spread over
fewer partitions, packed and certified again.  A round is kept only for runs where it needs fewer packs, so the
number of packs falls with every round, and a run goes on until it has no gap or no gain.
Every run takes this way, whatever its size.  Packing moves (id, length) rows, never the
token arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.session import cut_lineage
from loomwright.sources.tables import table

#: Items of a partition on average.
PARTITION_ITEMS = 2_000
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000
#: Functions u_k tried at most; beyond the items a pack can hold they say nothing new.
BOUND_KS = 100


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Packs that any packing of these items needs, by dual-feasible functions in whole numbers.

    Tried are the identity, ``u_k`` (rounding to parts of 1/k) and, for every length ``t`` up to
    half the capacity, the function that turns items over ``capacity - t`` into whole packs
    and drops those under ``t``, alone and with ``u_k`` applied behind it.  Sums over a range
    of lengths are differences of running sums, so a function costs one pass for all ``t``.
    """
    order = np.argsort(lengths, kind="stable")
    x, n = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    if not len(x):
        return 0
    t = np.concatenate([[0], np.unique(x[x * 2 <= capacity])])
    lo, hi = np.searchsorted(x, t, "left"), np.searchsorted(x, capacity - t, "right")

    def running(v: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(v * n)])

    def most(v: np.ndarray, whole: int) -> int:
        r = running(v)
        return int((-(-(over * whole + r[hi] - r[lo]) // whole)).max())

    ones = running(np.ones_like(x))
    over = ones[-1] - ones[hi]
    best = most(x, capacity)
    for k in range(1, min(BOUND_KS, capacity // int(x[0])) + 1):
        up = (k + 1) * x  # in units of 1 / (k * capacity)
        best = max(best, most(np.where(up % capacity == 0, x * k, up // capacity * capacity), k * capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pack of each item; each goes into the fullest pack that still holds it.

    Open packs are kept by their free room, with one bit per room that occurs, so the best
    fit is the lowest set bit at or above the length: time is linear in the items.
    """
    order = np.argsort(-lengths, kind="stable")
    packs = np.empty(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in order:
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = open_by_room[room]
            pack = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            pack, room, made = made, capacity, made + 1
        packs[i] = pack
        left = room - n
        if left:
            open_by_room[left].append(pack)
            rooms |= 1 << left
    return packs


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    lengths = pdf["length"].to_numpy(dtype=np.int64)
    pack = best_fit_decreasing(lengths, capacity)
    sizes, counts = np.unique(lengths, return_counts=True)
    out = pdf[["run", "capacity", "item", "piece", "length", "part"]].copy()
    out["pack"] = pack
    room = capacity - np.bincount(pack, weights=lengths).astype(np.int64)
    gap = int(pack.max()) + 1 > lower_bound(sizes, counts, capacity)
    emptiest = np.argsort(-room, kind="stable")
    emptiest = emptiest[: np.searchsorted(np.cumsum(room[emptiest]), capacity) + 1] if gap else emptiest[:1]
    out["gives"] = np.isin(pack, emptiest[room[emptiest] > 0])
    return out


def _packed(items: DataFrame) -> DataFrame:
    kinds = dict(items.dtypes)
    schema = f"run {kinds['run']}, capacity int, item {kinds['item']}, piece int, length int, part long, pack long, gives boolean"
    return items.groupBy("run", "part").applyInPandas(_pack_group, schema)


def _small(df: DataFrame) -> DataFrame:
    """A table of one row per run is broadcast when it has been counted and is small, else joined as the planner finds best."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _spread(items: DataFrame, per_run: DataFrame, seed: int, size: int) -> DataFrame:
    """Assigns each item a partition of its run; partitions hold ``size`` items on average.  ``per_run``: ``run, n``."""
    parts = F.greatest(F.ceil(F.col("n") / size), F.lit(1))
    return items.join(_small(per_run.select("run", "n")), "run").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "item", "piece"), parts)).drop("n")


def pack(items: DataFrame, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``run, pack_id, item, piece, start, length, at``: the pieces of each pack, in order.

    ``items``: ``run, capacity, item, length``.  Lengths are positive; null or non-positive
    ones, null runs and null or non-positive capacities are left out.  An item longer than the
    capacity is split into full pieces, each a pack by itself, and a rest.  ``start`` is the
    offset of the piece in its item, ``at`` its offset in the pack.  Repeated items must be
    removed before.  Empty tables give an empty result.
    """
    ok = items.where((F.col("length") > 0) & (F.col("capacity") > 0) & F.col("run").isNotNull() & F.col("item").isNotNull())
    pieces = ok.select("run", F.col("capacity").cast("int").alias("capacity"), "item", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / F.col("capacity")).cast("int") - 1)).alias("piece"), F.col("length").alias("whole"))
    pieces = cut_lineage(pieces.select("run", "capacity", "item", "piece", F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity")).cast("int").alias("length")))
    full = pieces.where("length = capacity").select("run", F.concat_ws("-", F.col("run").cast("string"), F.lit("full"), F.col("item").cast("string"), "piece").alias("pack_id"), "capacity", "item", "piece", "length")
    rest = pieces.where("length < capacity")
    per_run = cut_lineage(rest.groupBy("run").agg(F.count("*").alias("n")))
    now = cut_lineage(_packed(_spread(rest, per_run, 0, partition_items)).withColumn("round", F.lit(0)))
    going, k = per_run.select("run"), 0
    while True:  # ends: every round takes packs away
        k += 1
        pool = cut_lineage(now.where("gives").join(_small(going), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("part", "pack", "round").alias("old")))
        if pool.isEmpty():
            break
        pooled = now.where("gives").join(_small(pool.select("run")), "run", "left_semi").select("run", "capacity", "item", "piece", "length")
        again = cut_lineage(_packed(_spread(pooled, pool, k, partition_items)).withColumn("round", F.lit(k)))
        going = cut_lineage(again.groupBy("run").agg(F.count_distinct("part", "pack").alias("new")).join(pool, "run").where("new < old").select("run"))
        if going.isEmpty():
            break
        better = _small(going.withColumn("better", F.lit(True)))
        kept = now.join(better, "run", "left").where(F.col("better").isNull() | ~F.col("gives")).drop("better")
        now = cut_lineage(kept.unionByName(again.join(better, "run", "left_semi")))
    packed = now.select("run", F.concat_ws("-", F.col("run").cast("string"), "round", "part", "pack").alias("pack_id"), "capacity", "item", "piece", "length").unionByName(full)
    w = Window.partitionBy("pack_id").orderBy(F.col("length").desc(), "item", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("run", "pack_id", "item", "piece", (F.col("piece") * F.col("capacity")).cast("long").alias("start"), "length", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("at"))


def sft_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``seq_id`` of tokenized_sft: its run, that run's capacity, its tokens without padding.

    Tokens count where ``attention_mask`` is 1, without a mask where they are not the pad token.
    """
    d = table(spark, folder, "tokenized_sft").join(table(spark, folder, "pack_plan"), "run_name")
    real = F.when(F.col("attention_mask").isNotNull(), F.size(F.filter("attention_mask", lambda x: x == 1))).otherwise(F.size(F.filter("input_ids", lambda x: x != F.col("pad_token_id"))))
    d = d.where(F.size("input_ids") > 0).select(F.col("run_name").alias("run"), F.col("pack_length").alias("capacity"), F.col("seq_id").alias("item"), real.alias("length"))
    return d.groupBy("item").agg(F.min(F.struct("run", "capacity", "length")).alias("x")).select("item", "x.*").where("length > 0")


def p4_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of every run: which piece of which sequence lies where."""
    return pack(sft_items(spark, folder)).select(F.col("run").alias("run_name"), "pack_id", F.col("item").alias("seq_id"), "piece", F.col("start").alias("seq_start"), F.col("length").alias("n_tokens"), F.col("at").alias("pack_start"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: sequences, tokens, packs, the certified lower bound for the whole run, and the share filled.

    The bound needs only how often each length occurs: as many rows as the capacity at most.
    """
    items = cut_lineage(sft_items(spark, folder))
    packs = pack(items).groupBy("run").agg(F.count_distinct("pack_id").alias("n_packs"), F.count_distinct("item").alias("n_sequences"), F.sum("length").alias("n_tokens"))
    lengths = items.select("run", "capacity", F.expr("length % capacity").alias("rest"), F.expr("length div capacity").alias("full")).groupBy("run", "capacity", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf[pdf["rest"] > 0]
        c = int(pdf["capacity"].iloc[0])
        b = int(pdf["full"].sum()) + lower_bound(some["rest"].to_numpy(), some["n"].to_numpy(), c)
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "capacity": [c], "lower_bound": [b]})

    bounds = lengths.groupBy("run").applyInPandas(bound, "run string, capacity int, lower_bound long")
    return packs.join(bounds, "run").select(F.col("run").alias("run_name"), "n_sequences", "n_tokens", "n_packs", "lower_bound", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity")), 6).alias("filled"))


QUERIES = {"p4_packs": p4_packs, "p4_report": p4_report}
SQL: dict[str, str] = {}
