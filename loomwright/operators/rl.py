"""Preparing batches for reinforcement learning: advantages, filters, packing, returns, collation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import col


def advantages(df: DataFrame, group: str, reward: str, centered: bool = False) -> DataFrame:
    """Reward against its group: ``(r - mean) / (std + 1e-8)`` with the population deviation, or ``r - mean``."""
    w = Window.partitionBy(group)
    mean, std = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.col(reward) - mean if centered else (F.col(reward) - mean) / (std + 1e-8))


def informative_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ; the others carry no signal."""
    w = Window.partitionBy(group)
    return df.withColumn("_d", F.max(reward).over(w) > F.min(reward).over(w)).where("_d").drop("_d")


def group_report(df: DataFrame, group: str, reward: str, best: float) -> DataFrame:
    """How many groups differ, are all solved, all zero, or all the same otherwise."""
    g = df.groupBy(group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    kind = F.when(F.col("lo") < F.col("hi"), "differs").when(F.col("lo") >= best, "solved").when(F.col("lo") == 0, "zero").otherwise("same")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_groups"))


def pass_rate(df: DataFrame, by: str, correct: Column, low: float, high: float) -> DataFrame:
    """Groups whose rate of correct rollouts lies within the band, both ends included."""
    g = df.groupBy(by).agg(F.count("*").alias("total_rollouts"), F.count_if(correct).alias("total_correct_rollouts"))
    rate = F.col("total_correct_rollouts") / F.col("total_rollouts")
    return g.withColumn("passrate", F.round(rate, 6)).where((rate >= low) & (rate <= high))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _returns(values: pd.Series, gamma: pd.Series) -> pd.Series:
    out = []
    for v, g in zip(values, gamma):
        if v is None:
            out.append(None)
            continue
        back, total = np.empty(len(v)), 0.0
        for t in range(len(v) - 1, -1, -1):
            total = v[t] + g * total
            back[t] = total
        out.append(back)
    return pd.Series(out, dtype=object)


def discounted(values: str | Column, gamma: float) -> Column:
    """Discounted sums from the end of an array of doubles, in one pass."""
    return _returns(col(values).cast("array<double>"), F.lit(float(gamma)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _advantages(values: pd.Series, rewards: pd.Series, goes_on: pd.Series, gamma: pd.Series, lam: pd.Series) -> pd.Series:
    out = []
    for v, r, on, g, k in zip(values, rewards, goes_on, gamma, lam):
        if v is None or r is None or on is None:
            out.append(None)
            continue
        back, last = np.empty(len(v)), 0.0
        for t in range(len(v) - 1, -1, -1):
            following = v[t + 1] if t + 1 < len(v) else 0.0
            last = r[t] - v[t] + on[t] * g * (following + k * last)
            back[t] = last
        out.append(back)
    return pd.Series(out, dtype=object)


def gae(values: str | Column, rewards: str | Column, dones: str | Column, gamma: float = 1.0, lam: float = 0.95, response: str | Column | None = None) -> Column:
    """Generalised advantages of a row of packed sequences, in one pass from its end.

    A done step cuts off what follows it; so does, where a mask of responses is given, a step
    of a query.  Marks over 1 (a sequence's number) count as 1.  A null array gives null.
    """
    on = F.transform(col(dones), lambda d: 1 - F.least(d.cast("double"), F.lit(1.0)))
    if response is not None:
        on = F.zip_with(on, F.transform(col(response), lambda m: F.least(m.cast("double"), F.lit(1.0))), lambda a, b: a * b)
    return _advantages(col(values).cast("array<double>"), col(rewards).cast("array<double>"), on, F.lit(float(gamma)), F.lit(float(lam)))


def masked_mean(values: str | Column, mask: str | Column, denominator: float | None = None) -> Column:
    """Mean of an array where a mask is set, or its sum there over a fixed number; null where nothing is."""
    total = F.aggregate(F.zip_with(col(values), col(mask), lambda v, m: v.cast("double") * m), F.lit(0.0), lambda a, x: a + x)
    n = F.lit(float(denominator)) if denominator is not None else F.aggregate(col(mask), F.lit(0.0), lambda a, m: a + m)
    return F.when(n != 0, total / n)


def position_ids(lengths: str | Column) -> Column:
    """0, 1, ... anew for each sequence of a pack."""
    return F.flatten(F.transform(F.filter(col(lengths), lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1)))


def cumulative_lengths(lengths: str | Column) -> Column:
    """0 and the ends of the sequences of a pack."""
    return F.aggregate(col(lengths), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def next_fit(df: DataFrame, by: str, order: str, length: str, capacity: int) -> DataFrame:
    """``pack`` of each row when sequences are put in order into the open pack, never split.

    One that does not fit closes the pack, also an empty one.  The fold is sequential by its
    definition, so ``by`` names shards of bounded size; each is one task's work.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        fill, pack, packs = 0, 0, np.empty(len(pdf), dtype=np.int64)
        for i, n in enumerate(pdf[length].fillna(0).astype(int)):
            if fill + n > capacity:
                fill, pack = 0, pack + 1
            fill += n
            packs[i] = pack
        return pdf.assign(pack=packs)[[by, order, length, "pack"]]

    return df.select(by, order, length).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {length} {kinds[length]}, pack long")


def right_pad(ids: str | Column, to: Column, pad: int) -> Column:
    a = col(ids)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(to - F.size(a), F.lit(0)).cast("int")))


def left_pad(ids: str | Column, to: Column, pad: int) -> Column:
    a = col(ids)
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(to - F.size(a), F.lit(0)).cast("int")), a)


def stop_at(ids: str | Column, stop: int, pad: int) -> Column:
    """Everything behind the first stop token becomes padding."""
    a = col(ids)
    at = F.array_position(a, stop)
    return F.when(at > 0, F.transform(a, lambda x, i: F.when(i < at, x).otherwise(F.lit(pad)))).otherwise(a)


def separate(labels: str | Column) -> Column:
    """The first label of a sequence is ignored where sequences are laid end to end."""
    a = col(labels)
    return F.transform(a, lambda x, i: F.when(i == 0, F.lit(-100)).otherwise(x))


def advantage_by_mask(mask: str | Column, by_sequence: str | Column) -> Column:
    """Advantage of each token: the mask holds the 1-based sequence it answers, 0 for none."""
    return F.transform(col(mask), lambda m: F.when(m == 0, F.lit(0.0)).otherwise(F.try_element_at(col(by_sequence), m)))


def pack_sequences(df: DataFrame, by: str, order: str, query: str, response: str, mask: str, logprobs: str, capacity: int, pad: int, mask_tools: bool = False) -> DataFrame:
    """Packs of query and response tokens with all that training reads, one row per pack.

    Sequences go in order into the open pack and are never split; one that does not fit closes
    it, also an empty one.  Padding tokens go, with their mask and log-probability.  The
    response mask holds the 1-based number of the sequence in its shard, the attention mask its
    number in the pack; log-probabilities of query tokens are null; the last token of a sequence
    carries its number in ``dones``.  ``by`` names shards of bounded size.
    """
    kinds = dict(df.dtypes)

    def arrays(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict:
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        sizes = [len(q) + len(r) for _, q, r, _, _ in rows]
        return {
            "query_responses": cat([np.concatenate([q, r]) for _, q, r, _, _ in rows], np.int32),
            "attention_mask": np.repeat(np.arange(1, len(rows) + 1, dtype=np.int32), sizes),
            "position_ids": cat([np.arange(n) for n in sizes], np.int32),
            "response_mask": cat([np.concatenate([np.zeros(len(q)), (m != 0) * n if mask_tools else np.full(len(r), n)]) for n, q, r, m, _ in rows], np.int64),
            "logprobs": cat([np.concatenate([np.full(len(q), np.nan), p]) for _, q, r, _, p in rows], np.float64),
            "dones": cat([np.append(np.zeros(k - 1), n) if k else np.zeros(0) for (n, *_), k in zip(rows, sizes)], np.int64),
            "num_actions": np.array([len(r) for _, _, r, _, _ in rows], dtype=np.int32),
            "seq_lens": np.array(sizes, dtype=np.int32),
        }

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        packs, now, fill = [], [], 0
        for n, row in enumerate(pdf.itertuples(index=False), 1):
            q, r = np.asarray(getattr(row, query), dtype=np.int64), np.asarray(getattr(row, response), dtype=np.int64)
            m, p = np.asarray(getattr(row, mask)), np.asarray(getattr(row, logprobs), dtype=np.float64)
            if not len(r) == len(m) == len(p):
                raise ValueError("response, mask and log-probabilities differ in length")
            q, kept = q[q != pad], r != pad
            if fill + len(q) + kept.sum() > capacity:
                packs.append(now)
                now, fill = [], 0
            now.append((n, q, r[kept], m[kept], p[kept]))
            fill += len(q) + int(kept.sum())
        packs += [now] if fill else []
        return pd.DataFrame([{by: pdf[by].iloc[0], "pack": k, **arrays(rows)} for k, rows in enumerate(packs)])

    ints, longs = "array<int>", "array<bigint>"
    schema = f"{by} {kinds[by]}, pack int, query_responses {ints}, attention_mask {ints}, position_ids {ints}, response_mask {longs}, logprobs array<double>, dones {longs}, num_actions {ints}, seq_lens {ints}"
    return df.select(by, order, query, response, mask, logprobs).groupBy(by).applyInPandas(run, schema)


def flatten_batch(df: DataFrame, by: str, order: str, ids: str, labels: str) -> DataFrame:
    """Sequences of a batch laid end to end: tokens, labels with -100 at each start, positions, sequence numbers, ends."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("l"))))
    b = df.groupBy(by).agg(rows.alias("x"))
    lens = F.transform("x", lambda r: F.size(r["i"]))
    return b.select(
        by, F.flatten(F.transform("x", lambda r: r["i"])).alias("input_ids"), F.flatten(F.transform("x", lambda r: separate(r["l"]))).alias("labels"),
        position_ids(lens).alias("position_ids"), F.flatten(F.transform("x", lambda r, k: F.array_repeat(k, F.size(r["i"])))).alias("seq_idx"),
        cumulative_lengths(lens).alias("cu_seq_lens"), F.array_max(lens).alias("max_length"),
    )
