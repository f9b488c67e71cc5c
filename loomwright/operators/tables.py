"""Relational operators of the toolkit: offsets and chunks, forests, batch results, guards."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import col
from loomwright.operators.mix import global_index
from loomwright.session import cut_lineage


def running_offsets(df: DataFrame, key: str, size: str) -> DataFrame:
    """``start`` and ``stop`` of every row when rows are laid end to end in the order of ``key``.

    The prefix sum is distributed: rows are range-partitioned once and written down, the sums of
    the partitions (a small table) give each its start, and a window per partition goes on.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(F.broadcast(before), "_part").withColumn("stop", (F.col("_before") + inside).cast("long"))
    return out.withColumn("start", F.col("stop") - F.col(size)).drop("_part", "_before")


def chunk_boundaries(df: DataFrame, key: str, size: str, chunk: int) -> DataFrame:
    """``key, chunk, chunk_start, chunk_end``: each row clipped to the chunks it overlaps; empty rows are in none.

    The interval join becomes an explode of the few chunks a row touches.
    """
    o = running_offsets(df.select(key, size), key, size).where(F.col(size) > 0)
    o = o.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))))
    return o.select(key, "chunk", F.greatest(F.col("start") - F.col("chunk") * chunk, F.lit(0)).alias("chunk_start"), F.least(F.col("stop") - F.col("chunk") * chunk, F.lit(chunk)).alias("chunk_end"))


def forest(df: DataFrame, key: str, tree: str) -> DataFrame:
    """Adds ``parent``: rows of a tree in key order form a binary heap."""
    d = df.withColumn("_rn", F.row_number().over(Window.partitionBy(tree).orderBy(key)))
    p = d.select(F.col(tree).alias("_t"), F.col("_rn").alias("_p"), F.col(key).alias("parent"))
    return d.join(p, (d[tree] == p["_t"]) & (F.floor(d["_rn"] / 2) == p["_p"]), "left").drop("_rn", "_t", "_p")


def best_paths(df: DataFrame, key: str, parent: str, quality: str, top_k: int = 1, depth: int | None = None) -> DataFrame:
    """``key, depth, root`` of the nodes reached from the roots over the ``top_k`` best children.

    One join per level; a level without nodes ends the walk, or ``depth`` where it is given.  Cycles
    without a root are never met; a path longer than there are parents runs in a cycle and is an error.
    """
    w = Window.partitionBy(parent).orderBy(F.col(quality).desc_nulls_last(), key)
    kids = cut_lineage(df.where(F.col(parent).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_k).select(F.col(key).alias("_kid"), F.col(parent).alias("_par")))
    level = df.where(F.col(parent).isNull()).select(key, F.lit(0).alias("depth"), F.col(key).alias("root"))
    out = [cut_lineage(level)]
    longest = kids.select("_par").distinct().count()
    for n in count(1) if depth is None else range(1, depth + 1):
        nxt = cut_lineage(out[-1].join(kids, out[-1][key] == kids["_par"]).select(F.col("_kid").alias(key), F.lit(n).alias("depth"), "root"))
        if nxt.isEmpty():
            break
        if n > longest:
            raise ValueError(f"a cycle of {parent} can be reached from a root")
        out.append(nxt)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def same_size(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> bool:
    """Whether two tables differ in rows by no more than a share; raise on it where a batch must not go on."""
    n, m = a.count(), b.count()
    return abs(n - m) <= tolerance * max(n, 1)


def batch_requests(df: DataFrame, key: str, prompt: str, model: str, suffix: str = "", per_shard: int = 50_000) -> DataFrame:
    """``shard, line``: one JSON request per row, its id the key and a suffix; shards of ``per_shard`` rows in the order of the key."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    rows = global_index(df.where(F.col(prompt).isNotNull()).select(key, line.alias("line")), [F.col(key), F.col("line")])
    return rows.select(F.floor(F.col("_row_idx") / per_shard).cast("int").alias("shard"), "line")


def id_parts(custom_id: str | Column, sep: str = "_") -> tuple[Column, Column]:
    """(first, rest) of a batch id: what stands before the first separator, and all behind it."""
    p = F.split(col(custom_id), sep)
    return F.get(p, F.lit(0)), F.array_join(F.slice(p, 2, F.size(p)), sep)


RESULT = "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<finish_reason:string, message:struct<content:string>>>, usage:struct<prompt_tokens:bigint, completion_tokens:bigint>>>"


def batch_results(lines: DataFrame, line: str, order: list[Column] | None = None) -> DataFrame:
    """Parsed results: malformed lines, filtered and failed ones are left out.

    Of results with one id all are given; with ``order`` only the last in that order, as a
    dictionary filled line by line would hold.
    """
    r = lines.select(F.from_json(line, RESULT).alias("r"), F.struct(*(order or [F.lit(0)])).alias("_order")).where("r.custom_id is not null and r.response.status_code = 200")
    choice = F.try_element_at("r.response.body.choices", F.lit(1))
    r = r.where(F.size("r.response.body.choices") > 0).where(F.coalesce(choice["finish_reason"], F.lit("")) != "content_filter").select(
        "_order", F.col("r.custom_id").alias("custom_id"), choice["message"]["content"].alias("content"), F.col("r.response.body.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.response.body.usage.completion_tokens").alias("completion_tokens"))
    if order is None:
        return r.drop("_order")
    return r.groupBy("custom_id").agg(F.max_by(F.struct("content", "prompt_tokens", "completion_tokens"), "_order").alias("x")).select("custom_id", "x.*")


def cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    return (prompt * per_million_in + completion * per_million_out) / 1_000_000
