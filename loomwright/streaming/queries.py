"""Structured Streaming forms of the operators: incremental filters, windows, exclusion state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream of its files; times without a zone count as UTC's."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        df = r.parquet(path)
    else:
        df = r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields])


def run_once(df: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Processes all that is there, then stops; the result is a table in the shared folder.

    With ``root``, a folder of an earlier run, the stream goes on where that one stopped and only
    reads what is new; without it every run starts from the beginning in a folder of its own.
    ``update`` and ``complete`` results keep what the last micro-batch of a key says, by
    writing each batch down with its number.
    """
    spark = df.sparkSession
    import uuid

    root = root or f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{root}/data").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/data")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/data/part_no={number}")

    w.foreachBatch(keep).start().awaitTermination()
    return spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data/*").drop("part_no")


def windowed(df: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Event-time sessions per key that end after a gap."""
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def excluded_prompts(df: DataFrame, prompt: str, correct: str, least: int, rate: float) -> DataFrame:
    """Prompts that reach a pass rate after ``least`` rollouts, each told once, with state per prompt."""
    kind = dict(df.dtypes)[prompt]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ok, told = state.get if state.exists else (0, 0, False)
        for b in batches:
            n, ok = n + len(b), ok + int(b[correct].sum())
        hit = not told and n >= least and ok >= rate * n
        state.update((n, ok, told or hit))
        yield pd.DataFrame({prompt: [key[0]] if hit else [], "n": [n] if hit else []})

    return df.select(prompt, correct).groupBy(prompt).applyInPandasWithState(step, f"{prompt} {kind}, n long", "n long, ok long, told boolean", "append", GroupStateTimeout.NoTimeout)


def per_batch(df: DataFrame, name: str, work: Callable[[DataFrame, int], None]) -> None:
    """Runs ``work`` on every micro-batch: the place of a queue between producer and consumer."""
    root = f"{ensure_checkpoint_dir(df.sparkSession)}/streams/{name}"
    df.writeStream.foreachBatch(work).option("checkpointLocation", root).trigger(availableNow=True).start().awaitTermination()
