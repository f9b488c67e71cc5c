"""Readers and writers of the toolkit's file formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.mix import lowest
from loomwright.operators.tables import chunk_boundaries


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, JSON arrays, Parquet, CSV, TSV or ORC by suffix; a folder is Parquet. With a schema nothing is inferred."""
    r = spark.read.schema(schema) if schema else spark.read
    suffix = path.rstrip("/").rsplit("/", 1)[-1].lower().removesuffix(".gz")
    if suffix.endswith((".jsonl", ".ndjson")):
        return r.json(path)
    if suffix.endswith(".json"):
        return r.option("multiLine", True).json(path)
    if suffix.endswith(".csv"):
        return r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix.endswith(".tsv"):
        return r.option("header", True).option("sep", "\t").csv(path)
    if suffix.endswith(".orc"):
        return r.orc(path)
    return r.parquet(path)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.jsonl", schema: T.StructType | str | None = None) -> DataFrame:
    """All files under a folder, with the path of each row's file and the name of its folder."""
    r = spark.read.schema(schema) if schema else spark.read
    df = r.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("folder", F.element_at(F.split("file", "/"), -2))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet by way of pandas: such files are small."""
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def first_rows(df: DataFrame, spec: str, order: str) -> DataFrame:
    """``train[:n]`` or ``train[:p%]`` slices, in the order of a key."""
    limit = spec.split("[:", 1)[1].rstrip("]") if "[:" in spec else ""
    if not limit:
        return df
    n = int(df.count() * float(limit[:-1]) / 100) if limit.endswith("%") else int(limit)
    return lowest(df, n, F.col(order))


def write_lines(df: DataFrame, path: str, per_file: int | None = None, by: str | None = None) -> None:
    """JSON lines, nulls kept; at most ``per_file`` rows a file, one folder per value of ``by``."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    if per_file:
        w = w.option("maxRecordsPerFile", per_file)
    (w.partitionBy(by) if by else w).json(path)


def write_tsv(df: DataFrame, path: str, key: str) -> None:
    """A matrix: header, ``%.4f`` cells, one file."""
    cells = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).orderBy(key).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def split_kept(df: DataFrame, removed: str, path: str) -> None:
    """Kept and removed rows of one flagged table, each in its folder."""
    df.write.mode("overwrite").partitionBy(removed).parquet(path)


def id_type(vocabulary: int) -> np.dtype:
    """The smallest unsigned type that holds every id."""
    return next(np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64) if vocabulary - 1 <= np.iinfo(t).max)


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI, or as a path that all machines mount."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_tokens(df: DataFrame, key: str, ids: str, folder: str, vocabulary: int, chunk_tokens: int) -> DataFrame:
    """Flat binary chunks of token ids and a table of each document's stretch in them.

    Documents are laid end to end in key order; chunk ``n`` is ``tokens-n.bin``, written by one
    task from the stretches that touch it into the folder's own file system, which executors and
    driver must share.  A task that runs again writes the same file.  Returns ``key, chunk,
    chunk_start, chunk_end``.
    """
    store, path = _open_folder(folder)
    store.create_dir(path, recursive=True)
    kind = id_type(vocabulary)
    spans = chunk_boundaries(df.select(key, F.size(ids).alias("n")), key, "n", chunk_tokens)
    whole = df.select(key, F.col(ids).alias("_ids"))
    firsts = spans.groupBy(key).agg(F.min("chunk").alias("_first"))
    starts = spans.join(firsts, key).where("chunk = _first").select(key, (F.col("chunk") * chunk_tokens + F.col("chunk_start")).alias("_start"))
    parts = spans.join(starts, key).join(whole, key).select("chunk", "chunk_start", F.slice("_ids", (F.col("chunk") * chunk_tokens + F.col("chunk_start") - F.col("_start") + 1).cast("int"), (F.col("chunk_end") - F.col("chunk_start")).cast("int")).alias("ids"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_start")
        flat = np.concatenate([np.asarray(x, dtype=kind) for x in pdf["ids"]]) if len(pdf) else np.zeros(0, kind)
        n = int(pdf["chunk"].iloc[0])
        store, path = _open_folder(folder)
        with store.open_output_stream(f"{path}/tokens-{n:05d}.bin") as out:
            out.write(flat.tobytes())
        return pd.DataFrame({"chunk": [n], "n": [len(flat)]})

    parts.groupBy("chunk").applyInPandas(run, "chunk long, n long").write.mode("overwrite").parquet(f"{folder}/chunks")
    spans.write.mode("overwrite").option("compression", "gzip").csv(f"{folder}/boundaries")
    return spans


def read_tokens(folder: str, vocabulary: int) -> Iterator[np.ndarray]:
    """The chunks in order, one at a time."""
    store, path = _open_folder(folder)
    names = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".bin")]
    for name in sorted(names, key=lambda x: int(x.rsplit("-", 1)[1][:-4])):
        with store.open_input_stream(name) as f:
            yield np.frombuffer(f.read(), dtype=id_type(vocabulary))
