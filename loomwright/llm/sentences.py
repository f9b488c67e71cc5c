"""Problem 7 as a DataFrame operator: units of every document with their positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import boundaries as B
from loomwright.session import cut_lineage
from loomwright.sources.tables import table

#: Texts longer than this are cut into chunks of their own tasks, of so many characters; below, a text's chunks stay in its task.
LONG_TEXT, LONG_CHUNK = 1 << 19, 1 << 16
_ENDS = T.ArrayType(T.LongType())
_NUMBERS = T.ArrayType(T.IntegerType())
_PLACE = "_start int, _end int, _mid string, _goes_on boolean, _floor int, _followed boolean, _cut boolean, _last boolean"


@F.pandas_udf(_ENDS)
def _ends(texts: pd.Series) -> pd.Series:
    return pd.Series([B.unit_ends(t) if t else [] for t in texts], dtype=object)


def _cut(size: int) -> Callable:
    """Chunks of each text with as much of their neighbours as they see, and each as a function from the right."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, key, text in zip(b["_row"], b["_key"], b["_text"]):
                for no, c in enumerate(B.chunks_of(text, size)):
                    lo = min(c.start, c.floor)
                    hi = B._SPACE.match(text, c.end).end() + 2 * B.CONTEXT
                    near = c._replace(start=c.start - lo, end=c.end - lo, floor=c.floor - lo)
                    window = text[lo:hi]
                    loss, gain = B.chunk_right(window, near)
                    yield pd.DataFrame({"_row": [row], "_key": pd.Series([key], dtype=b["_key"].dtype), "_no": [no], "_at": [lo], "_chunk": [window], **{f"_{k}": [v] for k, v in near._asdict().items()}, "_loss": [loss], "_gain": [gain]})

    return run


@F.pandas_udf(T.ArrayType(_NUMBERS))
def _rights(loss: pd.Series, gain: pd.Series) -> pd.Series:
    return pd.Series([B.compose_suffixes([(list(x), list(y)) for x, y in zip(p, q)]) for p, q in zip(loss, gain)], dtype=object)


@F.pandas_udf(_NUMBERS)
def _entries(tables: pd.Series) -> pd.Series:
    return pd.Series([B.compose_prefixes([list(t) for t in ts]) for ts in tables], dtype=object)


def _chunk(r: pd.DataFrame, k: int) -> B.Chunk:
    return B.Chunk(*(r[f"_{f}"].iloc[k] for f in B.Chunk._fields))


@F.pandas_udf(T.StructType([T.StructField("_table", _NUMBERS), T.StructField("_ends", _ENDS)]))
def _transition(r: pd.DataFrame) -> pd.DataFrame:
    out = []
    for k in range(len(r)):
        table, ends = B.transition(r["_chunk"].iloc[k], _chunk(r, k), list(r["_right"].iloc[k]))
        out.append((table, [int(r["_at"].iloc[k]) + e for e in ends]))
    return pd.DataFrame(out, columns=["_table", "_ends"])


@F.pandas_udf(_ENDS)
def _emit(r: pd.DataFrame) -> pd.Series:
    out = []
    for k in range(len(r)):
        q, at = int(r["_state"].iloc[k]), int(r["_at"].iloc[k])
        out.append(list(r["_ends"].iloc[k]) if q == B.OUT else [at + e for e in B.emit(r["_chunk"].iloc[k], _chunk(r, k), q, list(r["_right"].iloc[k]))[0]])
    return pd.Series(out, dtype=object)


def sentence_ends(df: DataFrame, key: str = "doc_id", text: str = "text", long_text: int = LONG_TEXT, long_chunk: int = LONG_CHUNK) -> DataFrame:
    """``(key, sent_end)``: one row per sentence unit; ``sent_end`` counts code points.

    Null, empty and blank texts have no unit.  Rows are independent: repeated rows give
    repeated units; other columns are not read.  Every text is cut into chunks whose functions are
    composed by prefix scans.  Those of a text up to ``long_text`` code points stay in its task,
    which shuffles nothing; those of a longer one are rows of ``long_chunk`` characters, and only
    the functions of a text, some hundred numbers a chunk, come together.
    """
    d = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    usual = d.where(F.length("_text") <= long_text)
    short = usual.select("_key", F.explode(_ends("_text")).alias("sent_end"))

    long = d.where(F.length("_text") > long_text).withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType(long.select("_row", "_key").schema.fields + T.StructType.fromDDL(f"_no int, _at bigint, _chunk string, {_PLACE}, _loss array<int>, _gain array<int>").fields)
    chunks = cut_lineage(long.select("_row", "_key", "_text").mapInPandas(_cut(long_chunk), schema))
    place = [f"_{f}" for f in B.Chunk._fields]
    right = (
        chunks.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_no", "_loss", "_gain"))).alias("c"))
        .select("_row", F.posexplode(_rights(F.col("c._loss"), F.col("c._gain"))).alias("_no", "_right"))
    )
    moved = cut_lineage(chunks.drop("_loss", "_gain").join(right, ["_row", "_no"]).withColumn("x", _transition(F.struct("_at", "_chunk", "_right", *place))).select("*", "x.*").drop("x"))
    entry = (
        moved.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_no", "_table"))).alias("c"))
        .select("_row", F.posexplode(_entries(F.col("c._table"))).alias("_no", "_state"))
    )
    emitted = moved.drop("_table").join(entry, ["_row", "_no"]).select("_key", F.explode(_emit(F.struct("_at", "_chunk", "_right", "_ends", "_state", *place))).alias("sent_end"))
    return short.unionByName(emitted).withColumnRenamed("_key", key)


def unit_slice(text: Column, start: Column, end: Column) -> Column:
    """The unit's text, without the blanks before it."""
    return F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+", "")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, sent_end`` of every unit of documents."""
    return sentence_ends(table(spark, folder, "documents")).select("doc_id", F.col("sent_end").cast("long"))


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
