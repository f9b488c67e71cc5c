"""Types of the data model, and alignment of tables that are to be concatenated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
TOOL_MESSAGE = T.StructType([*MESSAGE.fields, T.StructField("functions", T.StringType()), T.StructField("function_calls", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
SFT = T.StructType([T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("messages", MESSAGES)])
PREFERENCE = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("chosen", MESSAGES), T.StructField("rejected", MESSAGES)])
IDS = T.ArrayType(T.IntegerType())
TOKENIZED = T.StructType([T.StructField(c, IDS) for c in ("input_ids", "attention_mask", "labels")])
TOKENIZED_PREFERENCE = T.StructType([T.StructField(f"{side}_{c}", IDS) for side in ("chosen", "rejected") for c in ("input_ids", "labels", "attention_mask")])
IGNORED_LABEL = -100


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself; raises when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``: others are dropped, absent ones are null strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns and types of ``schema``: cast where present, null where absent."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def concat_aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows in the columns and types of the first table."""
    first = frames[0].schema
    return reduce(DataFrame.unionAll, [align(f, first) for f in frames])


def as_list(df: DataFrame, column: str) -> DataFrame:
    """A scalar column becomes an array of one; arrays stay, null stays null."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.array(column)))
