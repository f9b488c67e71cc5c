"""Results kept by the fingerprint of the configuration that made them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators.mix import fingerprint


def cached(spark: SparkSession, folder: str, config: object, build: Callable[[], DataFrame], statistics: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The stored table of this configuration, built and written first where there is none.

    The folder is ``folder/<fingerprint>``; the configuration and the statistics lie beside the
    data.  A folder without its success mark is built anew, so a lost driver leaves no half result.
    """
    root = f"{folder}/{fingerprint(config)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(f"{root}/data")
        spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "config string").coalesce(1).write.mode("overwrite").text(f"{root}/config")
        if statistics:
            statistics(spark.read.parquet(f"{root}/data")).coalesce(1).write.mode("overwrite").json(f"{root}/statistics")
    return spark.read.parquet(f"{root}/data")


class Pipeline:
    """Named steps from table to table, as a configuration lists them.

    A step is a map (table to table) or a filter (a column that says what stays); ``keep``
    prunes columns behind every step but never the provenance column.
    """

    def __init__(self) -> None:
        self.steps: dict[str, tuple[Callable, str]] = {}

    def register(self, name: str, fn: Callable, kind: str = "map") -> None:
        if kind not in ("map", "filter"):
            raise ValueError(kind)
        self.steps[name] = (fn, kind)

    def run(self, df: DataFrame, names: list[str], arguments: dict[str, dict] | None = None, keep: list[str] | None = None) -> DataFrame:
        for n in names:
            fn, kind = self.steps[n]
            args = (arguments or {}).get(n, {})
            df = df.where(fn(**args)) if kind == "filter" else df.transform(fn, **args)
            if keep:
                df = df.select(*[c for c in df.columns if c in keep or c == "dataset_source"])
        return df
