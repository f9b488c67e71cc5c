"""Runs queries beside their SQL on one data folder and tells which differ."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def tables(con: duckdb.DuckDBPyConnection, folder: str) -> None:
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE OR REPLACE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return tuple(cell(y) for y in x)
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return round(x, 6) + 0.0
        if isinstance(x, bool):
            return int(x)
        return x

    cols = sorted(df.columns)
    return sorted((tuple(cell(x) for x in row) for row in df[cols].itertuples(index=False, name=None)), key=repr)


def differences(spark, folder: str, names: list[str], queries: dict, sql: dict) -> dict[str, str]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    tables(con, folder)
    bad = {}
    for n in names:
        try:
            ours = queries[n](spark, folder).toPandas()
            if n not in sql:
                print(n, len(ours), "no SQL")
                continue
            theirs = con.execute(sql[n]).df()
            a, b = sorted(ours.columns), sorted(theirs.columns)
            if a != b:
                bad[n] = f"columns {a} and {b}"
            elif len(ours) != len(theirs):
                bad[n] = f"rows {len(ours)} and {len(theirs)}"
            else:
                x, y = canonical(ours), canonical(theirs)
                if x != y:
                    k = next(i for i in range(len(x)) if x[i] != y[i])
                    bad[n] = f"row {k}: {str(x[k])[:300]} and {str(y[k])[:300]}; {[(str(t), str(ours[t].dtype), str(theirs[t].dtype)) for t in a]}"
            print(n, len(ours), "differs" if n in bad else "same")
        except Exception as e:
            bad[n] = f"{type(e).__name__}: {str(e)[:600]}"
            print(n, "failed")
    return bad


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from loomwright.session import get_session

    spark = get_session("compare", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or sorted(queries)
    for k, v in differences(spark, sys.argv[1], [n for n in names if n in queries], queries, sql).items():
        print("!!", k, v)
