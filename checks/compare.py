"""Runs the registered queries next to their SQL and reports every difference.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from riskline.session import start


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    out = [tuple(map(_plain, r)) for r in pdf.itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def difference(spark: SparkSession, con, folder: str, name: str) -> str | None:
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLE:
        return None if len(got) else "no rows"
    want = con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if not b:
        return "the SQL finds no rows"
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = start(
        "riskline-compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or QUERIES:
        began = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # report every query, not only the first to fail
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} queries differ; {len(ORACLE)} have SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
