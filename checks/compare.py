"""Run the registered queries beside their DuckDB statements and compare whole results.

python -m checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """'' when both hold the same columns and rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    cols = sorted(got.columns)
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in cols if got[c].dtype.kind != want[c].dtype.kind]

    def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
        text = df[cols].astype(object).where(df[cols].notna(), None)
        return sorted(tuple(str(v) for v in row) for row in text.itertuples(index=False))

    bad = [(a, b) for a, b in zip(rows(got), rows(want)) if a != b]
    if bad:
        return f"{len(bad)} rows differ, kinds {kinds}, first {bad[0]}"
    return f"kinds {kinds}" if kinds and len(got) else ""


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tradearea-")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, names: list[str]) -> int:
    spark, con, oracles, bad = session(), connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            verdict = same(got, con.execute(oracles[name]).df()) if name in oracles else "(rows only)"
        except Exception as error:  # a failing query must not hide the others
            got, took, verdict = pd.DataFrame(), time.time() - start, f"ERROR {str(error)[:600]}"
        bad += verdict not in ("", "(rows only)")
        print(f"{'ok ' if verdict in ('', '(rows only)') else 'BAD'} {name:28s} {len(got):7d} rows {took:6.1f}s {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
