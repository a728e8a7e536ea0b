"""Compare every query with its SQL: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for name in TABLES:
        database.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return database


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(mine: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs between two results, order aside; None if nothing does."""
    if sorted(mine.columns) != sorted(expected.columns):
        return f"columns {sorted(mine.columns)} and {sorted(expected.columns)}"
    if len(mine) != len(expected):
        return f"{len(mine)} rows and {len(expected)} expected"
    mine, expected = canonical(mine), canonical(expected)
    for column in mine.columns:
        a, b = mine[column], expected[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            place = (~same).idxmax()
            return f"{column}: {(~same).sum()} differ, first {a[place]!r} and {b[place]!r}"
        if a.isna().any() and {str(a.dtype), str(b.dtype)} == {"float64", "Int64"}:
            continue  # pandas has two forms of whole numbers with nulls
        if a.dtype != b.dtype:
            return f"{column}: types {a.dtype} and {b.dtype}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as contract
    from corpusweave.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(mine)} {took:.1f}s", flush=True)
                continue
            wrong = difference(mine, database.sql(oracles[name]).df())
        except Exception as error:  # report and go on with the next query
            wrong, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
        failed += wrong is not None
        print(f"{'ok   ' if wrong is None else 'WRONG'} {name} {took:.1f}s {wrong or ''}", flush=True)
    print(f"{failed} wrong, oracles without query: {sorted(set(oracles) - set(queries))}")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    sys.exit(bool(main(folder, arguments[1:])))
