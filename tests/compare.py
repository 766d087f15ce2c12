"""Runs registered queries on Spark and their oracle SQL on DuckDB and compares the rows.

    python tests/compare.py SF_DIR [name or prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if value.isoformat().endswith("00:00:00") else value.isoformat()
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)) or type(value).__name__ == "Decimal":
        return float(value) + 0.0
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    found = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} spark, {len(right)} oracle"
    names = sorted(left.columns)
    a, b = set(rows(left)), set(rows(right))
    if rows(left) == rows(right):
        return None
    only_a, only_b = sorted(a - b, key=str), sorted(b - a, key=str)
    detail = ""
    if only_a and only_b:
        x = only_a[0]
        y = max(only_b, key=lambda r: sum(p == q for p, q in zip(x, r)))
        detail = "; ".join(f"{n}: {p} | {q}" for n, p, q in zip(names, x, y) if p != q)
    return f"{len(only_a)} of {len(left)} rows differ: {detail}"


def main(directory: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from equiloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(directory), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            left = query(spark, directory).toPandas()
            took = time.time() - start
            note = "rows only" if name not in oracles else None
            if note is None:
                start = time.time()
                result = connection.sql(oracles[name])
                right = result.df()
                note = differences(left, right) or "ok"
                note += f" (duckdb {time.time() - start:.1f}s)" if time.time() - start > 5 else ""
        except Exception as error:  # report and go on
            took, left, note = time.time() - start, [], "ERROR " + str(error)[:700]
        bad += not note.startswith(("ok", "rows only"))
        print(f"{name:34s} {len(left):7d} rows {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
