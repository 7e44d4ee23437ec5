"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return "∅"
    if isinstance(value, float):
        return "∅" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "item"):
        return canonical(value.item())
    return str(value)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    typed = pdf.astype(object)
    return sorted(tuple(canonical(v) for v in row) for row in typed[columns].itertuples(index=False))


def kind(dtype) -> str:
    s = str(dtype).lower()
    return "int" if "int" in s else "float" if "float" in s or "double" in s else s


def compare(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = query(spark, folder).toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    for c in got.columns:
        if got[c].notna().all() and want[c].notna().all() and kind(got[c].dtype) != kind(want[c].dtype):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
        if kind(got[c].dtype) == "float" or kind(want[c].dtype) == "float":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else (None if a else "EMPTY")


def main() -> int:
    import __spark_entry__ as entry
    from assayloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session("8"), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, name, query, sql[name])
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                n = query(spark, folder).count()
                note, problem = f"rows only: {n}", None if n else "empty"
        except Exception as e:  # noqa: BLE001 - every failure is reported, the rest goes on
            problem = note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} problems")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
