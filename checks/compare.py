"""Run registered queries and their SQL side by side and compare all values.

``python -m checks.compare [scale] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "∅"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same values, else what differs first."""
    relation = con.sql(sql)
    if sorted(relation.columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(relation.columns)}"
    left = rows_of(spark_df.columns, spark_df.collect())
    right = rows_of(relation.columns, relation.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            cells = [(x[:300], y[:300]) for x, y in zip(a, b, strict=True) if x != y]
            return f"first difference {sorted(spark_df.columns)}: {a[:3]!r:.200} {cells}"
    return None


def main(scale: str, only: list[str]) -> int:
    from checks import oracle, queries
    from promptloom.session import build_session

    spark = build_session(
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        }
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = os.path.join("/root/testdata", f"sf{scale}")
    con, sql, bad = connect(sf_dir), oracle.oracle_sql(), 0
    for name, query in queries.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            result = difference(query(spark, sf_dir), con, sql[name]) if name in sql else "no SQL"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
