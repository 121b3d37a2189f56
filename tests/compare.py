"""Compare a Spark result with its SQL twin, order-insensitively."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, relation) -> str | None:
    """None when both hold the same rows, else a short description."""
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"
    mine = bag(spark_df.columns, spark_df.collect())
    theirs = bag(relation.columns, relation.fetchall())
    if mine == theirs:
        return None
    return (
        f"rows {sum(mine.values())} vs {sum(theirs.values())}; only spark: "
        f"{list((mine - theirs).items())[:3]}; only sql: {list((theirs - mine).items())[:3]}"
    )
