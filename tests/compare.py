"""Comparing a Spark result with the result of the same question asked in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "hugeint": "int",
    "double": "double", "float": "double", "varchar": "string", "string": "string", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs in columns, types, and rows (as multisets)."""
    cursor = con.execute(sql)
    theirs = {c[0]: str(c[1]).lower() for c in cursor.description}
    ours = dict(result.dtypes)
    if sorted(theirs) != sorted(ours):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    names = sorted(ours)
    found = [f"{c}: {ours[c]} != {theirs[c]}" for c in names
             if KINDS.get(ours[c], ours[c]) != KINDS.get(theirs[c], theirs[c])]
    order = [list(theirs).index(c) for c in names]
    expected = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    actual = Counter(tuple(plain(v) for v in row) for row in result.select(*names).collect())
    if expected != actual:
        extra, lacking = actual - expected, expected - actual
        found.append(
            f"{names}: {sum(actual.values())} rows against {sum(expected.values())}; "
            f"only here {list(extra.items())[:3]}, only there {list(lacking.items())[:3]}")
    return found
