"""Typed loads of the model's tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.model import HOSPITAL, MONTHLY, Table

MONTH = "month"  # the column of the monthly folders, as yyyy-MM


def load_tables(
    spark: SparkSession,
    directory: str,
    schemas: Mapping[str, T.StructType],
    fmt: str = "parquet",
    suffix: str | None = None,
    register: bool = True,
    **options: str,
) -> dict[str, DataFrame]:
    """Reads ``<directory>/<name><suffix>`` for every schema, without inference.

    Tables come back in the order of ``schemas`` and, with ``register``, as
    temporary views of the same name.
    """
    if fmt == "csv":
        options = {"header": "true", **options}
    suffix = f".{fmt}" if suffix is None else suffix
    tables = {}
    for name, schema in schemas.items():
        tables[name] = spark.read.schema(schema).options(**options).format(fmt).load(f"{directory}/{name}{suffix}")
        if register:
            tables[name].createOrReplaceTempView(name)
    return tables


def load_hospital(
    spark: SparkSession,
    directory: str,
    fmt: str = "parquet",
    suffix: str = "",
    model: Mapping[str, Table] = HOSPITAL,
    register: bool = True,
    months: tuple[str, str] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """The hospital tables under their English names, from files with the stored names.

    ``months``, first and last as yyyy-MM, limits the facts that are kept in monthly folders, as ``write_hospital`` leaves
    them: files of other months are not opened.
    """
    stored = {t.stored: t.stored_schema() for t in model.values()}
    if months:
        for name in MONTHLY.keys() & model.keys():
            stored[model[name].stored] = T.StructType([*model[name].stored_schema(), T.StructField(MONTH, T.StringType())])
    raw = load_tables(spark, directory, stored, fmt, suffix, register=False, **options)
    if months:
        raw |= {model[name].stored: raw[model[name].stored].where(F.col(MONTH).between(*months))
                for name in MONTHLY.keys() & model.keys()}
    tables = {name: from_stored(raw[t.stored], t) for name, t in model.items()}
    if register:
        register_views(tables)
    return tables


def from_stored(df: DataFrame, table: Table) -> DataFrame:
    return df.select(*(F.col(c.stored).cast(c.type).alias(c.name) for c in table.columns))


def to_stored(df: DataFrame, table: Table) -> DataFrame:
    return df.select(*(F.col(c.name).cast(c.type).alias(c.stored) for c in table.columns))


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, as a single job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
