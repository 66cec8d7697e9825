"""Writing results and tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.model import HOSPITAL, MONTHLY, Table
from wardbook.session import new_run_dir
from wardbook.sources.load import MONTH, to_stored

FORMATS = ("json", "csv", "parquet")


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the way results leave towards JSON consumers."""
    return df.select(*(
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ))


def export_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Writes a result set as JSON rows, CSV or Parquet, one file per partition.

    JSON rows keep NULL fields and hold decimals as numbers. CSV cannot hold
    arrays, which leave as JSON text.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    if fmt == "json":
        plain_numbers(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        flat = df.select(*(
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields
        ))
        flat.write.mode(mode).option("header", "true").csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_hospital(
    tables: Mapping[str, DataFrame],
    directory: str,
    mode: str = "errorifexists",
    model: Mapping[str, Table] = HOSPITAL,
) -> None:
    """Writes the tables as Parquet under their stored names and types, facts by month."""
    for name, table in model.items():
        if name not in tables:
            continue
        target = f"{directory}/{table.stored}"
        stored = to_stored(tables[name], table)
        if name in MONTHLY:
            instant = next(c.stored for c in table.columns if c.name == MONTHLY[name])
            by_month = stored.withColumn(MONTH, F.date_format(instant, "yyyy-MM"))
            # REBALANCE brings a month together in few files and splits a busy one.
            by_month.hint("rebalance", MONTH).write.mode(mode).partitionBy(MONTH).parquet(target)
        else:
            stored.write.mode(mode).parquet(target)


def write_bucketed(
    tables: Mapping[str, DataFrame],
    key: str = "encounter_id",
    buckets: int | None = None,
    database: str | None = None,
) -> dict[str, DataFrame]:
    """The tables as catalogue tables bucketed and sorted by ``key``, in the shared folder: joins and aggregates on the
    key need no exchange.

    ``buckets`` is the same for all of them, by default the session's number of shuffle partitions. One task reads a
    bucket, and a bucket cannot be split, so ``key`` has to be one whose rows are bounded, as those of an encounter are by
    the catalogue of procedures. Rows are dealt out by the key first, so that a bucket is one file. The tables have new
    names in ``database`` (the current one if not given) and can be dropped without losing the files.
    """
    made = {}
    for name, df in tables.items():
        spark = df.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = ".".join(filter(None, (database, f"{name}_{uuid.uuid4().hex}")))
        (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
         .option("path", new_run_dir(spark, f"bucketed/{name}")).saveAsTable(table))
        made[name] = spark.table(table)
    return made
