"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import new_run_dir

Tables = Mapping[str, DataFrame]


def distinct_keys(df: DataFrame, *columns: str, renamed: tuple[str, ...] = ()) -> DataFrame:
    """The distinct non-NULL keys of a table.

    Used for the right side of every semi, anti and presence join: the partial
    aggregate removes repeats before the shuffle, so a hot key travels as one row
    per task.
    """
    names = renamed or columns
    keys = df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    return splittable(keys.dropna().distinct())


def splittable(right: DataFrame) -> DataFrame:
    """An aggregate as the right side of a join whose left side may have a hot key.

    Spark splits a hot key at run time only where a shuffle lies directly below both
    sides of the join. A join that reuses the partitioning of an aggregate has none
    there, so the aggregate is dealt out anew, in partitions of any rows.
    """
    return right.hint("rebalance")


def written(df: DataFrame, job: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, here; lineage ends, and its size is known to later joins."""
    spark = df.sparkSession
    path = new_run_dir(spark, job)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(tables: Tables, role: str, *columns: str, prefix: str = "") -> DataFrame:
    """A role table (patient, staff, resident, supervisor) with columns of its person.

    Extracts that already carry the wanted columns are used as they are.
    """
    roles = tables[role]
    wanted = ("name", *columns)
    missing = [c for c in wanted if c not in roles.columns]
    if missing:
        person = tables["person"].select(F.col("person_id").alias(f"{role}_id"), *missing)
        roles = roles.join(person, f"{role}_id")
    if prefix:
        return roles.select(f"{role}_id", *(F.col(c).alias(prefix if c == "name" else c) for c in wanted))
    return roles

