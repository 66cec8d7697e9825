"""What the operators of this package share: reading, settled tables, Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.session import new_run_dir

# Bytes of one Arrow batch: with its copies, what a Python worker holds at once. A longer text is a batch of its own.
BYTES_PER_BATCH = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, job: str) -> DataFrame:
    """``df`` as a written table in the shared folder: lineage ends here, also for lost executors."""
    path = new_run_dir(df.sparkSession, f"llm/{job}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
             schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    return df.mapInArrow(work, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, the empty text for null."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def text_hash() -> Column:
    """With doc_id, tells rows apart where an id is repeated; null counts as the empty text."""
    return F.xxhash64(text_or_empty())


# Names that no table of a user has.
_KEY = ("__llm_null", "__llm_id", "__llm_hash")


def row_key(docs: DataFrame, hash_column: Column) -> dict[str, Column]:
    """Columns that are never null, so that rows without an id join and group too."""
    kind = docs.schema["doc_id"].dataType
    return dict(zip(_KEY, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)), hash_column)))


def keep_rows(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keepers`` (doc_id, text_hash) names, with all their columns.

    Of rows repeated with the same id and text one stays.
    """
    right = keepers.select(*(c.alias(k) for k, c in row_key(keepers, F.col("text_hash")).items())).distinct()
    left = docs.withColumns(row_key(docs, text_hash()))
    return left.join(right, list(_KEY), "left_semi").dropDuplicates(list(_KEY)).drop(*_KEY)


def fold(folds: int, held_out: int) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo ``folds``. Rows without an id always are."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(True))
