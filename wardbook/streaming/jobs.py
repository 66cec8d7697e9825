"""Structured Streaming jobs: audit log, running means, roster arbitration.

Each job drains what is available into Parquet tables below a directory, a folder per
micro-batch that is overwritten if the batch is delivered again, and returns what the
tables say. Given the same directory again it goes on where it stopped. A
micro-batch is worked on by the batch operators; how the input is cut into micro-batches does
not change what the tables say. Folders are merged as they come, so that neither their number nor
what a micro-batch reads grows with the micro-batches before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import ratio
from wardbook.functions.frames import Tables, splittable
from wardbook.operators.changes import audit_entries
from wardbook.operators.ingest import SLOT, against_standing, decided, first_of, judge_slots
from wardbook.session import new_run_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                bytes_per_batch: int = 64 << 30) -> DataFrame:
    """A stream over a Parquet table, a folder of part files or one file. Without any file it is an error.

    Micro-batches are bounded in bytes, or in files.
    """
    path = path.rstrip("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if not files:
        raise FileNotFoundError(f"there is no file of a table at {path}")
    if len(files) == 1 and files[0].rsplit("/", 1)[1] == path.rsplit("/", 1)[1]:
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


def _drain(stream: DataFrame, directory: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    (
        stream.writeStream.foreachBatch(work).outputMode(mode)
        .option("checkpointLocation", f"{directory}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )


FAN = 8  # folders of one width that are merged


class _Batches:
    """A table written by micro-batch; the number of the micro-batch is the column ``batch``.

    A folder holds a range of micro-batches. FAN folders of one width are merged into one of FAN times the
    width, so that a row is rewritten a logarithmic number of times and a reader opens a logarithmic number of folders.
    ``merge`` may shrink the rows on the way. Readers take complete folders (with Spark's success marker), the widest
    first: a merge that broke off is not seen, and is made again with its micro-batch. Folders that a wider one
    holds go when the next micro-batch begins, since then theirs is not delivered again; what was read before, but not
    yet computed, must be read anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str] = (),
                 merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.by, self.merge = spark, path, list(by), merge
        self.names = schema.names
        # What partitions the folders comes last, as Spark reads it.
        kept = [f for f in schema if f.name not in self.by]
        self.schema = T.StructType([*kept, T.StructField("batch", T.LongType()), *(f for f in schema if f.name in self.by)])

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        """Writes the rows of a micro-batch and returns them as written."""
        self._remove_merged(number)
        written = self._put(rows.select(*self.names).withColumn("batch", F.lit(number).cast("long")), number, number)
        width = FAN
        while (number + 1) % width == 0:
            first, step = number + 1 - width, width // FAN
            rows = self._open([(k, k + step - 1) for k in range(first, number + 1, step)])
            self._put(self.merge(rows) if self.merge else rows, first, number)
            width *= FAN
        return written

    def read(self) -> DataFrame:
        return self._open(self.folders())

    def folders(self) -> list[tuple[int, int]]:
        """First and last micro-batch of the folders that hold all rows, each once."""
        chosen, after = [], 0
        for first, last in sorted(self._complete(), key=lambda f: (f[0], -f[1])):
            if first >= after:
                chosen.append((first, last))
                after = last + 1
        return chosen

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/folder={first:010d}-{last:010d}"

    def _put(self, rows: DataFrame, first: int, last: int) -> DataFrame:
        rows.select(*self.schema.names).write.partitionBy(*self.by).mode("overwrite").parquet(self._folder(first, last))
        return self._open([(first, last)])

    def _open(self, folders: Sequence[tuple[int, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*(self._folder(*f) for f in folders)).select(*self.schema.names)

    def _files(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(context._jsc.hadoopConfiguration()), path

    def _complete(self) -> list[tuple[int, int]]:
        files, path = self._files()
        found = files.globStatus(path(f"{self.path}/*/_SUCCESS")) or []
        return [tuple(map(int, str(f.getPath().getParent().getName()).split("=")[1].split("-"))) for f in found]

    def _remove_merged(self, number: int) -> None:
        files, path = self._files()
        complete = self._complete()
        for first, last in complete:
            if any((x, y) != (first, last) and x <= first and last <= y < number for x, y in complete):
                files.delete(path(self._folder(first, last)), True)


def audit_to_table(changes: DataFrame, key: str, user: Column | None = None, directory: str | None = None) -> DataFrame:
    """The audit log of a stream of (change_id, operation, key, before, after, changed_at).

    Every change is logged once, however late it comes and however often it is
    delivered: the ids that were logged, with the day of the change, are the state of the
    stream. A micro-batch looks up its own ids in it, in a RocksDB store per partition whose files have Bloom
    filters (see ``session.STREAM_SETTINGS``), and never reads the log. Changes without an id are all logged.
    """
    spark = changes.sparkSession
    directory = directory or new_run_dir(spark, "audit")
    entries = audit_entries(changes, key, F.col("changed_at"), user).schema
    identity = [T.StructField("change_id", changes.schema["change_id"].dataType), T.StructField("day", T.DateType())]
    log = _Batches(spark, f"{directory}/rows", T.StructType([*entries, *identity]), by=["day"])
    day = F.coalesce(F.to_date("changed_at"), F.lit("1970-01-01").cast("date"))
    own = F.when(F.col("change_id").isNull(), F.expr("uuid()")).otherwise("")
    once = changes.withColumn("day", day).withColumn("_own", own).dropDuplicates(["change_id", "day", "_own"])
    _drain(once, directory, lambda batch, number: log.write(
        audit_entries(batch, key, F.col("changed_at"), user, "change_id", "day"), number))
    return log.read().select(*entries.names)


def means_to_table(performed: DataFrame, directory: str | None = None) -> DataFrame:
    """Running mean minutes per procedure of a stream of (procedure_id, minutes, sign).

    ``sign`` is 1 for an execution that was added and -1 for one that was removed;
    a change of minutes is one of each. Every micro-batch appends a new version
    per procedure it touched; the mean is NULL when no execution is left. Executions
    without a procedure are one group like any other.
    """
    spark = performed.sparkSession
    directory = directory or new_run_dir(spark, "means")
    minutes, sign = F.col("minutes").cast("long"), F.col("sign").cast("long")
    sums = performed.groupBy("procedure_id").agg(F.sum(minutes * sign).alias("total"), F.sum(sign).alias("n"))
    versions = sums.withColumn("mean_minutes", ratio("total", "n"))
    table = _Batches(spark, f"{directory}/rows", versions.schema)
    _drain(versions, directory, table.write, "update")
    return table.read().withColumnRenamed("batch", "version")


def current_means(versions: DataFrame) -> DataFrame:
    """The newest version per procedure of what ``means_to_table`` wrote."""
    newest = versions.groupBy("procedure_id").agg(F.max(F.struct("version", "n", "mean_minutes")).alias("v"))
    return newest.select("procedure_id", F.col("v.n").alias("executions"), "v.mean_minutes")


def _earliest(holders: DataFrame) -> DataFrame:
    """Of the holders of a slot the first."""
    first = holders.groupBy(*SLOT).agg(F.min(F.struct("_first", "_first_unit_id")).alias("h"), F.max("batch").alias("batch"))
    return first.select(*SLOT, "h.*", "batch")


def roster_to_table(requests: DataFrame, base: DataFrame | None = None, refs: Tables | None = None,
                    order: Sequence[str] = ("request_id",), directory: str | None = None) -> DataFrame:
    """Roster requests of a stream with ``reason`` (NULL: accepted), as of all that has arrived.

    The same labels as ``assign_roster`` gives the same requests, whatever order
    they arrive in: a micro-batch is judged on its own and leaves the
    first valid request for each slot it asks for; the first of those holds the
    slot. A request that arrives late and is earlier in ``order`` takes it over. The holders of merged
    micro-batches are one row per slot; no micro-batch reads the requests before it.
    """
    spark = requests.sparkSession
    directory = directory or new_run_dir(spark, "roster")
    reason = T.StructField("reason", T.StringType())
    rows = _Batches(spark, f"{directory}/rows", T.StructType([*requests.schema, reason]))
    open_requests = spark.createDataFrame([], rows.schema)
    holders = _Batches(
        spark, f"{directory}/holders", first_of(open_requests, SLOT, order, "unit_id").schema, merge=_earliest)

    def judge(batch: DataFrame, number: int) -> None:
        judged = judge_slots(batch, refs or {})
        if base is not None:
            judged = against_standing(judged, base)
        valid = rows.write(judged, number).where(F.col("reason").isNull())
        holders.write(first_of(valid, SLOT, order, "unit_id"), number)

    _drain(requests, directory, judge)
    winner = _earliest(holders.read()).drop("batch")
    return decided(rows.read().drop("batch"), splittable(winner), order).select(*requests.schema.names, "reason")
