"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for results (time zone, ANSI) or for skewed joins. Sizes
# that depend on the cluster (shuffle partitions, memory) are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle later on. It takes
    # a shuffle directly below both sides of the join: see functions.splittable.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Streaming state on local disk instead of in executor memory; a micro-batch adds what it changed to the
# checkpoint, not the whole state. A stream keeps the provider that its checkpoint was begun with.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

SHARED_DIR_SETTING = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session that somebody else built."""
    for key, value in {**SETTINGS, **STREAM_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "wardbook", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STREAM_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# By application; removed when the process ends.
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session within one process (``local``, ``local[n]``) that lacks the setting, as in tests, gets a
    temporary folder that goes with the process; on a cluster a machine-local folder would lose data,
    so a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(SHARED_DIR_SETTING, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"set {SHARED_DIR_SETTING} to a folder all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.TemporaryDirectory(prefix="wardbook-", ignore_cleanup_errors=True)
    return _local_dirs[context.applicationId].name


def new_run_dir(spark: SparkSession, job: str) -> str:
    """A fresh folder for one run of a job, below that of the application in the shared folder."""
    return f"{_application_dir(spark)}/{job}/{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wardbook/{spark.sparkContext.applicationId}"


def remove_run_dirs(spark: SparkSession) -> None:
    """Removes the run folders of this application. For when all results that read them have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
