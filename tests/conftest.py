from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from tests import seed
from wardbook.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = build_session("wardbook-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hospital(spark) -> dict[str, DataFrame]:
    return seed.tables(spark)


@pytest.fixture
def frame(spark):
    """Builds a DataFrame from a schema string and rows."""
    def build(schema: str, *rows) -> DataFrame:
        return spark.createDataFrame(list(rows), schema)
    return build


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def as_set(df: DataFrame) -> set[tuple]:
    found = rows(df)
    assert len(found) == len(set(found))
    return set(found)


def reasons(outcome, key: str) -> dict:
    """Key -> reason of every request; checks that accepted and rejected make up the batch."""
    labelled = {r[key]: r["reason"] for r in outcome.labelled.collect()}
    accepted = {r[key] for r in outcome.accepted.collect()}
    rejected = {r[key]: r["reason"] for r in outcome.rejected.collect()}
    assert accepted.isdisjoint(rejected)
    assert labelled == {**dict.fromkeys(accepted), **rejected}
    return labelled
