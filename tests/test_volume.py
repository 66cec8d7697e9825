"""What queries over large tables shuffle: facts are derived with one exchange, and once where they are read often."""

import datetime as dt
import re

import pytest

from tests.test_oracle import DIRECTORY
from wardbook.operators import ingest
from wardbook.plans.registered import QUERIES
from wardbook.sources.bindings import orders_clinic


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["performed", "billing"])
def test_lines_of_staffed_orders_take_one_exchange(spark, no_broadcast, name):
    assert len(re.findall(r"Exchange hashpartitioning", plan(orders_clinic(spark, DIRECTORY)[name]))) == 1


def test_the_audit_derives_its_facts_once(spark, no_broadcast):
    assert not re.search(r"FileScan parquet .*l_orderkey", plan(QUERIES["B_audit_hospital"](spark, DIRECTORY)))


def test_ids_of_bills_are_made_after_the_joins(spark, no_broadcast):
    lines = plan(QUERIES["B13_bill_procedures"](spark, DIRECTORY)).splitlines()
    digests = [i for i, line in enumerate(lines) if "sha2(" in line]
    assert digests and max(digests) < min(i for i, line in enumerate(lines) if "Exchange" in line)


def test_known_pairs_are_joined_where_their_aggregates_are(spark, no_broadcast):
    """Requests, their pairs, two tables of known pairs and the way back: six exchanges, not ten."""
    pairs = spark.createDataFrame([(1, 1)], "encounter_id long, procedure_id long")
    requests = spark.createDataFrame([("a", 1, 1, 5.0)], "request_id string, encounter_id long, procedure_id long, amount double")
    outcome = ingest.bill_procedures(requests, pairs, pairs, dt.date(2025, 6, 1))
    assert len(re.findall(r"Exchange ", plan(outcome.labelled))) <= 6


def test_the_first_valid_request_of_a_pair_is_billed(spark):
    pairs = spark.createDataFrame([(e, 1) for e in range(5)], "encounter_id long, procedure_id long")
    requests = spark.createDataFrame(
        [("a", 0, 0.0), ("b", 0, 5.0), ("c", 0, 6.0), ("d", 1, 5.0), ("e", 2, 0.0), ("f", 3, 5.0), ("g", 3, -1.0), ("h", 4, 5.0),
         ("i", 9, 5.0)], "request_id string, encounter_id long, amount double").selectExpr("*", "1L as procedure_id")
    outcome = ingest.bill_procedures(requests, pairs, pairs.where("encounter_id = 4"), dt.date(2025, 6, 1))
    assert {r["request_id"]: r["reason"] for r in outcome.labelled.collect()} == {
        "a": "invalid_amount", "b": None, "c": "already_billed", "d": None, "e": "invalid_amount", "f": None,
        "g": "invalid_amount", "h": "already_billed", "i": "not_found"}
    assert all(len(r["billing_id"]) == 64 for r in outcome.accepted.collect())
