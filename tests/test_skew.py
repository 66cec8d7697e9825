"""A third of all rows on one key: the joins behind each operator split it at run time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardbook.operators import analytics, changes, ingest, quality

ROWS = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Requests with a hot value in every key, and the tables they refer to, as written tables."""
    folder = str(tmp_path_factory.mktemp("skew"))
    row = F.col("id")
    hot = row % 3 == 0

    def key(share):
        return F.when(hot, F.lit(0).cast("long")).otherwise(F.floor(row / share)).cast("long")

    rows = spark.range(0, ROWS, 1, 8)
    made = {
        "requests": rows.select(
            row.alias("request_id"), key(7).alias("patient_id"), key(7).alias("resident_id"),
            key(7).alias("supervisor_id"), key(7).alias("unit_id"), key(7).alias("encounter_id"),
            (key(7) % 900).alias("procedure_id"), F.lit(dt.datetime(2025, 6, 1)).alias("started_at"),
            (1 + row % 50).cast("int").alias("minutes"), F.lit(10.0).alias("amount"),
            F.lit("segunda").alias("weekday"), F.lit("manha").alias("turn"),
            F.lit("terca").alias("to_weekday"), F.uuid().alias("filler")),
        "people": rows.select(
            row.cast("string").alias("request_id"), F.lit("paciente").alias("kind"), F.lit("n").alias("name"),
            key(7).cast("string").alias("cpf"), F.lit("1990-01-01").alias("birth_date"), F.lit("p").alias("phone"),
            F.lit("plan").alias("plan"), F.lit(None).cast("string").alias("allergies"), F.lit("O+").alias("blood_group"),
            F.when(~hot, row.cast("string")).alias("crm"), *[F.lit(None).cast("string").alias(c) for c in (
                "hired_on", "specialty", "year", "title")]),
        "keys": spark.range(0, ROWS // 7 + 1, 1, 8).select(*[row.alias(c) for c in (
            "patient_id", "resident_id", "supervisor_id", "unit_id", "encounter_id", "procedure_id", "cpf", "crm")]),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in made}


def splits(df) -> bool:
    """Whether the plan that ran split a skewed join."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def refs(t):
    return {n: t["keys"].select(f"{n}_id").distinct() for n in ("patient", "resident", "supervisor", "unit",
                                                                "encounter", "procedure")}


PAIR = ["encounter_id", "procedure_id"]
CASES = {
    "B5": lambda t: quality.audit_foreign_key(t["requests"], t["keys"], {"patient_id": "patient_id"}),
    "B8": lambda t: ingest.register_encounters(t["requests"], refs(t)).labelled,
    "B9": lambda t: ingest.register_people(
        t["people"], t["keys"].select(F.col("cpf").cast("string")), t["keys"].select(F.col("crm").cast("string")),
        dt.date(2025, 6, 1)).requests.labelled,
    "B11": lambda t: ingest.register_encounter_bundle(
        t["requests"].dropDuplicates(["request_id"]).withColumn("encounter_id", F.col("request_id")), refs(t),
        t["requests"].select("encounter_id", "procedure_id", "minutes")).labelled_items,
    "B12": lambda t: ingest.register_performed(
        t["requests"], {**refs(t), "performed": t["requests"].where("request_id % 2 = 0").select(*PAIR)}).labelled,
    "B13": lambda t: ingest.bill_procedures(
        t["requests"], t["requests"].select(*PAIR), t["requests"].where("request_id % 5 = 0").select(*PAIR),
        dt.date(2025, 6, 1)).labelled,
    "B14": lambda t: ingest.assign_roster(
        t["requests"],
        t["requests"].where("request_id % 2 = 0").select("resident_id", "weekday", "turn", "unit_id")).labelled,
    "C2": lambda t: changes.delete_performed(
        t["requests"].select(*PAIR, "minutes"), t["requests"],
        t["requests"].where("request_id % 5 = 0").select(*PAIR)).outcome,
    "C3": lambda t: changes.move_roster(
        t["requests"].select("resident_id", "weekday", "turn", "unit_id").distinct(),
        t["requests"].select("request_id", "resident_id", F.col("weekday").alias("from_weekday"),
                             F.col("turn").alias("from_turn"), "to_weekday", F.col("turn").alias("to_turn"))).outcome,
    "C6": lambda t: changes.delete_with_actions(
        {"encounter": t["keys"].select("encounter_id").distinct(),
         "performed": t["requests"].select(*PAIR), "billing": t["requests"].where("false").select(
             *PAIR, F.col("request_id").alias("billing_id"))},
        "encounter", t["keys"].select("encounter_id")).tables["performed"],
}


@pytest.mark.parametrize("name", CASES)
def test_a_hot_key_is_split(small_thresholds, tables, name):
    assert splits(CASES[name](tables))


def test_a_hot_encounter_is_split_in_the_monthly_report(small_thresholds, spark, tables):
    t = tables["requests"]
    encounter = tables["keys"].select("encounter_id", *[F.col(f"{n}_id") for n in ("patient", "resident", "supervisor")],
                                      (F.col("unit_id") % 5).alias("unit_id"), F.lit(30).alias("minutes"),
                                      F.lit(dt.datetime(2025, 6, 1)).alias("started_at"))
    hospital = {"encounter": encounter, "performed": t.select(*PAIR, "minutes", "started_at"),
                "unit": spark.range(5).select(F.col("id").alias("unit_id"), F.col("id").cast("string").alias("name")),
                "procedure": t.select("procedure_id").distinct().withColumn("name", F.lit("p"))}
    assert splits(analytics.monthly_stats(hospital))
