"""Reports over encounters, performed procedures, rosters and stays.

All of them aggregate a fact on its own key before they touch a dimension, so
that what is joined has one row per key and a hot key has been combined on the
map side. Dimensions are never broadcast by hint: Catalyst does so only below
the session's size threshold.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardbook.functions import (
    distinct_keys,
    in_order_of,
    month_bounds,
    month_of,
    named,
    ratio,
    weekday_label,
)
from wardbook.functions.frames import Tables, splittable
from wardbook.model import DOCTOR_TITLES, HIGH_RISK, TURNS, WEEKDAYS


def n_rows() -> Column:
    return F.count(F.lit(1))


def resident_ranking(t: Tables) -> DataFrame:
    """Encounters per resident, residents without any included; homonyms stay apart."""
    totals = t["encounter"].groupBy("resident_id").agg(n_rows().alias("encounters"))
    return (
        named(t, "resident").join(totals, "resident_id", "left")
        .select("resident_id", F.col("name").alias("resident"), "year",
                F.coalesce("encounters", F.lit(0)).alias("encounters"))
        .orderBy(F.desc("encounters"), "resident", "resident_id")
    )


def mean_duration_by_resident(t: Tables, decimals: int = 2) -> DataFrame:
    """Encounters and mean duration per resident; 0 and NULL for those without any."""
    totals = t["encounter"].groupBy("resident_id").agg(n_rows().alias("n"), F.sum("minutes").alias("total"))
    residents = named(t, "resident")
    if "specialty" not in residents.columns:
        staff = t["staff"].select(F.col("staff_id").alias("resident_id"), "specialty")
        residents = residents.join(staff, "resident_id")
    return (
        residents.join(totals, "resident_id", "left")
        .select("resident_id", F.col("name").alias("resident"), "specialty", "year",
                F.coalesce("n", F.lit(0)).alias("encounters"),
                ratio("total", "n", decimals).alias("mean_minutes"))
        .orderBy(F.desc_nulls_last("mean_minutes"), "resident", "resident_id")
    )


def busy_supervisors(t: Tables, year: int, month: int, min_count: int = 5, by_id: bool = False) -> DataFrame:
    """Supervisors with strictly more than ``min_count`` encounters in a month.

    Counts per name, as the report always did; ``by_id`` keeps homonyms apart.
    """
    first, following = month_bounds(year, month)
    started = F.col("started_at")
    totals = (
        t["encounter"].where((started >= F.lit(first)) & (started < F.lit(following)))
        .groupBy("supervisor_id").agg(n_rows().alias("n"))
    )
    keys = ["supervisor_id", "supervisor"] if by_id else ["supervisor"]
    return (
        named(t, "supervisor").withColumnRenamed("name", "supervisor").join(totals, "supervisor_id")
        .groupBy(*keys).agg(F.sum("n").alias("encounters"))
        .where(F.col("encounters") > min_count)
        .orderBy(F.desc("encounters"), *keys)
    )


def weekdays_in_month(spark, as_of: date) -> DataFrame:
    """How often each weekday occurs in the month of ``as_of``: at most seven rows."""
    first, following = month_bounds(as_of.year, as_of.month)
    days = F.explode(F.sequence(F.lit(first), F.date_sub(F.lit(following), 1)))
    return (
        spark.range(0, 1, 1, 1).select(days.alias("day"))
        .groupBy(weekday_label("day").alias("weekday")).agg(n_rows().alias("days"))
    )


def shifts_per_unit(t: Tables, as_of: date, by_id: bool = False) -> DataFrame:
    """Shifts per unit and resident in the month of ``as_of``.

    A roster row recurs weekly, so it counts once per matching day. The calendar
    is reduced to seven rows first (hence the broadcast), which spares
    multiplying the roster by the days of the month.
    """
    roster = t["roster"]
    calendar = F.broadcast(weekdays_in_month(roster.sparkSession, as_of))
    totals = roster.join(calendar, "weekday").groupBy("unit_id", "resident_id").agg(F.sum("days").alias("n"))
    keys = ["unit_id", "resident_id"] if by_id else []
    units = t["unit"].select("unit_id", F.col("name").alias("unit"))
    return (
        totals.join(units, "unit_id").join(named(t, "resident", prefix="resident"), "resident_id")
        .groupBy(*keys, "unit", "resident").agg(F.sum("n").alias("shifts"))
        .orderBy("unit", F.desc("shifts"), "resident", *keys)
    )


def patients_with_high_risk(t: Tables) -> DataFrame:
    """Distinct ids of patients with a high-risk procedure."""
    risky = distinct_keys(t["procedure"].where(F.col("risk") == HIGH_RISK), "procedure_id")
    encounters = distinct_keys(t["performed"].join(risky, "procedure_id", "left_semi"), "encounter_id")
    return distinct_keys(t["encounter"].join(encounters, "encounter_id", "left_semi"), "patient_id")


def patients_without_high_risk(t: Tables) -> DataFrame:
    """Patients who never had a high-risk procedure, those never seen included."""
    return (
        named(t, "patient").join(patients_with_high_risk(t), "patient_id", "left_anti")
        .select("patient_id", F.col("name").alias("patient"), "plan")
        .orderBy("patient", "patient_id")
    )


def mean_wait_by_unit(t: Tables) -> DataFrame:
    """Per unit, encounters with a procedure and mean minutes from arrival to the first one.

    Waits are summed as whole seconds and left-over microseconds, so that neither
    sum can overflow a long, and divided once at the end.
    """
    first = t["performed"].groupBy("encounter_id").agg(F.min("started_at").alias("first_at"))
    wait = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("first_at"))
    second = 1_000_000
    totals = (
        t["encounter"].join(first, "encounter_id")
        .select("unit_id", wait.alias("wait"))
        .groupBy("unit_id")
        .agg(n_rows().alias("measured"),
             F.sum(F.floor(F.col("wait") / second).cast("long")).alias("seconds"),
             F.sum(F.pmod("wait", F.lit(second))).alias("micros"))
    )
    total = F.col("seconds").cast("decimal(20,0)") * second + F.col("micros")
    minutes = ratio(total, F.col("measured") * (60 * second))
    return (
        t["unit"].select("unit_id", F.col("name").alias("unit")).join(totals, "unit_id")
        .select("unit_id", "unit", "measured", minutes.alias("mean_wait_minutes"))
        .orderBy("unit", "unit_id")
    )


def currently_admitted(t: Tables) -> DataFrame:
    """Patients whose latest stay is still open, by entry.

    The latest stay is chosen first and tested for being open afterwards; equal
    entries are decided by the id. The aggregate combines on the map side, so a
    patient with very many stays is no hot task.
    """
    latest = (
        t["stay"].groupBy("patient_id")
        .agg(F.max(F.struct("entered_at", "stay_id", "unit_id", "left_at", "reason")).alias("s"))
        .where("s.left_at is null")
        .select("patient_id", "s.stay_id", "s.unit_id", "s.entered_at", "s.reason")
    )
    return (
        latest.join(named(t, "patient", prefix="patient"), "patient_id")
        .join(t["unit"].select("unit_id", F.col("name").alias("unit")), "unit_id")
        .select("patient_id", "patient", "unit", "entered_at", "reason", "stay_id")
        .orderBy("entered_at", "stay_id").drop("stay_id")
    )


def not_a_doctor(title: str = "title") -> Column:
    return ~F.lower(F.trim(title)).isin(*DOCTOR_TITLES)


def residents_without_qualified_supervisor(t: Tables) -> DataFrame:
    """Rostered slots whose supervisor does not hold a doctor's title."""
    unqualified = (
        named(t, "supervisor").where(not_a_doctor())
        .select("supervisor_id", F.col("name").alias("supervisor"), "title")
    )
    residents = named(t, "resident").select("resident_id", F.col("name").alias("resident"), "year")
    return (
        t["roster"].join(unqualified, "supervisor_id").join(residents, "resident_id")
        .join(t["unit"].select("unit_id", F.col("name").alias("unit")), "unit_id")
        .select("resident_id", "resident", "year", "unit", "weekday", "turn", "supervisor", "title")
        .distinct()
        .orderBy("resident", in_order_of("weekday", WEEKDAYS), in_order_of("turn", TURNS), "resident_id", "unit")
    )


def monthly_stats(t: Tables) -> DataFrame:
    """Per month and unit: encounters, mean duration, most common procedure.

    Durations and procedures are aggregated apart, so that an encounter with
    several procedures counts once in the mean. Among equally common procedures
    the alphabetically first wins. Procedures are counted by id before their
    names are joined in; the names never cross the large shuffle.
    """
    placed = t["encounter"].select("encounter_id", month_of("started_at").alias("month"), "unit_id", "minutes")
    stats = placed.groupBy("month", "unit_id").agg(n_rows().alias("n"), F.sum("minutes").alias("total"))
    by_id = (
        t["performed"].select("encounter_id", "procedure_id")
        .join(splittable(placed.drop("minutes")), "encounter_id")
        .groupBy("month", "unit_id", "procedure_id").agg(n_rows().alias("n"))
    )
    by_name = (
        by_id.join(t["procedure"].select("procedure_id", "name"), "procedure_id")
        .groupBy("month", "unit_id", "name").agg(F.sum("n").alias("n"))
    )
    common = (
        by_name.groupBy("month", "unit_id")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), "name")).alias("top"))
        .select("month", "unit_id", F.col("top.name").alias("most_common_procedure"))
    )
    return (
        stats.join(common, ["month", "unit_id"], "left")
        .join(t["unit"].select("unit_id", F.col("name").alias("unit")), "unit_id")
        .select("month", "unit_id", "unit", F.col("n").alias("encounters"),
                ratio("total", "n").alias("mean_minutes"), "most_common_procedure")
        .orderBy("month", "unit", "unit_id").drop("unit_id")
    )


def supervisors_of_fans(t: Tables, via: str = "encounter") -> DataFrame:
    """Names of supervisors linked to patients with the fan flag.

    ``via='encounter'``: they supervised an encounter of such a patient.
    ``via='resident'``: they supervised, in any encounter, a resident who has
    treated such a patient.
    """
    if via not in ("encounter", "resident"):
        raise ValueError("via is 'encounter' or 'resident'")
    fans = distinct_keys(named(t, "patient", "is_fan").where("is_fan"), "patient_id")
    encounters = t["encounter"].join(fans, "patient_id", "left_semi")
    if via == "resident":
        encounters = t["encounter"].join(distinct_keys(encounters, "resident_id"), "resident_id", "left_semi")
    chosen = distinct_keys(encounters, "supervisor_id")
    return (
        named(t, "supervisor").join(chosen, "supervisor_id", "left_semi")
        .select(F.col("name").alias("supervisor")).distinct().orderBy("supervisor")
    )


def last_encounter_by_patient(t: Tables) -> DataFrame:
    """The latest encounter of each patient with names and procedure names.

    Encounters of a patient at the same latest instant are all kept. The rank
    filter prunes inside each task before the shuffle (window group limit).
    Procedure names are gathered only for the encounters that remain.
    """
    newest = Window.partitionBy("patient_id").orderBy(F.desc("started_at"))
    latest = (
        t["encounter"].select("encounter_id", "patient_id", "resident_id", "supervisor_id", "started_at")
        .withColumn("place", F.rank().over(newest)).where("place = 1").drop("place")
    )
    names = (
        t["performed"].select("encounter_id", "procedure_id")
        .join(distinct_keys(latest, "encounter_id"), "encounter_id", "left_semi")
        .join(t["procedure"].select("procedure_id", "name"), "procedure_id")
        .groupBy("encounter_id").agg(F.array_sort(F.collect_list("name")).alias("procedures"))
    )
    return (
        latest.join(names, "encounter_id", "left")
        .join(named(t, "patient", prefix="patient"), "patient_id")
        .join(named(t, "resident", prefix="resident"), "resident_id")
        .join(named(t, "supervisor", prefix="supervisor"), "supervisor_id")
        .select("encounter_id", "patient", "started_at", "resident", "supervisor",
                F.coalesce("procedures", F.array().cast("array<string>")).alias("procedures"))
        .orderBy(F.desc("started_at"), "encounter_id")
    )


def high_risk_share_by_resident(t: Tables) -> DataFrame:
    """Quantity-weighted procedures per resident, the high-risk part and its share in percent.

    Quantities are summed per encounter, then per resident: two aggregations
    that combine on the map side around one join of one row per encounter.
    Residents without procedures get 0, 0 and 0.0. Exact ties round half up.
    """
    risky = t["procedure"].select("procedure_id", (F.col("risk") == HIGH_RISK).alias("high"))
    per_encounter = (
        t["performed"].join(risky, "procedure_id").groupBy("encounter_id")
        .agg(F.sum("quantity").alias("total"), F.sum(F.when(F.col("high"), F.col("quantity"))).alias("high"))
    )
    totals = (
        t["encounter"].select("encounter_id", "resident_id").join(per_encounter, "encounter_id")
        .groupBy("resident_id").agg(F.sum("total").alias("total"), F.sum("high").alias("high"))
    )
    zero = F.lit(0)
    return (
        named(t, "resident").join(totals, "resident_id", "left")
        .select("resident_id", F.col("name").alias("resident"),
                F.coalesce("total", zero).alias("procedures"), F.coalesce("high", zero).alias("high_risk"))
        .withColumn("high_risk_percent",
                    F.coalesce(ratio(F.col("high_risk") * 100, F.col("procedures"), 1), F.lit(0).cast("decimal(10,1)")))
        .orderBy("resident", "resident_id")
    )


def dashboard_kpis(t: Tables, as_of: date, duty: Tables | None = None) -> DataFrame:
    """One row of key figures for the day and month of ``as_of``.

    ``duty`` may name other tables for the roster and stay figures. Every figure
    is an independent scalar subquery; nothing is joined.
    """
    duty = duty or t
    first, following = month_bounds(as_of.year, as_of.month)

    def in_month(column: str) -> Column:
        return (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(following))

    def figure(df: DataFrame, value: Column | None = None) -> Column:
        return df.agg(n_rows() if value is None else value).scalar()

    today = F.lit(WEEKDAYS[as_of.weekday()])
    unqualified = residents_without_qualified_supervisor(duty)
    figures = {
        "patients": figure(t["patient"]),
        "staff": figure(t["staff"]),
        "encounters_in_month": figure(t["encounter"].where(in_month("started_at"))),
        "shifts_today": figure(duty["roster"].where(F.col("weekday") == today)),
        "billed_in_month": figure(t["billing"].where(in_month("issued_on")),
                                  F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(20,2)"))),
        "patients_without_high_risk": figure(patients_without_high_risk(t)),
        "admitted": figure(currently_admitted(duty)),
        "residents_without_qualified_supervisor": figure(
            unqualified, F.count_distinct("resident_id")),
    }
    spark = t["patient"].sparkSession
    return spark.range(0, 1, 1, 1).select(*(column.alias(name) for name, column in figures.items()))
