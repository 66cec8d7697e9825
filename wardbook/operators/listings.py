"""Listings: projection, filter, join and order.

The single-record forms (one patient, one encounter) filter the fact first, so
the filter reaches the scan; without an id they list the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions import distinct_keys, in_order_of, named
from wardbook.functions.frames import Tables, written
from wardbook.model import RESIDENT, SUPERVISOR, TURNS, WEEKDAYS


def _only(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(column) == F.lit(value))


def _present(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in df.columns]


def list_patients(t: Tables, search: str | None = None) -> DataFrame:
    """Patients by name; ``search`` matches a part of the name or cpf in any case.

    ``%`` and ``_`` in the search text act as wildcards.
    """
    patients = named(t, "patient", "cpf")
    text = (search or "").strip()
    if text:
        pattern = f"%{text}%"
        patients = patients.where(F.ilike("name", F.lit(pattern)) | F.ilike("cpf", F.lit(pattern)))
    columns = _present(patients, "birth_date", "phone", "plan", "allergies", "blood_group")
    return (
        patients.select("patient_id", F.col("name").alias("patient"), "cpf", *columns)
        .orderBy("patient", "patient_id")
    )


def list_staff(t: Tables, role: str | None = None) -> DataFrame:
    """Staff by name with the year of residents and the title of supervisors.

    With a role only staff in that role's own table are listed.
    """
    staff = named(t, "staff", "cpf")
    how = {RESIDENT: ("inner", "left"), SUPERVISOR: ("left", "inner"), None: ("left", "left")}[role]
    residents = t["resident"].select(F.col("resident_id").alias("staff_id"), "year")
    supervisors = t["supervisor"].select(F.col("supervisor_id").alias("staff_id"), "title")
    return (
        staff.join(residents, "staff_id", how[0]).join(supervisors, "staff_id", how[1])
        .select("staff_id", "name", "cpf", "crm", "specialty", "role", *_present(staff, "hired_on"), "year", "title")
        .orderBy("name", "staff_id")
    )


def list_units(t: Tables) -> DataFrame:
    return t["unit"].orderBy("name", "unit_id")


def list_procedures(t: Tables) -> DataFrame:
    return t["procedure"].orderBy("name", "procedure_id")


NEWEST_AT_ONCE = 1 << 14  # candidates of the newest encounters that are taken before all are joined instead


def recent_encounters(t: Tables, limit: int = 50) -> DataFrame:
    """The newest encounters with names; equal instants by descending id.

    In two phases: candidates are the newest by time alone, twice as many as wanted, a bounded top of each task that is
    written once. Nothing enforces the references of Parquet tables, and an encounter that names nobody must
    not take the place of one that is listed, so the candidates are widened until enough of them have their names. Only they
    are joined; beyond NEWEST_AT_ONCE candidates it is all encounters.
    """
    order = (F.desc("started_at"), F.desc("encounter_id"))
    columns = ("encounter_id", "started_at", "minutes", "patient_id", "resident_id", "supervisor_id")
    width = 2 * limit
    while True:
        encounters, all_taken = t["encounter"].select(*columns), width > NEWEST_AT_ONCE
        if not all_taken:
            encounters = written(encounters.orderBy(*order).limit(width), "newest")
        listed = (
            encounters.join(named(t, "patient", prefix="patient"), "patient_id")
            .join(named(t, "resident", prefix="resident"), "resident_id")
            .join(named(t, "supervisor", prefix="supervisor"), "supervisor_id")
            .select("encounter_id", "started_at", "minutes", "patient", "resident", "supervisor")
        )
        if all_taken:
            return listed.orderBy(*order).limit(limit)
        listed = written(listed, "newest")
        if listed.count() >= limit or encounters.count() < width:
            return listed.orderBy(*order).limit(limit)
        width *= 8


def patient_encounters(t: Tables, patient_id=None) -> DataFrame:
    """Encounters of a patient (of every patient without an id), newest first, with names."""
    units = t["unit"].select("unit_id", F.col("name").alias("unit"))
    return (
        _only(t["encounter"], "patient_id", patient_id)
        .join(_only(named(t, "patient", prefix="patient"), "patient_id", patient_id), "patient_id")
        .join(named(t, "resident", prefix="resident"), "resident_id")
        .join(named(t, "supervisor", prefix="supervisor"), "supervisor_id")
        .join(units, "unit_id")
        .select("patient_id", "encounter_id", "started_at", "minutes", "patient", "resident", "supervisor", "unit")
        .orderBy("patient_id", F.desc("started_at"), F.desc("encounter_id"))
    )


def _performed_with_procedure(t: Tables, encounter_id) -> DataFrame:
    catalogue = t["procedure"].select("procedure_id", F.col("name").alias("procedure"), "risk")
    return _only(t["performed"], "encounter_id", encounter_id).join(catalogue, "procedure_id")


def encounter_procedures(t: Tables, encounter_id=None) -> DataFrame:
    """Procedures of an encounter with billing state and amount, by procedure name."""
    performed = _performed_with_procedure(t, encounter_id)
    bills = _only(t["billing"], "encounter_id", encounter_id).select("encounter_id", "procedure_id", "amount")
    return (
        performed.join(bills, ["encounter_id", "procedure_id"], "left")
        .select("encounter_id", "procedure_id", "procedure", "risk", "quantity", "minutes",
                *_present(performed, "note"), F.col("amount").isNotNull().alias("billed"), "amount")
        .orderBy("encounter_id", "procedure", "procedure_id")
    )


def encounter_procedures_timeline(t: Tables, encounter_id=None) -> DataFrame:
    """Procedures of an encounter with a billed flag, by start."""
    performed = _performed_with_procedure(t, encounter_id)
    pair = ("encounter_id", "procedure_id")
    billed = distinct_keys(_only(t["billing"], "encounter_id", encounter_id), *pair).withColumn("mark", F.lit(True))
    return (
        performed.join(billed, list(pair), "left")
        .select(*pair, "procedure", "risk", "quantity", "minutes", "started_at", *_present(performed, "note"),
                F.col("mark").isNotNull().alias("billed"))
        .orderBy("encounter_id", "started_at", "procedure_id")
    )


def list_roster(t: Tables) -> DataFrame:
    """The roster with names, by unit, then weekday and turn in calendar order."""
    calendar: list[Column] = [in_order_of("weekday", WEEKDAYS), in_order_of("turn", TURNS)]
    return (
        t["roster"].join(t["unit"].select("unit_id", F.col("name").alias("unit")), "unit_id")
        .join(named(t, "resident", prefix="resident"), "resident_id")
        .join(named(t, "supervisor", prefix="supervisor"), "supervisor_id")
        .select("roster_id", "unit", "weekday", "turn", "resident", "supervisor")
        .orderBy("unit", *calendar, "roster_id")
    )
