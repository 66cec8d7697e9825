"""Every declared rule: one row that breaks it, one that does not."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set, rows
from wardbook.model import HOSPITAL
from wardbook.operators import quality

TODAY = dt.date(2025, 7, 1)


def test_the_seed_rows_break_no_rule(hospital):
    assert rows(quality.audit_hospital(hospital, TODAY)) == []


BROKEN = [
    ("person", {"cpf": "'1112223334'"}, "cpf_has_11_characters"),
    ("person", {"cpf": "'1112223334A'"}, "cpf_is_numeric"),
    ("person", {"birth_date": "date'2025-07-02'"}, "birth_date_not_in_future"),
    ("person", {"name": "repeat('x', 151)"}, "name_length"),
    ("person", {"is_fan": "cast(null as boolean)"}, "is_fan_missing"),
    ("patient", {"blood_group": "'XYZ'"}, "blood_group_domain"),
    ("staff", {"role": "'diretor'"}, "role_domain"),
    ("supervisor", {"role": "'residente'"}, "role_domain"),
    ("resident", {"year": "'R4'"}, "year_domain"),
    ("procedure", {"risk": "'EXTREMO'"}, "risk_domain"),
    ("procedure", {"expected_minutes": "0"}, "expected_minutes_positive"),
    ("unit", {"beds": "0"}, "beds_positive"),
    ("unit", {"kind": "'Hospital'"}, "kind_domain"),
    ("encounter", {"minutes": "-1"}, "minutes_positive"),
    ("encounter", {"unit_id": "cast(null as string)"}, "unit_id_missing"),
    ("performed", {"quantity": "0"}, "quantity_positive"),
    ("performed", {"minutes": "0"}, "minutes_positive"),
    ("roster", {"weekday": "'monday'"}, "weekday_domain"),
    ("roster", {"turn": "'madrugada'"}, "turn_domain"),
    ("billing", {"amount": "cast(0 as decimal(10,2))"}, "amount_positive"),
    ("stay", {"left_at": "timestamp_ntz'2020-01-01'"}, "left_after_entered"),
]


def test_each_rule_catches_its_breach(hospital):
    """One query over all breaches: each broken table reports exactly its own rule."""
    found = None
    for i, (name, values, _) in enumerate(BROKEN):
        broken = hospital[name].limit(1).withColumns({c: F.expr(v) for c, v in values.items()})
        audit = quality.audit_table(broken, HOSPITAL[name], TODAY)
        audit = audit.select(F.lit(i).alias("case"), "rule")
        found = audit if found is None else found.unionByName(audit)
    by_case = {}
    for case, rule in rows(found):
        by_case.setdefault(case, set()).add(rule)
    for i, (name, values, rule) in enumerate(BROKEN):
        assert rule in by_case.get(i, set()), (name, rule)
        if rule not in ("cpf_has_11_characters", "cpf_is_numeric"):
            assert by_case[i] == {rule}, (name, rule)


def test_null_passes_a_check(frame):
    patients = frame("patient_id string, blood_group string", ("1", None), ("2", "A+"), ("3", "C+"))
    assert rows(quality.audit_domains(patients, {"blood_group": ("A+",)}, ["patient_id"])) == [
        ("blood_group", "3", "C+")]
    assert rows(quality.audit_checks(patients, {"starts_with_a": "blood_group like 'A%'"}, ["patient_id"])) == [
        ("starts_with_a", "3")]


def test_not_null_counts_per_column(frame):
    df = frame("a string, b int", ("x", None), (None, None), ("y", 1))
    assert as_set(quality.audit_not_null(df, ["a", "b"])) == {("a", 1), ("b", 2)}


def test_unique_ignores_null_keys(frame):
    df = frame("k string, j int", ("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1))
    assert rows(quality.audit_unique(df, ["k"])) == [("a", 3)]
    assert rows(quality.audit_unique(df, ["k", "j"])) == [("a", 1, 2)]


def test_foreign_key_single_composite_and_null(frame):
    child = frame("id int, a string, b string", (1, "x", "1"), (2, "x", "2"), (3, None, "1"), (4, "y", "1"))
    parent = frame("p string, q string", ("x", "1"), ("x", "1"))
    assert {r["id"] for r in quality.audit_foreign_key(child, parent, {"a": "p"}).collect()} == {4}
    assert {r["id"] for r in quality.audit_foreign_key(child, parent, {"a": "p", "b": "q"}).collect()} == {2, 4}


def test_orphans_duplicates_and_roles_of_the_hospital(hospital):
    t = dict(hospital)
    t["patient"] = hospital["patient"].where(f"patient_id <> 'patient-1'")
    t["person"] = hospital["person"].withColumn(
        "cpf", F.when(F.col("name").startswith("Wanda"), "10000000001").otherwise(F.col("cpf")))
    t["resident"] = hospital["resident"].unionByName(
        hospital["supervisor"].limit(1).select(
            F.col("supervisor_id").alias("resident_id"), F.lit("residente").alias("role"), F.lit("R1").alias("year")))
    found = as_set(quality.audit_hospital(t, TODAY).select("table", "rule", "record"))
    by_rule = {}
    for table, rule, record in found:
        by_rule.setdefault((table, rule), []).append(record)
    assert len(by_rule["encounter", "patient_id_in_patient"]) == 4
    assert len(by_rule["stay", "patient_id_in_patient"]) == 1
    assert by_rule["person", "cpf_unique"] == ["10000000001"]
    assert by_rule["resident", "resident_id_role_in_staff"] == ["supervisor-1"]
    assert len(by_rule) == 4


def test_exclusive_roles(hospital, frame):
    residents = hospital["resident"].select("resident_id")
    supervisors = hospital["supervisor"].select("supervisor_id")
    both = residents.union(frame("id string", ("supervisor-1",), ("ghost",)))
    found = as_set(quality.audit_exclusive_roles(hospital["staff"], {"residente": both, "preceptor": supervisors}))
    assert found == {
        ("supervisor-1", "residente", "role_mismatch"), ("supervisor-1", "residente", "several_subtypes"),
        ("supervisor-1", "preceptor", "several_subtypes"), ("ghost", "residente", "role_mismatch")}
    clean = {"residente": residents, "preceptor": supervisors}
    assert rows(quality.audit_exclusive_roles(hospital["staff"], clean)) == []


def test_roster_overlap(hospital, frame):
    assert rows(quality.audit_roster_overlap(hospital["roster"])) == []
    roster = frame("resident_id string, weekday string, turn string, unit_id string",
                   ("r", "segunda", "manha", "u1"), ("r", "segunda", "manha", "u2"), ("r", "segunda", "tarde", "u1"),
                   ("r", "segunda", "tarde", "u1"))
    assert rows(quality.audit_roster_overlap(roster)) == [("r", "segunda", "manha", 2)]


@pytest.mark.parametrize("name", list(HOSPITAL))
def test_model_names_its_own_columns(name):
    table = HOSPITAL[name]
    columns = {c.name for c in table.columns}
    keys = set(table.key).union(*table.unique)
    assert keys | set(table.domains) | set(table.defaults) <= columns
    for ref in table.references:
        assert set(ref.columns) <= columns
        assert set(ref.parent_columns) <= {c.name for c in HOSPITAL[ref.parent].columns}
        assert list(HOSPITAL).index(ref.parent) < list(HOSPITAL).index(name)
