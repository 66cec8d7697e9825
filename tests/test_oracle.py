"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences
from wardbook.plans.oracle import ORACLE
from wardbook.plans.registered import QUERIES

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(contract.queries()[name](spark, DIRECTORY), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0


# An outcome that never occurs in the test tables would leave a rule unchecked.
OUTCOMES = {
    "B8_validated_append": {"accepted", "missing_resident_id", "patient_not_found", "resident_not_found",
                            "supervisor_not_found", "unit_not_found", "invalid_minutes"},
    "B9_register_people": {"accepted", "missing_cpf", "malformed_birth_date", "duplicate_cpf", "duplicate_crm",
                           "invalid_blood_group"},
    "B10_register_units": {"accepted", "missing_name", "invalid_kind", "invalid_beds"},
    "B11_register_encounter_bundle": {"accepted", "missing_resident_id", "procedure_not_found", "repeated_procedure",
                                      "invalid_item"},
    "B12_register_performed": {"accepted", "encounter_not_found", "procedure_not_found", "invalid_minutes",
                               "already_registered"},
    "B13_bill_procedures": {"accepted", "invalid_amount", "not_found", "already_billed"},
    "B14_assign_roster": {"accepted", "unit_not_found", "duplicate_slot", "overlap"},
    "C2_delete_performed": {"deleted", "blocked_billed", "not_found"},
    "C3_move_roster": {"moved", "conflict_same_unit", "conflict_other_unit", "ambiguous"},
    "C3_move_roster_in_order": {"moved", "conflict_same_unit", "conflict_other_unit"},
    "C6_delete_with_actions": {"deleted", "blocked", "not_found"},
    "C7_change_roles": {"changed", "blocked_subtype", "unchanged"},
    "F3_stream_roster": {"accepted", "duplicate_slot", "overlap"},
}


@pytest.mark.parametrize("name", list(OUTCOMES))
def test_outcomes_occur(name):
    """Judged by the SQL alone, on tables large enough to hold every case."""
    con = connect(DIRECTORY.replace("sf0.001", "sf0.01"))
    column = "status" if name.startswith("C3") else "outcome"
    found = {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({contract.oracle_sql()[name]})").fetchall()}
    assert OUTCOMES[name] <= found
