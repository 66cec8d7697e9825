"""Validated ingest: a rejected and an accepted example for every rule."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set, reasons, rows
from wardbook.operators import ingest, quality

TODAY = dt.date(2025, 7, 1)
A1, B1, C1, C5, F1, F2 = (
    "patient-1", "supervisor-1", "resident-1", "resident-5", "unit-1", "unit-2")
NOBODY = "nobody-0"


def test_defaults_fill_missing_values_and_columns(frame):
    df = frame("k string, risk string", ("a", None), ("b", "ALTO"))
    filled = ingest.apply_defaults(df, {"risk": F.lit("BAIXO"), "quantity": F.lit(1)}, "id", ["k"])
    found = {r["k"]: (r["risk"], r["quantity"], r["id"]) for r in filled.collect()}
    assert found["a"][:2] == ("BAIXO", 1) and found["b"][:2] == ("ALTO", 1)
    assert found["a"][2] != found["b"][2] and len(found["a"][2]) == 64
    again = ingest.apply_defaults(filled, {}, "id", ["k"])
    assert {r["k"]: r["id"] for r in again.collect()} == {k: v[2] for k, v in found.items()}


ENCOUNTER = "request_id int, started_at string, minutes string, patient_id string, resident_id string, " \
            "supervisor_id string, unit_id string"


def test_encounters_are_refused_in_a_fixed_order(hospital, frame):
    at = "2025-06-14 10:00:00"
    batch = frame(
        ENCOUNTER,
        (1, at, "30", A1, C1, B1, F1),
        (2, at, "30", NOBODY, NOBODY, NOBODY, NOBODY),
        (3, at, "30", A1, NOBODY, NOBODY, NOBODY),
        (4, at, "30", A1, C1, NOBODY, NOBODY),
        (5, at, "30", A1, C1, B1, NOBODY),
        (6, at, "0", A1, C1, B1, F1),
        (7, at, "half an hour", A1, C1, B1, F1),
        (8, "soon", "30", A1, C1, B1, F1),
        (9, None, "30", A1, C1, B1, F1),
        (10, at, "30", A1, C1, B1, None),
        (11, at, "30", A1, B1, B1, F1),
    )
    outcome = ingest.register_encounters(batch, hospital)
    assert reasons(outcome, "request_id") == {
        1: None, 2: "patient_not_found", 3: "resident_not_found", 4: "supervisor_not_found", 5: "unit_not_found",
        6: "invalid_minutes", 7: "malformed_minutes", 8: "malformed_started_at", 9: "missing_started_at",
        10: "missing_unit_id", 11: "resident_not_found"}
    (accepted,) = outcome.accepted.collect()
    assert (accepted["started_at"], accepted["minutes"]) == (dt.datetime(2025, 6, 14, 10), 30)
    given = {r["request_id"]: r["minutes"] for r in outcome.rejected.collect()}
    assert given[7] == "half an hour"


def test_a_settled_outcome_is_the_same(hospital, frame):
    batch = frame(ENCOUNTER, (1, "2025-06-14 10:00:00", "30", A1, C1, B1, F1), (2, "x", "30", A1, C1, B1, F1))
    outcome = ingest.register_encounters(batch, hospital)
    assert reasons(outcome.settled(), "request_id") == reasons(outcome, "request_id")


def test_units(frame):
    batch = frame("unit_id string, name string, kind string, beds string",
                  ("1", "Ala Norte", "Ambulatorio", "5"), ("2", None, "UTI", "5"), ("3", "X", "Hospital", "5"),
                  ("4", "X", "UTI", "0"), ("5", "X", "UTI", None), ("6", "X", "UTI", "ten"))
    assert reasons(ingest.register_units(batch), "unit_id") == {
        "1": None, "2": "missing_name", "3": "invalid_kind", "4": "invalid_beds", "5": "missing_beds",
        "6": "malformed_beds"}


PEOPLE = "request_id int, kind string, name string, cpf string, birth_date string, phone string, plan string, " \
         "allergies string, blood_group string, crm string, hired_on string, specialty string, year string, title string"


def patient(i, cpf, name="P", born="1990-01-01", blood=None):
    return (i, "paciente", name, cpf, born, None, "SUS", None, blood, None, None, None, None, None)


def staff(i, kind, cpf, crm, year=None, title=None, hired="2020-01-01"):
    return (i, kind, "S", cpf, "1980-01-01", None, None, None, None, crm, hired, "Clinica Geral", year, title)


def test_people(hospital, frame):
    batch = frame(
        PEOPLE,
        patient(1, "30920930450", blood="O+"),
        patient(2, "30920930450"),                      # same cpf as an earlier request
        patient(3, "10000000001"),                      # cpf of a known person
        patient(4, "3092093045"), patient(5, "3092093045A"),
        patient(6, "30920930451", born="2025-07-02"), patient(7, "30920930452", born="yesterday"),
        patient(8, "30920930453", name=None), patient(9, "30920930454", blood="XYZ"),
        staff(10, "preceptor", "90019002900", "CRM x0001", title="Doutor"),
        staff(11, "residente", "90029003900", "CRM x0002", year="R1"),
        staff(12, "residente", "90029003901", "CRM x0001", year="R1"),   # crm of request 10
        staff(13, "residente", "90029003902", "CRM 101", year="R1"),   # crm of known staff
        staff(14, "residente", "90029003903", "CRM x0003"),
        staff(15, "preceptor", "90029003904", "CRM x0004"),
        staff(16, "residente", "90029003905", "CRM x0005", year="R9"),
        staff(17, "diretor", "90029003906", "CRM x0006"),
        staff(18, "preceptor", "90029003907", None, title="Doutor"),
        patient(21, "30920930455", born=None), staff(22, "preceptor", "90029003909", "CRM x0009", title="M", hired=None),
        staff(19, "preceptor", "10000000001", "CRM x0007", title="Doutor"),   # refused for its cpf ...
        staff(20, "preceptor", "90029003908", "CRM x0007", title="Doutor"),   # ... yet its crm stays taken
    )
    people = ingest.register_people(batch, hospital["person"], hospital["staff"], TODAY)
    assert reasons(people.requests, "request_id") == {
        1: None, 2: "duplicate_cpf", 3: "duplicate_cpf", 4: "invalid_cpf_has_11_characters",
        5: "invalid_cpf_is_numeric", 6: "invalid_birth_date_not_in_future", 7: "malformed_birth_date",
        8: "missing_name", 9: "invalid_blood_group", 10: None, 11: None, 12: "duplicate_crm", 13: "duplicate_crm",
        14: "missing_year", 15: "missing_title", 16: "invalid_year", 17: "invalid_kind", 18: "missing_crm",
        19: "duplicate_cpf", 20: "duplicate_crm", 21: "missing_birth_date", 22: "missing_hired_on"}
    sizes = [df.count() for df in (people.person, people.patient, people.staff, people.resident, people.supervisor)]
    assert sizes == [3, 1, 2, 1, 1]
    new = {name: hospital[name].unionByName(getattr(people, name))
           for name in ("person", "patient", "staff", "resident", "supervisor")}
    assert rows(quality.audit_hospital(new, TODAY)) == []


def taken_in_order(requests, known_cpf=(), known_crm=()):
    """request id -> reason, one request after the other; requests are (id, cpf, crm, is valid)."""
    cpfs, crms, found = set(known_cpf), set(known_crm), {}
    for i, cpf, crm, valid in sorted(requests):
        if cpf in cpfs or crm in crms:
            found[i] = "duplicate_cpf" if cpf in cpfs else "duplicate_crm"
        elif valid:
            found[i] = None
            cpfs.add(cpf)
            crms.update([crm] if crm else [])
        else:
            found[i] = "invalid_year" if crm else "invalid_blood_group"
    return found


def two_key_requests(kind, rng):
    if kind == "chain":  # each request waits for the one before
        return [(i, f"{(i + 1) // 2:011d}", f"CRM {i // 2}", True) for i in range(60)]
    if kind == "hot":  # a third of all want one cpf, another third one crm
        return [(i, "0" * 11 if i % 3 == 0 else f"{i:011d}", "CRM 0" if i % 3 == 1 else f"CRM {i}", i % 7 > 0)
                for i in range(150)]
    return [(i, f"{rng.randrange(60):011d}", f"CRM {rng.randrange(60)}" if rng.random() < 0.7 else None, rng.random() < 0.9)
            for i in range(300)]


@pytest.mark.parametrize("in_a_task", (0, 40, 1 << 16))
@pytest.mark.parametrize("kind", ("random", "chain", "hot"))
def test_people_in_order_equal_a_row_by_row_simulation(hospital, frame, monkeypatch, kind, in_a_task):
    monkeypatch.setattr(ingest, "OPEN_IN_A_TASK", in_a_task)
    if kind == "chain" and in_a_task == 0:
        monkeypatch.setattr(ingest, "OPEN_IN_A_TASK", 50)  # a round for every second request
    asked = two_key_requests(kind, random.Random(7))
    batch = frame(PEOPLE, *(
        staff(i, "residente", cpf, crm, year="R1" if valid else "R9") if crm else patient(i, cpf, blood="O+" if valid else "X")
        for i, cpf, crm, valid in asked)).repartition(3)
    known_people, known_staff = hospital["person"], hospital["staff"]
    people = ingest.register_people_in_order(batch, known_people, known_staff, TODAY).settled()
    found = taken_in_order(asked, {r["cpf"] for r in known_people.collect()}, {r["crm"] for r in known_staff.collect()})
    assert reasons(people.requests, "request_id") == found
    assert {None, "duplicate_cpf", "duplicate_crm"} <= {*found.values(), *([] if kind != "chain" else ["duplicate_cpf"])}


def test_a_refused_request_keeps_nobody_out(hospital, frame):
    batch = frame(
        PEOPLE,
        staff(1, "preceptor", "10000000001", "CRM x1", title="D"),      # cpf of a known person
        staff(2, "preceptor", "90000000002", "CRM x1", title="D"),      # so its crm is free
        staff(3, "preceptor", "90000000003", "CRM x1", title="D"),      # refused for its crm
        patient(4, "90000000003"),                                      # so its cpf is free
        staff(5, "residente", "90000000005", "CRM x5", year="R9"), staff(6, "residente", "90000000005", "CRM x5", year="R1"),
        patient(7, None), patient(8, "90000000005"))
    people = ingest.register_people_in_order(batch, hospital["person"], hospital["staff"], TODAY).settled()
    assert reasons(people.requests, "request_id") == {
        1: "duplicate_cpf", 2: None, 3: "duplicate_crm", 4: None, 5: "invalid_year", 6: None, 7: "missing_cpf",
        8: "duplicate_cpf"}
    new = {name: hospital[name].unionByName(getattr(people, name))
           for name in ("person", "patient", "staff", "resident", "supervisor")}
    assert rows(quality.audit_hospital(new, TODAY)) == []
    assert ingest.register_people_in_order(
        batch.limit(0), hospital["person"], hospital["staff"], TODAY).requests.labelled.count() == 0


ITEM = {"procedure_id": "procedure-2", "quantity": 1, "minutes": 9, "started_at": "2020-01-01 09:05:00", "note": "ok"}


def bundle(i, *items, patient_id=A1, text=None):
    return (str(i), "2020-01-01 09:00:00", "20", patient_id, C1, B1, F1,
            text if text is not None else json.dumps(list(items)))


def test_bundles_are_all_or_nothing(hospital, frame):
    schema = "encounter_id string, started_at string, minutes string, patient_id string, resident_id string, " \
             "supervisor_id string, unit_id string, items string"
    other = {**ITEM, "procedure_id": "procedure-3"}
    batch = frame(
        schema,
        bundle(1, ITEM, other),
        bundle(2, {"procedure_id": "procedure-2", "minutes": 5}),
        bundle(3, other, {**ITEM, "procedure_id": NOBODY}),
        bundle(4, ITEM, ITEM),
        bundle(5, other, {**ITEM, "quantity": 0}),
        bundle(6, {**ITEM, "minutes": None}),
        bundle(7, {**ITEM, "minutes": -3}),
        bundle(8, {**ITEM, "quantity": "two"}),
        bundle(9),
        bundle(10, text=""),
        bundle(11, text="not json"),
        bundle(12, ITEM, patient_id=NOBODY),
        bundle(13, {"minutes": 5}),
        bundle(14, {**ITEM, "started_at": "noon"}),
    )
    result = ingest.register_encounter_bundle(batch, hospital)
    assert reasons(result.requests, "encounter_id") == {
        "1": None, "2": None, "3": "procedure_not_found", "4": "repeated_procedure", "5": "invalid_item",
        "6": "invalid_item", "7": "invalid_item", "8": "invalid_item", "9": None, "10": None, "11": "malformed_items",
        "12": "patient_not_found", "13": "invalid_item", "14": "invalid_item"}
    assert {r["encounter_id"] for r in result.encounters.collect()} == {"1", "2", "9", "10"}
    performed = {(r["encounter_id"], r["procedure_id"]): r for r in result.performed.collect()}
    assert set(performed) == {("1", "procedure-2"), ("1", "procedure-3"), ("2", "procedure-2")}
    defaulted = performed["2", "procedure-2"]
    assert (defaulted["quantity"], defaulted["started_at"]) == (1, dt.datetime(2020, 1, 1, 9))
    assert performed["1", "procedure-2"]["started_at"] == dt.datetime(2020, 1, 1, 9, 5)


def test_flat_items_are_judged_like_nested_ones(hospital, frame):
    other, third = {**ITEM, "procedure_id": "procedure-3"}, {**ITEM, "procedure_id": "procedure-4"}
    bundles = {
        "1": [ITEM, other], "2": [ITEM, ITEM], "3": [other, {**ITEM, "procedure_id": NOBODY}], "4": [],
        "5": [other, {**ITEM, "minutes": 0}], "6": [{**ITEM, "quantity": "two"}], "7": [{**ITEM, "quantity": None}],
        "8": [{**ITEM, "procedure_id": None}], "9": [third, {**other, "started_at": None}],
        "10": [{**ITEM, "procedure_id": NOBODY}, {**other, "quantity": 0}],
    }
    schema = "encounter_id string, started_at string, minutes string, patient_id string, resident_id string, " \
             "supervisor_id string, unit_id string, items string"
    nested = frame(schema, *(bundle(i, *items) for i, items in bundles.items()))
    fields = list(ITEM)
    flat = frame("encounter_id string, " + ", ".join(f"{c} string" for c in fields),
                 *((i, *(None if x[c] is None else str(x[c]) for c in fields)) for i, xs in bundles.items() for x in xs))
    one = ingest.register_encounter_bundle(nested, hospital)
    two = ingest.register_encounter_bundle(nested.drop("items"), hospital, flat)
    assert reasons(one.requests, "encounter_id") == reasons(two.requests, "encounter_id")
    assert set(reasons(two.requests, "encounter_id").values()) == {
        None, "repeated_procedure", "procedure_not_found", "invalid_item"}
    assert as_set(one.performed) == as_set(two.performed)
    assert as_set(two.settled().performed) == as_set(two.performed)


def test_every_item_is_accounted_for(hospital, frame):
    requests = frame("encounter_id string, started_at string, minutes string, patient_id string, resident_id string, "
                     "supervisor_id string, unit_id string",
                     ("1", "2020-01-01 09:00:00", "20", A1, C1, B1, F1), ("2", "2020-01-01 09:00:00", "0", A1, C1, B1, F1),
                     (None, "2020-01-01 09:00:00", "20", A1, C1, B1, F1))
    items = frame("encounter_id string, procedure_id string, minutes string", ("1", "procedure-2", "5"),
                  ("2", "procedure-2", "5"), ("gone", "procedure-2", "5"), (None, "procedure-2", "5"))
    result = ingest.register_encounter_bundle(requests, hospital, items)
    found = {r["encounter_id"]: r["reason"] for r in result.labelled_items.collect()}
    assert found == {"1": None, "2": "invalid_minutes", "gone": "unknown_encounter", None: "unknown_encounter"}
    assert result.performed.count() + result.rejected_items.count() == items.count()
    assert reasons(result.requests, "encounter_id")[None] == "missing_encounter_id"


def test_bundles_take_arrays_too(hospital, frame):
    batch = frame(
        "encounter_id string, started_at timestamp_ntz, minutes int, patient_id string, resident_id string, "
        "supervisor_id string, unit_id string, "
        "items array<struct<procedure_id:string,quantity:int,minutes:int,started_at:timestamp_ntz,note:string>>",
        ("1", dt.datetime(2020, 1, 1), 20, A1, C1, B1, F1, [("procedure-2", None, 5, None, None)]),
        ("2", dt.datetime(2020, 1, 1), 20, A1, C1, B1, F1, [("procedure-2", 0, 5, None, None)]),
        ("3", dt.datetime(2020, 1, 1), 20, A1, C1, B1, F1, None),
    )
    result = ingest.register_encounter_bundle(batch, hospital)
    assert reasons(result.requests, "encounter_id") == {"1": None, "2": "invalid_item", "3": None}


def test_performed(hospital, frame):
    at = "2025-06-10 08:30:00"
    e1, e3, d2, d6, d7 = (
        "encounter-1", "encounter-3", "procedure-2", "procedure-6", "procedure-7")
    batch = frame(
        "request_id int, encounter_id string, procedure_id string, quantity string, minutes string, started_at string, "
        "note string",
        (1, e1, d6, None, "999", at, None), (2, e1, d6, "1", "9", at, None), (3, e1, d2, "1", "9", at, None),
        (4, NOBODY, d6, "1", "9", at, None), (5, e1, NOBODY, "1", "9", at, None), (6, e3, d6, "0", "9", at, None),
        (7, e3, d6, "1", "0", at, None), (8, e3, d6, "1", None, at, None), (9, e3, d6, "1", "9", None, None),
        (10, e3, d6, "1", "9", at, None), (11, e3, d7, "many", "9", at, None),
    )
    outcome = ingest.register_performed(batch, hospital)
    assert reasons(outcome, "request_id") == {
        1: None, 2: "already_registered", 3: "already_registered", 4: "encounter_not_found",
        5: "procedure_not_found", 6: "invalid_quantity", 7: "invalid_minutes", 8: "missing_minutes",
        9: "missing_started_at", 10: None, 11: "malformed_quantity"}
    assert {r["request_id"]: r["quantity"] for r in outcome.accepted.collect()} == {1: 1, 10: 1}


def test_bills(hospital, frame):
    e1, e2, d1, d2, d3 = (
        "encounter-1", "encounter-2", "procedure-1", "procedure-2", "procedure-3")
    requests = frame(
        "request_id int, encounter_id string, procedure_id string, amount string, issued_on date",
        (1, e1, d1, "80.00", None), (2, e1, d1, "80.00", None), (3, e2, d2, "80.00", None),
        (4, e1, d3, "80.00", None), (5, e1, d2, "-5", None), (6, e1, d2, None, None), (7, e1, d2, "dear", None),
        (8, e1, d2, "12.345", dt.date(2025, 1, 2)),
    )
    outcome = ingest.bill_procedures(requests, hospital["performed"], hospital["billing"], TODAY)
    assert reasons(outcome, "request_id") == {
        1: None, 2: "already_billed", 3: "already_billed", 4: "not_found", 5: "invalid_amount", 6: "missing_amount",
        7: "malformed_amount", 8: None}
    accepted = {r["request_id"]: r for r in outcome.accepted.collect()}
    assert accepted[1]["issued_on"] == TODAY and accepted[8]["issued_on"] == dt.date(2025, 1, 2)
    assert accepted[8]["amount"] == Decimal("12.35")
    assert accepted[1]["billing_id"] != accepted[8]["billing_id"]


SLOT_REQUEST = "request_id int, unit_id string, weekday string, turn string, resident_id string, supervisor_id string"


def test_roster_requests(hospital, frame):
    batch = frame(
        SLOT_REQUEST,
        (1, F1, "terca", "tarde", C1, "supervisor-2"),       # slot of the standing roster, other supervisor
        (2, F2, "terca", "tarde", C1, B1),              # standing slot, other unit
        (3, F1, "domingo", "manha", C5, B1),
        (4, F1, "domingo", "manha", C5, "supervisor-2"),     # rival for the same slot and unit
        (5, F2, "domingo", "manha", C5, B1),
        (6, F1, "sexta", "tarde", NOBODY, B1),
        (7, F1, "sunday", "tarde", C5, B1),
        (8, NOBODY, "sexta", "tarde", C5, B1),        # invalid, must not keep the next one out
        (9, F2, "sexta", "tarde", C5, B1),
        (10, F2, "sexta", "tarde", "resident-4", B1),    # same supervisor, another resident
        (11, F2, "domingo", "madrugada", C5, B1),
        (12, F2, "domingo", "noite", C5, None),
    )
    outcome = ingest.assign_roster(batch, hospital["roster"], hospital)
    assert reasons(outcome, "request_id") == {
        1: "duplicate_slot", 2: "overlap", 3: None, 4: "duplicate_slot", 5: "overlap", 6: "resident_not_found",
        7: "invalid_weekday", 8: "unit_not_found", 9: None, 10: None, 11: "invalid_turn", 12: "missing_supervisor_id"}


def test_history_held_by_two_units_is_an_overlap_for_both(frame):
    base = frame("resident_id string, weekday string, turn string, unit_id string",
                 ("r", "segunda", "manha", "u1"), ("r", "segunda", "manha", "u2"), ("r", "segunda", "tarde", "u1"))
    batch = frame(SLOT_REQUEST, (1, "u1", "segunda", "manha", "r", "s"), (2, "u1", "segunda", "tarde", "r", "s"))
    assert reasons(ingest.assign_roster(batch, base), "request_id") == {1: "overlap", 2: "duplicate_slot"}


def one_after_the_other(requests, base):
    """The rule as it reads: each request is tested against the roster left by those before it."""
    held = {}
    for unit, weekday, turn, resident in base:
        held.setdefault((resident, weekday, turn), set()).add(unit)
    result = {}
    for request, unit, weekday, turn, resident, _ in sorted(requests):
        units = held.setdefault((resident, weekday, turn), set())
        if units - {unit}:
            result[request] = "overlap"
        elif units:
            result[request] = "duplicate_slot"
        else:
            result[request] = None
            units.add(unit)
    return result


def crowd(n: int, seed: int) -> list[tuple]:
    """Requests of which a third are for one slot."""
    import random
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    slots = [("r0", "segunda", "manha")] * (n // 3)
    slots += [(f"r{rng.randrange(9)}", rng.choice(["segunda", "terca"]), rng.choice(["manha", "tarde"]))
              for _ in range(n - len(slots))]
    return [(i, f"u{rng.randrange(3)}", weekday, turn, resident, "s")
            for i, (resident, weekday, turn) in zip(ids, slots)]


@pytest.mark.parametrize("seed", [1, 2])
def test_roster_equals_the_sequential_rule(frame, seed):
    requests = crowd(300, seed)
    base = [("u0", "segunda", "tarde", "r1"), ("u1", "segunda", "tarde", "r1"), ("u2", "terca", "manha", "r2")]
    outcome = ingest.assign_roster(
        frame(SLOT_REQUEST, *requests), frame("unit_id string, weekday string, turn string, resident_id string", *base))
    assert reasons(outcome, "request_id") == one_after_the_other(requests, base)


def test_typed_keeps_the_given_value(frame):
    found = rows(ingest.typed(frame("n string", ("1",), ("x",)), {"n": "int"}).select("n", "_given_n"))
    assert found == [(1, "1"), (None, "x")]
    assert as_set(frame("n string", ("1",))) == {("1",)}
