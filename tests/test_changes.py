"""Bulk changes: outcomes per request, the new tables, and referential actions."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests import seed
from tests.conftest import as_set, rows
from wardbook.operators import changes, quality

A1, A2, C1, C2, C5, E1, E2, D1, D2, D8, F1, F2 = (
    "patient-1", "patient-2", "resident-1", "resident-2", "resident-5", "encounter-1", "encounter-2", "procedure-1",
    "procedure-2", "procedure-8", "unit-1", "unit-2")


def test_patches_keep_what_they_do_not_name(hospital, frame):
    patches = frame(
        "request_id int, patient_id string, plan string, allergies string, blood_group string",
        (1, A1, "plan X", None, None), (2, A1, None, "latex; dust", None), (3, A1, "plan Z", None, None),
        (4, "nobody-0", "X", None, None), (5, A2, None, None, None))
    result = changes.patch_patients(hospital["patient"], patches)
    found = {r["patient_id"]: tuple(r)[1:] for r in result.table.collect()}
    assert len(found) == 6
    assert found[A1] == ("plan Z", "latex; dust", "A-")
    assert found[A2] == ("plan 2", "latex", "O+")
    assert rows(result.not_found) == [("nobody-0",)]


def test_deletes_of_performed_procedures(hospital, frame):
    requests = frame("request_id int, encounter_id string, procedure_id string",
                     (1, E2, D2), (2, E1, D1), (3, E1, D1), (4, E1, D8), (5, None, D1))
    result = changes.delete_performed(hospital["performed"], requests, hospital["billing"])
    assert {r["request_id"]: r["outcome"] for r in result.outcome.collect()} == {
        1: "blocked_billed", 2: "deleted", 3: "not_found", 4: "not_found", 5: "not_found"}
    left = as_set(result.table.select("encounter_id", "procedure_id"))
    assert len(left) == len(seed.plain()["performed"]) - 1 and (E1, D1) not in left and (E2, D2) in left


MOVE = "request_id int, resident_id string, from_weekday string, from_turn string, to_weekday string, to_turn string"


def moved(base, frame, *moves):
    result = changes.move_roster(base, frame(MOVE, *moves))
    return {r["request_id"]: (r["status"], r["moved"]) for r in result.outcome.collect()}, result.table


def test_moves(hospital, frame):
    outcome, table = moved(
        hospital["roster"], frame,
        (1, C5, "segunda", "tarde", "domingo", "noite"),
        (2, C1, "terca", "tarde", "sabado", "manha"),         # the second unit holds the destination, the first the row
        (3, C2, "terca", "tarde", "terca", "tarde"),          # onto itself
        (4, "resident-4", "domingo", "manha", "terca", "manha"),  # nothing to move
        (5, "resident-3", "quarta", "noite", "quinta", "noite"),
        (6, "resident-3", "domingo", "manha", "quarta", "tarde"),
    )
    assert outcome == {
        1: ("moved", 1), 2: ("conflict_other_unit", 0), 3: ("conflict_same_unit", 0), 4: ("moved", 0),
        5: ("moved", 1), 6: ("ambiguous", 0)}
    before = as_set(hospital["roster"].select("roster_id", "weekday", "turn"))
    after = as_set(table.select("roster_id", "weekday", "turn"))
    assert after - before == {("8", "domingo", "noite"), ("5", "quinta", "noite")}
    assert len(after) == 9 and rows(quality.audit_roster_overlap(table)) == []


def test_moves_of_overlapping_history(frame):
    base = frame("roster_id int, unit_id string, weekday string, turn string, resident_id string",
                 (1, "u1", "segunda", "manha", "r"), (2, "u2", "segunda", "manha", "r"),
                 (3, "u1", "terca", "manha", "q"), (4, "u1", "quarta", "manha", "q"), (5, "u2", "quarta", "manha", "q"))
    outcome, table = moved(base, frame, (1, "r", "segunda", "manha", "sexta", "manha"),
                           (2, "q", "terca", "manha", "quarta", "manha"))
    assert outcome == {1: ("conflict_other_unit", 0), 2: ("conflict_same_unit", 0)}
    assert as_set(table) == as_set(base)


def one_by_one(base, moves):
    """The same moves on a list of rows, one after the other."""
    table, outcome = [dict(r) for r in base], {}
    for number, who, *slots in sorted(moves):
        if None in (who, *slots):
            outcome[number] = ("incomplete", 0)
            continue
        origin, target = tuple(slots[:2]), tuple(slots[2:])
        mine = [r for r in table if r["resident_id"] == who]
        leaving = [r for r in mine if (r["weekday"], r["turn"]) == origin]
        standing = [r for r in mine if (r["weekday"], r["turn"]) == target]
        units = {r["unit_id"] for r in leaving}
        if leaving and units & {r["unit_id"] for r in standing}:
            outcome[number] = ("conflict_same_unit", 0)
        elif leaving and (standing or len(units) > 1):
            outcome[number] = ("conflict_other_unit", 0)
        else:
            outcome[number] = ("moved", len(leaving))
            for r in leaving:
                r["weekday"], r["turn"] = target
    return {tuple(r.values()) for r in table}, outcome


STANDING = "roster_id int, unit_id string, weekday string, turn string, resident_id string"


@pytest.mark.parametrize("seed_number", [1, 2, 3])
def test_moves_in_order_equal_a_simulation(spark, frame, seed_number):
    """A third of all moves are one resident's; some lack a value, some slots hold several rows and units."""
    pick = random.Random(seed_number)
    days, turns = ["segunda", "terca", "quarta", None], ["manha", "tarde"]

    def slot():
        return pick.choices(days, [6, 6, 6, 1])[0], pick.choice(turns)

    def resident():
        return pick.choices(["hot", None, *(f"r{i}" for i in range(8))], [6, 1] + [1] * 8)[0]

    base = [(i, pick.choice(["u1", "u2", None]), *slot(), resident()) for i in range(25)]
    moves = [(i, resident(), *slot(), *slot()) for i in range(300)]
    given = frame(STANDING, *base)
    result = changes.move_roster_in_order(given, frame(MOVE, *moves).withColumn("note", F.lit("x")))
    table, outcome = one_by_one([r.asDict() for r in given.collect()], moves)
    assert as_set(result.table) == table
    assert {r["request_id"]: (r["status"], r["moved"]) for r in result.outcome.collect()} == outcome
    assert result.outcome.columns[-3:] == ["note", "status", "moved"]
    assert {s for s, _ in outcome.values()} == {"moved", "incomplete", "conflict_same_unit", "conflict_other_unit"}


def test_moves_in_order_follow_each_other(frame):
    base = frame(STANDING, (1, "u1", "segunda", "manha", "r"), (2, "u2", "terca", "manha", "r"))
    swap = [("segunda", "sexta"), ("terca", "segunda"), ("sexta", "terca"), ("sexta", "quarta")]
    moves = frame(MOVE, *((i, "r", a, "manha", b, "manha") for i, (a, b) in enumerate(swap)))
    result = changes.move_roster_in_order(base, moves)
    assert {r["request_id"]: r["moved"] for r in result.outcome.collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
    assert as_set(result.table.select("roster_id", "weekday")) == {(1, "terca"), (2, "segunda")}


def test_moves_in_order_of_empty_tables(frame):
    base, moves = frame(STANDING, (1, "u1", "segunda", "manha", "r")), frame(MOVE, (1, "r", "segunda", "manha", "terca", "tarde"))
    none = changes.move_roster_in_order(base, moves.limit(0))
    assert as_set(none.table) == as_set(base) and rows(none.outcome) == []
    nobody = changes.move_roster_in_order(base.limit(0), moves)
    assert rows(nobody.table) == [] and rows(nobody.outcome.select("status", "moved")) == [("moved", 0)]


def test_diff_audit(hospital):
    old = hospital["encounter"]
    longer = F.when(F.col("encounter_id") == E1, F.col("minutes") + 5).otherwise(F.col("minutes"))
    new = old.where(f"encounter_id <> '{E2}'").withColumn("minutes", longer).unionByName(
        old.where(f"encounter_id = '{E2}'").withColumn("encounter_id", F.lit("new")))
    at = F.lit(dt.datetime(2025, 7, 1)).cast("timestamp_ntz")
    log = {r["encounter_id"]: r for r in changes.diff_audit(old, new, "encounter_id", at, F.lit("me")).collect()}
    assert {k: r["operation"] for k, r in log.items()} == {E1: "UPDATE", E2: "DELETE", "new": "INSERT"}
    before, after = json.loads(log[E1]["before"]), json.loads(log[E1]["after"])
    assert (before.pop("minutes"), after.pop("minutes")) == (27, 32) and before == after
    assert log[E2]["after"] is None and log["new"]["before"] is None
    assert json.loads(log["new"]["after"])["patient_id"] == "patient-5"
    assert {r["changed_by"] for r in log.values()} == {"me"}
    assert len({r["audit_id"] for r in log.values()}) == 3
    assert rows(changes.diff_audit(old, old, "encounter_id", at)) == []


def test_null_to_value_is_a_change(frame):
    old, new = frame("k int, v string", (1, None), (2, None)), frame("k int, v string", (1, "x"), (2, None))
    (entry,) = changes.diff_audit(old, new, "k", F.lit("now")).collect()
    assert (entry["k"], json.loads(entry["before"]), json.loads(entry["after"])) == (
        1, {"k": 1, "v": None}, {"k": 1, "v": "x"})


def test_only_affected_means_are_refreshed(hospital, frame):
    stale = hospital["procedure"].withColumn("mean_minutes", F.lit(1).cast("decimal(10,2)"))
    without = hospital["performed"].where(f"procedure_id <> '{D8}'")
    affected = frame("procedure_id string", (D2,), (D2,), (D8,))
    found = dict(rows(changes.refresh_procedure_means(stale, without, affected).select("procedure_id", "mean_minutes")))
    minutes = [r["minutes"] for r in seed.records("performed") if r["procedure_id"] == D2]
    assert float(found[D2]) == round(sum(minutes) / len(minutes) + 1e-9, 2) and found[D8] is None
    assert {v for k, v in found.items() if k not in (D2, D8)} == {Decimal("1.00")}


def deleted(hospital, frame, table, *ids):
    key = {"person": "person_id", "staff": "staff_id"}.get(table, f"{table}_id")
    result = changes.delete_with_actions(hospital, table, frame(f"{key} string", *((i,) for i in ids)))
    return {r[0]: (r["outcome"], r["blocked_by"]) for r in result.outcome.collect()}, result.tables


def sizes(tables, *names):
    return [tables[n].count() for n in names]


def test_delete_of_encounters(hospital, frame):
    outcome, after = deleted(hospital, frame, "encounter", E1, E2, "nobody")
    assert outcome == {E1: ("deleted", None), E2: ("blocked", "billing"), "nobody": ("not_found", None)}
    assert sizes(after, "encounter", "performed", "billing") == [20, len(seed.plain()["performed"]) - 2, 3]


def test_delete_of_persons(hospital, frame):
    idle = "supervisor-5"
    outcome, after = deleted(hospital, frame, "person", A1, idle, "supervisor-4", C1)
    assert outcome == {
        A1: ("blocked", "encounter,stay"), idle: ("deleted", None), "supervisor-4": ("deleted", None),
        C1: ("blocked", "encounter,roster")}
    assert sizes(after, "person", "staff", "supervisor", "resident", "patient") == [15, 9, 3, 6, 6]


@pytest.mark.parametrize(("table", "row", "expected"), [
    ("procedure", "procedure-1", ("blocked", "performed")), ("procedure", "procedure-9", ("deleted", None)),
    ("unit", F1, ("blocked", "encounter,roster,stay")), ("patient", "patient-4", ("blocked", "encounter")),
])
def test_restricting_references(hospital, frame, table, row, expected):
    outcome, _ = deleted(hospital, frame, table, row)
    assert outcome == {row: expected}


def test_after_a_delete_no_reference_dangles(hospital, frame):
    _, after = deleted(hospital, frame, "encounter", *(f"encounter-{i}" for i in range(1, 10)))
    assert rows(quality.audit_hospital(after, dt.date(2025, 7, 1))) == []


def test_role_changes(hospital, frame):
    subtypes = {
        "residente": hospital["resident"].where(f"resident_id <> '{C1}'").select("resident_id"),
        "preceptor": hospital["supervisor"].select("supervisor_id"),
    }
    requests = frame("request_id int, staff_id string, role string",
                     (1, C1, "preceptor"), (2, C2, "preceptor"), (3, "supervisor-1", "preceptor"), (4, "x", "preceptor"),
                     (5, C5, "diretor"))
    result = changes.change_roles(hospital["staff"], subtypes, requests)
    assert {r["request_id"]: r["outcome"] for r in result.outcome.collect()} == {
        1: "changed", 2: "blocked_subtype", 3: "unchanged", 4: "not_found", 5: "invalid_role"}
    roles = dict(rows(result.table.select("staff_id", "role")))
    assert roles[C1] == "preceptor" and roles[C2] == "residente" and len(roles) == 11


def one_move_after_the_other(base, moves):
    """The rule as it reads: rows move one at a time, each tested against all others; a failure undoes the move."""
    table = {row_id: (unit, weekday, turn, resident) for row_id, unit, weekday, turn, resident in base}
    result, seen = {}, set()
    for request, resident, from_day, from_turn, to_day, to_turn in sorted(moves):
        if resident in seen:
            result[request] = ("ambiguous", 0)
            continue
        seen.add(resident)
        at = lambda day, turn: [
            i for i, row in sorted(table.items()) if row[1:] == (day, turn, resident)]
        origin, destination = at(from_day, from_turn), at(to_day, to_turn)
        if {table[i][0] for i in origin} & {table[i][0] for i in destination}:
            result[request] = ("conflict_same_unit", 0)
            continue
        trial = dict(table)
        for i in origin:
            unit = trial[i][0]
            if any(j != i and row[1:] == (to_day, to_turn, resident) and row[0] != unit for j, row in trial.items()):
                result[request] = ("conflict_other_unit", 0)
                break
            trial[i] = (unit, to_day, to_turn, resident)
        else:
            table = trial
            result[request] = ("moved", len(origin))
    return result, {(i, *row) for i, row in table.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_moves_equal_the_sequential_rule(frame, seed):
    import random
    rng = random.Random(seed)
    days, turns = ["segunda", "terca", "quarta"], ["manha", "tarde"]
    slots = {(f"u{rng.randrange(3)}", rng.choice(days), rng.choice(turns), f"r{rng.randrange(60)}") for _ in range(150)}
    base = [(i, *slot) for i, slot in enumerate(sorted(slots))]
    moves = [(i, f"r{rng.randrange(60)}", rng.choice(days), rng.choice(turns), rng.choice(days), rng.choice(turns))
             for i in range(90)]
    outcome, table = moved(
        frame("roster_id int, unit_id string, weekday string, turn string, resident_id string", *base), frame, *moves)
    expected, after = one_move_after_the_other(base, moves)
    assert outcome == expected
    assert as_set(table) == after
    assert {s for s, _ in expected.values()} == {"moved", "ambiguous", "conflict_same_unit", "conflict_other_unit"}


IMAGE = "procedure_id string, minutes int, tags array<string>, at struct<a:int,b:int>, note string"


def test_changed_rows_are_found_by_digest(frame):
    schema = f"k int, {IMAGE}"
    old = frame(schema, (1, "p", 5, ["x", None], (1, None), "n"), (2, "p", None, [None, "x"], (None, 1), None),
                (3, None, 5, None, None, "q"), (4, "p", 1, [], None, ""), (None, "no key", 1, None, None, None))
    new = frame(schema, (1, "p", 5, [None, "x"], (1, None), "n"), (2, "p", None, [None, "x"], (1, None), None),
                (3, "5", None, None, None, "q"), (4, "p", 1, [], None, None), (5, "p", 1, None, None, None),
                (None, "no key", 1, None, None, None))
    found = sorted(((r["k"], r["operation"]) for r in changes.change_rows(old, new, "k").collect()), key=repr)
    assert found == sorted([*((k, "UPDATE") for k in (1, 2, 3, 4)), (5, "INSERT"), (None, "DELETE"), (None, "INSERT")], key=repr)
    assert changes.change_rows(old.dropna(subset=["k"]), old.dropna(subset=["k"]), "k").count() == 0
    assert changes.change_rows(old.limit(0), new, "k").count() == 6


def test_unchanged_rows_are_shuffled_as_digests_only(spark):
    old = spark.range(20_000).withColumn("wide", F.repeat(F.col("id").cast("string"), 20))
    new = old.withColumn("wide", F.when(F.col("id") % 5_000 == 0, "changed").otherwise(F.col("wide")))
    found = changes.change_rows(old, new, "id")
    assert found.count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final
    # The images are narrowed to the differing keys before they are shuffled.
    assert all("LeftSemi" in part for part in final.split("Exchange hashpartitioning(id")[1:])


def test_means_follow_deltas(frame):
    procedures = frame("procedure_id string, mean_minutes decimal(10,2)", *((f"d{i}", None) for i in range(5)))
    schema = "k int, procedure_id string, minutes int"
    rows_before = [(i, f"d{i % 4}", 5 + i % 11) for i in range(90)]
    rows_after = [(i, "d4" if i % 10 == 0 else p, m + (i % 3 == 0)) for i, p, m in rows_before if p != "d1" and i % 7]
    rows_after += [(100 + i, "d2", 60) for i in range(9)]
    before, after = frame(schema, *rows_before), frame(schema, *rows_after)
    kept = changes.procedure_totals(before)
    shifted = changes.shifted_totals(kept, changes.change_rows(before, after, "k"))
    found = dict(rows(changes.means_from_totals(procedures, shifted)))
    assert found == dict(rows(changes.refresh_procedure_means(procedures, after)))
    assert found["d1"] is None and found["d4"] is not None
    untouched = changes.shifted_totals(kept, changes.change_rows(before, before, "k"))
    assert as_set(untouched) == as_set(kept)


def test_a_cascade_reads_each_table_twice_at_most(spark, hospital, tmp_path):
    tables = {}
    for name in ("person", "patient", "staff", "resident", "supervisor", "roster", "encounter", "performed", "billing", "stay"):
        if name in hospital:
            hospital[name].write.parquet(f"{tmp_path}/{name}")
            tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    result = changes.delete_with_actions(tables, "person", tables["person"].select("person_id"))
    for name in result.tables:
        plan = result.tables[name]._jdf.queryExecution().optimizedPlan().toString()
        reads = [line for line in plan.splitlines() if "Relation [" in line]
        assert 1 <= len(reads) <= 6  # the table itself and what the levels wrote
    assert {r["outcome"] for r in result.outcome.collect()} <= {"deleted", "blocked"}


def test_fields_of_audit_images(frame):
    at = dt.datetime(2025, 6, 1)
    log = frame("audit_id string, k int, operation string, before string, after string, changed_at timestamp_ntz",
                ("a", 1, "UPDATE", '{"m": 5, "n": "x", "z": null}', '{"m": 7, "n": "x", "z": null}', at),
                ("b", 2, "INSERT", None, '{"m": 5, "n": null}', at), ("c", 3, "DELETE", '{"m": "no", "n": ""}', None, at),
                ("d", 4, "UPDATE", "not json", '{"n": "5"}', at))
    found = as_set(changes.audited_fields(log, "k", {"m": "int", "n": "string", "z": "string"}).drop("changed_at"))
    assert found == {("a", 1, "UPDATE", "m", "5", "7"), ("b", 2, "INSERT", "m", None, "5"), ("c", 3, "DELETE", "n", "", None),
                     ("d", 4, "UPDATE", "n", None, "5")}
