"""Reports on the invented hospital against plain loops over its rows."""

import datetime as dt
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests import seed
from tests.conftest import rows
from wardbook.model import TURNS, WEEKDAYS
from wardbook.operators import analytics, changes, listings

JUNE = dt.date(2025, 6, 15)
NAME = {r["person_id"]: r["name"] for r in seed.records("person")}
UNIT = {r["unit_id"]: r["name"] for r in seed.records("unit")}
PROCEDURE = {r["procedure_id"]: r for r in seed.records("procedure")}
ENCOUNTERS, PERFORMED = seed.records("encounter"), seed.records("performed")
BY_ID = {e["encounter_id"]: e for e in ENCOUNTERS}
RESIDENTS = [r["resident_id"] for r in seed.records("resident")]
DOCTORS = ("supervisor-1", "supervisor-3")


def rounded(total, n, decimals=2) -> Decimal:
    return (Decimal(total) / n).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)


def of(records, key) -> dict:
    found = {}
    for r in records:
        found.setdefault(key(r), []).append(r)
    return found


def first_day(e) -> dt.date:
    return e["started_at"].date().replace(day=1)


def test_resident_ranking(hospital):
    n = Counter(e["resident_id"] for e in ENCOUNTERS)
    found = rows(analytics.resident_ranking(hospital).select("resident", "year", "encounters"))
    years = {r["resident_id"]: r["year"] for r in seed.records("resident")}
    assert found == sorted(((NAME[r], years[r], n[r]) for r in RESIDENTS), key=lambda x: (-x[2], x[0]))
    assert found[-1] == ("Gus Moreau", "R3", 0)


def test_ranking_keeps_homonyms_apart(hospital):
    person = hospital["person"].replace("Bea Novak", "Cem Yildiz", "name")
    found = rows(analytics.resident_ranking({**hospital, "person": person}).select("resident", "encounters"))
    assert len(found) == 6 and sum(name == "Cem Yildiz" for name, _ in found) == 2


@pytest.mark.parametrize("decimals", [2, 1])
def test_mean_duration(hospital, decimals):
    by = of(ENCOUNTERS, lambda e: e["resident_id"])
    found = rows(analytics.mean_duration_by_resident(hospital, decimals).select("resident", "encounters", "mean_minutes"))
    expected = [(NAME[r], len(x), rounded(sum(e["minutes"] for e in x), len(x), decimals)) for r, x in by.items()]
    assert found == sorted(expected, key=lambda x: (-x[2], x[0])) + [("Gus Moreau", 0, None)]


@pytest.mark.parametrize(("year", "month", "minimum"), [(2025, 6, 4), (2025, 6, 0), (2025, 5, 0), (2030, 1, 0)])
def test_busy_supervisors(hospital, year, month, minimum):
    n = Counter(NAME[e["supervisor_id"]] for e in ENCOUNTERS if first_day(e) == dt.date(year, month, 1))
    assert rows(analytics.busy_supervisors(hospital, year, month, minimum)) == sorted(
        ((s, k) for s, k in n.items() if k > minimum), key=lambda x: (-x[1], x[0]))


def test_busy_supervisors_homonyms_merge_unless_by_id(hospital):
    t = {**hospital, "person": hospital["person"].replace("Colin Mercer", "Amina Farouk", "name")}
    assert len(rows(analytics.busy_supervisors(t, 2025, 6, 0))) == 2
    assert len(rows(analytics.busy_supervisors(t, 2025, 6, 0, by_id=True))) == 3


def test_shifts_per_unit(hospital):
    days = Counter(WEEKDAYS[dt.date(2025, 6, d).weekday()] for d in range(1, 31))
    n = Counter()
    for r in seed.records("roster"):
        n[UNIT[r["unit_id"]], NAME[r["resident_id"]]] += days[r["weekday"]]
    assert rows(analytics.shifts_per_unit(hospital, JUNE)) == sorted(
        ((u, r, k) for (u, r), k in n.items()), key=lambda x: (x[0], -x[2], x[1]))


@pytest.mark.parametrize("as_of", [dt.date(2024, 2, 29), dt.date(2025, 2, 1), dt.date(2025, 12, 31)])
def test_weekdays_in_month_against_the_calendar(spark, as_of):
    import calendar
    from wardbook.model import WEEKDAYS
    days = calendar.monthrange(as_of.year, as_of.month)[1]
    expected = {}
    for day in range(1, days + 1):
        label = WEEKDAYS[dt.date(as_of.year, as_of.month, day).weekday()]
        expected[label] = expected.get(label, 0) + 1
    assert dict(rows(analytics.weekdays_in_month(spark, as_of))) == expected


def risky(p) -> bool:
    return PROCEDURE[p["procedure_id"]]["risk"] == "ALTO"


def test_patients_without_high_risk(hospital):
    at_risk = {BY_ID[p["encounter_id"]]["patient_id"] for p in PERFORMED if risky(p)}
    plans = {r["patient_id"]: r["plan"] for r in seed.records("patient")}
    expected = sorted((NAME[p], plan) for p, plan in plans.items() if p not in at_risk)
    assert rows(analytics.patients_without_high_risk(hospital).select("patient", "plan")) == expected
    assert ("Sven Lindqvist", "plan 6") in expected


def test_mean_wait(hospital):
    first = {e: min(p["started_at"] for p in x) for e, x in of(PERFORMED, lambda p: p["encounter_id"]).items()}
    by = of(ENCOUNTERS, lambda e: UNIT[e["unit_id"]])
    expected = []
    for unit, some in sorted(by.items()):
        waits = [(first[e["encounter_id"]] - e["started_at"]).total_seconds() for e in some if e["encounter_id"] in first]
        expected.append((unit, len(waits), rounded(Decimal(sum(waits)) / 60, len(waits))))
    assert rows(analytics.mean_wait_by_unit(hospital).select("unit", "measured", "mean_wait_minutes")) == expected


def test_mean_wait_counts_fractions_and_negative_waits(hospital, frame):
    encounter = frame("encounter_id string, started_at timestamp_ntz, unit_id string",
                      *((str(i), dt.datetime(2025, 1, 1, 12), "u") for i in range(3)))
    performed = frame("encounter_id string, started_at timestamp_ntz",
                      ("0", dt.datetime(2025, 1, 1, 11, 59, 59, 250_000)), ("0", dt.datetime(2025, 1, 2)),
                      ("1", dt.datetime(2025, 1, 1, 12, 0, 1)))
    unit = frame("unit_id string, name string", ("u", "U"))
    t = {"encounter": encounter, "performed": performed, "unit": unit}
    # (-0.75 s + 1 s) / 2 = 0.125 s = 0.002 minutes; the third encounter has no procedure
    assert rows(analytics.mean_wait_by_unit(t)) == [("u", "U", 2, Decimal("0.00"))]


def test_currently_admitted(hospital):
    assert rows(analytics.currently_admitted(hospital).select("patient", "unit", "entered_at")) == [
        ("Ilse Brandt", "Lighthouse", dt.datetime(2025, 5, 30, 22)),
        ("Wanda Okoye", "Lighthouse", dt.datetime(2025, 6, 7, 18))]


def test_an_open_stay_before_the_latest_one_does_not_count(hospital, frame):
    stay = frame("stay_id string, patient_id string, unit_id string, entered_at timestamp_ntz, "
                 "left_at timestamp_ntz, reason string",
                 ("1", "p", "u", dt.datetime(2025, 1, 1), None, None),
                 ("2", "p", "u", dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 3), None))
    t = {"stay": stay, "unit": frame("unit_id string, name string", ("u", "U")),
         "patient": frame("patient_id string, name string", ("p", "P"))}
    assert rows(analytics.currently_admitted(t)) == []


def test_residents_without_qualified_supervisor(hospital):
    expected = [(NAME[r["resident_id"]], UNIT[r["unit_id"]], r["weekday"], r["turn"], NAME[r["supervisor_id"]])
                for r in seed.records("roster") if r["supervisor_id"] not in DOCTORS]
    found = rows(analytics.residents_without_qualified_supervisor(hospital)
                 .select("resident", "unit", "weekday", "turn", "supervisor"))
    assert found == sorted(expected, key=lambda x: (x[0], WEEKDAYS.index(x[2]), TURNS.index(x[3])))


@pytest.mark.parametrize(("title", "listed"), [(" DOUTORA ", 0), ("doutor", 0), ("Doutorando", 3)])
def test_titles_are_normalised(hospital, title, listed):
    supervisor = hospital["supervisor"].replace("Mestre", title, "title")
    found = analytics.residents_without_qualified_supervisor({**hospital, "supervisor": supervisor})
    assert found.count() == listed


def test_monthly_stats(hospital):
    expected = []
    for (month, unit), some in sorted(of(ENCOUNTERS, lambda e: (first_day(e), UNIT[e["unit_id"]])).items()):
        ids = {e["encounter_id"] for e in some}
        n = Counter(PROCEDURE[p["procedure_id"]]["name"] for p in PERFORMED if p["encounter_id"] in ids)
        common = min(n, key=lambda name: (-n[name], name))
        expected.append((month, unit, len(some), rounded(sum(e["minutes"] for e in some), len(some)), common))
    assert rows(analytics.monthly_stats(hospital)) == expected
    assert len({m for m, *_ in expected}) == 2


def fans(*names) -> set:
    return {r["person_id"] for r in seed.records("person") if (r["name"] in names if names else r["is_fan"])}


@pytest.mark.parametrize("names", [(), ("Noor Haddad",)])
def test_supervisors_of_fans_in_both_readings(hospital, names):
    who = fans(*names)
    person = hospital["person"].withColumn("is_fan", F.col("person_id").isin(*who))
    t = {**hospital, "person": person}
    direct = {NAME[e["supervisor_id"]] for e in ENCOUNTERS if e["patient_id"] in who}
    through = {e["resident_id"] for e in ENCOUNTERS if e["patient_id"] in who}
    via = {NAME[e["supervisor_id"]] for e in ENCOUNTERS if e["resident_id"] in through}
    assert rows(analytics.supervisors_of_fans(t)) == sorted((s,) for s in direct)
    assert rows(analytics.supervisors_of_fans(t, via="resident")) == sorted((s,) for s in via)
    with pytest.raises(ValueError):
        analytics.supervisors_of_fans(t, via="unit")


def procedures_of(encounter) -> list[str]:
    return sorted(PROCEDURE[p["procedure_id"]]["name"] for p in PERFORMED if p["encounter_id"] == encounter)


def test_last_encounter_by_patient(hospital):
    found = rows(analytics.last_encounter_by_patient(hospital).select("patient", "started_at", "procedures"))
    last = [max(x, key=lambda e: e["started_at"]) for x in of(ENCOUNTERS, lambda e: e["patient_id"]).values()]
    last.sort(key=lambda e: e["started_at"], reverse=True)
    assert [(p, at, sorted(x)) for p, at, x in found] == [
        (NAME[e["patient_id"]], e["started_at"], procedures_of(e["encounter_id"])) for e in last]


def test_last_encounter_keeps_ties_and_empty_lists(hospital):
    same = hospital["encounter"].withColumn("started_at", F.lit(dt.datetime(2025, 6, 1)).cast("timestamp_ntz"))
    bare = {**hospital, "encounter": same, "performed": hospital["performed"].where("encounter_id = 'encounter-1'")}
    found = analytics.last_encounter_by_patient(bare).collect()
    assert sorted(len(r["procedures"]) for r in found) == [0] * (seed.N_ENCOUNTERS - 1) + [2]


def test_high_risk_share(hospital):
    by = of(PERFORMED, lambda p: BY_ID[p["encounter_id"]]["resident_id"])
    expected = set()
    for resident, some in by.items():
        n, high = sum(p["quantity"] for p in some), sum(p["quantity"] for p in some if risky(p))
        expected.add((NAME[resident], n, high, rounded(100 * high, n, 1)))
    found = rows(analytics.high_risk_share_by_resident(hospital).drop("resident_id"))
    assert set(found) - {("Gus Moreau", 0, 0, Decimal("0.0"))} == expected and len(expected) == 5


def test_high_risk_share_without_procedures(hospital):
    none = {**hospital, "performed": hospital["performed"].limit(0)}
    assert {tuple(r)[2:] for r in analytics.high_risk_share_by_resident(none).collect()} == {(0, 0, Decimal("0.0"))}


def test_dashboard(hospital):
    (row,) = analytics.dashboard_kpis(hospital, JUNE).collect()
    at_risk = {BY_ID[p["encounter_id"]]["patient_id"] for p in PERFORMED if risky(p)}
    assert row.asDict() == {
        "patients": 6, "staff": 11, "encounters_in_month": sum(first_day(e) == dt.date(2025, 6, 1) for e in ENCOUNTERS),
        "shifts_today": sum(r["weekday"] == WEEKDAYS[JUNE.weekday()] for r in seed.records("roster")),
        "billed_in_month": Decimal("735.75"), "patients_without_high_risk": 6 - len(at_risk), "admitted": 2,
        "residents_without_qualified_supervisor": 3}
    (later,) = analytics.dashboard_kpis(hospital, dt.date(2030, 1, 1)).collect()
    assert (later["encounters_in_month"], later["billed_in_month"]) == (0, Decimal("0.00"))


def test_procedure_means(hospital):
    by = of(PERFORMED, lambda p: p["procedure_id"])
    found = dict(rows(changes.refresh_procedure_means(hospital["procedure"], hospital["performed"])
                      .select("procedure_id", "mean_minutes")))
    assert found == {p: rounded(sum(r["minutes"] for r in by[p]), len(by[p])) if p in by else None for p in PROCEDURE}
    assert found["procedure-9"] is None


# ---- listings ----

def test_list_patients(hospital):
    assert [r["patient"] for r in listings.list_patients(hospital).collect()] == sorted(seed.PATIENTS)


@pytest.mark.parametrize(("search", "expected"), [
    ("QUIROGA", ["Tomás Quiroga"]), (" 0000003 ", ["Wanda Okoye"]), ("w_nda", ["Wanda Okoye"]),
    ("i%brandt", ["Ilse Brandt"]), ("nobody", []),
])
def test_list_patients_search(hospital, search, expected):
    assert [r["patient"] for r in listings.list_patients(hospital, search).collect()] == expected


def test_list_staff(hospital):
    everyone = listings.list_staff(hospital).collect()
    assert len(everyone) == 11
    assert all((r["year"] is None) == (r["role"] == "preceptor") for r in everyone)
    assert {r["role"] for r in listings.list_staff(hospital, "residente").collect()} == {"residente"}
    assert listings.list_staff(hospital, "preceptor").count() == 5


def test_catalogues(hospital):
    assert [r["name"] for r in listings.list_units(hospital).collect()] == sorted(u for u, *_ in seed.UNITS)
    assert listings.list_procedures(hospital).count() == 9


def test_recent_encounters(hospital):
    newest = sorted(ENCOUNTERS, key=lambda e: e["started_at"], reverse=True)
    found = listings.recent_encounters(hospital, limit=3).collect()
    assert [(r["encounter_id"], r["patient"]) for r in found] == [
        (e["encounter_id"], NAME[e["patient_id"]]) for e in newest[:3]]
    # An encounter that names nobody takes no other's place.
    dangling = F.when(F.col("encounter_id") == newest[1]["encounter_id"], "nobody").otherwise(F.col("patient_id"))
    t = {**hospital, "encounter": hospital["encounter"].withColumn("patient_id", dangling)}
    assert [r["encounter_id"] for r in listings.recent_encounters(t, limit=3).collect()] == [
        newest[i]["encounter_id"] for i in (0, 2, 3)]


@pytest.mark.parametrize("at_once", (1 << 14, 20))
def test_recent_encounters_are_widened_past_many_that_name_nobody(hospital, monkeypatch, at_once):
    monkeypatch.setattr(listings, "NEWEST_AT_ONCE", at_once)
    newest = sorted(ENCOUNTERS, key=lambda e: e["started_at"], reverse=True)
    lost = [e["encounter_id"] for e in newest[:-3]]
    dangling = F.when(F.col("encounter_id").isin(lost), "nobody").otherwise(F.col("resident_id"))
    t = {**hospital, "encounter": hospital["encounter"].withColumn("resident_id", dangling)}
    found = [r["encounter_id"] for r in listings.recent_encounters(t, limit=2).collect()]
    assert found == [e["encounter_id"] for e in newest[-3:-1]]
    assert listings.recent_encounters(t, limit=5).count() == 3
    assert listings.recent_encounters({**t, "encounter": t["encounter"].limit(0)}).count() == 0


def test_patient_encounters(hospital):
    found = [r["encounter_id"] for r in listings.patient_encounters(hospital, "patient-2").collect()]
    own = sorted((e for e in ENCOUNTERS if e["patient_id"] == "patient-2"), key=lambda e: e["started_at"], reverse=True)
    assert found == [e["encounter_id"] for e in own] and len(found) == 4
    assert listings.patient_encounters(hospital).count() == seed.N_ENCOUNTERS


def test_encounter_procedures(hospital):
    found = listings.encounter_procedures(hospital, "encounter-2").collect()
    assert [(r["procedure"], r["billed"], r["amount"]) for r in found] == [
        ("Blood count", True, Decimal("95.50")), ("Infusion", False, None)]
    billed = listings.encounter_procedures(hospital).where("billed").collect()
    assert sorted(float(r["amount"]) for r in billed) == [95.5, 310.0, 640.25]


def test_encounter_procedures_timeline(hospital):
    found = listings.encounter_procedures_timeline(hospital, "encounter-2").collect()
    assert [(r["procedure"], r["billed"]) for r in found] == [("Blood count", True), ("Infusion", False)]


def test_list_roster(hospital):
    expected = [(UNIT[r["unit_id"]], r["weekday"], r["turn"]) for r in seed.records("roster")]
    assert rows(listings.list_roster(hospital).select("unit", "weekday", "turn")) == sorted(
        expected, key=lambda x: (x[0], WEEKDAYS.index(x[1]), TURNS.index(x[2])))
