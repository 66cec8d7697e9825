"""Loads, exports and the SQL surface."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import seed
from tests.conftest import as_set, rows
from wardbook import session
from wardbook.model import HOSPITAL
from wardbook.operators import analytics
from wardbook.plans import surface
from wardbook.sources import export, load

JUNE = dt.date(2025, 6, 15)


def test_hospital_survives_a_round_trip(spark, hospital, tmp_path):
    export.write_hospital(hospital, str(tmp_path))
    back = load.load_hospital(spark, str(tmp_path), register=False)
    assert list(back) == list(HOSPITAL)
    for name, df in hospital.items():
        assert back[name].schema == df.schema
        assert as_set(back[name]) == as_set(df)
    assert (tmp_path / "atendimento" / "month=2025-06").is_dir()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_formats_load_typed(spark, hospital, tmp_path, fmt):
    model = {name: HOSPITAL[name] for name in ("person", "encounter", "billing", "stay")}
    for name, table in model.items():
        writer = load.to_stored(hospital[name], table).write.option("header", "true")
        getattr(writer, fmt)(f"{tmp_path}/{table.stored}.{fmt}")
    back = load.load_hospital(spark, str(tmp_path), fmt, suffix=f".{fmt}", model=model, register=False)
    for name in model:
        assert back[name].schema == hospital[name].schema
        assert as_set(back[name]) == as_set(hospital[name])


def test_row_counts(hospital):
    assert dict(rows(load.row_counts(hospital)))["performed"] == len(seed.plain()["performed"])


def test_export_json_has_plain_numbers_and_nulls(hospital, tmp_path):
    report = analytics.mean_duration_by_resident({**hospital, "encounter": hospital["encounter"].limit(0)})
    export.export_result(report, str(tmp_path / "out"), "json")
    lines = [json.loads(line) for f in Path(tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 6 and {line["mean_minutes"] for line in lines} == {None}
    kpis = analytics.dashboard_kpis(hospital, JUNE)
    export.export_result(kpis, str(tmp_path / "kpis"), "json")
    (line,) = [json.loads(f.read_text()) for f in Path(tmp_path / "kpis").glob("*.json")]
    assert line["billed_in_month"] == 735.75


def test_export_csv_and_parquet(spark, hospital, tmp_path):
    report = analytics.last_encounter_by_patient(hospital)
    export.export_result(report, str(tmp_path / "p"), "parquet")
    assert sorted(rows(spark.read.parquet(str(tmp_path / "p")))) == sorted(rows(report))
    export.export_result(report, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert back.count() == 5 and '["Biopsy","Ultrasound"]' in {r["procedures"] for r in back.collect()}
    with pytest.raises(ValueError):
        export.export_result(report, str(tmp_path / "x"), "xml")


def test_views_function_and_named_queries(spark, hospital):
    load.register_views(hospital)
    for name in surface.register_views(spark):
        assert rows(spark.sql(f"SELECT * FROM {name}")) == rows(surface.VIEWS[name](hospital))
    (function,) = surface.register_functions(spark)
    assert rows(spark.sql(f"SELECT * FROM {function}()")) == rows(analytics.mean_wait_by_unit(hospital))
    assert rows(surface.run_named(spark, "busy_supervisors", year=2025, month=6)) == rows(
        analytics.busy_supervisors(hospital, 2025, 6, 5)) != []
    assert rows(surface.run_named(spark, "busy_supervisors", year=2025, month=6, min_count=0)) == rows(
        analytics.busy_supervisors(hospital, 2025, 6, 0))
    found = surface.run_named(spark, "patients", search="x' OR 1=1 --")
    assert rows(found) == []


PARAMETERS = {"busy_supervisors": {"year": 2025, "month": 6}, "shifts_per_unit": {"as_of": JUNE},
              "dashboard_kpis": {"as_of": JUNE}}


def test_the_whole_catalogue_runs(spark, hospital):
    load.register_views(hospital)
    for name in surface.CATALOGUE:
        assert surface.run_named(spark, name, **PARAMETERS.get(name, {})).count() > 0, name
    with pytest.raises(KeyError):
        surface.run_named(spark, "no such query")
    with pytest.raises(TypeError):
        surface.run_named(spark, "patients", colour="red")


def test_sql_written_for_the_hospital_database(spark, hospital):
    """Stored table and column names work in Spark SQL, joins and grouping included."""
    surface.register_stored_tables(hospital)
    found = spark.sql("""
        WITH custo AS (SELECT id_procedimento, avg(valor) AS medio FROM FATURAMENTO GROUP BY id_procedimento)
        SELECT u.nome, count(DISTINCT x.id_procedimento), max(c.medio) FROM UNIDADE u
        JOIN ATENDIMENTO y USING (id_unidade) JOIN PROCEDIMENTO_REALIZADO x USING (id_atendimento)
        LEFT JOIN custo c USING (id_procedimento)
        GROUP BY u.nome HAVING count(*) > 1""")
    assert {name for name, *_ in rows(found)} == {name for name, *_ in seed.UNITS}
    assert max(float(cost) for *_, cost in rows(found) if cost is not None) == 640.25


def test_shared_dir_is_the_one_the_session_names(spark):
    named = spark.conf.get(session.SHARED_DIR_SETTING)
    assert session.shared_dir(spark) == named
    first, second = session.new_run_dir(spark, "job"), session.new_run_dir(spark, "job")
    assert first != second and first.startswith(named)


def test_calendar_bounds():
    from wardbook.functions import month_bounds
    assert month_bounds(2025, 12) == (dt.date(2025, 12, 1), dt.date(2026, 1, 1))
    assert month_bounds(2024, 2) == (dt.date(2024, 2, 1), dt.date(2024, 3, 1))


def test_ratio_rounds_half_away_from_zero(frame):
    from wardbook.functions import ratio
    df = frame("t long, n long", (100496, 100000), (201, 200), (-201, 200), (1, 0), (2, 3))
    assert [None if v is None else str(v) for (v,) in rows(df.select(ratio("t", "n")))] == [
        "1.00", "1.01", "-1.01", None, "0.67"]


def test_a_month_opens_the_files_of_that_month(spark, hospital, tmp_path):
    export.write_hospital(hospital, str(tmp_path))
    months = sorted({str(r["started_at"])[:7] for r in hospital["encounter"].collect()})
    assert len(months) > 1
    loaded = load.load_hospital(spark, str(tmp_path), register=False, months=(months[0], months[0]))
    every = load.load_hospital(spark, str(tmp_path), register=False)
    own = every["encounter"].where(F.date_format("started_at", "yyyy-MM") == months[0])
    assert sorted(loaded["encounter"].collect()) == sorted(own.collect())
    assert loaded["encounter"].count() < every["encounter"].count() and loaded["patient"].count() == every["patient"].count()
    plan = loaded["encounter"]._jdf.queryExecution().executedPlan().toString()
    assert "month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    report = analytics.busy_supervisors({**loaded, "supervisor": every["supervisor"]}, *map(int, months[0].split("-")), 0)
    assert sorted(report.collect()) == sorted(
        analytics.busy_supervisors(every, *map(int, months[0].split("-")), 0).collect())


def _below_join(df, key: str) -> str:
    """The part of the plan below the sort-merge join on ``key``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    at = next(i for i, line in enumerate(lines) if f"SortMergeJoin [{key}#" in line)
    after = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    return "\n".join(lines[at + 1:after])


def test_bucketed_facts_join_without_an_exchange(spark, hospital):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = export.write_bucketed({name: hospital[name] for name in ("encounter", "performed")}, buckets=3)
        for name, table in bucketed.items():
            assert sorted(table.collect(), key=repr) == sorted(hospital[name].collect(), key=repr)
        report = analytics.mean_wait_by_unit({**hospital, **bucketed})
        plain = analytics.mean_wait_by_unit(hospital)
        assert report.collect() == plain.collect() != []
        assert "Exchange" in _below_join(plain, "encounter_id")
        below = _below_join(report, "encounter_id")
        assert "Exchange" not in below and below.count("FileScan") == 2 and "SelectedBucketsCount: 3 out of 3" in below
        empty = export.write_bucketed({"performed": hospital["performed"].limit(0)})
        assert analytics.mean_wait_by_unit({**hospital, **empty}).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
