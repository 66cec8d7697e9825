"""The SQL surface: tables, views and a table function by name, and a query catalogue."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wardbook.functions import month_bounds
from wardbook.functions.frames import Tables
from wardbook.model import HOSPITAL, RESIDENT, SUPERVISOR
from wardbook.operators import analytics, listings
from wardbook.sources.load import to_stored

VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "currently_admitted": analytics.currently_admitted,
    "residents_without_qualified_supervisor": analytics.residents_without_qualified_supervisor,
    "monthly_stats": analytics.monthly_stats,
}


class SessionTables(Mapping):
    """The tables registered in a session, looked up by name when they are used."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __getitem__(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            raise KeyError(name)
        return self.spark.table(name)

    def __iter__(self) -> Iterator[str]:
        return (name for name in HOSPITAL if self.spark.catalog.tableExists(name))

    def __len__(self) -> int:
        return sum(1 for _ in self)


def register_stored_tables(tables: Tables) -> None:
    """Views with the stored table and column names, for SQL written against the hospital database."""
    for name, df in tables.items():
        table = HOSPITAL[name]
        to_stored(df, table).createOrReplaceTempView(table.stored)


def register_views(spark: SparkSession, tables: Tables | None = None) -> list[str]:
    """The reports that are selectable by name in SQL; over the session's tables if none are given."""
    tables = tables or SessionTables(spark)
    for name, build in VIEWS.items():
        build(tables).createOrReplaceTempView(name)
    return list(VIEWS)


WAIT_FUNCTION = "mean_wait_by_unit"


def register_functions(spark: SparkSession, tables: Tables | None = None) -> list[str]:
    """The table function ``mean_wait_by_unit()``."""
    rows = analytics.mean_wait_by_unit(tables or SessionTables(spark))
    rows.createOrReplaceTempView(f"{WAIT_FUNCTION}_rows")
    returns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {WAIT_FUNCTION}() "
        f"RETURNS TABLE ({returns}) RETURN SELECT * FROM {WAIT_FUNCTION}_rows")
    return [WAIT_FUNCTION]


BUSY_SUPERVISORS_SQL = """
    SELECT s.name AS supervisor, sum(e.n) AS encounters
    FROM (
        SELECT supervisor_id, count(*) AS n FROM encounter
        WHERE started_at >= :first AND started_at < :following
        GROUP BY supervisor_id
    ) e JOIN {supervisors} s ON s.supervisor_id = e.supervisor_id
    GROUP BY s.name HAVING sum(e.n) > :min_count
    ORDER BY encounters DESC, supervisor
"""
SUPERVISOR_NAMES_SQL = "(SELECT r.supervisor_id, p.name FROM supervisor r JOIN person p ON p.person_id = r.supervisor_id)"


def busy_supervisors_sql(t: SessionTables, year: int, month: int, min_count: int = 5) -> DataFrame:
    """``busy_supervisors`` as SQL text; the parameters are bound, never pasted in."""
    first, following = month_bounds(year, month)
    has_names = "name" in t["supervisor"].columns
    text = BUSY_SUPERVISORS_SQL.replace("{supervisors}", "supervisor" if has_names else SUPERVISOR_NAMES_SQL)
    return t.spark.sql(text, args={"first": first, "following": following, "min_count": min_count})


def _staff_in(role: str) -> Callable[[Tables], DataFrame]:
    return lambda t: listings.list_staff(t, role)


CATALOGUE: dict[str, Callable[..., DataFrame]] = {
    "patients": listings.list_patients,
    "staff": listings.list_staff,
    "residents": _staff_in(RESIDENT),
    "supervisors": _staff_in(SUPERVISOR),
    "units": listings.list_units,
    "procedures": listings.list_procedures,
    "encounters": listings.recent_encounters,
    "roster": listings.list_roster,
    "patient_encounters": listings.patient_encounters,
    "encounter_procedures": listings.encounter_procedures,
    "encounter_procedures_timeline": listings.encounter_procedures_timeline,
    "resident_ranking": analytics.resident_ranking,
    "mean_duration_by_resident": analytics.mean_duration_by_resident,
    "busy_supervisors": busy_supervisors_sql,
    "shifts_per_unit": analytics.shifts_per_unit,
    "patients_without_high_risk": analytics.patients_without_high_risk,
    "mean_wait_by_unit": analytics.mean_wait_by_unit,
    "supervisors_of_fans": analytics.supervisors_of_fans,
    "last_encounter_by_patient": analytics.last_encounter_by_patient,
    "high_risk_share_by_resident": analytics.high_risk_share_by_resident,
    "dashboard_kpis": analytics.dashboard_kpis,
    **VIEWS,
}


def run_named(spark: SparkSession, name: str, **params: int | str | date | None) -> DataFrame:
    """Runs a query of the catalogue on the tables registered in the session."""
    if name not in CATALOGUE:
        raise KeyError(f"no query named {name!r}; there are {', '.join(sorted(CATALOGUE))}")
    query = CATALOGUE[name]
    tables = SessionTables(spark)
    inspect.signature(query).bind(tables, **params)  # an unknown parameter is an error here
    return query(tables, **params)


__all__ = [
    "CATALOGUE", "SessionTables", "VIEWS", "register_functions", "register_stored_tables", "register_views", "run_named",
]
