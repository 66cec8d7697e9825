"""Audits: the model's constraints as queries that return the offending rows.

Checks follow SQL's three-valued logic: a rule fails only where it is false,
NULL passes. NULL keys are neither duplicates nor orphans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions import distinct_keys
from wardbook.functions.frames import Tables
from wardbook.model import HOSPITAL, Table


def _failures(df: DataFrame, failing: Mapping[str, Column], key: Sequence[str], **extra: Column) -> DataFrame:
    """(rule, key...) for every rule whose condition holds; one pass over the rows."""
    marks = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in failing.items())))
    return df.select(F.explode(marks).alias("rule"), *key, *(c.alias(n) for n, c in extra.items()))


def outside_domain(column: str, allowed: Sequence[str]) -> Column:
    return ~F.col(column).isin(*allowed)


def audit_domains(df: DataFrame, domains: Mapping[str, Sequence[str]], key: Sequence[str]) -> DataFrame:
    """Rows with a value outside its list: (column, key..., value)."""
    found = F.array_compact(F.array(*(
        F.when(outside_domain(c, allowed), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        for c, allowed in domains.items()
    )))
    return df.select(F.explode(found).alias("f"), *key).select("f.column", *key, "f.value")


def audit_checks(df: DataFrame, rules: Mapping[str, Column | str], key: Sequence[str]) -> DataFrame:
    """Rows failing a boolean rule: (rule, key...), one row per failed rule."""
    failing = {name: ~(F.expr(rule) if isinstance(rule, str) else rule) for name, rule in rules.items()}
    return _failures(df, failing, key)


def audit_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column: (column, missing), one pass and one row per column."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counted.unpivot([], list(columns), "column", "missing")


def audit_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit_foreign_key(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of ``child`` whose key (child column -> parent column) has no parent."""
    columns = list(on)
    parents = distinct_keys(parent, *on.values(), renamed=tuple(columns))
    return child.dropna(subset=columns).join(parents, columns, "left_anti")


def audit_exclusive_roles(staff: DataFrame, subtypes: Mapping[str, DataFrame], staff_id: str = "staff_id") -> DataFrame:
    """Staff in a subtype they may not be in: (staff_id, subtype, problem).

    ``subtypes`` maps a role to its table, whose first column is the staff id.
    ``role_mismatch``: the current role differs (or the person is no staff at
    all); ``several_subtypes``: the person is in more than one subtype.
    """
    members = None
    for role, df in subtypes.items():
        part = distinct_keys(df, df.columns[0], renamed=(staff_id,)).withColumn("subtype", F.lit(role))
        members = part if members is None else members.unionByName(part)
    per_person = members.groupBy(staff_id).agg(F.count(F.lit(1)).alias("memberships"))
    current = staff.select(staff_id, F.col("role").alias("current_role"))
    checked = members.join(per_person, staff_id).join(current, staff_id, "left")
    problems = {
        "role_mismatch": ~F.col("current_role").eqNullSafe(F.col("subtype")),
        "several_subtypes": F.col("memberships") > 1,
    }
    return _failures(checked, problems, [staff_id, "subtype"]).select(staff_id, "subtype", F.col("rule").alias("problem"))


def audit_roster_overlap(roster: DataFrame) -> DataFrame:
    """Slots in which a resident is rostered in more than one unit."""
    return (
        roster.groupBy("resident_id", "weekday", "turn")
        .agg(F.count_distinct("unit_id").alias("units"))
        .where("units > 1")
    )


def audit_table(df: DataFrame, table: Table, as_of: date) -> DataFrame:
    """Domains, rules and mandatory columns of one table: (table, rule, record key as text)."""
    failing = {f"{c}_domain": outside_domain(c, allowed) for c, allowed in table.domains.items()}
    failing |= {name: ~rule for name, rule in table.checks(as_of).items()}
    failing |= {f"{c}_missing": F.col(c).isNull() for c in table.required_columns()}
    return _failures(df, failing, [], record=_record(table.key)).select(F.lit(table.name).alias("table"), "rule", "record")


def audit_hospital(t: Tables, as_of: date, model: Mapping[str, Table] = HOSPITAL) -> DataFrame:
    """Every declared constraint over every given table: (table, rule, record)."""
    parts = []
    for name, table in model.items():
        if name not in t:
            continue
        df = t[name]
        parts.append(audit_table(df, table, as_of))
        for key in (table.key, *table.unique):
            parts.append(audit_unique(df, key).select(
                F.lit(name).alias("table"), F.lit("_".join(key) + "_unique").alias("rule"), _record(key).alias("record")))
        for ref in table.references:
            if ref.parent in t:
                orphans = audit_foreign_key(df, t[ref.parent], dict(zip(ref.columns, ref.parent_columns)))
                parts.append(orphans.select(
                    F.lit(name).alias("table"), F.lit("_".join(ref.columns) + f"_in_{ref.parent}").alias("rule"),
                    _record(table.key).alias("record")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _record(key: Sequence[str]) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
