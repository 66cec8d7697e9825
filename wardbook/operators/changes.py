"""Bulk changes: updates, deletes and their consequences, as new DataFrames.

Base tables are never altered in place: each operator returns the new table and
what became of every request.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import distinct_keys, ratio, stable_id
from wardbook.functions.frames import Tables, splittable, written
from wardbook.model import CASCADE, HOSPITAL, RESTRICT, ROLES, Table
from wardbook.operators.ingest import PAIR, order_key

PATIENT_FIELDS = ("plan", "allergies", "blood_group")


@dataclass(frozen=True)
class Patched:
    table: DataFrame
    not_found: DataFrame


def patch_patients(base: DataFrame, patches: DataFrame, fields: Sequence[str] = PATIENT_FIELDS,
                   key: str = "patient_id", order: str = "request_id") -> Patched:
    """Partial updates: NULL in a patch keeps the old value; unknown ids are reported.

    Several patches of one id act as if applied one after the other: per column
    the last value given wins.
    """
    fields = [c for c in fields if c in patches.columns]
    last = patches.groupBy(key).agg(*(
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("value")))).alias(f"_{c}")
        for c in fields
    ))
    updated = base.join(last, key, "left").select(*(
        F.coalesce(f"_{c}.value", c).alias(c) if c in fields else F.col(c) for c in base.columns
    ))
    not_found = last.select(key).join(distinct_keys(base, key), key, "left_anti")
    return Patched(updated, not_found)


@dataclass(frozen=True)
class Deleted:
    table: DataFrame
    outcome: DataFrame


def delete_performed(base: DataFrame, requests: DataFrame, billing: DataFrame,
                     order: Sequence[str] = ("request_id",)) -> Deleted:
    """Removes performed procedures that are not billed.

    Outcome per request: ``deleted``, ``blocked_billed`` or ``not_found``. A
    repeated request for a pair finds it gone: only the first one deletes.
    """
    pair = list(PAIR)
    asked = requests.dropna(subset=pair).groupBy(*pair).agg(F.min(order_key(order)).alias("_first"))
    billed = distinct_keys(billing, *pair).withColumn("_billed", F.lit(True))
    existing = distinct_keys(base, *pair).withColumn("_exists", F.lit(True))
    fate = asked.join(existing, pair, "left").join(billed, pair, "left")
    deletable = fate.where("_exists and _billed is null").select(*pair)
    first = F.col("_first").eqNullSafe(order_key(order))
    outcome = (
        F.when(F.col("_exists").isNull(), "not_found").when(F.col("_billed"), "blocked_billed")
        .when(first, "deleted").otherwise("not_found")
    )
    judged = requests.join(splittable(fate), pair, "left").select(*requests.columns, outcome.alias("outcome"))
    return Deleted(base.join(splittable(deletable), pair, "left_anti"), judged)


@dataclass(frozen=True)
class Moved:
    table: DataFrame
    outcome: DataFrame


def move_roster(base: DataFrame, moves: DataFrame, order: str = "request_id") -> Moved:
    """Moves all of a resident's rows from one (weekday, turn) to another, or none.

    Moves: request_id, resident_id, from_weekday, from_turn, to_weekday, to_turn.
    Outcome per move: ``status`` and the number of rows ``moved``.

    * ``conflict_same_unit``: the resident already holds the destination in a
      unit of the rows to move (moving a slot onto itself included);
    * ``conflict_other_unit``: holds it in another unit, or the rows to move are
      in several units and would overlap each other there;
    * ``ambiguous``: not the resident's first move of the batch;
    * ``moved``, with 0 rows when nothing matches the origin.
    """
    first = moves.groupBy("resident_id").agg(F.min(order).alias("_first"))
    ranked = moves.join(splittable(first), "resident_id", "left")
    chosen = ranked.where(F.col(order) == F.col("_first")).drop("_first")
    at_origin = (F.col("weekday") == F.col("from_weekday")) & (F.col("turn") == F.col("from_turn"))
    at_destination = (F.col("weekday") == F.col("to_weekday")) & (F.col("turn") == F.col("to_turn"))
    per_unit = (
        base.join(chosen, "resident_id").where(at_origin | at_destination)
        .groupBy(order, "unit_id")
        .agg(F.count_if(at_origin).alias("leaving"), F.count_if(at_destination).alias("standing"))
    )
    verdict = (
        per_unit.groupBy(order)
        .agg(
            F.sum("leaving").alias("leaving"),
            F.sum("standing").alias("standing"),
            F.count_if(F.col("leaving") > 0).alias("units"),
            F.bool_or(F.expr("leaving > 0 and standing > 0")).alias("same_unit"),
        )
        .withColumn("status", F.when(F.col("leaving") == 0, "moved")
                    .when(F.col("same_unit"), "conflict_same_unit")
                    .when((F.col("standing") > 0) | (F.col("units") > 1), "conflict_other_unit")
                    .otherwise("moved"))
    )
    status = F.when(F.col(order) != F.col("_first"), "ambiguous").otherwise(F.coalesce("status", F.lit("moved")))
    outcome = (
        ranked.join(verdict.select(order, "leaving", "status"), order, "left")
        .withColumn("status", status)
        .withColumn("moved", F.when(F.col("status") == "moved", F.coalesce("leaving", F.lit(0))).otherwise(0))
        .select(*moves.columns, "status", "moved")
    )
    applied = chosen.join(verdict.where("status = 'moved' and leaving > 0").select(order), order, "left_semi")
    targets = applied.select("resident_id", "from_weekday", "from_turn", "to_weekday", "to_turn")
    hit = F.coalesce(at_origin, F.lit(False))
    table = base.join(splittable(targets), "resident_id", "left").select(*(
        F.when(hit, F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) if c in ("weekday", "turn") else F.col(c)
        for c in base.columns
    ))
    return Moved(table, outcome)


ORIGIN, DESTINATION = ("from_weekday", "from_turn"), ("to_weekday", "to_turn")


def move_roster_in_order(base: DataFrame, moves: DataFrame, order: str = "request_id") -> Moved:
    """As ``move_roster``, but any number of moves a resident: each finds the roster as the moves before it left it.

    Only residents that are moved are looked at, one task each, in the order of their moves: what a move finds depends on
    all before it. Spark sorts (and spills) the moves; the task holds where the rows of one resident's slots are, a week
    of turns at most, however many moves there are. All rows of a slot move together or not at all, so a slot of the
    table as it was has one place at the end, and the table is joined with those alone.

    * ``incomplete``: NULL in the resident, the origin or the destination; moves nothing;
    * ``moved``, ``conflict_same_unit``, ``conflict_other_unit``: as in ``move_roster``, judged at the move's turn.

    Ids of moves must be unique. Rows of the roster with a NULL resident, weekday or turn stay as they are.
    """
    slot = ("weekday", "turn")
    complete = moves.dropna(subset=["resident_id", *ORIGIN, *DESTINATION])
    who = splittable(distinct_keys(complete, "resident_id"))
    nothing = {"unit_id": base.schema["unit_id"].dataType, order: moves.schema[order].dataType}
    standing = (
        base.dropna(subset=["resident_id", *slot]).join(who, "resident_id", "left_semi")
        .groupBy("resident_id", *slot, "unit_id").agg(F.count("*").alias("rows"))
        .select("resident_id", F.lit(None).cast(nothing[order]).alias(order), F.col("weekday").alias(ORIGIN[0]),
                F.col("turn").alias(ORIGIN[1]), *(F.lit(None).cast("string").alias(c) for c in DESTINATION),
                "unit_id", "rows"))
    asked = complete.select("resident_id", order, *ORIGIN, *DESTINATION,
                            F.lit(None).cast(nothing["unit_id"]).alias("unit_id"), F.lit(None).cast("long").alias("rows"))
    walked = T.StructType([
        T.StructField("resident_id", base.schema["resident_id"].dataType), T.StructField(order, nothing[order]),
        *(T.StructField(c, T.StringType()) for c in (*ORIGIN, *DESTINATION, "status")), T.StructField("moved", T.LongType())])
    # Of a resident the standing rows, which have no id, come first.
    in_order = standing.unionByName(asked).repartition("resident_id").sortWithinPartitions(
        "resident_id", F.col(order).asc_nulls_first())
    found = written(in_order.mapInArrow(_walk(order, walked), walked), "walked_moves")
    judged = found.where("status is not null").select(order, F.col("status").alias("_status"), "moved")
    outcome = moves.join(judged, order, "left").select(
        *moves.columns, F.coalesce("_status", F.lit("incomplete")).alias("status"), F.coalesce("moved", F.lit(0)).alias("moved"))
    places = found.where("status is null").select(
        "resident_id", F.col(ORIGIN[0]).alias("weekday"), F.col(ORIGIN[1]).alias("turn"), *DESTINATION)
    table = base.join(splittable(places), ["resident_id", *slot], "left").select(*(
        F.coalesce(f"to_{c}", c).alias(c) if c in slot else F.col(c) for c in base.columns))
    return Moved(table, outcome)


def _walk(order: str, schema: T.StructType):
    """Rows of a resident in order -> the verdict of each move, and for each slot that ends elsewhere its place."""
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident, held = None, {}  # slot -> the slot where its rows were at first, their units and number

        def places() -> list[tuple]:
            return [(resident, None, *was, *now, None, None) for now, (was, _, _) in held.items() if was != now]

        types = None
        for batch in batches:
            types = types or [batch.schema.field(c).type for c in names[:-2]] + [pa.string(), pa.int64()]
            out = []
            for who, number, day, turn, to_day, to_turn, unit, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if who != resident:
                    out += places()
                    resident, held = who, {}
                here, there = (day, turn), (to_day, to_turn)
                if rows is not None:
                    _, units, n = held.get(here, (here, frozenset(), 0))
                    held[here] = here, units | {unit}, n + rows
                    continue
                leaving, standing = held.get(here), held.get(there)
                status, moved = "moved", 0
                if leaving and standing and leaving[1] & standing[1]:
                    status = "conflict_same_unit"
                elif leaving and (standing or len(leaving[1]) > 1):
                    status = "conflict_other_unit"
                elif leaving:
                    held[there] = held.pop(here)
                    moved = leaving[2]
                out.append((who, number, *here, *there, status, moved))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if out := places():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return work


def _digest(columns: list[T.StructField]) -> list[Column]:
    """128 bits of a row's values: two hashes of other beginnings. Which values are NULL is hashed too, since Spark's hash
    passes over a NULL; nested values are hashed as JSON for the same reason."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    values = []
    for field in columns:
        value = F.col(field.name)
        if isinstance(field.dataType, nested):
            value = F.to_json(value, {"ignoreNullFields": "false"})
        values += [value.isNull(), value]
    return [F.xxhash64(F.lit(i), *values).alias(f"_digest_{i}") for i in (0, 1)]


def change_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Inserted, deleted and changed rows: (key, operation, before, after) with structs.

    Keys and digests of both tables are joined first, which is all of an unchanged row that is shuffled. The keys that
    differ are written, so that the joins that fetch their images know their number: few are broadcast, by Spark's
    own check of the size.
    """
    columns = [c for c in new.columns if c != key]
    fields = [new.schema[c] for c in columns]
    pairs = old.select(key, *_digest([old.schema[c] for c in columns])).join(
        new.select(F.col(key).alias("_key"), *(d.alias(f"_new_{i}") for i, d in enumerate(_digest(fields)))),
        F.col(key) == F.col("_key"), "full_outer")
    same = F.col("_digest_0").eqNullSafe(F.col("_new_0")) & F.col("_digest_1").eqNullSafe(F.col("_new_1"))
    keys = written(pairs.where(~same).select(F.coalesce(key, "_key").alias(key)).dropna().distinct(), "differing_keys")
    no_key = F.col(key).isNull()

    def images(table: DataFrame, name: str) -> DataFrame:
        # A row without a key has no other side.
        image = table.select(key, F.struct(key, *columns).alias(name))
        return image.join(keys, key, "left_semi").unionByName(image.where(no_key))

    operation = (
        F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    )
    return (
        images(old, "before").join(images(new, "after"), key, "full_outer")
        .where(~F.col("before").eqNullSafe(F.col("after")))
        .select(key, operation.alias("operation"), "before", "after")
    )


def as_json(image: str) -> Column:
    """A row image as JSON with its NULL fields."""
    return F.to_json(image, {"ignoreNullFields": "false"})


def audit_entries(changes: DataFrame, key: str, changed_at: Column, user: Column | None = None,
                  *carry: str) -> DataFrame:
    """Change rows as audit log entries; ids are digests of key, operation and time. ``carry`` columns come along."""
    entries = changes.select(
        key, "operation", as_json("before").alias("before"), as_json("after").alias("after"),
        changed_at.alias("changed_at"), *([] if user is None else [user.alias("changed_by")]), *carry,
    )
    return entries.withColumn("audit_id", stable_id(key, "operation", "changed_at"))


def diff_audit(old: DataFrame, new: DataFrame, key: str, changed_at: Column, user: Column | None = None) -> DataFrame:
    """The audit log of replacing ``old`` by ``new``; unchanged rows leave no entry."""
    return audit_entries(change_rows(old, new, key), key, changed_at, user)


def audited_fields(log: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """What audit entries say of single fields: (audit_id, key, changed_at, operation, field, before, after), as text.

    ``fields`` has the SQL type of each field asked for. Images are parsed once per entry, as VARIANT; a field that an
    image lacks or that is no such value is NULL, and a field that is the same before and after is left out.
    """
    images = {side: F.try_parse_json(side) for side in ("before", "after")}
    entries = log.select("audit_id", key, "changed_at", "operation", *(v.alias(f"_{s}") for s, v in images.items()))
    values = [F.struct(F.lit(f).alias("field"), *(
        F.try_variant_get(f"_{side}", f"$.{f}", kind).cast("string").alias(side) for side in images))
        for f, kind in fields.items()]
    return (
        entries.select("audit_id", key, "changed_at", "operation", F.explode(F.array(*values)).alias("f"))
        .where(~F.col("f.before").eqNullSafe(F.col("f.after")))
        .select("audit_id", key, "changed_at", "operation", "f.*")
    )


def refresh_procedure_means(procedure: DataFrame, performed: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Procedures with the mean real minutes of their executions; NULL without any.

    ``affected`` limits the work to the procedures of changed rows (the ids in the
    rows before and after, repeats allowed); all others keep their mean.
    """
    rows = performed.select("procedure_id", "minutes")
    if affected is not None:
        ids = distinct_keys(affected, "procedure_id")
        rows = rows.join(ids, "procedure_id", "left_semi")
        procedure = procedure.join(ids.withColumn("_affected", F.lit(True)), "procedure_id", "left")
    totals = rows.groupBy("procedure_id").agg(F.sum("minutes").alias("_total"), F.count(F.lit(1)).alias("_n"))
    fresh = ratio("_total", "_n").cast("decimal(10,2)")
    if affected is not None:
        fresh = F.when(F.col("_affected"), fresh).otherwise(F.col("mean_minutes"))
    return (
        procedure.join(totals, "procedure_id", "left")
        .withColumn("mean_minutes", fresh).drop("_total", "_n", "_affected")
    )


def procedure_totals(performed: DataFrame) -> DataFrame:
    """procedure_id, total, n: what the means are made of, to be kept and moved on by :func:`shifted_totals`.

    ``n`` counts executions, ``total`` adds up their minutes.
    """
    return performed.groupBy("procedure_id").agg(
        F.sum(F.col("minutes").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


def shifted_totals(totals: DataFrame, changes: DataFrame) -> DataFrame:
    """``totals`` after ``changes`` (before, after: images with procedure_id and minutes, as of :func:`change_rows`).

    An image before is taken away, one after is added; a change of procedure is one of each. Work follows
    the changes and the number of procedures: performed rows are not read. Procedures without executions are left out.
    """
    sides = [
        changes.where(F.col(side).isNotNull()).select(
            F.col(f"{side}.procedure_id").alias("procedure_id"), (F.col(f"{side}.minutes").cast("long") * sign).alias("total"),
            F.lit(sign).cast("long").alias("n"))
        for side, sign in (("before", -1), ("after", 1))
    ]
    return (
        totals.select("procedure_id", "total", "n").unionByName(sides[0]).unionByName(sides[1])
        .groupBy("procedure_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n <> 0")
    )


def means_from_totals(procedure: DataFrame, totals: DataFrame) -> DataFrame:
    """Procedures with the mean real minutes of their executions; NULL without any."""
    mean = totals.select("procedure_id", ratio("total", "n").cast("decimal(10,2)").alias("mean_minutes"))
    return procedure.drop("mean_minutes").join(mean, "procedure_id", "left")


@dataclass(frozen=True)
class Cascade:
    """The tables after the delete and, per requested id, what happened."""

    tables: dict[str, DataFrame]
    outcome: DataFrame


def _children(parent: str, tables: Tables, model: Mapping[str, Table]):
    """(child table, reference) for every given table that references ``parent``."""
    return [(child, ref) for child in model.values() if child.name in tables
            for ref in child.references if ref.parent == parent]


def delete_with_actions(tables: Tables, table: str, ids: DataFrame,
                        model: Mapping[str, Table] = HOSPITAL) -> Cascade:
    """Deletes rows with the model's referential actions.

    CASCADE follows references downwards, RESTRICT anywhere along the way blocks
    the requested id (outcome ``blocked``, with the blocking tables); ``ids`` has
    the key columns of ``table``. Level by level: the (requested id, key) pairs that a level adds are
    written to the shared folder, and the tables below are joined with what was written. So each table is
    read once for its references and once for what is left of it.
    """
    key = model[table].key
    asked = distinct_keys(ids, *key)
    root = [f"_root_{c}" for c in key]
    present = written(asked.join(distinct_keys(tables[table], *key), list(key), "left_semi"), "cascade")
    level = {table: present.select(*key, *(F.col(c).alias(r) for c, r in zip(key, root)))}
    doomed, hits = dict(level), []
    while level:
        below: dict[str, DataFrame] = {}
        for parent, pairs in level.items():
            for child, ref in _children(parent, tables, model):
                links = pairs
                # The parent columns a reference uses may be others than its key.
                if set(ref.parent_columns) - set(model[parent].key):
                    rows = tables[parent].select(*dict.fromkeys((*model[parent].key, *ref.parent_columns)))
                    links = pairs.join(rows, list(model[parent].key))
                links = links.select(*root, *(F.col(p).alias(c) for p, c in zip(ref.parent_columns, ref.columns)))
                if ref.on_delete == RESTRICT:
                    held = distinct_keys(tables[child.name], *ref.columns)
                    hits.append(links.join(held, list(ref.columns), "left_semi").select(*root).distinct()
                                .withColumn("blocked_by", F.lit(child.name)))
                elif ref.on_delete == CASCADE:
                    rows = tables[child.name].select(*dict.fromkeys((*child.key, *ref.columns)))
                    found = rows.join(links, list(ref.columns)).select(*child.key, *root)
                    below[child.name] = below[child.name].unionByName(found) if child.name in below else found
        level = {}
        for name, found in below.items():
            found = found.distinct()
            if name in doomed:
                found = found.join(doomed[name], [*model[name].key, *root], "left_anti")
            found = written(found, "cascade")
            if not found.isEmpty():
                level[name] = found
                doomed[name] = doomed[name].unionByName(found) if name in doomed else found
    blocked = written(reduce(DataFrame.unionByName, hits), "cascade_blocked") if hits else None
    if blocked is None:
        reasons = present.limit(0).select(*key).withColumn("blocked_by", F.lit(""))
    else:
        reasons = (
            blocked.groupBy(*root).agg(F.array_join(F.array_sort(F.collect_set("blocked_by")), ",").alias("blocked_by"))
            .select(*(F.col(r).alias(c) for r, c in zip(root, key)), "blocked_by")
        )
    marked = present.withColumn("_present", F.lit(True))
    status = (
        F.when(F.col("_present").isNull(), "not_found")
        .when(F.col("blocked_by").isNotNull(), "blocked").otherwise("deleted")
    )
    outcome = (
        asked.join(marked, list(key), "left").join(reasons, list(key), "left")
        .select(*key, status.alias("outcome"), "blocked_by")
    )
    blocked_roots = reasons.select(*(F.col(c).alias(r) for c, r in zip(key, root)))
    after = dict(tables)
    for name, pairs in doomed.items():
        gone = distinct_keys(pairs.join(blocked_roots, root, "left_anti"), *model[name].key)
        after[name] = tables[name].join(gone, list(model[name].key), "left_anti")
    return Cascade(after, outcome)


@dataclass(frozen=True)
class RoleChanges:
    table: DataFrame
    outcome: DataFrame


def change_roles(staff: DataFrame, subtypes: Mapping[str, DataFrame], requests: DataFrame,
                 order: str = "request_id") -> RoleChanges:
    """Role changes, allowed only once no row is left in the old role's subtype.

    Requests: request_id, staff_id, role. Outcome per request: ``changed``,
    ``unchanged`` (the role asked for is the current one), ``blocked_subtype``,
    ``not_found`` or ``invalid_role``. Of several allowed requests of one person
    the last sets the role.
    """
    members = None
    for role, df in subtypes.items():
        part = distinct_keys(df, df.columns[0], renamed=("staff_id",)).withColumn("_current", F.lit(role))
        members = part if members is None else members.unionByName(part)
    current = staff.select("staff_id", F.col("role").alias("_current"))
    held = current.join(members.withColumn("_held", F.lit(True)), ["staff_id", "_current"], "left")
    outcome = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "invalid_role")
        .when(F.col("_current").isNull(), "not_found")
        .when(F.col("role") == F.col("_current"), "unchanged")
        .when(F.col("_held"), "blocked_subtype").otherwise("changed")
    )
    judged = requests.join(held, "staff_id", "left").withColumn("outcome", outcome)
    # A change that is allowed makes a later request for the first role a change too;
    # the last of a person's requests that are not refused holds.
    last = (
        judged.where(F.col("outcome").isin("changed", "unchanged")).groupBy("staff_id")
        .agg(F.max(F.struct(order, "role")).alias("_last"))
    )
    table = staff.join(last, "staff_id", "left").select(*(
        F.coalesce("_last.role", "role").alias(c) if c == "role" else F.col(c) for c in staff.columns
    ))
    return RoleChanges(table, judged.select(*requests.columns, "outcome"))
