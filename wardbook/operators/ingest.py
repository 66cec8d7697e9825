"""Validated bulk ingest: batches of requests become rows, or are refused with a reason.

Every operator returns ``accepted`` rows and ``rejected`` requests that together
are the whole batch. A request carries the first reason that applies, in a fixed
order. Where the first of several competing requests wins, the winner is found by
an aggregate (which combines on the map side) and joined back, never by a window
over the group. What is joined back is a shuffle away from its aggregate (see
``splittable``), so that the requests of a key that a third of them ask for are split
over tasks by the skewed-join rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import blank, distinct_keys, first_failure, stable_id
from wardbook.functions.frames import Tables, splittable, written
from wardbook.model import (
    BLOOD_GROUPS,
    PERSON,
    RESIDENCY_YEARS,
    RESIDENT,
    ROLES,
    SUPERVISOR,
    TURNS,
    UNIT_KINDS,
    WEEKDAYS,
)
from wardbook.operators.quality import outside_domain
from wardbook.session import new_run_dir

PATIENT_KIND = "paciente"  # fixed value: kind of a registration request, beside the staff roles


Types = Mapping[str, "str | T.DataType"]
NO_TYPES: Types = MappingProxyType({})


@dataclass(frozen=True)
class Outcome:
    """A judged batch: ``accepted`` rows with cast values, ``rejected`` requests as given.

    ``labelled`` is the whole batch as given with ``reason``, NULL for accepted ones.
    """

    judged: DataFrame
    columns: Sequence[str]
    types: Types = NO_TYPES

    @property
    def accepted(self) -> DataFrame:
        return self.judged.where("reason is null").select(*self.columns)

    @property
    def labelled(self) -> DataFrame:
        given = [F.col(_as_given(c, self.types)).alias(c) for c in self.columns]
        return self.judged.select(*given, "reason")

    @property
    def rejected(self) -> DataFrame:
        return self.labelled.where("reason is not null")

    def settled(self) -> Outcome:
        """The same outcome from a table in the shared folder.

        For outcomes that feed several tables: the batch is judged once, here, and
        not again for every table written from it.
        """
        return replace(self, judged=written(self.judged, "outcome"))


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column], id_column: str | None = None,
                   id_from: Sequence[str] = ()) -> DataFrame:
    """Fills missing values (adding absent columns); a missing id becomes a digest of ``id_from``."""
    df = df.withColumns({
        c: F.coalesce(F.col(c), value.cast(df.schema[c].dataType)) if c in df.columns else value
        for c, value in defaults.items()
    })
    if id_column:
        made = stable_id(*id_from)
        df = df.withColumn(id_column, F.coalesce(F.col(id_column).cast("string"), made)
                           if id_column in df.columns else made)
    return df


def typed(batch: DataFrame, types: Types) -> DataFrame:
    """Casts columns without failing: a value that cannot be cast becomes NULL.

    The values as given stay in ``_given_<column>``, for the reasons and for
    handing back refused requests unchanged.
    """
    present = [c for c in types if c in batch.columns]
    given = batch.withColumns({f"_given_{c}": F.col(c) for c in present})
    return given.withColumns({c: F.col(c).try_cast(types[c]) for c in present})


def _as_given(column: str, types: Types) -> str:
    return f"_given_{column}" if column in types else column


Reasons = list[tuple[Column, str]]


def _missing(required: Sequence[str], types: Types = NO_TYPES) -> Reasons:
    return [(blank(_as_given(c, types)), f"missing_{c}") for c in required]


def _malformed(types: Types) -> Reasons:
    """Values given that could not be cast."""
    return [(F.col(c).isNull() & ~blank(f"_given_{c}"), f"malformed_{c}") for c in types]


def _field_reasons(required: Sequence[str], types: Types) -> Reasons:
    return _missing(required, types) + _malformed(types)


def _mark_known(batch: DataFrame, columns: Sequence[str], known: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: TRUE where the key is among ``known`` (distinct keys, same column names)."""
    return batch.join(known.withColumn(flag, F.lit(True)), list(columns), "left")  # distinct_keys are splittable


def _unknown(flag: str) -> Column:
    return F.col(flag).isNull()


@dataclass(frozen=True)
class Parent:
    """A reference a request must satisfy: its column, the parent's keys, the reason otherwise."""

    column: str
    keys: DataFrame
    key_column: str
    reason: str


def judge(batch: DataFrame, parents: Sequence[Parent], rules: Mapping[str, Column],
          required: Sequence[str], types: Types = NO_TYPES) -> DataFrame:
    """The batch with ``reason``: a missing or malformed field, an unknown parent, a failed rule, or NULL."""
    return judge_typed(typed(batch, types), parents, rules, required, types)


def judge_typed(judged: DataFrame, parents: Sequence[Parent], rules: Mapping[str, Column],
                required: Sequence[str], types: Types) -> DataFrame:
    """The same for a batch that :func:`typed` has cast already."""
    reasons = _field_reasons(required, types)
    for i, parent in enumerate(parents):
        keys = distinct_keys(parent.keys, parent.key_column, renamed=(parent.column,))
        judged = _mark_known(judged, [parent.column], keys, f"_known{i}")
        reasons.append((_unknown(f"_known{i}"), parent.reason))
    reasons += [(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]
    flags = [f"_known{i}" for i in range(len(parents))]
    return judged.withColumn("reason", first_failure(reasons)).drop(*flags)


def validated_append(batch: DataFrame, parents: Sequence[Parent], rules: Mapping[str, Column],
                     required: Sequence[str], types: Types = NO_TYPES) -> Outcome:
    """Accepts the requests whose parents exist and whose rules hold."""
    return Outcome(judge(batch, parents, rules, required, types), batch.columns, types)


ENCOUNTER_FIELDS = ("started_at", "minutes", "patient_id", "resident_id", "supervisor_id", "unit_id")
ENCOUNTER_TYPES = {"started_at": "timestamp_ntz", "minutes": "int"}


def encounter_parents(refs: Tables) -> list[Parent]:
    return [Parent(f"{p}_id", refs[p], f"{p}_id", f"{p}_not_found")
            for p in ("patient", "resident", "supervisor", "unit")]


def encounter_rules() -> dict[str, Column]:
    return {"invalid_minutes": F.col("minutes") > 0}


def register_encounters(batch: DataFrame, refs: Tables) -> Outcome:
    """Encounters whose patient, resident, supervisor and unit exist, tested in this order."""
    return validated_append(batch, encounter_parents(refs), encounter_rules(), ENCOUNTER_FIELDS, ENCOUNTER_TYPES)


def register_units(batch: DataFrame) -> Outcome:
    """Units with name, kind and beds, a kind of the list and at least one bed."""
    rules = {"invalid_kind": ~outside_domain("kind", UNIT_KINDS), "invalid_beds": F.col("beds") > 0}
    return validated_append(batch, [], rules, ("name", "kind", "beds"), {"beds": "int"})


def order_key(order: Sequence[str]) -> Column:
    """What requests are ordered by. A single id stays plain: its minimum needs no sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_of(batch: DataFrame, key: Sequence[str], order: Sequence[str], *carry: str) -> DataFrame:
    """Per non-NULL key the first row in ``order``: its order key as ``_first``, and ``carry`` columns of it.

    ``order`` must tell any two requests apart, as the default, a request id, does.
    """
    groups = batch.dropna(subset=list(key)).groupBy(*key)
    if not carry:
        return groups.agg(F.min(order_key(order)).alias("_first"))
    first = groups.agg(F.min(F.struct(order_key(order).alias("at"), *carry)).alias("f"))
    return first.select(*key, F.col("f.at").alias("_first"), *(F.col(f"f.{c}").alias(f"_first_{c}") for c in carry))


def _is_first(order: Sequence[str]) -> Column:
    return order_key(order).eqNullSafe(F.col("_first"))


def _mark_first(batch: DataFrame, key: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Adds ``flag``: whether the row is the first of its key."""
    return (
        batch.join(splittable(first_of(batch, key, order)), list(key), "left")
        .withColumn(flag, _is_first(order)).drop("_first")
    )


PERSON_TYPES = {"birth_date": "date", "hired_on": "date"}


@dataclass(frozen=True)
class People:
    """Rows for each table out of one batch of registrations, and what became of the requests."""

    requests: Outcome

    @property
    def _taken(self) -> DataFrame:
        return self.requests.accepted.withColumn("person_id", stable_id("cpf"))

    def _of_kind(self, *kinds: str) -> DataFrame:
        return self._taken.where(F.col("kind").isin(*kinds))

    @property
    def person(self) -> DataFrame:
        return self._taken.select("person_id", "name", "cpf", "birth_date", F.lit(True).alias("is_fan"), "phone")

    @property
    def patient(self) -> DataFrame:
        return self._of_kind(PATIENT_KIND).select(
            F.col("person_id").alias("patient_id"), "plan", "allergies", "blood_group")

    @property
    def staff(self) -> DataFrame:
        return self._of_kind(*ROLES).select(
            F.col("person_id").alias("staff_id"), "crm", "hired_on", "specialty", F.col("kind").alias("role"))

    @property
    def resident(self) -> DataFrame:
        return self._of_kind(RESIDENT).select(
            F.col("person_id").alias("resident_id"), F.col("kind").alias("role"), "year")

    @property
    def supervisor(self) -> DataFrame:
        return self._of_kind(SUPERVISOR).select(
            F.col("person_id").alias("supervisor_id"), F.col("kind").alias("role"), "title")

    @property
    def rejected(self) -> DataFrame:
        return self.requests.rejected

    def settled(self) -> People:
        return People(self.requests.settled())


def _against_people(requests: DataFrame, person: DataFrame, staff: DataFrame) -> DataFrame:
    """The requests, dates cast, with ``_cpf_taken`` and ``_crm_taken`` (NULL: not in the base)."""
    judged = typed(requests, PERSON_TYPES)
    judged = _mark_known(judged, ["cpf"], distinct_keys(person, "cpf"), "_cpf_taken")
    return _mark_known(judged, ["crm"], distinct_keys(staff, "crm"), "_crm_taken")


def _people_reasons(as_of: date, cpf_taken: Column, crm_taken: Column) -> list[tuple[Column, str]]:
    kind = F.col("kind")
    is_staff = kind.isin(*ROLES)
    person_rules = PERSON.checks(as_of)
    return [
        (~F.coalesce(kind.isin(PATIENT_KIND, *ROLES), F.lit(False)), "invalid_kind"),
        *_missing(("name", "cpf", "birth_date"), PERSON_TYPES),
        *((is_staff & missing, label) for missing, label in _missing(("crm", "hired_on", "specialty"), PERSON_TYPES)),
        ((kind == RESIDENT) & blank("year"), "missing_year"),
        ((kind == SUPERVISOR) & blank("title"), "missing_title"),
        *_malformed(PERSON_TYPES),
        *((~rule, f"invalid_{name}") for name, rule in person_rules.items()),
        (cpf_taken, "duplicate_cpf"),
        (is_staff & crm_taken, "duplicate_crm"),
        ((kind == PATIENT_KIND) & outside_domain("blood_group", BLOOD_GROUPS), "invalid_blood_group"),
        ((kind == RESIDENT) & outside_domain("year", RESIDENCY_YEARS), "invalid_year"),
    ]


def judge_people(requests: DataFrame, person: DataFrame, staff: DataFrame, as_of: date) -> DataFrame:
    """The requests, dates cast, with ``reason``; see :func:`register_people`."""
    judged = typed(requests, PERSON_TYPES)
    # Key by key, so that the batch is shuffled once for each.
    judged = _mark_known(judged, ["cpf"], distinct_keys(person, "cpf"), "_cpf_taken")
    judged = _mark_first(judged, ["cpf"], ["request_id"], "_cpf_first")
    judged = _mark_known(judged, ["crm"], distinct_keys(staff, "crm"), "_crm_taken")
    judged = _mark_first(judged, ["crm"], ["request_id"], "_crm_first")
    reasons = _people_reasons(as_of, F.col("_cpf_taken") | ~F.col("_cpf_first"), F.col("_crm_taken") | ~F.col("_crm_first"))
    return judged.withColumn("reason", first_failure(reasons))


# Requests that are still open once so few are left are decided by one task, in order: a chain in which each
# request waits for the one before would take a round for every second of them.
OPEN_IN_A_TASK = 1 << 16


def holders_in_order(requests: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Of requests that each want one value of every key, those that get them, one after the other in ``order``.

    A request is taken if no request taken before it has one of its values; a request that is refused blocks nobody. A
    NULL value wants nothing. In rounds: a request that is the first of the open ones for each of its values is taken,
    its rivals are refused. Every round is an aggregate and a join per key over what is still open, written to the shared
    folder; the first open request is taken in each, so that rounds end.
    """
    spark = requests.sparkSession
    folder = new_run_dir(spark, "holders")
    open_yet = written(requests.select(order, *keys), "open_requests")
    rounds = 0
    while True:
        last = open_yet.limit(OPEN_IN_A_TASK + 1).count() <= OPEN_IN_A_TASK
        if last:
            held = _one_after_the_other(open_yet, order, keys)
        else:
            held, is_first = open_yet, F.lit(True)
            for i, key in enumerate(keys):
                first = open_yet.dropna(subset=[key]).groupBy(key).agg(F.min(order).alias(f"_first_{i}"))
                held = held.join(splittable(first), key, "left")
                is_first &= F.col(key).isNull() | (F.col(order) == F.col(f"_first_{i}"))
            held = held.where(is_first).select(order, *keys)
        held.write.parquet(f"{folder}/round={rounds}")
        if last:
            return spark.read.schema(open_yet.schema).parquet(folder).select(order, *keys)
        taken = spark.read.schema(open_yet.schema).parquet(f"{folder}/round={rounds}")
        for key in keys:
            open_yet = open_yet.join(distinct_keys(taken, key), key, "left_anti")
        # Requests without any value are in nobody's way and got through.
        open_yet = written(open_yet.where(F.coalesce(*keys).isNotNull()).select(order, *keys), "open_requests")
        rounds += 1


def _one_after_the_other(requests: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [set() for _ in keys]
        for batch in batches:
            held = []
            for values in zip(*(batch.column(k).to_pylist() for k in keys)):
                free = not any(v in used for v, used in zip(values, taken))
                held.append(free)
                if free:
                    for v, used in zip(values, taken):
                        if v is not None:
                            used.add(v)
            yield batch.filter(pa.array(held, pa.bool_()))

    return requests.coalesce(1).sortWithinPartitions(order).mapInArrow(work, requests.schema)


def judge_people_in_order(requests: DataFrame, person: DataFrame, staff: DataFrame, as_of: date) -> DataFrame:
    """The requests, dates cast, with ``reason``; see :func:`register_people_in_order`."""
    judged = _against_people(requests, person, staff)
    crm = F.when(F.col("kind").isin(*ROLES), F.col("crm"))
    valid = first_failure(_people_reasons(as_of, F.col("_cpf_taken"), F.col("_crm_taken"))).isNull()
    holders = holders_in_order(judged.where(valid).select("request_id", "cpf", crm.alias("crm")), "request_id", ("cpf", "crm"))
    for key in ("cpf", "crm"):
        holder = holders.dropna(subset=[key]).select(key, F.col("request_id").alias(f"_{key}_holder"))
        judged = judged.join(splittable(holder), key, "left")
    taken = (F.col(f"_{key}_taken") | (F.col(f"_{key}_holder") < F.col("request_id")) for key in ("cpf", "crm"))
    return judged.withColumn("reason", first_failure(_people_reasons(as_of, *taken)))


def register_people_in_order(requests: DataFrame, person: DataFrame, staff: DataFrame, as_of: date) -> People:
    """As :func:`register_people`, but one request after the other, by ``request_id``.

    A request is refused for a cpf or crm of the base or of a request that was taken before it. One
    that is refused, for whatever reason, is as if it had not been made: it keeps nobody out.
    """
    return People(Outcome(judge_people_in_order(requests, person, staff, as_of), requests.columns, PERSON_TYPES))


def register_people(requests: DataFrame, person: DataFrame, staff: DataFrame, as_of: date) -> People:
    """Splits wide registration requests into person, patient, staff and subtype rows.

    A request is taken as a whole or refused as a whole. Two keys must be unique,
    cpf and crm, against the base and within the batch. Set rule for the batch: a
    request is refused if an earlier request (smaller ``request_id``) has the same
    cpf or crm, whether that one was itself accepted or not; for requests that act
    one after the other see :func:`register_people_in_order`.

    Requests: request_id, kind, name, cpf, birth_date, phone, plan, allergies,
    blood_group, crm, hired_on, specialty, year, title. Ids of new persons are
    digests of the cpf, so that a repeated run gives the same rows.
    """
    return People(Outcome(judge_people(requests, person, staff, as_of), requests.columns, PERSON_TYPES))


# An item of an encounter bundle, read as text first so that a malformed number
# is told from an absent one.
ITEM_FIELDS = {
    "procedure_id": "string", "quantity": "int", "minutes": "int", "started_at": "timestamp_ntz", "note": "string",
}


@dataclass(frozen=True)
class Bundles:
    """Encounter and performed rows of the accepted bundles, and what became of the requests."""

    requests: Outcome
    items: DataFrame | None = None  # apart from the requests, or else nested in them

    @property
    def encounters(self) -> DataFrame:
        return self.requests.judged.where("reason is null").select("encounter_id", *ENCOUNTER_FIELDS)

    @property
    def performed(self) -> DataFrame:
        taken = self.requests.judged.where("reason is null").withColumn("_arrival", F.col("started_at"))
        if self.items is None:
            items = taken.select("encounter_id", "_arrival", F.explode("_items").alias("_item"))
        else:
            items = self.items.join(taken.select("encounter_id", "_arrival"), "encounter_id")
        start = F.coalesce("_item.started_at", "_arrival").alias("started_at")
        return items.select(
            "encounter_id", "_item.procedure_id", "_item.quantity", "_item.minutes", start, "_item.note")

    @property
    def rejected(self) -> DataFrame:
        return self.requests.rejected

    @property
    def labelled_items(self) -> DataFrame:
        """Every item with the reason of its encounter's request, NULL if accepted; ``unknown_encounter`` without one."""
        judged = self.requests.judged.select("encounter_id", "reason", F.lit(True).alias("_asked"))
        if self.items is None:
            own = self.requests.judged.select("encounter_id", "reason", F.explode("_items").alias("_item"))
            return own.select("encounter_id", "_item.*", "reason").drop("bad")
        found = self.items.join(judged, "encounter_id", "left")
        reason = F.when(F.col("_asked").isNull(), "unknown_encounter").otherwise(F.col("reason"))
        return found.select("encounter_id", "_item.*", reason.alias("reason")).drop("bad")

    @property
    def rejected_items(self) -> DataFrame:
        return self.labelled_items.where("reason is not null")

    def settled(self) -> Bundles:
        return replace(self, requests=self.requests.settled())


def _item(field: Callable[[str], Column], procedure_id_type: T.DataType) -> Column:
    """A typed item with its default quantity, and ``bad`` where it cannot be accepted."""
    types = {**ITEM_FIELDS, "procedure_id": procedure_id_type}
    cast = {c: field(c).try_cast(kind) for c, kind in types.items()}
    uncastable = F.lit(False)
    for c in ITEM_FIELDS:
        uncastable = uncastable | (field(c).isNotNull() & cast[c].isNull())
    cast["quantity"] = F.coalesce(cast["quantity"], F.lit(1))
    bad = (
        uncastable | cast["procedure_id"].isNull()
        | (cast["quantity"] <= 0) | F.coalesce(cast["minutes"] <= 0, F.lit(True))
    )
    return F.struct(*(value.alias(c) for c, value in cast.items()), bad.alias("bad"))


def _nested_verdicts(batch: DataFrame, refs: Tables) -> tuple[DataFrame, dict[str, Column]]:
    """Item rules for nested items, as JSON text or an array of structs.

    The items are read once, in a narrow branch of the plan: all rules but one are
    tested inside the row, and what is shuffled are (encounter, procedure) pairs with the verdicts of
    the row. Only verdicts come back to the batch. ``_items`` is read again, for the accepted
    requests, where performed rows are asked for.
    """
    kind = refs["procedure"].schema["procedure_id"].dataType
    whole_items = "array<struct<" + ",".join(f"{c}:string" for c in ITEM_FIELDS) + ">>"
    if isinstance(batch.schema["items"].dataType, T.StringType):
        given = F.when(F.trim("items") != "", F.col("items"))
        raw = F.from_json(given, whole_items)
    else:
        given = F.col("items")
        raw = given.cast(whole_items)

    def items(raw: Column) -> Column:
        return F.transform(F.coalesce(raw, F.array().cast(whole_items)), lambda x: _item(lambda c: x[c], kind))

    read = batch.where(given.isNotNull()).select("encounter_id", raw.alias("_raw"))
    read = read.select("encounter_id", F.col("_raw").isNull().alias("_malformed"), items(F.col("_raw")).alias("_items"))
    ids = F.col("_items.procedure_id")
    # explode_outer: explode would filter on the array first and so read it twice
    asked = read.select(
        "encounter_id", "_malformed", F.exists("_items", lambda x: x["bad"]).alias("_bad"),
        (F.size(F.array_distinct(ids)) != F.size(ids)).alias("_repeated"), F.explode_outer(ids).alias("procedure_id"))
    asked = _mark_known(asked, ["procedure_id"], distinct_keys(refs["procedure"], "procedure_id"), "_known")
    unknown = F.col("procedure_id").isNotNull() & F.col("_known").isNull()
    verdicts = asked.groupBy("encounter_id").agg(
        *[F.bool_or(c).alias(c) for c in ("_malformed", "_bad", "_repeated")], F.bool_or(unknown).alias("_unknown"))
    return batch.withColumn("_items", items(raw)).join(splittable(verdicts), "encounter_id", "left"), {
        "malformed_items": ~F.col("_malformed"),
        "procedure_not_found": ~F.col("_unknown"),
        "invalid_item": ~F.col("_bad"),
        "repeated_procedure": ~F.col("_repeated"),
    }


def _flat_verdicts(batch: DataFrame, items: DataFrame, refs: Tables) -> tuple[DataFrame, dict[str, Column]]:
    """Item rules for items in rows of their own, combined per pair and then per encounter, so that
    the many items of a hot encounter are spread over tasks."""
    per_pair = items.groupBy("encounter_id", F.col("_item.procedure_id").alias("procedure_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("_item.bad").alias("_bad"))
    procedures = distinct_keys(refs["procedure"], "procedure_id")
    named = F.col("procedure_id").isNotNull()
    per_encounter = _mark_known(per_pair, ["procedure_id"], procedures, "_known").groupBy("encounter_id").agg(
        F.bool_or("_bad").alias("_bad"),
        F.bool_or(named & F.col("_known").isNull()).alias("_unknown"),
        F.bool_or(named & (F.col("_n") > 1)).alias("_repeated"),
    )
    return batch.join(splittable(per_encounter), "encounter_id", "left"), {
        "procedure_not_found": ~F.col("_unknown"),
        "invalid_item": ~F.col("_bad"),
        "repeated_procedure": ~F.col("_repeated"),
    }


def register_encounter_bundle(batch: DataFrame, refs: Tables, items: DataFrame | None = None) -> Bundles:
    """Encounters together with their procedures, all or nothing per encounter.

    Items (procedure_id, quantity, minutes, started_at, note) come nested in the
    column ``items``, as a JSON list or an array of structs, or as rows of their
    own with ``encounter_id``. Quantity defaults to 1 and the start to that of the
    encounter; an encounter without items is legal. Every item is either in
    ``performed`` or in ``rejected_items``, also one whose encounter nobody asked for.
    """
    typed_batch = typed(batch, ENCOUNTER_TYPES)
    if items is None:
        read, rules = _nested_verdicts(typed_batch, refs)
    else:
        kind = refs["procedure"].schema["procedure_id"].dataType
        given = [c for c in ITEM_FIELDS if c in items.columns]
        absent = {c: F.lit(None).cast("string") for c in ITEM_FIELDS if c not in given}
        items = items.withColumns(absent).select("encounter_id", _item(F.col, kind).alias("_item"))
        read, rules = _flat_verdicts(typed_batch, items, refs)
    # Verdicts on items come by the id, so that there must be one.
    rules = {"missing_encounter_id": F.col("encounter_id").isNotNull(), **encounter_rules(), **rules}
    judged = judge_typed(read, encounter_parents(refs), rules, ENCOUNTER_FIELDS, ENCOUNTER_TYPES)
    return Bundles(Outcome(judged, batch.columns, ENCOUNTER_TYPES), items)


PAIR = ("encounter_id", "procedure_id")


PERFORMED_TYPES = {"quantity": "int", "minutes": "int", "started_at": "timestamp_ntz"}
BILLING_TYPES = {"amount": "decimal(10,2)", "issued_on": "date"}


def _with_pair_facts(batch: DataFrame, valid: Column, order: Sequence[str],
                     known: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """The batch with what holds for its pair: a flag per known key, and ``_is_first``.

    ``_is_first`` marks the first ``valid`` row of a pair; it tells nothing of other rows. Facts are looked up once
    per distinct pair, however often the pair is asked for, and joined back once. The order key of the first travels only
    where several valid rows compete.
    """
    first = F.when(F.count_if(valid) > 1, F.min(F.when(valid, order_key(order)))).alias("_first")
    pairs = batch.dropna(subset=list(PAIR)).groupBy(*PAIR).agg(first)
    for flag, (df, columns) in known.items():
        # Neither side of a join by pair has a hot key, so that it stays in the partitions of the aggregates.
        keys = df.select(*PAIR).dropna().distinct() if tuple(columns) == PAIR else distinct_keys(df, *columns)
        pairs = _mark_known(pairs, columns, keys, flag)
    joined = batch.join(splittable(pairs), list(PAIR), "left")
    return joined.withColumn("_is_first", F.col("_first").isNull() | _is_first(order))


def judge_performed(batch: DataFrame, refs: Tables, order: Sequence[str] = ("request_id",)) -> DataFrame:
    """The batch, defaults filled and values cast, with ``reason``; see :func:`register_performed`."""
    filled = typed(apply_defaults(batch, {"quantity": F.lit(1)}), PERFORMED_TYPES)
    fields = _field_reasons((*PAIR, "minutes", "started_at"), PERFORMED_TYPES)
    values = [(F.col("quantity") <= 0, "invalid_quantity"), (F.col("minutes") <= 0, "invalid_minutes")]
    facts = _with_pair_facts(filled, first_failure([*fields, *values]).isNull(), order, {
        "_encounter": (refs["encounter"], PAIR[:1]),
        "_procedure": (refs["procedure"], PAIR[1:]),
        "_taken": (refs["performed"], PAIR),
    })
    return facts.withColumn("reason", first_failure([
        *fields,
        (_unknown("_encounter"), "encounter_not_found"),
        (_unknown("_procedure"), "procedure_not_found"),
        *values,
        (F.col("_taken") | ~F.col("_is_first"), "already_registered"),
    ]))


def register_performed(batch: DataFrame, refs: Tables, order: Sequence[str] = ("request_id",)) -> Outcome:
    """Performed procedures: encounter and procedure exist, values valid, the pair is new.

    Quantity defaults to 1; minutes and start are mandatory. Of several valid
    requests for a pair the first in ``order`` wins.
    """
    columns = list(dict.fromkeys([*batch.columns, "quantity"]))
    return Outcome(judge_performed(batch, refs, order), columns, PERFORMED_TYPES)


def judge_bills(requests: DataFrame, performed: DataFrame, billing: DataFrame, as_of: date,
                order: Sequence[str] = ("request_id",)) -> DataFrame:
    """The requests, defaults filled and values cast, with ``reason``; see :func:`bill_procedures`."""
    filled = typed(apply_defaults(requests, {"issued_on": F.lit(as_of)}), BILLING_TYPES)
    own = [*_field_reasons((*PAIR, "amount"), BILLING_TYPES), (F.col("amount") <= 0, "invalid_amount")]
    facts = _with_pair_facts(filled, first_failure(own).isNull(), order, {
        "_performed": (performed, PAIR), "_billed": (billing, PAIR),
    })
    # Digests do not compress, so they are made after the joins.
    return apply_defaults(facts, {}, "billing_id", PAIR).withColumn("reason", first_failure([
        *own,
        (_unknown("_performed"), "not_found"),
        (F.col("_billed") | ~F.col("_is_first"), "already_billed"),
    ]))


def bill_procedures(requests: DataFrame, performed: DataFrame, billing: DataFrame, as_of: date,
                    order: Sequence[str] = ("request_id",)) -> Outcome:
    """Bills for performed, unbilled pairs with a positive amount.

    Reasons: a missing or malformed field, ``invalid_amount``, ``not_found``,
    ``already_billed``. The issue date defaults to ``as_of``; ids are digests of
    the pair. Of several valid requests for a pair the first in ``order`` wins.
    """
    columns = list(dict.fromkeys([*requests.columns, "issued_on", "billing_id"]))
    return Outcome(judge_bills(requests, performed, billing, as_of, order), columns, BILLING_TYPES)


SLOT = ("resident_id", "weekday", "turn")


def judge_slots(batch: DataFrame, refs: Tables) -> DataFrame:
    """Roster requests with ``reason`` for what is wrong with them in themselves."""
    parents = [Parent(f"{p}_id", refs[p], f"{p}_id", f"{p}_not_found")
               for p in ("unit", "resident", "supervisor") if p in refs]
    rules = {"invalid_weekday": ~outside_domain("weekday", WEEKDAYS), "invalid_turn": ~outside_domain("turn", TURNS)}
    return judge(batch, parents, rules, ("unit_id", "weekday", "turn", "resident_id", "supervisor_id"))


def against_standing(judged: DataFrame, base: DataFrame) -> DataFrame:
    """Refuses valid requests for a slot of the standing roster.

    History may hold a slot in several units; any other unit than the requested
    one makes it an overlap.
    """
    standing = base.groupBy(*SLOT).agg(F.min("unit_id").alias("_low"), F.max("unit_id").alias("_high"))
    unit = F.col("unit_id")
    held = (
        F.when(F.col("_low").isNull(), F.lit(None).cast("string"))
        .when((unit == F.col("_low")) & (unit == F.col("_high")), "duplicate_slot").otherwise("overlap")
    )
    return (
        judged.join(splittable(standing), list(SLOT), "left")
        .withColumn("reason", F.coalesce("reason", held)).drop("_low", "_high")
    )


def label_roster(batch: DataFrame, base: DataFrame, refs: Tables | None = None,
                 order: Sequence[str] = ("request_id",)) -> DataFrame:
    """The batch with ``reason``; see :func:`assign_roster`."""
    judged = against_standing(judge_slots(batch, refs or {}), base)
    winner = first_of(judged.where("reason is null"), SLOT, order, "unit_id")
    return decided(judged, splittable(winner), order).select(*batch.columns, "reason")


def decided(judged: DataFrame, winner: DataFrame, order: Sequence[str]) -> DataFrame:
    """Refuses the valid requests that are not the winner of their slot (see :func:`first_of`)."""
    lost = F.when(F.col("unit_id") == F.col("_first_unit_id"), "duplicate_slot").otherwise("overlap")
    loses = F.col("reason").isNull() & ~_is_first(order)
    return judged.join(winner, list(SLOT), "left").withColumn("reason", F.when(loses, lost).otherwise(F.col("reason")))


def assign_roster(batch: DataFrame, base: DataFrame, refs: Tables | None = None,
                  order: Sequence[str] = ("request_id",)) -> Outcome:
    """Roster requests against the standing roster and each other; the first to arrive wins.

    A resident can hold one place per (weekday, turn). A later request for the
    same unit is a ``duplicate_slot``, one for another unit an ``overlap``. Both
    refuse, so at most one request per slot is ever accepted, and the rule "one
    after the other" needs no loop. Requests that are invalid in themselves are
    put aside first and cannot keep a valid one out.
    """
    return Outcome(label_roster(batch, base, refs, order), batch.columns)
