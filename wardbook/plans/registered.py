"""The operators bound to the test tables, one entry per operator of the inventory.

Every entry takes ``(spark, directory)`` and runs over the whole tables. What it
needs beyond the bindings (orphans, repeated keys, patches) is derived from the
same tables by the conditions given here and restated in ``plans.oracle``.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.functions import weekday_label
from wardbook.functions.frames import written
from wardbook.model import HOSPITAL, RESIDENT, SUPERVISOR, UNIT_KINDS
from wardbook.operators import analytics, changes, ingest, listings, quality
from wardbook.plans import surface
from wardbook.session import configure, new_run_dir
from wardbook.sources.bindings import (
    TEST_SCHEMAS,
    duty_clinic,
    encounter_requests,
    orders_clinic,
    read_raw,
    roster_requests,
    whole,
)
from wardbook.sources.export import export_result, plain_numbers, write_bucketed, write_hospital
from wardbook.sources.load import load_hospital, load_tables, register_views, row_counts
from wardbook.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

ORDERS_AS_OF = date(1998, 6, 15)
EVENTS_AS_OF = date(2024, 1, 15)

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, directory: plain_numbers(build(configure(spark), directory))
        return build
    return register


def outcome(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def on_orders(name: str, operator: Callable[..., DataFrame], *args, **kwargs) -> None:
    query(name)(lambda spark, d: operator(orders_clinic(spark, d), *args, **kwargs))


def on_events(name: str, operator: Callable[..., DataFrame], *args, **kwargs) -> None:
    query(name)(lambda spark, d: operator(duty_clinic(spark, d), *args, **kwargs))


# ---- A: sources and sinks -------------------------------------------------

@query("A1_load_tables")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return row_counts(load_tables(spark, d, TEST_SCHEMAS, register=False))


@query("A1_load_hospital_month")
def a1_month(spark: SparkSession, d: str) -> DataFrame:
    """Encounters are written in monthly folders; the report of June 1998 reads that one."""
    t = orders_clinic(spark, d)
    path, model = new_run_dir(spark, "hospital"), {"encounter": HOSPITAL["encounter"]}
    write_hospital({"encounter": t["encounter"]}, path, model=model)
    june = load_hospital(spark, path, model=model, register=False, months=("1998-06", "1998-06"))
    supervisor = t["supervisor"].withColumn("supervisor_id", F.col("supervisor_id").cast("string"))
    return analytics.busy_supervisors({**june, "supervisor": supervisor}, 1998, 6)


@query("A2_export_result")
def a2(spark: SparkSession, d: str) -> DataFrame:
    report = plain_numbers(analytics.mean_duration_by_resident(orders_clinic(spark, d)))
    path = new_run_dir(spark, "export")
    export_result(report, path, "json")
    return spark.read.schema(report.schema).json(path)


@query("A2_export_result_csv")
def a2_csv(spark: SparkSession, d: str) -> DataFrame:
    report = plain_numbers(analytics.monthly_stats(orders_clinic(spark, d)))
    path = new_run_dir(spark, "export")
    export_result(report, path, "csv")
    return spark.read.schema(report.schema).option("header", "true").csv(path)


@query("A2_export_result_parquet")
def a2_parquet(spark: SparkSession, d: str) -> DataFrame:
    report = plain_numbers(listings.patient_encounters(orders_clinic(spark, d)))
    path = new_run_dir(spark, "export")
    export_result(report, path, "parquet")
    return spark.read.schema(report.schema).parquet(path)


# ---- B: audits ------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("B1_audit_domains")
def b1(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = read_raw(spark, d, "orders")
    allowed = {"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), "o_orderstatus": ("F", "O")}
    return quality.audit_domains(orders, allowed, ["o_orderkey"])


@query("B2_audit_checks")
def b2(spark: SparkSession, d: str) -> DataFrame:
    orders, lineitem = read_raw(spark, d, "orders", "lineitem")
    dates = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rules = {
        "shipped_after_order": F.col("l_shipdate") >= F.col("o_orderdate"),
        "quantity_positive": "l_quantity > 0",
        "discount_below_9_percent": "l_discount < 0.085",
        "flag_is_one_letter": F.col("l_returnflag").rlike("^[A-Z]$") & (F.length("l_returnflag") == 1),
    }
    return quality.audit_checks(lineitem.join(dates, "l_orderkey"), rules, LINE_KEY)


@query("B3_audit_not_null")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_not_null(duty_clinic(spark, d)["stay"], [c.name for c in HOSPITAL["stay"].columns])


@query("B4_audit_unique")
def b4(spark: SparkSession, d: str) -> DataFrame:
    (lineitem,) = read_raw(spark, d, "lineitem")
    return quality.audit_unique(lineitem, ["l_orderkey", "l_partkey"])


@query("B5_audit_foreign_key")
def b5(spark: SparkSession, d: str) -> DataFrame:
    orders, lineitem = read_raw(spark, d, "orders", "lineitem")
    settled = orders.where("o_orderstatus <> 'P'")
    return quality.audit_foreign_key(lineitem, settled, {"l_orderkey": "o_orderkey"}).select(*LINE_KEY)


@query("B6_audit_exclusive_roles")
def b6(spark: SparkSession, d: str) -> DataFrame:
    t = orders_clinic(spark, d)
    (supplier,) = read_raw(spark, d, "supplier")
    ids = supplier.select(F.col("s_suppkey").alias("id"), "s_nationkey")
    subtypes = {
        RESIDENT: ids.where("id % 2 = 0 or s_nationkey = 5").select("id"),
        SUPERVISOR: ids.where("id % 2 = 1 or s_nationkey = 7").select("id"),
    }
    return quality.audit_exclusive_roles(t["staff"], subtypes)


@query("B_audit_hospital")
def b_hospital(spark: SparkSession, d: str) -> DataFrame:
    """Every declared rule over four tables; procedures over size 48 are not in the catalogue."""
    t = orders_clinic(spark, d, keep=True)
    tables = {name: t[name] for name in ("encounter", "performed", "billing")}
    tables["procedure"] = t["procedure"].where("expected_minutes <= 48")
    return quality.audit_hospital(tables, ORDERS_AS_OF)


@query("B7_apply_defaults")
def b7(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = read_raw(spark, d, "orders")
    batch = orders.select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    defaults = {"priority": F.lit("5-LOW"), "quantity": F.lit(1), "issued_on": F.lit(ORDERS_AS_OF),
                "active": F.lit(True)}
    return ingest.apply_defaults(batch, defaults, "request_id", ["o_orderkey", "o_custkey"])


def encounter_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every order asks to become an encounter; some lack staff, some last 0 minutes."""
    requests = encounter_requests(*read_raw(spark, d, "orders", "customer", "lineitem"))
    return requests.withColumn("minutes", (F.col("price") % 90).cast("int")).drop("price")


@query("B8_validated_append")
def b8(spark: SparkSession, d: str) -> DataFrame:
    customer, supplier, nation = read_raw(spark, d, "customer", "supplier", "nation")
    solvent = supplier.where("s_acctbal >= 0")
    refs = {
        "patient": customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("patient_id")),
        "resident": solvent.select(F.col("s_suppkey").alias("resident_id")),
        "supervisor": solvent.select(F.col("s_suppkey").alias("supervisor_id")),
        "unit": nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("unit_id")),
    }
    return outcome(ingest.register_encounters(encounter_batch(spark, d), refs).labelled, "encounter_id")


def registrations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers and suppliers as registration requests, with the people and staff already known."""
    customer, supplier = read_raw(spark, d, "customer", "supplier")

    def shared(prefix: str, key: str, share: int) -> Column:
        return F.concat(F.lit(prefix), F.lpad(F.floor(F.col(key) / share).cast("string"), 10, "0"))

    none = F.lit(None).cast("string")
    patients = customer.select(
        F.concat(F.lit("p"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("request_id"),
        F.lit("paciente").alias("kind"), F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") != 3, shared("1", "c_custkey", 2)).alias("cpf"),
        F.when(F.col("c_nationkey") == 4, "not a date").otherwise("1990-01-01").alias("birth_date"),
        none.alias("phone"), F.col("c_mktsegment").alias("plan"), none.alias("allergies"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "XYZ").otherwise("O+").alias("blood_group"),
        none.alias("crm"), none.alias("hired_on"), none.alias("specialty"), none.alias("year"), none.alias("title"),
    )
    odd = F.col("s_suppkey") % 2 == 1
    staff = supplier.select(
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("request_id"),
        F.when(F.col("s_nationkey") == 6, "visitante").when(odd, SUPERVISOR).otherwise(RESIDENT).alias("kind"),
        F.col("s_name").alias("name"), shared("2", "s_suppkey", 1).alias("cpf"),
        F.lit("1980-01-01").alias("birth_date"), none.alias("phone"), none.alias("plan"), none.alias("allergies"),
        none.alias("blood_group"),
        F.concat(F.lit("CRM "), F.floor(F.col("s_suppkey") / 3)).alias("crm"),
        F.lit("2020-02-01").alias("hired_on"), F.col("s_nationkey").cast("string").alias("specialty"),
        F.when(~odd & (F.col("s_nationkey") != 0), F.concat(F.lit("R"), 1 + F.col("s_suppkey") % 4)).alias("year"),
        F.when(odd & (F.col("s_nationkey") != 0), F.lit("Mestre")).alias("title"),
    )
    known_people = customer.where("c_nationkey = 1").select(shared("1", "c_custkey", 2).alias("cpf"))
    known_staff = supplier.where("s_nationkey = 2").select(
        F.concat(F.lit("CRM "), F.floor(F.col("s_suppkey") / 3)).alias("crm"))
    return patients.unionByName(staff), known_people, known_staff


@query("B9_register_people")
def b9(spark: SparkSession, d: str) -> DataFrame:
    return outcome(ingest.register_people(*registrations(spark, d), ORDERS_AS_OF).requests.labelled, "request_id")


@query("B9_register_people_rows")
def b9_rows(spark: SparkSession, d: str) -> DataFrame:
    people = ingest.register_people(*registrations(spark, d), ORDERS_AS_OF).settled()
    parts = [
        people.person.select(F.lit("person").alias("table_name"), "person_id", F.col("name").alias("detail")),
        people.patient.select(F.lit("patient"), "patient_id", "plan"),
        people.staff.select(F.lit("staff"), "staff_id", "crm"),
        people.resident.select(F.lit("resident"), "resident_id", "year"),
        people.supervisor.select(F.lit("supervisor"), "supervisor_id", "title"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


def order_registrations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every order registers a person; orders of a customer share their cpf, orders of like price their crm.

    Urgent orders register patients. Some are invalid in themselves, and must keep nobody out.
    """
    orders, customer = read_raw(spark, d, "orders", "customer")
    none = F.lit(None).cast("string")
    priority, pending = F.col("o_orderpriority"), F.col("o_orderstatus") == "P"
    patient, odd = priority == "1-URGENT", F.col("o_orderkey") % 2 == 1

    def cpf(key: str) -> Column:
        return F.lpad(F.col(key).cast("string"), 11, "0")

    crm = F.concat(F.lit("CRM "), F.floor(F.col("o_totalprice") / 500))
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.when(patient, "paciente").when(odd, SUPERVISOR).otherwise(RESIDENT).alias("kind"),
        F.concat(F.lit("Person "), F.col("o_orderkey")).alias("name"), cpf("o_custkey").alias("cpf"),
        F.when(pending & (priority == "2-HIGH"), "not a date").otherwise("1980-01-01").alias("birth_date"),
        none.alias("phone"), none.alias("plan"), none.alias("allergies"),
        F.when(pending, "XYZ").otherwise("O+").alias("blood_group"),
        crm.alias("crm"), F.lit("2020-02-01").alias("hired_on"), priority.alias("specialty"),
        F.when(~patient & ~odd, F.when(pending, "R9").otherwise("R1")).alias("year"),
        F.when(~patient & odd, F.lit("Mestre")).alias("title"),
    )
    known_people = customer.where("c_nationkey = 1").select(cpf("c_custkey").alias("cpf"))
    known_staff = orders.where("o_orderdate < '1993-01-01'").select(crm.alias("crm"))
    return requests, known_people, known_staff


@query("B9_register_people_in_order")
def b9_in_order(spark: SparkSession, d: str) -> DataFrame:
    people = ingest.register_people_in_order(*order_registrations(spark, d), ORDERS_AS_OF)
    return outcome(people.requests.labelled, "request_id")


@query("B10_register_units")
def b10(spark: SparkSession, d: str) -> DataFrame:
    (nation,) = read_raw(spark, d, "nation")
    kinds = F.array(*map(F.lit, UNIT_KINDS), F.lit("Hospital"))
    batch = nation.select(
        F.col("n_nationkey").alias("unit_id"),
        F.when(F.col("n_nationkey") != 24, F.col("n_name")).alias("name"),
        F.element_at(kinds, F.col("n_regionkey") + 1).alias("kind"),
        (F.col("n_nationkey") - 2).alias("beds"),
    )
    return outcome(ingest.register_units(batch).labelled, "unit_id")


def bundles(spark: SparkSession, d: str, present: Column | None = None) -> ingest.Bundles:
    """Orders with their lines as items; parts over size 48 are not in the catalogue.

    The requests of orders that are not ``present`` have other ids than their items name.
    """
    lineitem, part = read_raw(spark, d, "lineitem", "part")
    items = lineitem.select(
        F.col("l_orderkey").alias("encounter_id"), F.col("l_partkey").alias("procedure_id"),
        F.col("l_quantity").cast("int").alias("quantity"), (whole("l_extendedprice") % 240).alias("minutes"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("started_at"),
    )
    requests = encounter_requests(*read_raw(spark, d, "orders", "customer", "lineitem"))
    if present is not None:
        own = F.col("encounter_id")
        requests = requests.withColumn("encounter_id", F.when(present, own).otherwise(-1 - own))
    batch = requests.withColumn("minutes", (1 + F.col("price") % 90).cast("int")).drop("price")
    refs = ChainMap({"procedure": catalogue(part)}, orders_clinic(spark, d))
    return ingest.register_encounter_bundle(batch, refs, items)


def catalogue(part: DataFrame) -> DataFrame:
    return part.where("p_size <= 48").select(F.col("p_partkey").alias("procedure_id"))


@query("B11_register_encounter_bundle")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return outcome(bundles(spark, d).requests.labelled, "encounter_id")


@query("B11_register_encounter_bundle_performed")
def b11_performed(spark: SparkSession, d: str) -> DataFrame:
    return bundles(spark, d).performed.drop("note")


@query("B11_register_encounter_bundle_items")
def b11_items(spark: SparkSession, d: str) -> DataFrame:
    """What became of every item; those of orders over 400000 come without their encounter."""
    made = bundles(spark, d, F.col("price") <= 400_000)
    return made.labelled_items.groupBy("encounter_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("items"), F.sum("quantity").alias("quantity"))


@query("B11_bundle_to_audit")
def b11_audit(spark: SparkSession, d: str) -> DataFrame:
    """The log of adding the accepted bundles to the encounters of the first half of 1995."""
    made = bundles(spark, d).settled()
    before = made.encounters.where("started_at < '1995-07-01'")
    log = changes.diff_audit(before, made.encounters, "encounter_id", F.lit(ORDERS_AS_OF).cast("timestamp_ntz"))
    return log.select("encounter_id", "operation", F.col("before").isNull().alias("is_new"))


@query("B11_bundle_to_means")
def b11_means(spark: SparkSession, d: str) -> DataFrame:
    """The means after the accepted bundles; procedures that none of them names keep having none."""
    made = bundles(spark, d).settled().performed
    (part,) = read_raw(spark, d, "part")
    known = catalogue(part).withColumn("mean_minutes", F.lit(None).cast("decimal(10,2)"))
    return changes.refresh_procedure_means(known, made, made).select("procedure_id", "mean_minutes")


@query("B11_register_encounter_bundle_json")
def b11_json(spark: SparkSession, d: str) -> DataFrame:
    """Every line asks for an encounter of its own with a JSON list of two procedures.

    The second is the part whose key equals the supplier's; both lead suppliers
    are the line's neighbours in the key range.
    """
    lineitem, part = read_raw(spark, d, "lineitem", "part")

    def procedure(key: str, quantity: Column) -> Column:
        return F.struct(F.col(key).alias("procedure_id"), quantity.alias("quantity"),
                        (whole("l_extendedprice") % 240).alias("minutes"))

    pair = F.array(procedure("l_partkey", F.col("l_quantity").cast("int")),
                   procedure("l_suppkey", F.col("l_linenumber") - 1))
    batch = lineitem.select(
        F.concat_ws("-", *LINE_KEY, F.round(F.col("l_extendedprice") * 100).cast("long")).alias("encounter_id"),
        F.col("l_shipdate").alias("started_at"), F.lit(30).alias("minutes"),
        F.col("l_suppkey").alias("patient_id"),
        (F.col("l_suppkey") - F.col("l_suppkey") % 2).alias("resident_id"),
        (F.col("l_suppkey") - F.col("l_suppkey") % 2 + 1).alias("supervisor_id"),
        F.col("l_linenumber").alias("unit_id"),
        F.when(F.col("l_returnflag") != "N", F.to_json(pair)).alias("items"),
    )
    result = ingest.register_encounter_bundle(batch, ChainMap({"procedure": catalogue(part)}, orders_clinic(spark, d)))
    return outcome(result.requests.labelled, "encounter_id")


def line_requests(lineitem: DataFrame, part: str = "l_partkey") -> DataFrame:
    return lineitem.select(
        F.concat_ws("-", *LINE_KEY).alias("request_id"),
        F.col("l_orderkey").alias("encounter_id"), F.col(part).alias("procedure_id"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).alias("quantity"),
        (whole("l_extendedprice") % 240).alias("minutes"), F.col("l_shipdate").alias("started_at"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).otherwise(0.0).alias("amount"),
        F.col("l_returnflag").alias("flag"),
    )


LINE_ORDER = ("line", "supplier", "price")  # tells any two lines of an order and part apart


@query("B12_register_performed")
def b12(spark: SparkSession, d: str) -> DataFrame:
    """Lines with odd numbers are on record, those with even numbers ask to be added."""
    t = orders_clinic(spark, d)
    lineitem, part = read_raw(spark, d, "lineitem", "part")
    lines = line_requests(lineitem)
    refs = {
        "encounter": t["encounter"], "performed": lines.where("line % 2 = 1"),
        "procedure": catalogue(part),
    }
    result = ingest.register_performed(lines.where("line % 2 = 0"), refs, LINE_ORDER)
    return outcome(result.labelled, "request_id", "quantity")


@query("B13_bill_procedures")
def b13(spark: SparkSession, d: str) -> DataFrame:
    t = orders_clinic(spark, d)
    requests = line_requests(*read_raw(spark, d, "lineitem"))
    # Bills of 50000 and more are of procedures that nobody asks for.
    paid = F.when(F.col("amount") < 50_000, F.col("procedure_id")).otherwise(-1 - F.col("procedure_id"))
    billed = t["billing"].withColumn("procedure_id", paid)
    result = ingest.bill_procedures(requests, t["performed"], billed, ORDERS_AS_OF, LINE_ORDER)
    return outcome(result.labelled, "request_id", "billing_id", "issued_on")


@query("B14_assign_roster")
def b14(spark: SparkSession, d: str) -> DataFrame:
    """The roster of the unit 'signup' stands; all other requests come in; 'error' is no unit."""
    t = duty_clinic(spark, d)
    refs = {"unit": t["unit"].where("unit_id <> 'error'"), "resident": t["resident"], "supervisor": t["supervisor"]}
    batch = t["requests"].where("unit_id <> 'signup'")
    base = t["roster"].where("unit_id = 'signup'")
    return outcome(ingest.assign_roster(batch, base, refs).labelled, "request_id")


@query("B15_audit_roster_overlap")
def b15(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_roster_overlap(duty_clinic(spark, d)["roster"])


# ---- C: bulk changes ------------------------------------------------------

def patched(spark: SparkSession, d: str) -> changes.Patched:
    """Every order patches its customer; patches of pending orders name nobody."""
    (orders,) = read_raw(spark, d, "orders")
    base = orders_clinic(spark, d)["patient"].withColumn("allergies", F.lit(None).cast("string"))
    known = F.col("o_orderstatus") != "P"
    patches = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.when(known, F.col("o_custkey")).otherwise(-1 - F.col("o_custkey")).alias("patient_id"),
        F.when(F.col("o_orderpriority") <= "2-HIGH", F.col("o_orderpriority")).alias("plan"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus")).alias("allergies"),
    )
    return changes.patch_patients(base, patches)


@query("C1_patch_patients")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return patched(spark, d).table


@query("C1_patch_patients_not_found")
def c1_not_found(spark: SparkSession, d: str) -> DataFrame:
    return patched(spark, d).not_found


def deletions(spark: SparkSession, d: str) -> changes.Deleted:
    """Finished lines ask for their pair to be removed, the others for one that nobody performed."""
    t = orders_clinic(spark, d)
    (lineitem,) = read_raw(spark, d, "lineitem")
    part = F.col("l_partkey")
    asked = lineitem.withColumn("asked", F.when(F.col("l_linestatus") == "F", part).otherwise(-1 - part))
    requests = line_requests(asked, "asked")
    return changes.delete_performed(t["performed"], requests, t["billing"], LINE_ORDER)


@query("C2_delete_performed")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return deletions(spark, d).outcome.select("request_id", "outcome")


@query("C2_delete_performed_survivors")
def c2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return deletions(spark, d).table.select("encounter_id", "procedure_id", "minutes")


def standing_and_moves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every event asks to move the resident's slot of that time by one to three days.

    Each user is two residents: one holds the slots of the units 'signup' and
    'click' and is moved by purchases, the other holds those of all other units and is moved by
    all other events. That leaves slots to move to.
    """
    (events,) = read_raw(spark, d, "events")

    def resident(first: Column) -> Column:
        return F.when(first, F.col("resident_id")).otherwise(-1 - F.col("resident_id")).alias("resident_id")

    later = F.col("ts") + F.make_dt_interval(days=(1 + F.col("event_id") % 3).cast("int"))
    requests = roster_requests(events, to_weekday=weekday_label(later)).select(
        "request_id", resident(F.col("unit_id") == "purchase"), F.col("weekday").alias("from_weekday"),
        F.col("turn").alias("from_turn"),
        "to_weekday", F.col("turn").alias("to_turn"))
    roster = duty_clinic(spark, d)["roster"]
    standing = roster.withColumn("resident_id", resident(F.col("unit_id").isin("signup", "click")))
    return standing, requests


@query("C3_move_roster")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return changes.move_roster(*standing_and_moves(spark, d)).outcome


@query("C3_move_roster_table")
def c3_table(spark: SparkSession, d: str) -> DataFrame:
    return changes.move_roster(*standing_and_moves(spark, d)).table


@query("C3_move_roster_in_order")
def c3_in_order(spark: SparkSession, d: str) -> DataFrame:
    return changes.move_roster_in_order(*standing_and_moves(spark, d)).outcome


@query("C3_move_roster_in_order_table")
def c3_in_order_table(spark: SparkSession, d: str) -> DataFrame:
    return changes.move_roster_in_order(*standing_and_moves(spark, d)).table


def order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    (orders,) = read_raw(spark, d, "orders")
    minutes = (1 + whole("o_totalprice") % 90).cast("int")
    rows = orders.select(
        F.col("o_orderkey").alias("encounter_id"), minutes.alias("minutes"), F.col("o_custkey").alias("patient_id"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("note"), "o_orderstatus",
        "o_orderpriority")
    old = rows.where("o_orderstatus <> 'O' or o_orderpriority <> '5-LOW'")
    new = rows.where("o_orderstatus <> 'P'").withColumn(
        "minutes", F.col("minutes") + F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(0))
    columns = ("encounter_id", "minutes", "patient_id", "note")
    return old.select(*columns), new.select(*columns)


@query("C4_diff_audit")
def c4(spark: SparkSession, d: str) -> DataFrame:
    changed_at = F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    return changes.diff_audit(*order_versions(spark, d), "encounter_id", changed_at)


@query("C4_audited_fields")
def c4_fields(spark: SparkSession, d: str) -> DataFrame:
    log = changes.diff_audit(*order_versions(spark, d), "encounter_id", F.lit(ORDERS_AS_OF).cast("timestamp_ntz"))
    fields = {"minutes": "int", "patient_id": "bigint", "note": "string"}
    return changes.audited_fields(log, "encounter_id", fields).drop("audit_id", "changed_at")


@query("C5_refresh_procedure_means")
def c5(spark: SparkSession, d: str) -> DataFrame:
    t = orders_clinic(spark, d)
    return changes.refresh_procedure_means(t["procedure"], t["performed"]).select(
        "procedure_id", "name", "mean_minutes")


@query("C5_refresh_procedure_means_affected")
def c5_affected(spark: SparkSession, d: str) -> DataFrame:
    """Only the procedures started in June 1998 are refreshed; the others keep their expected minutes."""
    t = orders_clinic(spark, d)
    before = t["procedure"].withColumn("mean_minutes", F.col("expected_minutes").cast("decimal(10,2)"))
    affected = t["performed"].where("started_at >= '1998-06-01' and started_at < '1998-07-01'")
    return changes.refresh_procedure_means(before, t["performed"], affected).select("procedure_id", "mean_minutes")


@query("C5_means_from_deltas")
def c5_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The totals of executions before 1997 are kept; those of 1997 are added, a third of 1992's are removed, and the
    minutes of 1996 grow by five."""
    t = orders_clinic(spark, d)
    performed = t["performed"].select("encounter_id", "procedure_id", "minutes", F.year("started_at").alias("y"))
    kept = written(changes.procedure_totals(performed.where("y < 1997")), "procedure_totals")
    image = F.struct("procedure_id", "minutes")
    longer = F.struct("procedure_id", (F.col("minutes") + 5).alias("minutes"))
    gone = (F.col("y") == 1992) & (F.col("minutes") % 3 == 0)
    deltas = performed.where((F.col("y") == 1996) | (F.col("y") == 1997) | gone).select(
        F.when(F.col("y") != 1997, image).alias("before"),
        F.when(F.col("y") == 1997, image).when(F.col("y") == 1996, longer).alias("after"))
    return changes.means_from_totals(t["procedure"], changes.shifted_totals(kept, deltas)).select(
        "procedure_id", "mean_minutes")


def cascade(spark: SparkSession, d: str) -> changes.Cascade:
    """All orders are to be deleted as encounters; a billed line blocks its encounter."""
    t = orders_clinic(spark, d)
    (orders,) = read_raw(spark, d, "orders")
    tables = {name: t[name] for name in ("encounter", "performed", "billing")}
    return changes.delete_with_actions(tables, "encounter", orders.select(F.col("o_orderkey").alias("encounter_id")))


@query("C6_delete_with_actions")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return cascade(spark, d).outcome


@query("C6_delete_with_actions_performed")
def c6_performed(spark: SparkSession, d: str) -> DataFrame:
    return cascade(spark, d).tables["performed"].select("encounter_id", "procedure_id")


@query("C6_delete_procedures")
def c6_procedures(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalogue is to be deleted; a procedure that was performed stays."""
    t = orders_clinic(spark, d)
    tables = {name: t[name] for name in ("procedure", "performed", "billing")}
    return changes.delete_with_actions(tables, "procedure", t["procedure"]).outcome


@query("C6_delete_people")
def c6_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers are to be deleted as persons, with their roles; those in an encounter stay."""
    t = orders_clinic(spark, d)
    text = {"patient": "c", "staff": "s", "resident": "s", "supervisor": "s"}

    def own(name: str, frame: DataFrame) -> DataFrame:
        """One id of a person for both kinds of people."""
        return frame.withColumn(f"{name}_id", F.concat(F.lit(text[name]), F.col(f"{name}_id").cast("string")))

    tables = {name: own(name, t[name]) for name in ("patient", "staff")}
    staff = tables["staff"]
    for name, role in (("resident", RESIDENT), ("supervisor", SUPERVISOR)):
        tables[name] = staff.where(F.col("role") == role).select(F.col("staff_id").alias(f"{name}_id"), "role")
    person = tables["patient"].select(F.col("patient_id").alias("person_id")).unionByName(
        staff.select(F.col("staff_id").alias("person_id")))
    encounter = t["encounter"]
    for name in ("patient", "resident", "supervisor"):
        encounter = own(name, encounter)
    return changes.delete_with_actions({**tables, "person": person, "encounter": encounter}, "person", person).outcome


def role_changes(spark: SparkSession, d: str) -> changes.RoleChanges:
    """Every supplier asks to be a supervisor; those in debt have no subtype row left."""
    (supplier,) = read_raw(spark, d, "supplier")
    staff = orders_clinic(spark, d)["staff"].where("specialty <> '3'").select("staff_id", "name", "role")
    solvent = supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"))
    subtypes = {RESIDENT: solvent.where("id % 2 = 0"), SUPERVISOR: solvent.where("id % 2 = 1")}
    requests = supplier.select(
        F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("staff_id"),
        F.when(F.col("s_nationkey") == 8, "diretor").otherwise(SUPERVISOR).alias("role"))
    return changes.change_roles(staff, subtypes, requests)


@query("C7_change_roles")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return role_changes(spark, d).outcome


@query("C7_change_roles_table")
def c7_table(spark: SparkSession, d: str) -> DataFrame:
    return role_changes(spark, d).table


# ---- D: listings ----------------------------------------------------------

on_orders("D1_list_patients", listings.list_patients)
on_orders("D1_list_patients_search", listings.list_patients, search=" MER#000000_7")
on_orders("D2_list_staff", listings.list_staff)
on_orders("D2_list_staff_residents", listings.list_staff, role=RESIDENT)
on_orders("D3_list_units", listings.list_units)
on_orders("D3_list_procedures", listings.list_procedures)
on_orders("D4_recent_encounters", listings.recent_encounters, limit=50)
on_orders("D5_patient_encounters", listings.patient_encounters)
on_orders("D5_patient_encounters_by_id", listings.patient_encounters, patient_id=7)
on_orders("D6_encounter_procedures", listings.encounter_procedures)
on_orders("D7_encounter_procedures_timeline", listings.encounter_procedures_timeline)


def on_first_encounter(name: str, operator: Callable[..., DataFrame]) -> None:
    @query(name)
    def by_id(spark: SparkSession, d: str) -> DataFrame:
        t = orders_clinic(spark, d)
        (first,) = t["encounter"].agg(F.min("encounter_id")).first()
        return operator(t, encounter_id=first)


on_first_encounter("D6_encounter_procedures_by_id", listings.encounter_procedures)
on_first_encounter("D7_encounter_procedures_timeline_by_id", listings.encounter_procedures_timeline)
on_events("D8_list_roster", listings.list_roster)

# ---- E: analytics ---------------------------------------------------------

on_orders("E1_resident_ranking", analytics.resident_ranking)
on_orders("E2_mean_duration_by_resident", analytics.mean_duration_by_resident)
on_orders("E2_mean_duration_one_decimal", analytics.mean_duration_by_resident, decimals=1)
on_orders("E3_busy_supervisors", analytics.busy_supervisors, 1998, 6)
on_events("E4_shifts_per_unit", analytics.shifts_per_unit, EVENTS_AS_OF)
on_orders("E5_patients_without_high_risk", analytics.patients_without_high_risk)
on_orders("E6_mean_wait_by_unit", analytics.mean_wait_by_unit)
on_events("E7_currently_admitted", analytics.currently_admitted)
on_events("E8_residents_without_qualified_supervisor", analytics.residents_without_qualified_supervisor)
on_orders("E9_monthly_stats", analytics.monthly_stats)
on_orders("E10_supervisors_of_fans", analytics.supervisors_of_fans)
on_orders("E10_supervisors_of_fans_via_resident", analytics.supervisors_of_fans, via="resident")


@query("E11_last_encounter_by_patient")
def e11(spark: SparkSession, d: str) -> DataFrame:
    rows = analytics.last_encounter_by_patient(orders_clinic(spark, d))
    return rows.withColumn("procedures", F.array_join("procedures", "; "))


on_orders("E12_high_risk_share_by_resident", analytics.high_risk_share_by_resident)


def bucketed_clinic(spark: SparkSession, d: str) -> ChainMap:
    """Encounters and performed procedures are written in buckets of their encounter."""
    t = orders_clinic(spark, d)
    return ChainMap(write_bucketed({name: t[name] for name in ("encounter", "performed")}), t)


query("E6_mean_wait_by_unit_bucketed")(lambda spark, d: analytics.mean_wait_by_unit(bucketed_clinic(spark, d)))
query("E12_high_risk_share_by_resident_bucketed")(
    lambda spark, d: analytics.high_risk_share_by_resident(bucketed_clinic(spark, d)))


@query("E13_dashboard_kpis")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return analytics.dashboard_kpis(orders_clinic(spark, d), ORDERS_AS_OF, duty_clinic(spark, d))


# ---- F: streaming ---------------------------------------------------------

def event_stream(spark: SparkSession, d: str, **limits: int) -> DataFrame:
    return jobs.read_stream(spark, f"{d}/events.parquet", TEST_SCHEMAS["events"], **limits)


def event_changes(events: DataFrame) -> DataFrame:
    """Every event changes its user's row: sign-ups insert it, errors delete it, the rest updates it."""
    kind = F.col("event_type")
    before = F.struct(F.col("user_id"), whole("value").alias("level"))
    after = F.struct(F.col("user_id"), (whole("value") + 1).alias("level"))
    return events.select(
        F.col("event_id").alias("change_id"), F.col("user_id"), F.col("ts").alias("changed_at"),
        F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE").alias("operation"),
        F.when(kind != "signup", before).alias("before"), F.when(kind != "error", after).alias("after"),
    )


@query("F1_stream_audit")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """The stream delivers every change twice; the log holds it once."""
    twice = event_changes(event_stream(spark, d)).unionByName(event_changes(event_stream(spark, d)))
    return jobs.audit_to_table(twice, "user_id").select("user_id", "operation", "before", "after", "changed_at")


@query("F2_stream_procedure_means")
def f2(spark: SparkSession, d: str) -> DataFrame:
    """Every event is an execution; those below 10 minutes are removed again."""
    def executions(sign: int) -> DataFrame:
        return event_stream(spark, d).select(
            F.col("event_type").alias("procedure_id"), whole("value").alias("minutes"), F.lit(sign).alias("sign"))

    signed = executions(1).unionByName(executions(-1).where("minutes < 10"))
    return jobs.current_means(jobs.means_to_table(signed))


@query("F3_stream_roster")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return outcome(jobs.roster_to_table(roster_requests(event_stream(spark, d))), "request_id")


# ---- G: SQL surface -------------------------------------------------------

def both_clinics(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """One set of tables for all views: duty tables with the encounters' facts beside them."""
    orders, duty = orders_clinic(spark, d), duty_clinic(spark, d)
    facts = {name: orders[name] for name in ("encounter", "performed", "procedure")}
    units = orders["unit"].withColumn("unit_id", F.col("unit_id").cast("string"))
    facts["encounter"] = facts["encounter"].withColumn("unit_id", F.col("unit_id").cast("string"))
    return {**duty, **facts, "unit": duty["unit"].unionByName(units)}


def from_view(name: str, view: str) -> None:
    @query(name)
    def select(spark: SparkSession, d: str) -> DataFrame:
        register_views(both_clinics(spark, d))
        surface.register_views(spark)
        return spark.sql(f"SELECT * FROM {view}")


from_view("G1_view_currently_admitted", "currently_admitted")
from_view("G1_view_residents_without_qualified_supervisor", "residents_without_qualified_supervisor")
from_view("G1_view_monthly_stats", "monthly_stats")


@query("G2_function_mean_wait_by_unit")
def g2(spark: SparkSession, d: str) -> DataFrame:
    register_views(orders_clinic(spark, d))
    (function,) = surface.register_functions(spark)
    return spark.sql(f"SELECT * FROM {function}()")


@query("G3_run_named")
def g3(spark: SparkSession, d: str) -> DataFrame:
    register_views(orders_clinic(spark, d))
    return surface.run_named(spark, "busy_supervisors", year=1998, month=6, min_count=5)
