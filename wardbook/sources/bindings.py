"""The hospital model read from the driver's retail-like test tables.

Two bindings exist because no single test table carries all concepts:
``orders_clinic`` (encounters are orders, performed procedures are line items)
and ``duty_clinic`` (duty rosters and stays come from events). Both return
frames with the model's English column names, so every operator runs on them
unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardbook.functions import weekday_label
from wardbook.functions.frames import written
from wardbook.model import RESIDENT, SUPERVISOR, TURNS
from wardbook.sources.load import load_tables

_types = {
    "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "text": T.StringType(),
    "instant": T.TimestampNTZType(), "floats": T.ArrayType(T.FloatType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _types[kind]) for name, kind in columns.items()])


TEST_SCHEMAS = {
    "region": _schema(r_regionkey="int", r_name="text"),
    "nation": _schema(n_nationkey="int", n_name="text", n_regionkey="int"),
    "customer": _schema(c_custkey="long", c_name="text", c_nationkey="int", c_acctbal="double", c_mktsegment="text"),
    "supplier": _schema(s_suppkey="long", s_name="text", s_nationkey="int", s_acctbal="double"),
    "part": _schema(p_partkey="long", p_name="text", p_brand="text", p_type="text", p_size="int",
                    p_retailprice="double"),
    "orders": _schema(o_orderkey="long", o_custkey="long", o_orderstatus="text", o_totalprice="double",
                      o_orderdate="instant", o_orderpriority="text"),
    "lineitem": _schema(l_orderkey="long", l_partkey="long", l_suppkey="long", l_linenumber="int",
                        l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double",
                        l_returnflag="text", l_linestatus="text", l_shipdate="instant"),
    "events": _schema(event_id="long", ts="instant", user_id="long", event_type="text", value="double", props="text"),
    "documents": _schema(doc_id="long", text="text", lang="text", source="text", n_chars="long"),
    "embeddings": _schema(vec_id="long", embedding="floats", label="int"),
    "pages": _schema(page_id="long", url="text", html="text"),
    "benchmark": _schema(item_id="long", text="text"),
    "labels": _schema(doc_id="long", quality="int", toxic="int"),
    "conversations": _schema(conv_id="long", turn="long", role="text", text="text"),
}


def read_raw(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    raw = load_tables(spark, directory, {n: TEST_SCHEMAS[n] for n in names}, register=False)
    return [raw[n] for n in names]


def whole(column: str) -> Column:
    return F.floor(F.col(column))


def lead_staff(lineitem: DataFrame) -> DataFrame:
    """Per order the lowest even and the lowest odd supplier key; NULL when it has none."""
    key = F.col("l_suppkey")
    return lineitem.groupBy(F.col("l_orderkey").alias("encounter_id")).agg(
        F.min(F.when(key % 2 == 0, key)).alias("resident_id"),
        F.min(F.when(key % 2 == 1, key)).alias("supervisor_id"),
    )


def with_both(orders: DataFrame) -> DataFrame:
    return orders.where("resident_id is not null and supervisor_id is not null")


def encounter_requests(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Every order as an encounter; resident or supervisor stay NULL where no line names one."""
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("encounter_id"),
            F.col("o_orderdate").alias("started_at"),
            whole("o_totalprice").alias("price"),
            F.col("o_custkey").alias("patient_id"),
            F.col("c_nationkey").alias("unit_id"),
        )
        .join(lead_staff(lineitem), "encounter_id", "left")
    )


def performed_lines(lineitem: DataFrame) -> DataFrame:
    """The first line of every (order, part) pair."""
    first = F.min(F.struct(
        "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag",
    )).alias("line")
    return (
        lineitem.groupBy(F.col("l_orderkey").alias("encounter_id"), F.col("l_partkey").alias("procedure_id"))
        .agg(first)
        .select(
            "encounter_id", "procedure_id",
            F.col("line.l_quantity").cast("int").alias("quantity"),
            (1 + F.floor("line.l_extendedprice") % 60).cast("int").alias("minutes"),
            F.col("line.l_shipdate").alias("started_at"),
            F.col("line.l_extendedprice").cast("decimal(10,2)").alias("amount"),
            F.col("line.l_returnflag").alias("flag"),
        )
    )


def risk_of(size: str) -> Column:
    return F.when(F.col(size) <= 16, "BAIXO").when(F.col(size) <= 33, "MEDIO").otherwise("ALTO")


class Clinic(Mapping):
    """Tables built when they are first asked for: a query pays only for what it reads."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def orders_clinic(spark: SparkSession, directory: str, keep: bool = False) -> Clinic:
    """Patients are customers, staff are suppliers, encounters orders, procedures parts.

    With ``keep`` the facts are derived once and written to the shared folder, for queries that read them many times.
    """

    def kept(df: DataFrame, job: str) -> DataFrame:
        return written(df, job) if keep else df

    def raw(name: str) -> DataFrame:
        return read_raw(spark, directory, name)[0]

    def patient() -> DataFrame:
        return raw("customer").select(
            F.col("c_custkey").alias("patient_id"),
            F.col("c_name").alias("name"),
            F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("cpf"),
            F.col("c_mktsegment").alias("plan"),
            (F.col("c_mktsegment") == "BUILDING").alias("is_fan"),
        )

    def staff() -> DataFrame:
        return raw("supplier").select(
            F.col("s_suppkey").alias("staff_id"),
            F.col("s_name").alias("name"),
            F.lpad(F.col("s_suppkey").cast("string"), 11, "0").alias("cpf"),
            F.concat(F.lit("CRM "), F.col("s_suppkey")).alias("crm"),
            F.col("s_nationkey").cast("string").alias("specialty"),
            F.when(F.col("s_suppkey") % 2 == 0, RESIDENT).otherwise(SUPERVISOR).alias("role"),
        )

    def resident() -> DataFrame:
        return clinic["staff"].where(F.col("role") == RESIDENT).select(
            F.col("staff_id").alias("resident_id"), "name", "specialty",
            F.concat(F.lit("R"), 1 + F.col("staff_id") % 3).alias("year"),
        )

    def supervisor() -> DataFrame:
        return clinic["staff"].where(F.col("role") == SUPERVISOR).select(
            F.col("staff_id").alias("supervisor_id"), "name", "specialty",
            F.when(F.col("staff_id") % 3 == 0, " Doutor ")
            .when(F.col("staff_id") % 3 == 1, "Mestre").otherwise("Especialista").alias("title"),
        )

    def unit() -> DataFrame:
        return raw("nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"))

    def procedure() -> DataFrame:
        return raw("part").select(
            F.col("p_partkey").alias("procedure_id"),
            F.col("p_brand").alias("code"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("expected_minutes"),
            risk_of("p_size").alias("risk"),
        )

    def encounter() -> DataFrame:
        return kept(
            encounter_requests(*read_raw(spark, directory, "orders", "customer", "lineitem"))
            .transform(with_both)
            .select("encounter_id", "started_at", (1 + F.col("price") % 90).cast("int").alias("minutes"),
                    "patient_id", "resident_id", "supervisor_id", "unit_id"), "encounter")

    @cache
    def lines() -> DataFrame:
        # Every line's order exists and every order's customer does, so the lines of
        # an encounter are those of an order with both kinds of staff. Lines are dealt out by
        # order once: the window, the aggregate by pair and its filter need no other exchange.
        of_order, key = Window.partitionBy("l_orderkey"), F.col("l_suppkey")
        staffed = raw("lineitem").where("l_orderkey is not null").withColumns({
            "even": F.max(key % 2 == 0).over(of_order), "odd": F.max(key % 2 == 1).over(of_order)})
        return kept(performed_lines(staffed.where("even and odd")), "lines")

    def performed() -> DataFrame:
        return lines().drop("amount", "flag")

    def billing() -> DataFrame:
        return lines().where("flag = 'R'").select(
            F.concat_ws("-", "encounter_id", "procedure_id").alias("billing_id"),
            "encounter_id", "procedure_id", "amount", F.col("started_at").cast("date").alias("issued_on"),
        )

    builders = (patient, staff, resident, supervisor, unit, procedure, encounter, performed, billing)
    clinic = Clinic({build.__name__: build for build in builders})
    return clinic


def roster_requests(events: DataFrame, **more: Column) -> DataFrame:
    """Every event asks for a place on the roster; the event id is its order of arrival."""
    turn = F.element_at(F.array(*map(F.lit, TURNS)), (F.floor(F.hour("ts") / 8) + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("unit_id"),
        weekday_label("ts").alias("weekday"),
        turn.alias("turn"),
        F.col("user_id").alias("resident_id"),
        (2 * (F.col("event_id") % 5) + 1).alias("supervisor_id"),
        *(column.alias(name) for name, column in more.items()),
    )


def first_slots(requests: DataFrame) -> DataFrame:
    """The roster left by the requests when only exact repeats are refused."""
    return (
        requests.groupBy("unit_id", "weekday", "turn", "resident_id")
        .agg(F.min("request_id").alias("roster_id"))
        .withColumn("supervisor_id", 2 * (F.col("roster_id") % 5) + 1)
    )


def duty_clinic(spark: SparkSession, directory: str) -> Clinic:
    """Rosters and stays from events, with their own residents, patients and units."""

    def events() -> DataFrame:
        return read_raw(spark, directory, "events")[0]

    def resident() -> DataFrame:
        return events().select("user_id").distinct().select(
            F.col("user_id").alias("resident_id"),
            F.concat(F.lit("Resident#"), "user_id").alias("name"),
            F.concat(F.lit("R"), 1 + F.col("user_id") % 3).alias("year"),
        )

    def patient() -> DataFrame:
        return events().select("user_id").distinct().select(
            F.col("user_id").alias("patient_id"), F.concat(F.lit("Patient#"), "user_id").alias("name"))

    def unit() -> DataFrame:
        return events().select(F.col("event_type").alias("unit_id")).distinct().withColumn("name", F.col("unit_id"))

    def supervisor() -> DataFrame:
        return orders_clinic(spark, directory)["supervisor"]

    def stay() -> DataFrame:
        length = F.make_dt_interval(mins=F.floor("value").cast("int"))
        return events().select(
            F.col("event_id").alias("stay_id"),
            F.col("user_id").alias("patient_id"),
            F.col("event_type").alias("unit_id"),
            F.col("ts").alias("entered_at"),
            F.when(F.col("event_type") != "error", F.col("ts") + length).alias("left_at"),
            F.col("props").alias("reason"),
        )

    def requests() -> DataFrame:
        return roster_requests(events())

    def roster() -> DataFrame:
        return first_slots(requests())

    builders = (resident, patient, unit, supervisor, stay, requests, roster)
    return Clinic({build.__name__: build for build in builders})
