"""The hospital data model: tables, types, keys, references and rules.

Everything the audits, the ingest and the deletes need to know about a table is
declared here once. Files keep the column names of the hospital database
(``Column.stored``); the operators work on the English names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The labels stored in the hospital's data. Order is meaningful,
# these are ordered enumerations.
ROLES = ("residente", "preceptor")
RESIDENCY_YEARS = ("R1", "R2", "R3")
WEEKDAYS = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")
TURNS = ("manha", "tarde", "noite")
RISKS = ("BAIXO", "MEDIO", "ALTO")
BLOOD_GROUPS = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
UNIT_KINDS = ("Enfermaria", "UTI", "Pronto-Socorro", "Ambulatorio")
AUDIT_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
DOCTOR_TITLES = ("doutor", "doutora")
RESIDENT, SUPERVISOR = ROLES
LOW_RISK, HIGH_RISK = "BAIXO", "ALTO"

CASCADE, RESTRICT = "cascade", "restrict"

Rule = Callable[[date], SparkColumn]


@dataclass(frozen=True)
class Column:
    """One column: working name, name in the files, type, whether it is mandatory."""

    name: str
    stored: str
    type: T.DataType
    required: bool = True
    max_length: int | None = None


@dataclass(frozen=True)
class Reference:
    """A foreign key to another table and what a delete of the parent does."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = RESTRICT


@dataclass(frozen=True)
class Table:
    name: str
    stored: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    defaults: dict[str, Rule] = field(default_factory=dict)

    def stored_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.stored, c.type, True) for c in self.columns])

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])

    def required_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    def checks(self, as_of: date) -> dict[str, SparkColumn]:
        """Every row rule as a boolean column: the declared ones and the text lengths."""
        rules = {name: rule(as_of) for name, rule in self.rules.items()}
        for c in self.columns:
            if c.max_length:
                rules[f"{c.name}_length"] = F.length(c.name) <= c.max_length
        return rules


_text, _int, _date, _bool = T.StringType(), T.IntegerType(), T.DateType(), T.BooleanType()
_instant, _money = T.TimestampNTZType(), T.DecimalType(10, 2)


def _at_least_one(column: str) -> Rule:
    return lambda as_of: F.col(column) > 0


def _of_person(column: str) -> tuple[Reference, ...]:
    return (Reference((column,), "person", ("person_id",), CASCADE),)


def _to(*parents: str) -> tuple[Reference, ...]:
    return tuple(Reference((f"{p}_id",), p, (f"{p}_id",)) for p in parents)


PERSON = Table(
    "person", "pessoa",
    (
        Column("person_id", "id_pessoa", _text),
        Column("name", "nome", _text, max_length=150),
        Column("cpf", "cpf", _text),
        Column("birth_date", "data_nascimento", _date),
        Column("is_fan", "is_flamengo", _bool),
        Column("phone", "telefone", _text, required=False, max_length=20),
    ),
    key=("person_id",),
    unique=(("cpf",),),
    rules={
        "cpf_has_11_characters": lambda as_of: F.length("cpf") == 11,
        "cpf_is_numeric": lambda as_of: F.col("cpf").rlike("^[0-9]{11}$"),
        "birth_date_not_in_future": lambda as_of: F.col("birth_date") <= F.lit(as_of),
    },
    defaults={"is_fan": lambda as_of: F.lit(True)},
)

PATIENT = Table(
    "patient", "paciente",
    (
        Column("patient_id", "id_pessoa", _text),
        Column("plan", "num_convenio", _text, required=False, max_length=50),
        Column("allergies", "alergias", _text, required=False),
        Column("blood_group", "grupo_sanguineo", _text, required=False),
    ),
    key=("patient_id",),
    references=_of_person("patient_id"),
    domains={"blood_group": BLOOD_GROUPS},
)

STAFF = Table(
    "staff", "profissional",
    (
        Column("staff_id", "id_pessoa", _text),
        Column("crm", "crm", _text, max_length=20),
        Column("hired_on", "data_admissao", _date),
        Column("specialty", "especialidade", _text, max_length=100),
        Column("role", "papel_atual", _text),
    ),
    key=("staff_id",),
    unique=(("crm",), ("staff_id", "role")),
    references=_of_person("staff_id"),
    domains={"role": ROLES},
)

SUPERVISOR_TABLE = Table(
    "supervisor", "preceptor",
    (
        Column("supervisor_id", "id_pessoa", _text),
        Column("role", "papel", _text),
        Column("title", "titulacao", _text, max_length=50),
    ),
    key=("supervisor_id",),
    references=(Reference(("supervisor_id", "role"), "staff", ("staff_id", "role"), CASCADE),),
    domains={"role": (SUPERVISOR,)},
    defaults={"role": lambda as_of: F.lit(SUPERVISOR)},
)

RESIDENT_TABLE = Table(
    "resident", "residente",
    (
        Column("resident_id", "id_pessoa", _text),
        Column("role", "papel", _text),
        Column("year", "ano_residencia", _text),
    ),
    key=("resident_id",),
    references=(Reference(("resident_id", "role"), "staff", ("staff_id", "role"), CASCADE),),
    domains={"role": (RESIDENT,), "year": RESIDENCY_YEARS},
    defaults={"role": lambda as_of: F.lit(RESIDENT)},
)

UNIT = Table(
    "unit", "unidade",
    (
        Column("unit_id", "id_unidade", _text),
        Column("name", "nome", _text, max_length=100),
        Column("kind", "tipo", _text),
        Column("beds", "capacidade_leitos", _int),
    ),
    key=("unit_id",),
    domains={"kind": UNIT_KINDS},
    rules={"beds_positive": _at_least_one("beds")},
)

PROCEDURE = Table(
    "procedure", "procedimento",
    (
        Column("procedure_id", "id_procedimento", _text),
        Column("code", "codigo", _text, max_length=20),
        Column("name", "nome", _text, max_length=100),
        Column("expected_minutes", "tempo_medio_minutos", _int),
        Column("risk", "nivel_risco", _text),
        Column("mean_minutes", "media_tempo_procedimento", _money, required=False),
    ),
    key=("procedure_id",),
    unique=(("code",),),
    domains={"risk": RISKS},
    rules={"expected_minutes_positive": _at_least_one("expected_minutes")},
    defaults={"risk": lambda as_of: F.lit(LOW_RISK)},
)

ENCOUNTER = Table(
    "encounter", "atendimento",
    (
        Column("encounter_id", "id_atendimento", _text),
        Column("started_at", "data_hora", _instant),
        Column("minutes", "duracao_minutos", _int),
        Column("patient_id", "id_paciente", _text),
        Column("resident_id", "id_residente", _text),
        Column("supervisor_id", "id_preceptor", _text),
        Column("unit_id", "id_unidade", _text),
    ),
    key=("encounter_id",),
    references=_to("patient", "resident", "supervisor", "unit"),
    rules={"minutes_positive": _at_least_one("minutes")},
)

PERFORMED = Table(
    "performed", "procedimento_realizado",
    (
        Column("encounter_id", "id_atendimento", _text),
        Column("procedure_id", "id_procedimento", _text),
        Column("quantity", "quantidade", _int),
        Column("minutes", "tempo_real_minutos", _int),
        Column("started_at", "data_hora_inicio", _instant),
        Column("note", "observacao", _text, required=False),
    ),
    key=("encounter_id", "procedure_id"),
    references=(
        Reference(("encounter_id",), "encounter", ("encounter_id",), CASCADE),
        Reference(("procedure_id",), "procedure", ("procedure_id",)),
    ),
    rules={"quantity_positive": _at_least_one("quantity"), "minutes_positive": _at_least_one("minutes")},
)

ROSTER = Table(
    "roster", "escala",
    (
        Column("roster_id", "id_escala", _text),
        Column("unit_id", "id_unidade", _text),
        Column("weekday", "dia_semana", _text),
        Column("turn", "turno", _text),
        Column("resident_id", "id_residente", _text),
        Column("supervisor_id", "id_preceptor", _text),
    ),
    key=("roster_id",),
    unique=(("unit_id", "weekday", "turn", "resident_id"),),
    references=_to("unit", "resident", "supervisor"),
    domains={"weekday": WEEKDAYS, "turn": TURNS},
)

BILLING = Table(
    "billing", "faturamento",
    (
        Column("billing_id", "id_faturamento", _text),
        Column("encounter_id", "id_atendimento", _text),
        Column("procedure_id", "id_procedimento", _text),
        Column("amount", "valor", _money),
        Column("issued_on", "data_emissao", _date),
    ),
    key=("billing_id",),
    unique=(("encounter_id", "procedure_id"),),
    references=(Reference(("encounter_id", "procedure_id"), "performed", ("encounter_id", "procedure_id")),),
    rules={"amount_positive": _at_least_one("amount")},
    defaults={"issued_on": lambda as_of: F.lit(as_of)},
)

ENCOUNTER_AUDIT = Table(
    "encounter_audit", "auditoria_atendimento",
    (
        Column("audit_id", "id_auditoria", _text),
        Column("encounter_id", "id_atendimento", _text),
        Column("operation", "operacao", _text),
        Column("before", "dados_antigos", _text, required=False),
        Column("after", "dados_novos", _text, required=False),
        Column("changed_at", "alterado_em", _instant),
    ),
    key=("audit_id",),
    domains={"operation": AUDIT_OPERATIONS},
)

STAY = Table(
    "stay", "internacao",
    (
        Column("stay_id", "id_internacao", _text),
        Column("patient_id", "id_paciente", _text),
        Column("unit_id", "id_unidade", _text),
        Column("entered_at", "data_hora_entrada", _instant),
        Column("left_at", "data_hora_saida", _instant, required=False),
        Column("reason", "motivo", _text, required=False),
    ),
    key=("stay_id",),
    references=_to("patient", "unit"),
    rules={"left_after_entered": lambda as_of: F.col("left_at").isNull() | (F.col("left_at") >= F.col("entered_at"))},
)

# In dependency order: a parent always comes before its children.
HOSPITAL: dict[str, Table] = {
    t.name: t
    for t in (
        PERSON, PATIENT, STAFF, SUPERVISOR_TABLE, RESIDENT_TABLE, PROCEDURE, UNIT,
        ENCOUNTER, PERFORMED, ROSTER, BILLING, ENCOUNTER_AUDIT, STAY,
    )
}

# Facts that reports read by month: kept in monthly folders, by this column, so that a month's report opens only
# that month's files.
MONTHLY = {"encounter": "started_at", "billing": "issued_on"}
