"""A small invented hospital. What happens in it follows from the numbers of its encounters."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from wardbook.model import HOSPITAL

START = dt.datetime(2025, 5, 28, 7)
PATIENTS = ("Ilse Brandt", "Tomás Quiroga", "Wanda Okoye", "Piet Verhoeven", "Noor Haddad", "Sven Lindqvist")
SUPERVISORS = (("Amina Farouk", "Doutora"), ("Colin Mercer", "Mestre"), ("Greta Holm", " doutor "),
               ("Rafael Prado", "Mestre"), ("Uma Castellan", "Especialista"))
RESIDENTS = (("Bea Novak", "R1"), ("Cem Yildiz", "R3"), ("Dora Kim", "R2"), ("Emil Sato", "R1"), ("Fay Osei", "R2"),
             ("Gus Moreau", "R3"))
UNITS = (("Harbour Ward", "Enfermaria", 18), ("Lighthouse", "UTI", 6), ("Quay Entrance", "Pronto-Socorro", 9))
PROCEDURES = (("Splint", "ALTO"), ("Blood count", "BAIXO"), ("Infusion", "MEDIO"), ("Ultrasound", "BAIXO"),
              ("Biopsy", "ALTO"), ("Cast", "MEDIO"), ("Eye test", "BAIXO"), ("Allergy test", "MEDIO"), ("Dialysis", "ALTO"))
BLOOD = ("A-", "O+", "B+", "AB-", "O-", "A+")
N_ENCOUNTERS = 21


def _person(key: str, i: int, name: str, number: int) -> tuple:
    return (f"{key}-{i}", name, f"1000000{number:04d}", dt.date(1950 + 2 * number, 1 + i, 3 * i), number % 3 > 0,
            f"555-{number:04d}")


def _encounter(i: int) -> tuple:
    return (f"encounter-{i}", START + i * dt.timedelta(hours=19), 20 + 7 * i % 41, f"patient-{1 + 2 * i % 5}",
            f"resident-{1 + 3 * i % 5}", f"supervisor-{1 + i // 2 % 3}", f"unit-{1 + i % 3}")


def _performed(i: int) -> list[tuple]:
    start, minutes = _encounter(i)[1], 6 + 5 * i % 17
    first = (f"encounter-{i}", f"procedure-{1 + (i - 1) % 8}", 2 if i == 10 else 1, minutes,
             start + dt.timedelta(minutes=3 + i % 4), None)
    second = (f"encounter-{i}", f"procedure-{1 + i % 8}", 1, minutes + 4, start + dt.timedelta(minutes=12), "as well")
    return [first, second] if i <= 2 or i % 4 == 0 else [first]


def _staff(key: str, role: str, people: tuple, number: int) -> list[tuple]:
    return [(f"{key}-{i}", f"CRM {number + i}", dt.date(2015 + i, 2, 1), f"specialty {i}", role)
            for i in range(1, len(people) + 1)]


def plain() -> dict[str, list[tuple]]:
    """The rows of every table, columns as in the model."""
    numbers = range(1, N_ENCOUNTERS + 1)
    return {
        "person": [_person("patient", i, n, i) for i, n in enumerate(PATIENTS, 1)]
                  + [_person("supervisor", i, n, 10 + i) for i, (n, _) in enumerate(SUPERVISORS, 1)]
                  + [_person("resident", i, n, 20 + i) for i, (n, _) in enumerate(RESIDENTS, 1)],
        "patient": [(f"patient-{i}", f"plan {i}", None if i % 2 else "latex", b) for i, b in enumerate(BLOOD, 1)],
        "staff": _staff("supervisor", "preceptor", SUPERVISORS, 100) + _staff("resident", "residente", RESIDENTS, 200),
        "supervisor": [(f"supervisor-{i}", "preceptor", title) for i, (_, title) in enumerate(SUPERVISORS, 1)],
        "resident": [(f"resident-{i}", "residente", year) for i, (_, year) in enumerate(RESIDENTS, 1)],
        "unit": [(f"unit-{i}", *u) for i, u in enumerate(UNITS, 1)],
        "procedure": [(f"procedure-{i}", f"P{i}", name, 5 + 3 * i, risk, None)
                      for i, (name, risk) in enumerate(PROCEDURES, 1)],
        "encounter": [_encounter(i) for i in numbers],
        "performed": [row for i in numbers for row in _performed(i)],
        "roster": [
            ("1", "unit-1", "terca", "tarde", "resident-1", "supervisor-1"),
            ("2", "unit-2", "sabado", "manha", "resident-1", "supervisor-2"),
            ("3", "unit-1", "terca", "tarde", "resident-2", "supervisor-1"),
            ("4", "unit-2", "quinta", "manha", "resident-2", "supervisor-2"),
            ("5", "unit-3", "quarta", "noite", "resident-3", "supervisor-3"),
            ("6", "unit-3", "domingo", "manha", "resident-3", "supervisor-1"),
            ("7", "unit-3", "sexta", "noite", "resident-4", "supervisor-2"),
            ("8", "unit-2", "segunda", "tarde", "resident-5", "supervisor-3"),
            ("9", "unit-2", "domingo", "tarde", "resident-5", "supervisor-3"),
        ],
        "billing": [
            ("1", "encounter-2", "procedure-2", Decimal("95.50"), dt.date(2025, 6, 2)),
            ("2", "encounter-5", "procedure-5", Decimal("310.00"), dt.date(2025, 5, 20)),
            ("3", "encounter-12", "procedure-4", Decimal("640.25"), dt.date(2025, 6, 30)),
        ],
        "encounter_audit": [],
        "stay": [
            ("1", "patient-1", "unit-2", dt.datetime(2025, 5, 30, 22), None, "observation"),
            ("2", "patient-3", "unit-1", dt.datetime(2025, 6, 1, 9), dt.datetime(2025, 6, 4, 10), "done"),
            ("3", "patient-3", "unit-2", dt.datetime(2025, 6, 7, 18), None, "back again"),
            ("4", "patient-2", "unit-3", dt.datetime(2025, 6, 8, 1), dt.datetime(2025, 6, 8, 6), "one night"),
        ],
    }


def records(name: str) -> list[dict]:
    columns = [c.name for c in HOSPITAL[name].columns]
    return [dict(zip(columns, row, strict=True)) for row in plain()[name]]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    rows = plain()
    return {name: spark.createDataFrame(rows[name], table.schema()) for name, table in HOSPITAL.items()}
