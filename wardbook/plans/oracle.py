"""The registered queries as plain SQL over the same test tables, for cross-checking.

Written independently of the operators: rows are ranked with windows, existence
is tested with subqueries. ``BINDINGS`` restates the binding of the hospital
model to the test tables.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong label in the engine shows.
WEEKDAYS = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")
TURNS = ("manha", "tarde", "noite")


def _list(labels: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in labels) + "]"


def mean(total: str, n: str, decimals: int = 2) -> str:
    """total / n rounded half away from zero, in integers."""
    scale = 10 ** decimals
    return f"CAST(sign({total}) * ((2 * {scale} * abs({total}) + {n}) // (2 * {n})) AS DOUBLE) / {scale}"


BINDINGS = f"""
WITH lead_staff AS (
    SELECT l_orderkey AS encounter_id,
           min(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END) AS resident_id,
           min(CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey END) AS supervisor_id
    FROM lineitem GROUP BY l_orderkey
), encounter_request AS (
    SELECT o_orderkey AS encounter_id, o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS price,
           o_custkey AS patient_id, c_nationkey AS unit_id, resident_id, supervisor_id
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lead_staff ON encounter_id = o_orderkey
), encounter AS (
    SELECT encounter_id, started_at, CAST(1 + price % 90 AS INTEGER) AS minutes, patient_id, resident_id,
           supervisor_id, unit_id
    FROM encounter_request WHERE resident_id IS NOT NULL AND supervisor_id IS NOT NULL
), patient AS (
    SELECT c_custkey AS patient_id, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf,
           c_mktsegment AS plan, c_mktsegment = 'BUILDING' AS is_fan
    FROM customer
), staff AS (
    SELECT s_suppkey AS staff_id, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS cpf,
           'CRM ' || s_suppkey AS crm, CAST(s_nationkey AS VARCHAR) AS specialty,
           CASE WHEN s_suppkey % 2 = 0 THEN 'residente' ELSE 'preceptor' END AS role
    FROM supplier
), resident AS (
    SELECT staff_id AS resident_id, name, specialty, 'R' || (1 + staff_id % 3) AS year
    FROM staff WHERE role = 'residente'
), supervisor AS (
    SELECT staff_id AS supervisor_id, name,
           CASE staff_id % 3 WHEN 0 THEN ' Doutor ' WHEN 1 THEN 'Mestre' ELSE 'Especialista' END AS title
    FROM staff WHERE role = 'preceptor'
), unit AS (
    SELECT n_nationkey AS unit_id, n_name AS name FROM nation
), proc AS (
    SELECT p_partkey AS procedure_id, p_brand AS code, p_name AS name, p_size AS expected_minutes,
           CASE WHEN p_size <= 16 THEN 'BAIXO' WHEN p_size <= 33 THEN 'MEDIO' ELSE 'ALTO' END AS risk
    FROM part
), line AS (
    SELECT l_orderkey AS encounter_id, l_partkey AS procedure_id, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(1 + CAST(floor(l_extendedprice) AS BIGINT) % 60 AS INTEGER) AS minutes, l_shipdate AS started_at,
           CAST(l_extendedprice AS DECIMAL(10,2)) AS amount, l_returnflag AS flag
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey,
                 l_shipdate, l_quantity, l_extendedprice, l_returnflag) AS place FROM lineitem)
    WHERE place = 1
), performed AS (
    SELECT * FROM line WHERE encounter_id IN (SELECT encounter_id FROM encounter)
), billing AS (
    SELECT encounter_id, procedure_id, amount, CAST(started_at AS DATE) AS issued_on FROM performed WHERE flag = 'R'
), request AS (
    SELECT event_id AS request_id, event_type AS unit_id, ({_list(WEEKDAYS)})[isodow(ts)] AS weekday,
           ({_list(TURNS)})[hour(ts) // 8 + 1] AS turn, user_id AS resident_id,
           2 * (event_id % 5) + 1 AS supervisor_id, ts
    FROM events
), roster AS (
    SELECT request_id AS roster_id, unit_id, weekday, turn, resident_id, supervisor_id
    FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, weekday, turn, resident_id ORDER BY request_id) AS place
          FROM request)
    WHERE place = 1
), duty_resident AS (
    SELECT DISTINCT user_id AS resident_id, 'Resident#' || user_id AS name, 'R' || (1 + user_id % 3) AS year FROM events
), duty_patient AS (
    SELECT DISTINCT user_id AS patient_id, 'Patient#' || user_id AS name FROM events
), stay AS (
    SELECT event_id AS stay_id, user_id AS patient_id, event_type AS unit_id, ts AS entered_at,
           CASE WHEN event_type <> 'error' THEN ts + to_minutes(CAST(floor(value) AS BIGINT)) END AS left_at,
           props AS reason
    FROM events
), admitted AS (
    SELECT s.patient_id, p.name AS patient, s.unit_id AS unit, s.entered_at, s.reason
    FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY entered_at DESC, stay_id DESC) AS place
          FROM stay) s
    JOIN duty_patient p ON p.patient_id = s.patient_id
    WHERE s.place = 1 AND s.left_at IS NULL
), unqualified AS (
    SELECT DISTINCT r.resident_id, d.name AS resident, d.year, r.unit_id AS unit, r.weekday, r.turn,
           s.name AS supervisor, s.title
    FROM roster r JOIN duty_resident d ON d.resident_id = r.resident_id
    JOIN supervisor s ON s.supervisor_id = r.supervisor_id
    WHERE lower(trim(s.title)) NOT IN ('doutor', 'doutora')
), never_high_risk AS (
    SELECT patient_id, name AS patient, plan FROM patient p
    WHERE NOT EXISTS (
        SELECT 1 FROM encounter e JOIN performed x ON x.encounter_id = e.encounter_id
        JOIN proc c ON c.procedure_id = x.procedure_id
        WHERE e.patient_id = p.patient_id AND c.risk = 'ALTO')
), busy AS (
    SELECT s.name AS supervisor, count(*) AS encounters
    FROM encounter e JOIN supervisor s ON s.supervisor_id = e.supervisor_id
    WHERE year(e.started_at) = 1998 AND month(e.started_at) = 6
    GROUP BY s.name HAVING count(*) > 5
), by_resident AS (
    SELECT r.resident_id, r.name AS resident, r.specialty, r.year, count(e.encounter_id) AS encounters,
           sum(e.minutes) AS total
    FROM resident r LEFT JOIN encounter e ON e.resident_id = r.resident_id
    GROUP BY r.resident_id, r.name, r.specialty, r.year
), waits AS (
    SELECT u.unit_id, u.name AS unit, count(*) AS measured,
           {mean("sum(epoch_us(f.first_at) - epoch_us(e.started_at))", "(count(*) * 60000000)")} AS mean_wait_minutes
    FROM (SELECT encounter_id, min(started_at) AS first_at FROM performed GROUP BY encounter_id) f
    JOIN encounter e ON e.encounter_id = f.encounter_id JOIN unit u ON u.unit_id = e.unit_id
    GROUP BY u.unit_id, u.name
), monthly AS (
    SELECT s.month, u.name AS unit, s.encounters, s.mean_minutes, c.name AS most_common_procedure
    FROM (SELECT CAST(date_trunc('month', started_at) AS DATE) AS month, unit_id, count(*) AS encounters,
                 {mean("sum(minutes)", "count(*)")} AS mean_minutes
          FROM encounter GROUP BY 1, 2) s
    JOIN unit u ON u.unit_id = s.unit_id
    LEFT JOIN (
        SELECT month, unit_id, name,
               row_number() OVER (PARTITION BY month, unit_id ORDER BY n DESC, name) AS place
        FROM (SELECT CAST(date_trunc('month', e.started_at) AS DATE) AS month, e.unit_id, c.name, count(*) AS n
              FROM encounter e JOIN performed x ON x.encounter_id = e.encounter_id
              JOIN proc c ON c.procedure_id = x.procedure_id GROUP BY 1, 2, 3)
    ) c ON c.month = s.month AND c.unit_id = s.unit_id AND c.place = 1
), detail AS (
    SELECT x.encounter_id, x.procedure_id, c.name AS procedure, c.risk, x.quantity, x.minutes, x.started_at,
           b.amount IS NOT NULL AS billed, CAST(b.amount AS DOUBLE) AS amount
    FROM performed x JOIN proc c ON c.procedure_id = x.procedure_id
    LEFT JOIN billing b ON b.encounter_id = x.encounter_id AND b.procedure_id = x.procedure_id
), encounter_names AS (
    SELECT e.*, p.name AS patient, r.name AS resident, s.name AS supervisor, u.name AS unit
    FROM encounter e JOIN patient p ON p.patient_id = e.patient_id JOIN resident r ON r.resident_id = e.resident_id
    JOIN supervisor s ON s.supervisor_id = e.supervisor_id JOIN unit u ON u.unit_id = e.unit_id
), line_request AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id, l_orderkey AS encounter_id,
           l_partkey AS procedure_id, l_linenumber AS line, l_suppkey AS supplier, l_extendedprice AS price,
           CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) ELSE 1 END AS quantity,
           CAST(floor(l_extendedprice) AS BIGINT) % 240 AS minutes,
           CASE WHEN l_discount > 0 THEN l_extendedprice ELSE 0 END AS amount, l_linestatus AS status
    FROM lineitem
), registration AS (
    SELECT 'p' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS request_id, 'paciente' AS kind, c_name AS name,
           CASE WHEN c_nationkey <> 3 THEN '1' || lpad(CAST(c_custkey // 2 AS VARCHAR), 10, '0') END AS cpf,
           c_nationkey = 4 AS bad_date, c_mktsegment AS plan, c_mktsegment = 'MACHINERY' AS bad_blood,
           NULL AS crm, NULL AS year, NULL AS title
    FROM customer
    UNION ALL
    SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0'),
           CASE WHEN s_nationkey = 6 THEN 'visitante' WHEN s_suppkey % 2 = 1 THEN 'preceptor' ELSE 'residente' END,
           s_name, '2' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), FALSE, NULL, FALSE,
           'CRM ' || (s_suppkey // 3),
           CASE WHEN s_suppkey % 2 = 0 AND s_nationkey <> 0 THEN 'R' || (1 + s_suppkey % 4) END,
           CASE WHEN s_suppkey % 2 = 1 AND s_nationkey <> 0 THEN 'Mestre' END
    FROM supplier
), registration_outcome AS (
    SELECT *, CASE
        WHEN kind = 'visitante' THEN 'invalid_kind'
        WHEN cpf IS NULL THEN 'missing_cpf'
        WHEN kind = 'residente' AND year IS NULL THEN 'missing_year'
        WHEN kind = 'preceptor' AND title IS NULL THEN 'missing_title'
        WHEN bad_date THEN 'malformed_birth_date'
        WHEN cpf_place > 1 OR cpf IN (SELECT '1' || lpad(CAST(c_custkey // 2 AS VARCHAR), 10, '0')
                                      FROM customer WHERE c_nationkey = 1) THEN 'duplicate_cpf'
        WHEN kind <> 'paciente' AND (crm_place > 1 OR crm IN (SELECT 'CRM ' || (s_suppkey // 3)
                                     FROM supplier WHERE s_nationkey = 2)) THEN 'duplicate_crm'
        WHEN kind = 'paciente' AND bad_blood THEN 'invalid_blood_group'
        WHEN kind = 'residente' AND year NOT IN ('R1', 'R2', 'R3') THEN 'invalid_year'
        ELSE 'accepted' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY cpf ORDER BY request_id) AS cpf_place,
                 row_number() OVER (PARTITION BY crm ORDER BY request_id) AS crm_place FROM registration)
), bundle_item AS (
    SELECT l_orderkey AS encounter_id, l_partkey AS procedure_id, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(CAST(floor(l_extendedprice) AS BIGINT) % 240 AS INTEGER) AS minutes,
           CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS started_at
    FROM lineitem
), bundle_outcome AS (
    SELECT e.encounter_id, e.started_at, CASE
        WHEN e.resident_id IS NULL THEN 'missing_resident_id'
        WHEN e.supervisor_id IS NULL THEN 'missing_supervisor_id'
        WHEN i.unknown THEN 'procedure_not_found'
        WHEN i.bad THEN 'invalid_item'
        WHEN i.repeated THEN 'repeated_procedure'
        ELSE 'accepted' END AS outcome
    FROM encounter_request e LEFT JOIN (
        SELECT encounter_id, bool_or(procedure_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48)) AS unknown,
               bool_or(minutes <= 0 OR quantity <= 0) AS bad, count(*) > count(DISTINCT procedure_id) AS repeated
        FROM bundle_item GROUP BY encounter_id
    ) i ON i.encounter_id = e.encounter_id
), patch AS (
    SELECT o_orderkey AS request_id,
           CASE WHEN o_orderstatus <> 'P' THEN o_custkey ELSE -1 - o_custkey END AS patient_id,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS plan,
           CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END AS allergies
    FROM orders
), deletion AS (
    SELECT q.*, CASE
        WHEN q.status <> 'F' OR x.encounter_id IS NULL THEN 'not_found'
        WHEN b.encounter_id IS NOT NULL THEN 'blocked_billed'
        WHEN row_number() OVER (PARTITION BY q.encounter_id, q.procedure_id, q.status = 'F'
                                ORDER BY q.line, q.supplier, q.price) = 1
        THEN 'deleted' ELSE 'not_found' END AS outcome
    FROM line_request q
    LEFT JOIN performed x ON x.encounter_id = q.encounter_id AND x.procedure_id = q.procedure_id
    LEFT JOIN billing b ON b.encounter_id = q.encounter_id AND b.procedure_id = q.procedure_id
), standing AS (
    SELECT * REPLACE (CASE WHEN unit_id IN ('signup', 'click') THEN resident_id ELSE -1 - resident_id END
                      AS resident_id) FROM roster
), move_request AS (
    SELECT * REPLACE (CASE WHEN unit_id = 'purchase' THEN resident_id ELSE -1 - resident_id END AS resident_id)
    FROM request
), move AS (
    SELECT request_id, resident_id, weekday AS from_weekday, turn AS from_turn,
           ({_list(WEEKDAYS)})[isodow(ts + to_days(CAST(1 + request_id % 3 AS INTEGER)))] AS to_weekday,
           turn AS to_turn,
           row_number() OVER (PARTITION BY resident_id ORDER BY request_id) AS place
    FROM move_request
), move_outcome AS (
    SELECT m.*, coalesce(o.rows, 0) AS leaving, CASE
        WHEN place > 1 THEN 'ambiguous'
        WHEN coalesce(o.rows, 0) = 0 THEN 'moved'
        WHEN EXISTS (SELECT 1 FROM standing a JOIN standing b ON a.resident_id = b.resident_id AND a.unit_id = b.unit_id
                     WHERE a.resident_id = m.resident_id AND a.weekday = m.from_weekday AND a.turn = m.from_turn
                     AND b.weekday = m.to_weekday AND b.turn = m.to_turn) THEN 'conflict_same_unit'
        WHEN o.rows > 1 OR EXISTS (SELECT 1 FROM standing b WHERE b.resident_id = m.resident_id
                     AND b.weekday = m.to_weekday AND b.turn = m.to_turn) THEN 'conflict_other_unit'
        ELSE 'moved' END AS status
    FROM move m LEFT JOIN (
        SELECT resident_id, weekday, turn, count(*) AS rows FROM standing GROUP BY resident_id, weekday, turn
    ) o ON o.resident_id = m.resident_id AND o.weekday = m.from_weekday AND o.turn = m.from_turn
), order_row AS (
    SELECT o_orderkey AS encounter_id, CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS INTEGER) AS minutes,
           o_custkey AS patient_id, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS note,
           o_orderstatus AS status, o_orderpriority AS priority,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 0 END AS extra
    FROM orders
), fate AS (
    SELECT o_orderkey AS encounter_id, CASE
        WHEN o_orderkey NOT IN (SELECT encounter_id FROM encounter) THEN 'not_found'
        WHEN o_orderkey IN (SELECT encounter_id FROM billing) THEN 'blocked'
        ELSE 'deleted' END AS outcome
    FROM orders
), role_outcome AS (
    SELECT s_suppkey AS request_id, s_suppkey AS staff_id,
           CASE WHEN s_nationkey = 8 THEN 'diretor' ELSE 'preceptor' END AS role, CASE
        WHEN s_nationkey = 8 THEN 'invalid_role'
        WHEN s_nationkey = 3 THEN 'not_found'
        WHEN s_suppkey % 2 = 1 THEN 'unchanged'
        WHEN s_acctbal >= 0 THEN 'blocked_subtype'
        ELSE 'changed' END AS outcome
    FROM supplier
)
"""


def _roster_outcome(batch: str, standing: str, unknown_unit: str) -> str:
    """First come, first served, with the standing roster before everyone."""
    return f"""
    SELECT q.request_id, CASE
        WHEN q.unit_id = '{unknown_unit}' THEN 'unit_not_found'
        WHEN h.low = q.unit_id AND h.high = q.unit_id THEN 'duplicate_slot'
        WHEN h.low IS NOT NULL THEN 'overlap'
        WHEN q.request_id = w.first THEN 'accepted'
        WHEN q.unit_id = w.unit THEN 'duplicate_slot' ELSE 'overlap' END AS outcome
    FROM request q
    LEFT JOIN (SELECT resident_id, weekday, turn, min(unit_id) AS low, max(unit_id) AS high
               FROM roster WHERE {standing} GROUP BY resident_id, weekday, turn) h
      ON h.resident_id = q.resident_id AND h.weekday = q.weekday AND h.turn = q.turn
    LEFT JOIN (SELECT resident_id, weekday, turn, min(request_id) AS first, arg_min(unit_id, request_id) AS unit
               FROM request WHERE {batch} AND unit_id <> '{unknown_unit}' GROUP BY resident_id, weekday, turn) w
      ON w.resident_id = q.resident_id AND w.weekday = q.weekday AND w.turn = q.turn
    WHERE {batch.replace("unit_id", "q.unit_id")}
    """


def _moves_in_order(select: str) -> str:
    """Move by move: what a resident holds is a list of slots with their first and their present place."""
    return f"""
    SELECT * FROM (
        WITH RECURSIVE slot AS (
            SELECT resident_id, weekday, turn, count(*) AS rows, list(DISTINCT unit_id) AS units
            FROM standing GROUP BY resident_id, weekday, turn
        ), step AS (
            SELECT resident_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS request_id,
                   CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS moved,
                   list({{'was': weekday || '/' || turn, 'now': weekday || '/' || turn, 'rows': rows, 'units': units}})
                       AS held
            FROM slot GROUP BY resident_id
            UNION ALL
            SELECT resident_id, place, request_id, status, CASE WHEN goes THEN leaving.rows ELSE 0 END,
                   CASE WHEN goes THEN list_transform(held, lambda x: {{
                       'was': x.was, 'now': CASE WHEN x.now = origin THEN destination ELSE x.now END,
                       'rows': x.rows, 'units': x.units}}) ELSE held END
            FROM (
                SELECT *, status = 'moved' AND leaving IS NOT NULL AS goes
                FROM (
                    SELECT *, CASE
                        WHEN leaving IS NULL THEN 'moved'
                        WHEN target IS NOT NULL AND list_has_any(leaving.units, target.units) THEN 'conflict_same_unit'
                        WHEN target IS NOT NULL OR len(leaving.units) > 1 THEN 'conflict_other_unit'
                        ELSE 'moved' END AS status
                    FROM (
                        SELECT s.resident_id, m.place, m.request_id, s.held,
                               m.from_weekday || '/' || m.from_turn AS origin,
                               m.to_weekday || '/' || m.to_turn AS destination,
                               list_filter(s.held, lambda x: x.now = m.from_weekday || '/' || m.from_turn)[1] AS leaving,
                               list_filter(s.held, lambda x: x.now = m.to_weekday || '/' || m.to_turn)[1] AS target
                        FROM step s JOIN move m ON m.resident_id = s.resident_id AND m.place = s.place + 1)))
        ), ends AS (
            SELECT resident_id, unnest(arg_max(held, place)) AS slot FROM step GROUP BY resident_id)
        {select})"""


SHA = "sha256(concat_ws(chr(31), {}))"

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations")
_STAY = ("stay_id", "patient_id", "unit_id", "entered_at", "left_at", "reason")
_LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_BY_RESIDENT = "resident_id, resident, specialty, year, encounters"
_PERSON_ID = "sha256(cpf)"
_AFTER = "{'user_id': user_id, 'level': CAST(floor(value) AS BIGINT) + 1}"
_BEFORE = "{'user_id': user_id, 'level': CAST(floor(value) AS BIGINT)}"
_ORDER_IMAGE = (
    "json_object('encounter_id', {0}.encounter_id, 'minutes', {1}, 'patient_id', {0}.patient_id, 'note', {0}.note)")
_BEFORE_IMAGE = _ORDER_IMAGE.format("b", "b.minutes")
_AFTER_IMAGE = _ORDER_IMAGE.format("a", "a.minutes + a.extra")

# Queries over the bindings, and queries over the raw tables alone.
_BOUND = {
    "A1_load_hospital_month": "SELECT * FROM busy",
    "B_audit_hospital": """
        SELECT 'procedure' AS "table", 'code_unique' AS rule, code AS record FROM proc WHERE expected_minutes <= 48
        GROUP BY code HAVING count(*) > 1
        UNION ALL SELECT 'performed', 'procedure_id_in_procedure', concat_ws('/', encounter_id, procedure_id)
        FROM performed WHERE procedure_id NOT IN (SELECT procedure_id FROM proc WHERE expected_minutes <= 48)""",
    "A2_export_result": f"SELECT {_BY_RESIDENT}, {mean('total', 'encounters')} AS mean_minutes FROM by_resident",
    "A2_export_result_csv": "SELECT * FROM monthly",
    "A2_export_result_parquet": """
        SELECT patient_id, encounter_id, started_at, minutes, patient, resident, supervisor, unit
        FROM encounter_names""",
    "B3_audit_not_null": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM stay" for c in _STAY),
    "B6_audit_exclusive_roles": """
        , member AS (
            SELECT s_suppkey AS staff_id, 'residente' AS subtype FROM supplier
            WHERE s_suppkey % 2 = 0 OR s_nationkey = 5
            UNION ALL
            SELECT s_suppkey, 'preceptor' FROM supplier WHERE s_suppkey % 2 = 1 OR s_nationkey = 7)
        SELECT m.staff_id, m.subtype, 'role_mismatch' AS problem FROM member m JOIN staff s ON s.staff_id = m.staff_id
        WHERE s.role <> m.subtype
        UNION ALL
        SELECT staff_id, subtype, 'several_subtypes' FROM member
        WHERE staff_id IN (SELECT staff_id FROM member GROUP BY staff_id HAVING count(*) > 1)""",
    "B8_validated_append": """
        SELECT encounter_id, CASE
            WHEN resident_id IS NULL THEN 'missing_resident_id'
            WHEN supervisor_id IS NULL THEN 'missing_supervisor_id'
            WHEN patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'patient_not_found'
            WHEN resident_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'resident_not_found'
            WHEN supervisor_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'supervisor_not_found'
            WHEN unit_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) THEN 'unit_not_found'
            WHEN price % 90 = 0 THEN 'invalid_minutes'
            ELSE 'accepted' END AS outcome
        FROM encounter_request""",
    "B9_register_people": "SELECT request_id, outcome FROM registration_outcome",
    "B9_register_people_rows": f"""
        SELECT 'person' AS table_name, {_PERSON_ID} AS person_id, name AS detail
        FROM registration_outcome WHERE outcome = 'accepted'
        UNION ALL SELECT 'patient', {_PERSON_ID}, plan FROM registration_outcome
        WHERE outcome = 'accepted' AND kind = 'paciente'
        UNION ALL SELECT 'staff', {_PERSON_ID}, crm FROM registration_outcome
        WHERE outcome = 'accepted' AND kind <> 'paciente'
        UNION ALL SELECT 'resident', {_PERSON_ID}, year FROM registration_outcome
        WHERE outcome = 'accepted' AND kind = 'residente'
        UNION ALL SELECT 'supervisor', {_PERSON_ID}, title FROM registration_outcome
        WHERE outcome = 'accepted' AND kind = 'preceptor'""",
    "B11_register_encounter_bundle": "SELECT encounter_id, outcome FROM bundle_outcome",
    "B11_register_encounter_bundle_performed": """
        SELECT i.encounter_id, i.procedure_id, i.quantity, i.minutes, coalesce(i.started_at, o.started_at) AS started_at
        FROM bundle_item i JOIN bundle_outcome o ON o.encounter_id = i.encounter_id WHERE o.outcome = 'accepted'""",
    "B11_register_encounter_bundle_items": """
        SELECT encounter_id, outcome, count(*) AS items, sum(quantity) AS quantity FROM (
            SELECT i.encounter_id, i.quantity, CASE WHEN r.price <= 400000 THEN o.outcome
                ELSE 'unknown_encounter' END AS outcome
            FROM bundle_item i LEFT JOIN bundle_outcome o ON o.encounter_id = i.encounter_id
            LEFT JOIN encounter_request r ON r.encounter_id = i.encounter_id)
        GROUP BY encounter_id, outcome""",
    "B11_bundle_to_audit": """
        SELECT r.encounter_id, 'INSERT' AS operation, TRUE AS is_new
        FROM bundle_outcome o JOIN encounter_request r ON r.encounter_id = o.encounter_id
        WHERE o.outcome = 'accepted' AND r.started_at >= DATE '1995-07-01'""",
    "B11_bundle_to_means": f"""
        SELECT p_partkey AS procedure_id, m.mean_minutes FROM part LEFT JOIN (
            SELECT i.procedure_id, {mean('sum(i.minutes)', 'count(*)')} AS mean_minutes
            FROM bundle_item i JOIN bundle_outcome o ON o.encounter_id = i.encounter_id
            WHERE o.outcome = 'accepted' GROUP BY i.procedure_id) m ON m.procedure_id = p_partkey
        WHERE p_size <= 48""",
    "B11_register_encounter_bundle_json": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(round(l_extendedprice * 100) AS BIGINT)) AS encounter_id, CASE
            WHEN l_suppkey // 2 * 2 + 1 NOT IN (SELECT supervisor_id FROM supervisor) THEN 'supervisor_not_found'
            WHEN l_returnflag = 'N' THEN 'accepted'
            WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48)
              OR l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48) THEN 'procedure_not_found'
            WHEN CAST(floor(l_extendedprice) AS BIGINT) % 240 <= 0 OR l_linenumber <= 1 OR l_quantity < 1
            THEN 'invalid_item'
            WHEN l_partkey = l_suppkey THEN 'repeated_procedure'
            ELSE 'accepted' END AS outcome
        FROM lineitem""",
    "B12_register_performed": """
        , checked AS (
            SELECT *, CASE
                WHEN encounter_id NOT IN (SELECT encounter_id FROM encounter) THEN 'encounter_not_found'
                WHEN procedure_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48) THEN 'procedure_not_found'
                WHEN quantity <= 0 THEN 'invalid_quantity'
                WHEN minutes <= 0 THEN 'invalid_minutes' ELSE 'accepted' END AS verdict
            FROM line_request WHERE line % 2 = 0)
        SELECT request_id, quantity, CASE
            WHEN verdict <> 'accepted' THEN verdict
            WHEN EXISTS (SELECT 1 FROM line_request b WHERE b.line % 2 = 1 AND b.encounter_id = c.encounter_id
                         AND b.procedure_id = c.procedure_id)
              OR row_number() OVER (PARTITION BY encounter_id, procedure_id, verdict ORDER BY line, supplier, price) > 1
            THEN 'already_registered' ELSE 'accepted' END AS outcome
        FROM checked c""",
    "B13_bill_procedures": f"""
        , checked AS (
            SELECT q.*, b.encounter_id IS NOT NULL AS billed, CASE
                WHEN q.amount <= 0 THEN 'invalid_amount'
                WHEN x.encounter_id IS NULL THEN 'not_found' ELSE 'accepted' END AS verdict
            FROM line_request q
            LEFT JOIN performed x ON x.encounter_id = q.encounter_id AND x.procedure_id = q.procedure_id
            LEFT JOIN billing b ON b.encounter_id = q.encounter_id AND b.procedure_id = q.procedure_id
             AND b.amount < 50000
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY encounter_id, procedure_id, verdict
                                         ORDER BY line, supplier, price) AS place
            FROM checked)
        SELECT request_id, {SHA.format("encounter_id, procedure_id")} AS billing_id,
               DATE '1998-06-15' AS issued_on, CASE
            WHEN verdict <> 'accepted' THEN verdict
            WHEN billed OR place > 1 THEN 'already_billed' ELSE 'accepted' END AS outcome
        FROM ranked""",
    "B14_assign_roster": _roster_outcome("unit_id <> 'signup'", "unit_id = 'signup'", "error"),
    "B15_audit_roster_overlap": """
        SELECT resident_id, weekday, turn, count(DISTINCT unit_id) AS units FROM roster
        GROUP BY resident_id, weekday, turn HAVING count(DISTINCT unit_id) > 1""",
    "C1_patch_patients": """
        SELECT p.patient_id, p.name, p.cpf, coalesce(u.plan, p.plan) AS plan, p.is_fan, u.allergies
        FROM patient p LEFT JOIN (
            SELECT patient_id, arg_max(plan, request_id) FILTER (WHERE plan IS NOT NULL) AS plan,
                   arg_max(allergies, request_id) FILTER (WHERE allergies IS NOT NULL) AS allergies
            FROM patch GROUP BY patient_id) u ON u.patient_id = p.patient_id""",
    "C1_patch_patients_not_found": """
        SELECT DISTINCT patient_id FROM patch WHERE patient_id NOT IN (SELECT patient_id FROM patient)""",
    "C2_delete_performed": "SELECT request_id, outcome FROM deletion",
    "C2_delete_performed_survivors": """
        SELECT encounter_id, procedure_id, minutes FROM performed x
        WHERE NOT EXISTS (SELECT 1 FROM deletion d WHERE d.outcome = 'deleted' AND d.encounter_id = x.encounter_id
                          AND d.procedure_id = x.procedure_id)""",
    "C3_move_roster": """
        SELECT request_id, resident_id, from_weekday, from_turn, to_weekday, to_turn, status,
               CASE WHEN status = 'moved' THEN leaving ELSE 0 END AS moved
        FROM move_outcome""",
    "C3_move_roster_table": """
        SELECT s.roster_id, s.unit_id, s.resident_id, s.supervisor_id,
               coalesce(m.to_weekday, s.weekday) AS weekday, coalesce(m.to_turn, s.turn) AS turn
        FROM standing s LEFT JOIN move_outcome m ON m.status = 'moved' AND m.resident_id = s.resident_id
         AND m.from_weekday = s.weekday AND m.from_turn = s.turn""",
    "C3_move_roster_in_order": _moves_in_order("""
        SELECT m.request_id, m.resident_id, from_weekday, from_turn, to_weekday, to_turn,
               coalesce(s.status, 'moved') AS status, coalesce(s.moved, 0) AS moved
        FROM move m LEFT JOIN step s ON s.request_id = m.request_id"""),
    "C3_move_roster_in_order_table": _moves_in_order("""
        SELECT s.roster_id, s.unit_id, s.resident_id, s.supervisor_id,
               split_part(e.slot.now, '/', 1) AS weekday, split_part(e.slot.now, '/', 2) AS turn
        FROM standing s JOIN ends e ON e.resident_id = s.resident_id AND e.slot.was = s.weekday || '/' || s.turn"""),
    "C4_diff_audit": f"""
        , entry AS (
            SELECT coalesce(a.encounter_id, b.encounter_id) AS encounter_id,
                   CASE WHEN b.encounter_id IS NULL THEN 'INSERT' WHEN a.encounter_id IS NULL THEN 'DELETE'
                        ELSE 'UPDATE' END AS operation,
                   CASE WHEN b.encounter_id IS NOT NULL THEN CAST({_BEFORE_IMAGE} AS VARCHAR) END AS before,
                   CASE WHEN a.encounter_id IS NOT NULL THEN CAST({_AFTER_IMAGE} AS VARCHAR) END AS after
            FROM (SELECT * FROM order_row WHERE status <> 'O' OR priority <> '5-LOW') b
            FULL JOIN (SELECT * FROM order_row WHERE status <> 'P') a ON a.encounter_id = b.encounter_id
            WHERE a.encounter_id IS NULL OR b.encounter_id IS NULL OR a.extra <> 0)
        SELECT *, TIMESTAMP '1998-06-15 00:00:00' AS changed_at,
               {SHA.format("encounter_id, operation, '1998-06-15 00:00:00'")} AS audit_id
        FROM entry""",
    "C4_audited_fields": """
        , image AS (
            SELECT coalesce(a.encounter_id, b.encounter_id) AS encounter_id,
                   CASE WHEN b.encounter_id IS NULL THEN 'INSERT' WHEN a.encounter_id IS NULL THEN 'DELETE'
                        ELSE 'UPDATE' END AS operation,
                   CAST(b.minutes AS VARCHAR) AS minutes_before, CAST(a.minutes + a.extra AS VARCHAR) AS minutes_after,
                   CAST(b.patient_id AS VARCHAR) AS patient_before, CAST(a.patient_id AS VARCHAR) AS patient_after,
                   b.note AS note_before, a.note AS note_after
            FROM (SELECT * FROM order_row WHERE status <> 'O' OR priority <> '5-LOW') b
            FULL JOIN (SELECT * FROM order_row WHERE status <> 'P') a ON a.encounter_id = b.encounter_id)
        SELECT encounter_id, operation, 'minutes' AS field, minutes_before AS before, minutes_after AS after FROM image
        WHERE minutes_before IS DISTINCT FROM minutes_after
        UNION ALL SELECT encounter_id, operation, 'patient_id', patient_before, patient_after FROM image
        WHERE patient_before IS DISTINCT FROM patient_after
        UNION ALL SELECT encounter_id, operation, 'note', note_before, note_after FROM image
        WHERE note_before IS DISTINCT FROM note_after""",
    "C5_refresh_procedure_means": f"""
        SELECT c.procedure_id, c.name, m.mean_minutes FROM proc c LEFT JOIN (
            SELECT procedure_id, {mean('sum(minutes)', 'count(*)')} AS mean_minutes FROM performed GROUP BY procedure_id
        ) m ON m.procedure_id = c.procedure_id""",
    "C5_refresh_procedure_means_affected": f"""
        SELECT c.procedure_id, coalesce(m.mean_minutes, c.expected_minutes) AS mean_minutes FROM proc c LEFT JOIN (
            SELECT procedure_id, {mean('sum(minutes)', 'count(*)')} AS mean_minutes FROM performed
            WHERE procedure_id IN (SELECT procedure_id FROM performed
                                   WHERE started_at >= DATE '1998-06-01' AND started_at < DATE '1998-07-01')
            GROUP BY procedure_id
        ) m ON m.procedure_id = c.procedure_id""",
    "C5_means_from_deltas": f"""
        SELECT c.procedure_id, m.mean_minutes FROM proc c LEFT JOIN (
            SELECT procedure_id, {mean('sum(minutes + CASE WHEN year(started_at) = 1996 THEN 5 ELSE 0 END)', 'count(*)')}
                   AS mean_minutes
            FROM performed WHERE year(started_at) <= 1997 AND NOT (year(started_at) = 1992 AND minutes % 3 = 0)
            GROUP BY procedure_id
        ) m ON m.procedure_id = c.procedure_id""",
    "C6_delete_with_actions": """
        SELECT encounter_id, outcome, CASE WHEN outcome = 'blocked' THEN 'billing' END AS blocked_by FROM fate""",
    "C6_delete_procedures": """
        SELECT p_partkey AS procedure_id, CASE WHEN x.used THEN 'blocked' ELSE 'deleted' END AS outcome,
               CASE WHEN x.used THEN 'performed' END AS blocked_by
        FROM part LEFT JOIN (SELECT DISTINCT procedure_id, TRUE AS used FROM performed) x ON x.procedure_id = p_partkey""",
    "C6_delete_people": """
        SELECT person_id, CASE WHEN used THEN 'blocked' ELSE 'deleted' END AS outcome,
               CASE WHEN used THEN 'encounter' END AS blocked_by
        FROM (
            SELECT 'c' || c_custkey AS person_id, c_custkey IN (SELECT patient_id FROM encounter) AS used FROM customer
            UNION ALL
            SELECT 's' || s_suppkey, s_suppkey IN (SELECT resident_id FROM encounter)
                   OR s_suppkey IN (SELECT supervisor_id FROM encounter) FROM supplier)""",
    "C6_delete_with_actions_performed": """
        SELECT encounter_id, procedure_id FROM performed
        WHERE encounter_id NOT IN (SELECT encounter_id FROM fate WHERE outcome = 'deleted')""",
    "C7_change_roles": "SELECT request_id, staff_id, role, outcome FROM role_outcome",
    "C7_change_roles_table": """
        SELECT s.staff_id, s.name, CASE WHEN o.outcome = 'changed' THEN o.role ELSE s.role END AS role
        FROM staff s JOIN role_outcome o ON o.staff_id = s.staff_id WHERE s.specialty <> '3'""",
    "D1_list_patients": "SELECT patient_id, name AS patient, cpf, plan FROM patient",
    "D1_list_patients_search": """
        SELECT patient_id, name AS patient, cpf, plan FROM patient
        WHERE name ILIKE '%MER#000000_7%' OR cpf ILIKE '%MER#000000_7%'""",
    "D2_list_staff": """
        SELECT s.staff_id, s.name, s.cpf, s.crm, s.specialty, s.role, r.year, v.title
        FROM staff s LEFT JOIN resident r ON r.resident_id = s.staff_id
        LEFT JOIN supervisor v ON v.supervisor_id = s.staff_id""",
    "D2_list_staff_residents": """
        SELECT s.staff_id, s.name, s.cpf, s.crm, s.specialty, s.role, r.year, CAST(NULL AS VARCHAR) AS title
        FROM staff s JOIN resident r ON r.resident_id = s.staff_id""",
    "D3_list_units": "SELECT unit_id, name FROM unit",
    "D3_list_procedures": "SELECT procedure_id, code, name, expected_minutes, risk FROM proc",
    "D4_recent_encounters": """
        SELECT encounter_id, started_at, minutes, patient, resident, supervisor FROM encounter_names
        ORDER BY started_at DESC, encounter_id DESC LIMIT 50""",
    "D5_patient_encounters": """
        SELECT patient_id, encounter_id, started_at, minutes, patient, resident, supervisor, unit
        FROM encounter_names""",
    "D6_encounter_procedures": """
        SELECT encounter_id, procedure_id, procedure, risk, quantity, minutes, billed, amount FROM detail""",
    "D7_encounter_procedures_timeline": """
        SELECT encounter_id, procedure_id, procedure, risk, quantity, minutes, started_at, billed FROM detail""",
    "D5_patient_encounters_by_id": """
        SELECT patient_id, encounter_id, started_at, minutes, patient, resident, supervisor, unit
        FROM encounter_names WHERE patient_id = 7""",
    "D6_encounter_procedures_by_id": """
        SELECT encounter_id, procedure_id, procedure, risk, quantity, minutes, billed, amount FROM detail
        WHERE encounter_id = (SELECT min(encounter_id) FROM encounter)""",
    "D7_encounter_procedures_timeline_by_id": """
        SELECT encounter_id, procedure_id, procedure, risk, quantity, minutes, started_at, billed FROM detail
        WHERE encounter_id = (SELECT min(encounter_id) FROM encounter)""",
    "D8_list_roster": """
        SELECT r.roster_id, r.unit_id AS unit, r.weekday, r.turn, d.name AS resident, s.name AS supervisor
        FROM roster r JOIN duty_resident d ON d.resident_id = r.resident_id
        JOIN supervisor s ON s.supervisor_id = r.supervisor_id""",
    "E1_resident_ranking": "SELECT resident_id, resident, year, encounters FROM by_resident",
    "E2_mean_duration_by_resident": f"""
        SELECT {_BY_RESIDENT}, {mean('total', 'encounters')} AS mean_minutes FROM by_resident""",
    "E2_mean_duration_one_decimal": f"""
        SELECT {_BY_RESIDENT}, {mean('total', 'encounters', 1)} AS mean_minutes FROM by_resident""",
    "E3_busy_supervisors": "SELECT * FROM busy",
    "E4_shifts_per_unit": f"""
        SELECT r.unit_id AS unit, d.name AS resident, count(*) AS shifts
        FROM roster r JOIN duty_resident d ON d.resident_id = r.resident_id
        JOIN (SELECT ({_list(WEEKDAYS)})[isodow(day)] AS weekday
              FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS g(day)) c
          ON c.weekday = r.weekday
        GROUP BY r.unit_id, d.name""",
    "E5_patients_without_high_risk": "SELECT * FROM never_high_risk",
    "E6_mean_wait_by_unit": "SELECT * FROM waits",
    "E7_currently_admitted": "SELECT * FROM admitted",
    "E8_residents_without_qualified_supervisor": "SELECT * FROM unqualified",
    "E9_monthly_stats": "SELECT * FROM monthly",
    "E10_supervisors_of_fans": """
        SELECT DISTINCT s.name AS supervisor FROM encounter e JOIN supervisor s ON s.supervisor_id = e.supervisor_id
        JOIN patient p ON p.patient_id = e.patient_id WHERE p.is_fan""",
    "E10_supervisors_of_fans_via_resident": """
        SELECT DISTINCT s.name AS supervisor FROM encounter e JOIN supervisor s ON s.supervisor_id = e.supervisor_id
        WHERE e.resident_id IN (SELECT f.resident_id FROM encounter f JOIN patient p ON p.patient_id = f.patient_id
                                WHERE p.is_fan)""",
    "E11_last_encounter_by_patient": """
        SELECT e.encounter_id, e.patient, e.started_at, e.resident, e.supervisor,
               coalesce(n.procedures, '') AS procedures
        FROM encounter_names e
        JOIN (SELECT patient_id, max(started_at) AS newest FROM encounter GROUP BY patient_id) l
          ON l.patient_id = e.patient_id AND l.newest = e.started_at
        LEFT JOIN (SELECT x.encounter_id, string_agg(c.name, '; ' ORDER BY c.name) AS procedures
                   FROM performed x JOIN proc c ON c.procedure_id = x.procedure_id GROUP BY x.encounter_id) n
          ON n.encounter_id = e.encounter_id""",
    "E12_high_risk_share_by_resident": f"""
        SELECT resident_id, resident, procedures, high_risk,
               CASE WHEN procedures = 0 THEN 0 ELSE {mean('(100 * high_risk)', 'procedures', 1)} END
                   AS high_risk_percent
        FROM (
            SELECT r.resident_id, r.name AS resident, CAST(coalesce(sum(x.quantity), 0) AS BIGINT) AS procedures,
                   CAST(coalesce(sum(CASE WHEN c.risk = 'ALTO' THEN x.quantity END), 0) AS BIGINT) AS high_risk
            FROM resident r LEFT JOIN encounter e ON e.resident_id = r.resident_id
            LEFT JOIN performed x ON x.encounter_id = e.encounter_id
            LEFT JOIN proc c ON c.procedure_id = x.procedure_id
            GROUP BY r.resident_id, r.name)""",
    "E13_dashboard_kpis": """
        SELECT (SELECT count(*) FROM patient) AS patients,
               (SELECT count(*) FROM staff) AS staff,
               (SELECT count(*) FROM encounter WHERE date_trunc('month', started_at) = DATE '1998-06-01')
                   AS encounters_in_month,
               (SELECT count(*) FROM roster WHERE weekday = 'segunda') AS shifts_today,
               (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM billing
                WHERE date_trunc('month', issued_on) = DATE '1998-06-01') AS billed_in_month,
               (SELECT count(*) FROM never_high_risk) AS patients_without_high_risk,
               (SELECT count(*) FROM admitted) AS admitted,
               (SELECT count(DISTINCT resident_id) FROM unqualified) AS residents_without_qualified_supervisor""",
    "F3_stream_roster": _roster_outcome("unit_id <> ''", "FALSE", ""),
    "G1_view_currently_admitted": "SELECT * FROM admitted",
    "G1_view_residents_without_qualified_supervisor": "SELECT * FROM unqualified",
    "G1_view_monthly_stats": "SELECT * FROM monthly",
    "G2_function_mean_wait_by_unit": "SELECT * FROM waits",
    "G3_run_named": "SELECT * FROM busy",
}

_RAW = {
    "A1_load_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES),
    "B1_audit_domains": """
        SELECT 'o_orderpriority' AS "column", o_orderkey, o_orderpriority AS value FROM orders
        WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
        UNION ALL SELECT 'o_orderstatus', o_orderkey, o_orderstatus FROM orders
        WHERE o_orderstatus NOT IN ('F', 'O')""",
    "B2_audit_checks": f"""
        SELECT 'shipped_after_order' AS rule, {_LINE_KEY} FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_shipdate < o_orderdate
        UNION ALL SELECT 'quantity_positive', {_LINE_KEY} FROM lineitem WHERE l_quantity <= 0
        UNION ALL SELECT 'discount_below_9_percent', {_LINE_KEY} FROM lineitem WHERE l_discount >= 0.085
        UNION ALL SELECT 'flag_is_one_letter', {_LINE_KEY} FROM lineitem
        WHERE NOT regexp_full_match(l_returnflag, '[A-Z]')""",
    "B4_audit_unique": """
        SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
    "B5_audit_foreign_key": f"""
        SELECT {_LINE_KEY} FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""",
    "B7_apply_defaults": f"""
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderstatus = 'P' THEN '5-LOW' ELSE o_orderpriority END AS priority, 1 AS quantity,
               DATE '1998-06-15' AS issued_on, TRUE AS active,
               {SHA.format("o_orderkey, o_custkey")} AS request_id
        FROM orders""",
    "B9_register_people_in_order": """
        WITH RECURSIVE asked AS (
            SELECT o_orderkey AS request_id, lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS cpf,
                   CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(floor(o_totalprice / 500) AS BIGINT) END AS crm,
                   o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AS no_date,
                   o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS no_blood,
                   o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' AND o_orderkey % 2 = 0 AS no_year
            FROM orders
        ), judged AS (
            SELECT *, cpf IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') FROM customer WHERE c_nationkey = 1) AS old_cpf,
                   crm IS NOT NULL AND crm IN (SELECT CAST(floor(o_totalprice / 500) AS BIGINT) FROM orders
                                               WHERE o_orderdate < DATE '1993-01-01') AS old_crm
            FROM asked
        ), turn AS (
            SELECT request_id, cpf, crm, 'open' AS fate FROM judged
            WHERE NOT (no_date OR no_blood OR no_year OR old_cpf OR old_crm)
            UNION ALL
            SELECT request_id, cpf, crm, CASE WHEN held THEN 'held'
                WHEN bool_or(held) OVER (PARTITION BY cpf) THEN 'lost'
                WHEN crm IS NOT NULL AND bool_or(held) OVER (PARTITION BY crm) THEN 'lost' ELSE 'open' END
            FROM (SELECT *, request_id = first_cpf AND (crm IS NULL OR request_id = first_crm) AS held
                  FROM (SELECT *, min(request_id) OVER (PARTITION BY cpf) AS first_cpf,
                               min(request_id) OVER (PARTITION BY crm) AS first_crm
                        FROM turn WHERE fate = 'open') AS waiting) AS chosen
        ), held AS (SELECT request_id, cpf, crm FROM turn WHERE fate = 'held')
        SELECT j.request_id, CASE
            WHEN no_date THEN 'malformed_birth_date'
            WHEN old_cpf OR p.request_id < j.request_id THEN 'duplicate_cpf'
            WHEN old_crm OR s.request_id < j.request_id THEN 'duplicate_crm'
            WHEN no_blood THEN 'invalid_blood_group' WHEN no_year THEN 'invalid_year' ELSE 'accepted' END AS outcome
        FROM judged j LEFT JOIN held p ON p.cpf = j.cpf LEFT JOIN held s ON s.crm = j.crm""",
    "B10_register_units": """
        SELECT n_nationkey AS unit_id, CASE
            WHEN n_nationkey = 24 THEN 'missing_name'
            WHEN n_regionkey > 3 THEN 'invalid_kind'
            WHEN n_nationkey - 2 <= 0 THEN 'invalid_beds' ELSE 'accepted' END AS outcome
        FROM nation""",
    "F1_stream_audit": f"""
        SELECT user_id,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
               CASE WHEN event_type <> 'signup' THEN CAST(to_json({_BEFORE}) AS VARCHAR) END AS before,
               CASE WHEN event_type <> 'error' THEN CAST(to_json({_AFTER}) AS VARCHAR) END AS after,
               ts AS changed_at
        FROM events""",
    "F2_stream_procedure_means": f"""
        SELECT event_type AS procedure_id, count(*) AS executions,
               {mean('sum(CAST(floor(value) AS BIGINT))', 'count(*)')} AS mean_minutes
        FROM events WHERE floor(value) >= 10 GROUP BY event_type""",
}
for _report in ("E6_mean_wait_by_unit", "E12_high_risk_share_by_resident"):
    _BOUND[f"{_report}_bucketed"] = _BOUND[_report]

ORACLE: dict[str, str] = {**{name: BINDINGS + sql for name, sql in _BOUND.items()}, **_RAW}
