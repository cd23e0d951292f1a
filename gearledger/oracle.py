"""Independent SQL for the registered queries, written from the rules for another engine.

The rental tables come from the same mapping texts; everything after that is separate work:
whole-number cents where the operators use DECIMAL, windows where they use aggregates, pair
joins where they count timelines, and recursion where they allocate in rounds.
"""

from __future__ import annotations

from .catalog import AS_OF, BROKEN, CLIENT, ID_TRIGGERS
from .operators.rejects import REFUSALS
from .sources import schemas
from .sources.mapping import oracle_ctes

NOW = f"TIMESTAMP '{AS_OF}'"
_SQL: dict[str, str] = {}


def _message(source: str = "source", code: str = "code") -> str:
    cases = " ".join(
        f"WHEN {source} = '{s}' AND {code} = {c} THEN '{m}'" for (s, c), m in REFUSALS.items()
    )
    return f"CASE {cases} END"


def _add(name: str, tables: tuple[str, ...], body: str, *extra: str) -> None:
    ctes = ",\n".join([t for t in (oracle_ctes(*tables), *extra) if t])
    _SQL[name] = f"WITH RECURSIVE {ctes}\n{body}"


def _refused(name: str, tables: tuple[str, ...], body: str, columns: str, *extra: str) -> None:
    """A decided CTE body with source and code; adds the message."""
    _add(
        name,
        tables,
        f"""SELECT {columns}, source, CAST(code AS BIGINT) AS code, {_message()} AS message
            FROM decided""",
        *extra,
        f"decided AS ({body})",
    )


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Value in cents by whole-number arithmetic. The clock is midnight of a first of month, so a
# partial month is (1 - day) days of 31.
def value_cents(e: str = "e") -> str:
    d = f"{e}.purchase_date"
    months = f"((2024 - year({d})) * 12 + 7 - month({d}))"
    secs = f"CAST({months} * 2678400 + (1 - day({d})) * 86400 AS HUGEINT)"
    p = f"CAST({e}.purchase_price * 100 AS HUGEINT)"
    r = f"CAST({e}.depreciation_rate * 100 AS HUGEINT)"
    top = f"({p} * 3214080000 - {p} * {r} * {secs})"
    return f"(CASE WHEN {top} < 0 THEN 0 ELSE ({top} + 1607040000) // 3214080000 END)"


def half_up(top: str, bottom: str) -> str:
    """Quotient of non-negative whole numbers, halves up."""
    return f"((2 * ({top}) + ({bottom})) // (2 * ({bottom})))"


def euros(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100.0)"


VALUES = f"""values_now AS MATERIALIZED (
    SELECT e.*, {value_cents()} AS value_cents,
           CAST(coalesce(e.deposit_rate, 0) * 100 AS HUGEINT) AS deposit_percent
    FROM equipments e),
deposit_now AS MATERIALIZED (
    SELECT *, {half_up('value_cents * deposit_percent', '100')} AS deposit_cents
    FROM values_now)"""

# ---------------------------------------------------------------- sources and sinks

_add(
    "src1_table_scan",
    tuple(schemas.TABLES),
    " UNION ALL ".join(
        "SELECT count(*) AS row_count, CAST("
        + " + ".join(f"count({c.name})" for c in schemas.columns(t) if c.required)
        + f" AS BIGINT) AS required_values, '{t}' AS table_name FROM {t}"
        for t in schemas.TABLES
    ),
)

_add(
    "snk1_insert_with_defaults",
    ("returns", "rental_items"),
    f"""SELECT return_id, return_date, condition_status, CAST(damage_percent AS DOUBLE) AS damage_percent,
               CAST(damage_fee AS DOUBLE) AS damage_fee, CAST(late_fee AS DOUBLE) AS late_fee,
               inspection_status, rental_item_id FROM returns
        UNION ALL
        SELECT rental_item_id, {NOW}, 'GOOD', NULL, 0.0, NULL, 'PENDING', rental_item_id
        FROM rental_items WHERE item_status = 'BORROWING'""",
)

_DEPOSIT_TABLES = ("rental_commands", "rentals", "rental_items", "equipments", "deposits")
_DEPOSIT_DECIDED = """deposit_due AS (
    SELECT i.rental_id, sum(CASE WHEN e.deposit_rate > 0 THEN e.deposit_cents * i.quantity ELSE 0 END) AS due
    FROM rental_items i LEFT JOIN deposit_now e USING (equipment_id) GROUP BY 1),
decided AS (
    SELECT c.request_id, c.rental_id, c.payment_method, u.due,
           CASE WHEN r.rental_id IS NULL THEN -20001 WHEN u.due IS NULL THEN -20004
                WHEN EXISTS (SELECT 1 FROM deposits d WHERE d.rental_id = c.rental_id) THEN -20002
                WHEN u.due >= 10000000000 THEN -6502
                WHEN u.due <= 0 THEN -20003
                WHEN row_number() OVER (PARTITION BY c.rental_id ORDER BY c.request_id) > 1 THEN -20002
           END AS code
    FROM rental_commands c LEFT JOIN rentals r ON r.rental_id = c.rental_id
    LEFT JOIN deposit_due u ON u.rental_id = c.rental_id)"""
_add(
    "sp5_create_deposit_payment",
    _DEPOSIT_TABLES,
    f"""SELECT *, {_message()} AS message FROM (
        SELECT request_id, rental_id, payment_method,
               CASE WHEN code IS NULL THEN {euros('due')} END AS deposit_amount,
               CASE WHEN code = -6502 THEN 'precision' WHEN code IS NOT NULL THEN 'deposit_payment' END AS source,
               CAST(code AS BIGINT) AS code FROM decided)""",
    VALUES,
    _DEPOSIT_DECIDED,
)
_add(
    "sp5_rental_deposit_required",
    _DEPOSIT_TABLES,
    f"""SELECT r.rental_id, coalesce({euros('d.due')}, CAST(r.deposit_required AS DOUBLE)) AS deposit_required,
               CASE WHEN d.rental_id IS NULL THEN r.updated_at ELSE {NOW} END AS updated_at
        FROM rentals r LEFT JOIN decided d ON d.rental_id = r.rental_id AND d.code IS NULL""",
    VALUES,
    _DEPOSIT_DECIDED,
)


def _code(prefix: str, number: str, pad: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}' || CASE WHEN length({text}) >= {pad} THEN {text} ELSE lpad({text}, {pad}, '0') END"


_add(
    "snk2_insert_returning_ids",
    _DEPOSIT_TABLES,
    f"""SELECT rental_id, {_code('DP', 'n', 3)} AS deposit_id, {_code('PY', 'n', 3)} AS payment_id,
               {_code('TX', 'n', 5)} AS transaction_code, {euros('due')} AS amount
        FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM decided WHERE code IS NULL)""",
    VALUES,
    _DEPOSIT_DECIDED,
)

_PAY = ("pay_invoice_commands", "invoices")
_PAY_DECIDED = """decided AS (
    SELECT c.request_id, c.invoice_id, c.payment_method, i.rental_id, i.final_amount,
           CASE WHEN i.invoice_id IS NULL
                  OR row_number() OVER (PARTITION BY c.invoice_id ORDER BY c.request_id) > 1
                THEN -20010 END AS code
    FROM pay_invoice_commands c
    LEFT JOIN invoices i ON i.invoice_id = c.invoice_id AND i.status = 'PENDING')"""
for _name in ("snk3_keyed_upsert", "snk3_upsert_by_parts"):
    _add(
        _name,
        _PAY,
        """SELECT i.invoice_id,
                  CASE WHEN i.invoice_id IN (SELECT invoice_id FROM decided WHERE code IS NULL)
                       THEN 'PAID' ELSE i.status END AS status,
                  CAST(i.final_amount AS DOUBLE) AS final_amount
           FROM invoices i""",
        _PAY_DECIDED,
    )
_DELETE = """asked AS (
    SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM rental_items i WHERE i.rental_id = r.rental_id) THEN -20062
                     WHEN EXISTS (SELECT 1 FROM invoices v WHERE v.rental_id = r.rental_id) THEN -20063
                END AS code,
           (r.status = 'CREATED' OR r.due_date < TIMESTAMP '1998-01-01 00:00:00') AS wanted
    FROM rentals r)"""
for _name in ("snk4_guarded_delete", "snk4_delete_by_parts"):
    _add(
        _name,
        ("rentals", "rental_items", "invoices"),
        "SELECT rental_id, rental_code, status FROM asked WHERE NOT wanted OR code IS NOT NULL",
        _DELETE,
    )
_add(
    "snk4_guarded_delete_rejects",
    ("rentals", "rental_items", "invoices"),
    f"""SELECT 'rental_delete' AS source, CAST(code AS BIGINT) AS code,
               {_message("'rental_delete'")} AS message, CAST(rental_id AS VARCHAR) AS key
        FROM asked WHERE wanted AND code IS NOT NULL""",
    _DELETE,
)

# ---------------------------------------------------------------- lookups

_add("fl1_equipment_by_type_status", ("equipments",),
     """SELECT equipment_id, equipment_name, equipment_type, status FROM equipments
        WHERE equipment_type = 'MAIN' AND status = 'AVAILABLE'""")
_add("fl2_equipment_by_category", ("equipments",),
     "SELECT equipment_id, equipment_name, category_id FROM equipments WHERE category_id = 'CAT02'")
_add("fl3_equipment_by_make", ("equipments",),
     "SELECT equipment_id, brand, model, mount_type FROM equipments WHERE brand = 'Brand#17'")
_add("fl3_equipment_by_make_and_mount", ("equipments",),
     """SELECT equipment_id, brand, model, mount_type FROM equipments
        WHERE brand = 'Brand#17' AND model = 'ECONOMY' AND mount_type = 'Z'""")
_add("fl4_customers_by_status", ("customers",),
     "SELECT customer_id, full_name, status FROM customers WHERE status = 'INACTIVE'")
for _name in ("fl5_customers_in_box", "fl5_customers_in_box_by_place"):
    _add(_name, ("customers",),
         """SELECT customer_id, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
            FROM customers WHERE latitude BETWEEN 10.75 AND 10.80 AND longitude BETWEEN 106.65 AND 106.75""")
_add("fl6_rental_report", ("rentals",),
     """SELECT status, CAST(date_trunc('month', rental_date) AS TIMESTAMP) AS month, count(*) AS rental_count,
               CAST(sum(total_amount) AS DOUBLE) AS total_amount
        FROM rentals WHERE rental_date >= TIMESTAMP '1996-01-01' AND rental_date < TIMESTAMP '1999-01-01'
        GROUP BY 1, 2""")
_add("fl7_rentals_of_employee", ("rentals", "customers"),
     """SELECT r.rental_id, r.customer_id, r.employee_id, c.full_name
        FROM rentals r JOIN customers c USING (customer_id) WHERE r.employee_id = 3""")
_add("fl8_items_per_equipment_status", ("rental_items",),
     """SELECT equipment_id, item_status, count(*) AS item_count, CAST(sum(quantity) AS BIGINT) AS units
        FROM rental_items GROUP BY 1, 2""")
_add("fl9_items_of_rentals", ("rental_items", "rentals"),
     """SELECT r.rental_id, count(*) AS item_count, CAST(sum(i.subtotal) AS DOUBLE) AS rent
        FROM rentals r JOIN rental_items i USING (rental_id) WHERE r.status = 'BORROWING' GROUP BY 1""")
_add("fl10_invoices_of_rentals", ("invoices", "rentals"),
     """SELECT i.invoice_id, i.rental_id, i.status, CAST(i.final_amount AS DOUBLE) AS final_amount, r.customer_id
        FROM invoices i JOIN rentals r ON r.rental_id = i.rental_id""")
_add("fl11_unpaid_invoices_by_day", ("invoices",),
     """SELECT CAST(date_trunc('day', invoice_date) AS TIMESTAMP) AS invoice_day, count(*) AS invoice_count,
               CAST(sum(final_amount) AS DOUBLE) AS amount_due
        FROM invoices WHERE status IN ('PENDING', 'PARTIAL') AND invoice_date >= TIMESTAMP '1996-01-01'
          AND invoice_date < TIMESTAMP '1999-01-01' GROUP BY 1""")
_add("fl12_payments_of_invoices", ("payments", "invoices"),
     """SELECT p.invoice_id, p.payment_status, count(*) AS payment_count, CAST(sum(p.amount) AS DOUBLE) AS amount
        FROM payments p JOIN invoices i ON i.invoice_id = p.invoice_id GROUP BY 1, 2""")
_add("fl13_payments_by_date", ("payments",),
     """SELECT payment_id, payment_date, payment_type, CAST(amount AS DOUBLE) AS amount FROM payments
        WHERE payment_date >= TIMESTAMP '1997-01-01' AND payment_date < TIMESTAMP '1998-01-01'
        ORDER BY payment_date, payment_id""")
_add("fl14_log_by_time", ("system_log",),
     """SELECT log_id, action, table_name, action_time FROM system_log
        WHERE action_time >= TIMESTAMP '2024-01-10' AND action_time < TIMESTAMP '2024-01-20'
        ORDER BY action_time DESC, log_id""")
_add("fl15_log_by_table", ("system_log",),
     "SELECT log_id, action, table_name, record_id FROM system_log WHERE table_name = 'RENTALS'")

# ---------------------------------------------------------------- views and reports

_add("vw1_inventory_status", ("inventory", "equipments", "rental_items"),
     """SELECT i.equipment_id, e.equipment_name, e.equipment_type, e.status AS equipment_status,
               CAST(i.total_quantity AS BIGINT) AS total_quantity,
               CAST(coalesce(sum(r.quantity), 0) AS BIGINT) AS borrowed_quantity,
               CAST(i.total_quantity - coalesce(sum(r.quantity), 0) AS BIGINT) AS available_quantity
        FROM inventory i JOIN equipments e ON e.equipment_id = i.equipment_id
        LEFT JOIN rental_items r ON r.equipment_id = i.equipment_id AND r.item_status = 'BORROWING'
        GROUP BY 1, 2, 3, 4, i.total_quantity ORDER BY e.equipment_name""")
_add("vw2_available_equipment", ("inventory", "equipments", "rental_items"),
     """SELECT e.equipment_id, e.equipment_name, e.equipment_type, e.status AS equipment_status,
               CAST(e.rental_price_per_day AS DOUBLE) AS rental_price_per_day,
               CAST(coalesce(i.total_quantity, 0) - coalesce(sum(r.quantity), 0) AS BIGINT) AS available_quantity
        FROM equipments e LEFT JOIN inventory i ON e.equipment_id = i.equipment_id
        LEFT JOIN rental_items r ON r.equipment_id = e.equipment_id AND r.item_status = 'BORROWING'
        WHERE e.status = 'AVAILABLE'
        GROUP BY 1, 2, 3, 4, e.rental_price_per_day, i.total_quantity ORDER BY e.equipment_name""")
_add("vw3_rental_details", ("rentals", "customers", "employees", "rental_items", "equipments"),
     """SELECT r.rental_id, r.rental_code, r.rental_type, r.status AS rental_status,
               CAST(r.total_amount AS DOUBLE) AS total_amount,
               CAST(r.deposit_required AS DOUBLE) AS deposit_required, r.rental_date, r.due_date,
               r.return_date, r.customer_id, c.full_name AS customer_name, r.employee_id,
               e.full_name AS employee_name, i.rental_item_id, q.equipment_id, q.equipment_name,
               CAST(i.quantity AS BIGINT) AS quantity, CAST(i.days AS BIGINT) AS days,
               CAST(i.price_per_day AS DOUBLE) AS price_per_day, CAST(i.subtotal AS DOUBLE) AS subtotal,
               i.item_status
        FROM rentals r JOIN customers c ON c.customer_id = r.customer_id
        JOIN employees e ON e.employee_id = r.employee_id
        LEFT JOIN rental_items i ON i.rental_id = r.rental_id
        LEFT JOIN equipments q ON q.equipment_id = i.equipment_id
        ORDER BY r.rental_date DESC, r.rental_code""")
_add("vw4_invoice_full", ("invoices", "rentals", "payments", "deposits"),
     """SELECT v.invoice_id, v.invoice_number, v.status AS invoice_status, v.rental_id, r.rental_code,
               CAST(v.subtotal_amount AS DOUBLE) AS subtotal_amount, CAST(v.tax_amount AS DOUBLE) AS tax_amount,
               CAST(v.total_amount AS DOUBLE) AS total_amount, CAST(v.deposit_used AS DOUBLE) AS deposit_used,
               CAST(v.final_amount AS DOUBLE) AS final_amount, v.invoice_date, v.payment_due_date,
               CAST(coalesce((SELECT sum(amount) FROM payments p WHERE p.invoice_id = v.invoice_id), 0) AS DOUBLE) AS total_paid,
               CAST(coalesce((SELECT sum(deposit_amount) FROM deposits d WHERE d.rental_id = v.rental_id), 0) AS DOUBLE) AS total_deposit
        FROM invoices v JOIN rentals r ON r.rental_id = v.rental_id ORDER BY v.invoice_date DESC""")
_add("vw5_return_analysis", ("returns", "rental_items", "rentals", "equipments"),
     """SELECT t.return_id, t.return_date, i.rental_item_id, i.rental_id, e.equipment_id, e.equipment_name,
               CAST(i.quantity AS BIGINT) AS quantity, CAST(i.days AS BIGINT) AS days, i.item_status, r.due_date,
               CASE WHEN t.return_date > r.due_date
                    THEN CAST(epoch_us(t.return_date) - epoch_us(r.due_date) AS DOUBLE) / 86400000000.0
                    ELSE 0.0 END AS late_days
        FROM returns t JOIN rental_items i ON i.rental_item_id = t.rental_item_id
        JOIN rentals r ON r.rental_id = i.rental_id JOIN equipments e ON e.equipment_id = i.equipment_id
        ORDER BY t.return_date DESC""")

_add("rp1_equipment_values", ("equipments",),
     f"SELECT equipment_id, equipment_name, {euros('value_cents')} AS equipment_value FROM values_now", VALUES)
_add("fn1_equipment_value", ("equipments",),
     f"SELECT equipment_id, {euros('value_cents')} AS equipment_value FROM values_now", VALUES)
_add("fn2_deposit", ("equipments",),
     f"SELECT equipment_id, {euros('deposit_cents')} AS deposit FROM deposit_now", VALUES)

# late_top / 86400000 is the unrounded late fee: seconds * cents * 15.
LATE = """late AS MATERIALIZED (
    SELECT r.rental_id, r.due_date, x.last_return,
           CASE WHEN x.last_return > r.due_date
                THEN CAST((epoch_us(x.last_return) - epoch_us(r.due_date)) // 1000000 AS HUGEINT)
                     * CAST(coalesce(b.base, 0) * 100 AS HUGEINT) * 15 ELSE 0 END AS late_top
    FROM rentals r
    LEFT JOIN (SELECT i.rental_id, max(t.return_date) AS last_return FROM returns t
               JOIN rental_items i ON i.rental_item_id = t.rental_item_id GROUP BY 1) x
           ON x.rental_id = r.rental_id
    LEFT JOIN (SELECT rental_id, sum(price_per_day * quantity) AS base FROM rental_items GROUP BY 1) b
           ON b.rental_id = r.rental_id)"""
_add("rp2_late_fee_report", ("rentals", "rental_items", "returns"),
     """SELECT rental_id, due_date, last_return, CAST(late_top AS DOUBLE) / 86400000.0 AS late_fee FROM late""",
     LATE)
_add("fn3_late_fee", ("rentals", "rental_items", "returns"),
     "SELECT rental_id, CAST(late_top AS DOUBLE) / 86400000.0 AS late_fee FROM late", LATE)

DAMAGE = f"""damage AS MATERIALIZED (
    SELECT t.return_id, i.rental_id,
           CASE WHEN t.condition_status = 'GOOD' THEN 0
                WHEN t.condition_status = 'LOST' THEN e.value_cents * i.quantity
                WHEN coalesce(t.damage_percent, 0) = 0 THEN 0
                ELSE {half_up("e.value_cents * i.quantity * CAST(t.damage_percent * 100 AS HUGEINT)", "10000")}
           END AS damage_cents
    FROM returns t JOIN rental_items i ON i.rental_item_id = t.rental_item_id
    JOIN values_now e ON e.equipment_id = i.equipment_id)"""
_FEES = ("returns", "rental_items", "equipments")
_add("rp3_damage_fee_report", _FEES,
     f"SELECT return_id, {euros('damage_cents')} AS damage_fee FROM damage", VALUES, DAMAGE)
_add("fn4_damage_fee", _FEES,
     f"SELECT return_id, rental_id, {euros('damage_cents')} AS damage_fee FROM damage", VALUES, DAMAGE)

_RECOMPUTE = """CAST(greatest(s.subtotal + CAST(s.subtotal * s.tax_rate * 0.01 AS DECIMAL(10,2))
                              - coalesce(s.deposit_used, 0), 0) AS DOUBLE)"""


def _parts(tax: str) -> str:
    return f"""parts AS (
        SELECT v.*, t.tax_rate, CAST(coalesce(v.rental_amount, 0) + coalesce(v.late_fee, 0)
               + coalesce(v.damage_fee, 0) + coalesce(v.shipping_fee, 0) AS DECIMAL(10,2)) AS subtotal
        FROM invoices v LEFT JOIN taxes t ON t.tax_id = {tax})"""


_add("rp4_invoice_recomputation", ("invoices", "taxes"),
     f"""SELECT s.invoice_id, {_RECOMPUTE} AS calculated_final,
                CAST(s.final_amount AS DOUBLE) AS final_amount FROM parts s""",
     _parts("v.tax_id"))
_add("fn5_invoice_total", ("invoices", "taxes"),
     f"""SELECT s.invoice_id, CASE WHEN s.tax_rate IS NULL THEN 0.0 ELSE {_RECOMPUTE} END AS calculated_final
         FROM parts s""",
     _parts("CASE v.invoice_id % 3 WHEN 0 THEN 'T0009' WHEN 1 THEN 'T0002' ELSE v.tax_id END"))
_add("rp5_shipping_totals", ("shipments", "rentals"),
     """SELECT r.rental_id, CAST(sum(s.shipping_fee) AS DOUBLE) AS total_shipping_fee
        FROM shipments s JOIN rentals r ON r.rental_id = s.rental_id GROUP BY 1""")
_add("rp6_audit_log", ("system_log",),
     """SELECT log_id, action, table_name, record_id, action_time, description FROM system_log
        ORDER BY action_time DESC""")

SHIPPING = """places AS (
    SELECT r.rental_id, r.rental_type, s.latitude AS lat1, s.longitude AS lon1, c.latitude AS lat2,
           c.longitude AS lon2, s.shop_id, c.customer_id
    FROM rentals r LEFT JOIN shop_info s ON s.shop_id = r.shop_id
    LEFT JOIN customers c ON c.customer_id = r.customer_id),
measured AS (
    SELECT *, CASE WHEN rental_type NOT IN ('PICKUP', 'RETURN') AND lat1 IS NOT NULL AND lon1 IS NOT NULL
                    AND lat2 IS NOT NULL AND lon2 IS NOT NULL
              THEN CAST(6371 * acos(greatest(-1.0, least(1.0,
                   cos(CAST(lat1 AS DOUBLE) * pi() / 180) * cos(CAST(lat2 AS DOUBLE) * pi() / 180)
                   * cos(CAST(lon2 - lon1 AS DOUBLE) * pi() / 180)
                   + sin(CAST(lat1 AS DOUBLE) * pi() / 180) * sin(CAST(lat2 AS DOUBLE) * pi() / 180))))
                   AS DECIMAL(10,2)) END AS km
    FROM places),
shipping AS MATERIALIZED (
    SELECT *, CASE WHEN shop_id IS NULL OR customer_id IS NULL THEN -20023
                   WHEN rental_type = 'PICKUP' THEN NULL
                   WHEN lat1 IS NULL OR lon1 IS NULL THEN -20022
                   WHEN lat2 IS NULL OR lon2 IS NULL THEN -20020
                   WHEN km > 20 THEN -20021 END AS ship_code,
           CASE WHEN rental_type IN ('PICKUP', 'RETURN') THEN 0 WHEN km < 5 THEN 20000
                WHEN km < 10 THEN 50000 ELSE 70000 END AS ship_fee
    FROM measured)"""
_add("fn6_shipping_fee", ("rentals", "shop_info", "customers"),
     f"""SELECT rental_id, CAST(km AS DOUBLE) AS distance_km,
                CASE WHEN ship_code IS NULL THEN CAST(ship_fee AS DOUBLE) END AS shipping_fee,
                CASE WHEN ship_code IS NOT NULL THEN 'shipping_fee' END AS source,
                CAST(ship_code AS BIGINT) AS code, {_message("'shipping_fee'", 'ship_code')} AS message
         FROM shipping""",
     SHIPPING)
_add("fn7_generated_codes", ("rentals",),
     f"""SELECT rental_id, {_code('RC', 'n', 5)} AS rental_code, {_code('RE', 'n', 3)} AS short_code
         FROM (SELECT rental_id, row_number() OVER (ORDER BY rental_id) AS n FROM rentals)""")

# ---------------------------------------------------------------- procedures

_PAIR = """CASE WHEN {m}.equipment_id IS NULL THEN -20042 WHEN {x}.equipment_id IS NULL THEN -20043
     WHEN {m}.category_id <> 'CAT01' THEN -20044
     WHEN {x}.category_id = 'CAT02' AND ({m}.mount_type IS NULL OR {x}.mount_type IS NULL) THEN -20045
     WHEN {x}.category_id = 'CAT02' AND {m}.mount_type <> {x}.mount_type THEN -20046
     WHEN {x}.category_id = 'CAT03' AND {m}.mount_type <> {x}.mount_type THEN -20047 END"""
_add("sp1_check_compatibility", ("compatibility_commands", "equipments"),
     f"""SELECT request_id, main_equipment_id, extra_equipment_id,
                CASE WHEN code IS NOT NULL THEN 'compatibility' END AS source,
                CAST(code AS BIGINT) AS code, {_message("'compatibility'")} AS message
         FROM (SELECT c.*, {_PAIR.format(m='m', x='x')} AS code FROM compatibility_commands c
               LEFT JOIN equipments m ON m.equipment_id = c.main_equipment_id
               LEFT JOIN equipments x ON x.equipment_id = c.extra_equipment_id)""")
_add("sp1_compatible_lens_counts", ("equipments",),
     """SELECT c.equipment_id, c.mount_type, count(l.equipment_id) AS lens_count
        FROM equipments c LEFT JOIN equipments l ON l.category_id = 'CAT02' AND l.mount_type = c.mount_type
        WHERE c.category_id = 'CAT01' GROUP BY 1, 2""")


def _sequential(requests: str, capacity: str) -> str:
    """Serve requests(request_id, equipment_id, quantity) per equipment in id order."""
    return f"""queue AS MATERIALIZED (
        SELECT request_id, equipment_id, quantity,
               row_number() OVER (PARTITION BY equipment_id ORDER BY request_id) AS pos
        FROM ({requests})),
    line AS (
        SELECT equipment_id, CAST(0 AS BIGINT) AS pos, CAST({capacity} AS BIGINT) AS units_left,
               CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS served
        FROM stock
        UNION ALL
        SELECT l.equipment_id, q.pos,
               CASE WHEN q.quantity <= l.units_left THEN l.units_left - q.quantity ELSE l.units_left END,
               q.request_id, q.quantity <= l.units_left
        FROM line l JOIN queue q ON q.equipment_id = l.equipment_id AND q.pos = l.pos + 1),
    answers AS MATERIALIZED (SELECT request_id, served FROM line WHERE request_id IS NOT NULL)"""


_RENT = """requests AS MATERIALIZED (
    SELECT rental_item_id AS request_id, equipment_id,
           CASE WHEN rental_item_id % 47 = 0 THEN 0 WHEN rental_item_id % 53 <> 0 THEN quantity END AS quantity
    FROM rental_items),
stock AS (SELECT * FROM inventory)"""
_RENT_QUEUE = _sequential(
    "SELECT r.* FROM requests r JOIN stock s USING (equipment_id) WHERE r.quantity > 0",
    "available_quantity")
_RENT_DECIDED = """decided AS MATERIALIZED (
    SELECT r.*, CASE WHEN r.quantity <= 0 THEN -20010 WHEN s.equipment_id IS NULL THEN -1403
                     WHEN r.quantity IS NULL THEN -1407 WHEN NOT a.served THEN -20011 END AS code
    FROM requests r LEFT JOIN stock s ON s.equipment_id = r.equipment_id
    LEFT JOIN answers a ON a.request_id = r.request_id)"""
_add("sp2_update_inventory_on_rent", ("rental_items", "inventory"),
     f"""SELECT request_id, equipment_id, CAST(quantity AS BIGINT) AS quantity,
                CASE WHEN code IS NOT NULL THEN 'stock_out' END AS source, CAST(code AS BIGINT) AS code,
                {_message("'stock_out'")} AS message FROM decided""",
     _RENT, _RENT_QUEUE, _RENT_DECIDED)
_add("sp2_inventory_after_rent", ("rental_items", "inventory"),
     f"""SELECT s.equipment_id, CAST(s.total_quantity AS BIGINT) AS total_quantity,
                CAST(s.available_quantity - coalesce(u.units, 0) AS BIGINT) AS available_quantity,
                CAST(s.rented_quantity + coalesce(u.units, 0) AS BIGINT) AS rented_quantity,
                CASE WHEN u.units IS NULL THEN s.last_updated ELSE {NOW} END AS last_updated
         FROM stock s LEFT JOIN (SELECT equipment_id, sum(quantity) AS units FROM decided
                                 WHERE code IS NULL GROUP BY 1) u ON u.equipment_id = s.equipment_id""",
     _RENT, _RENT_QUEUE, _RENT_DECIDED)

_BACK = """known AS MATERIALIZED (
    SELECT c.request_id, c.rental_item_id, c.condition_status, i.equipment_id, i.quantity,
           CASE WHEN c.condition_status NOT IN ('GOOD', 'DAMAGED', 'LOST') THEN -20020
                WHEN i.rental_item_id IS NULL OR s.equipment_id IS NULL THEN -1403 END AS early
    FROM return_item_commands c LEFT JOIN rental_items i ON i.rental_item_id = c.rental_item_id
    LEFT JOIN inventory_half_rented s ON s.equipment_id = i.equipment_id),
stock AS (SELECT * FROM inventory_half_rented)"""
_BACK_QUEUE = _sequential("SELECT request_id, equipment_id, quantity FROM known "
                          "WHERE early IS NULL AND condition_status IS NOT NULL",
                          "rented_quantity")
_BACK_DECIDED = """decided AS MATERIALIZED (
    SELECT k.*, coalesce(early, CASE WHEN NOT a.served THEN -2290 END) AS code
    FROM known k LEFT JOIN answers a ON a.request_id = k.request_id)"""
_BACK_TABLES = ("return_item_commands", "rental_items", "inventory_half_rented")
_add("sp3_update_inventory_on_return", _BACK_TABLES,
     f"""SELECT request_id, rental_item_id, condition_status, equipment_id, CAST(quantity AS BIGINT) AS quantity,
                CASE WHEN code IS NOT NULL THEN 'stock_in' END AS source, CAST(code AS BIGINT) AS code,
                {_message("'stock_in'")} AS message FROM decided""",
     _BACK, _BACK_QUEUE, _BACK_DECIDED)
_add("sp3_inventory_after_return", _BACK_TABLES,
     f"""SELECT s.equipment_id, CAST(s.total_quantity AS BIGINT) AS total_quantity,
                CAST(s.available_quantity + coalesce(u.good, 0) AS BIGINT) AS available_quantity,
                CAST(s.rented_quantity - coalesce(u.good + u.damaged + u.lost, 0) AS BIGINT) AS rented_quantity,
                CAST(s.damaged_quantity + coalesce(u.damaged, 0) AS BIGINT) AS damaged_quantity,
                CAST(s.lost_quantity + coalesce(u.lost, 0) AS BIGINT) AS lost_quantity,
                CASE WHEN u.good IS NULL THEN s.last_updated ELSE {NOW} END AS last_updated
         FROM stock s LEFT JOIN (
             SELECT equipment_id, sum(CASE condition_status WHEN 'GOOD' THEN quantity ELSE 0 END) AS good,
                    sum(CASE condition_status WHEN 'DAMAGED' THEN quantity ELSE 0 END) AS damaged,
                    sum(CASE condition_status WHEN 'LOST' THEN quantity ELSE 0 END) AS lost
             FROM decided WHERE code IS NULL AND condition_status IS NOT NULL GROUP BY 1) u
             ON u.equipment_id = s.equipment_id""",
     _BACK, _BACK_QUEUE, _BACK_DECIDED)

# A main item shares stock only with its one accessory, so requests are served per such pair.
_CREATE_TABLES = ("create_rental_commands", "customers", "equipments", "equipment_accessories", "inventory")
_CREATE = f"""early AS MATERIALIZED (
    SELECT c.*, u.full_name, e.deposit_cents, e.rental_price_per_day AS price,
           CASE WHEN c.customer_confirm = 0 THEN 'create_rental/-20060'
                WHEN u.customer_id IS NULL OR e.equipment_id IS NULL THEN 'create_rental/-20050'
                WHEN c.quantity * c.days * e.rental_price_per_day IS NULL THEN 'create_rental/-1400'
                WHEN c.quantity <= 0 THEN 'item_check/-20040'
                WHEN e.status <> 'AVAILABLE' THEN 'item_available/-20050'
                WHEN v.equipment_id IS NULL THEN 'create_rental/-20050' END AS early,
           a.accessory_id, a.quantity * c.quantity AS extra_units,
           CASE WHEN a.accessory_id IS NULL THEN NULL
                WHEN {_PAIR.format(m='e', x='x')} IS NOT NULL
                THEN 'compatibility/' || CAST({_PAIR.format(m='e', x='x')} AS VARCHAR)
                WHEN x.status <> 'AVAILABLE' THEN 'item_available/-20050'
                WHEN w.equipment_id IS NULL THEN 'create_rental/-20050' END AS late
    FROM create_rental_commands c LEFT JOIN customers u ON u.customer_id = c.customer_id
    LEFT JOIN deposit_now e ON e.equipment_id = c.equipment_id
    LEFT JOIN inventory v ON v.equipment_id = c.equipment_id
    LEFT JOIN equipment_accessories a ON a.equipment_id = c.equipment_id
    LEFT JOIN equipments x ON x.equipment_id = a.accessory_id
    LEFT JOIN inventory w ON w.equipment_id = a.accessory_id),
groups AS (
    SELECT *, equipment_id % 6 = 5 AS is_extra,
           CASE WHEN equipment_id % 6 = 5 THEN equipment_id - 5 ELSE equipment_id END AS pair
    FROM early WHERE early IS NULL),
queue AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY pair ORDER BY rental_date, request_id) AS pos,
           row_number() OVER (ORDER BY rental_date, request_id) AS seq FROM groups),
line AS (
    SELECT p.pair, CAST(0 AS BIGINT) AS pos,
           CAST(coalesce((SELECT available_quantity FROM inventory WHERE equipment_id = p.pair), 0) AS BIGINT) AS main_left,
           CAST(coalesce((SELECT available_quantity FROM inventory WHERE equipment_id = p.pair + 5), 0) AS BIGINT) AS extra_left,
           CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS short, CAST(NULL AS BOOLEAN) AS served
    FROM (SELECT DISTINCT pair FROM queue) p
    UNION ALL
    SELECT pair, pos,
           main_left - CASE WHEN served AND NOT is_extra THEN quantity ELSE 0 END,
           extra_left - CASE WHEN served AND is_extra THEN quantity WHEN served THEN coalesce(extra_units, 0) ELSE 0 END,
           request_id, short, served
    FROM (SELECT *, NOT short AND late IS NULL AS served FROM (
            SELECT l.pair, q.pos, l.main_left, l.extra_left, q.request_id, q.is_extra, q.quantity,
                   q.extra_units, q.late,
                   CASE WHEN q.is_extra THEN q.quantity > l.extra_left
                        WHEN q.quantity > l.main_left THEN TRUE
                        ELSE q.late IS NULL AND coalesce(q.extra_units, 0) > l.extra_left END AS short
            FROM line l JOIN queue q ON q.pair = l.pair AND q.pos = l.pos + 1))),
answers AS MATERIALIZED (SELECT request_id, short, served FROM line WHERE request_id IS NOT NULL),
verdicts AS MATERIALIZED (
    SELECT e.*, coalesce(e.early, CASE WHEN a.short THEN 'stock_out/-20011' END, e.late) AS verdict
    FROM early e LEFT JOIN answers a ON a.request_id = e.request_id),
made AS MATERIALIZED (
    SELECT v.*, row_number() OVER (ORDER BY rental_date, request_id) AS n FROM verdicts v WHERE verdict IS NULL)"""
_add("sp4_create_rental", _CREATE_TABLES,
     f"""SELECT request_id, equipment_id, source, code,
                CASE WHEN source IS NULL THEN {_code('RE', 'n', 3)} END AS rental_id,
                CASE WHEN source IS NULL THEN {_code('RC', 'n', 5)} END AS rental_code,
                CASE WHEN source IS NULL THEN CAST(quantity * days * price AS DOUBLE) END AS total_amount,
                CASE WHEN source IS NULL THEN {euros('deposit_cents * quantity')} END AS deposit_required,
                CASE WHEN source IS NULL THEN full_name END AS customer_name, {_message()} AS message
         FROM (SELECT request_id, equipment_id, quantity, days, price, deposit_cents, full_name,
                      split_part(verdict, '/', 1) AS source, CAST(split_part(verdict, '/', 2) AS BIGINT) AS code,
                      row_number() OVER (PARTITION BY verdict IS NULL ORDER BY rental_date, request_id) AS n
               FROM verdicts)""",
     VALUES, _CREATE)
_add("sp4_create_rental_items", _CREATE_TABLES,
     f"""SELECT {_code('RI', 'k', 3)} AS rental_item_id, {_code('RE', 'n', 3)} AS rental_id, equipment_id,
                CAST(quantity AS BIGINT) AS quantity, CAST(days AS BIGINT) AS days,
                CAST(price AS DOUBLE) AS price_per_day, CAST(quantity * days * price AS DOUBLE) AS subtotal,
                'BORROWING' AS item_status
         FROM (SELECT *, row_number() OVER (ORDER BY n, kind) AS k FROM (
               SELECT n, 0 AS kind, equipment_id, quantity, days, price FROM made
               UNION ALL SELECT n, 1, accessory_id, extra_units, days, 0 FROM made WHERE accessory_id IS NOT NULL))""",
     VALUES, _CREATE)
_add("sp4_inventory_after_create", _CREATE_TABLES,
     """SELECT i.equipment_id, CAST(i.total_quantity AS BIGINT) AS total_quantity,
               CAST(i.available_quantity - coalesce(u.units, 0) AS BIGINT) AS available_quantity,
               CAST(i.rented_quantity + coalesce(u.units, 0) AS BIGINT) AS rented_quantity
        FROM inventory i LEFT JOIN (
            SELECT equipment_id, sum(quantity) AS units FROM (
                SELECT equipment_id, quantity FROM made
                UNION ALL SELECT accessory_id, extra_units FROM made WHERE accessory_id IS NOT NULL)
            GROUP BY 1) u ON u.equipment_id = i.equipment_id""",
     VALUES, _CREATE)

_PICKUP = """decided AS MATERIALIZED (
    SELECT c.request_id, c.rental_id,
           CASE WHEN r.rental_id IS NULL OR r.status NOT IN ('CREATED', 'CONFIRMED')
                  OR row_number() OVER (PARTITION BY c.rental_id ORDER BY c.request_id) > 1
                THEN -20001 END AS code
    FROM rental_commands c LEFT JOIN rentals r ON r.rental_id = c.rental_id)"""
_add("sp6_confirm_pickup", ("rental_commands", "rentals"),
     f"""SELECT request_id, rental_id, CASE WHEN code IS NOT NULL THEN 'confirm_pickup' END AS source,
                CAST(code AS BIGINT) AS code, {_message("'confirm_pickup'")} AS message FROM decided""",
     _PICKUP)
_add("sp6_rentals_after_pickup", ("rental_commands", "rentals"),
     f"""SELECT r.rental_id, CASE WHEN d.rental_id IS NULL THEN r.status ELSE 'BORROWING' END AS status,
                CAST(CASE WHEN d.rental_id IS NULL THEN r.customer_confirmed ELSE 1 END AS BIGINT) AS customer_confirmed,
                CASE WHEN d.rental_id IS NULL THEN r.confirmed_at ELSE {NOW} END AS confirmed_at,
                CASE WHEN d.rental_id IS NULL THEN r.start_date ELSE {NOW} END AS start_date
         FROM rentals r LEFT JOIN decided d ON d.rental_id = r.rental_id AND d.code IS NULL""",
     _PICKUP)
_add("sp6_pickup_media", ("rental_commands", "rentals", "rental_items"),
     f"""SELECT {_code('MD', 'n', 5)} AS media_id, rental_item_id, 'IMAGE' AS media_type,
                'placeholder_before_delivery.jpg' AS media_path, 'BEFORE_DELIVERY' AS capture_stage,
                {NOW} AS created_at
         FROM (SELECT i.rental_item_id, row_number() OVER (ORDER BY i.rental_item_id) AS n
               FROM rental_items i JOIN decided d ON d.rental_id = i.rental_id AND d.code IS NULL)""",
     _PICKUP)

_add("sp6_items_after_pickup", ("rental_commands", "rentals", "rental_items"),
     """SELECT i.rental_item_id, i.rental_id,
               CASE WHEN d.rental_id IS NULL THEN i.item_status ELSE 'BORROWING' END AS item_status
        FROM rental_items i LEFT JOIN decided d ON d.rental_id = i.rental_id AND d.code IS NULL""",
     _PICKUP)

_INVOICE_TABLES = ("rental_commands", "rentals", "rental_items", "returns", "equipments", "shop_info",
                   "customers", "deposits", "taxes")
CHARGES = f"""{VALUES}, {LATE}, {DAMAGE}, {SHIPPING},
rents AS (SELECT rental_id, sum(subtotal) AS rent FROM rental_items GROUP BY 1),
damages AS (SELECT rental_id, sum(damage_cents) AS damage_cents FROM damage GROUP BY 1),
held AS (SELECT rental_id, sum(deposit_amount) AS held FROM deposits GROUP BY 1),
tax AS (SELECT tax_id, tax_rate FROM taxes WHERE is_active = 1
        AND {NOW} BETWEEN effective_from AND effective_to ORDER BY effective_from DESC, tax_id LIMIT 1),
charged AS MATERIALIZED (
    SELECT r.rental_id, r.status, s.ship_code,
           CAST(coalesce(n.rent, 0) * 100 AS HUGEINT) AS rent_cents,
           {half_up('l.late_top', '864000')} AS late_cents,
           coalesce(d.damage_cents, 0) AS damage_cents, CAST(s.ship_fee * 100 AS HUGEINT) AS ship_cents,
           CAST(coalesce(h.held, 0) * 100 AS HUGEINT) AS held_cents,
           t.tax_id, CAST(t.tax_rate * 100 AS HUGEINT) AS tax_points
    FROM rentals r JOIN late l ON l.rental_id = r.rental_id JOIN shipping s ON s.rental_id = r.rental_id
    LEFT JOIN rents n ON n.rental_id = r.rental_id LEFT JOIN damages d ON d.rental_id = r.rental_id
    LEFT JOIN held h ON h.rental_id = r.rental_id LEFT JOIN tax t ON TRUE),
summed AS (SELECT *, rent_cents + late_cents + damage_cents + ship_cents AS sub_cents FROM charged),
priced AS MATERIALIZED (
    SELECT *, {half_up('sub_cents * tax_points', '10000')} AS tax_cents FROM summed)"""
# Amounts of more than eight digits before the point cannot be stored.
_PRICE_VERDICT = """CASE
    WHEN greatest(p.rent_cents, p.late_cents, p.damage_cents) >= 10000000000 THEN 'precision/-6502'
    WHEN p.ship_code IS NOT NULL THEN 'shipping_fee/' || CAST(p.ship_code AS VARCHAR)
    WHEN greatest(p.held_cents, p.sub_cents) >= 10000000000 THEN 'precision/-6502'
    WHEN p.tax_id IS NULL THEN 'create_invoice/-1403'
    WHEN p.sub_cents + p.tax_cents >= 10000000000 THEN 'precision/-6502' END"""
_INVOICE_DECIDED = f"""verdicts AS (
    SELECT c.request_id, c.rental_id AS asked_id, p.*,
           CASE WHEN p.rental_id IS NULL THEN 'create_invoice/-20001'
                WHEN p.status NOT IN ('BORROWING', 'OVERDUE', 'RETURNED') THEN 'create_invoice/-20002'
                ELSE {_PRICE_VERDICT} END AS verdict
    FROM rental_commands c LEFT JOIN priced p ON p.rental_id = c.rental_id),
decided AS MATERIALIZED (
    SELECT *, split_part(verdict, '/', 1) AS source, CAST(split_part(verdict, '/', 2) AS BIGINT) AS code
    FROM verdicts)"""
_AMOUNTS = f"""{euros('rent_cents')} AS rental_amount, {euros('late_cents')} AS late_fee,
    {euros('damage_cents')} AS damage_fee, {euros('ship_cents')} AS shipping_fee,
    {euros('sub_cents')} AS subtotal_amount, {euros('tax_cents')} AS tax_amount,
    {euros('sub_cents + tax_cents')} AS total_amount, {euros('held_cents')} AS deposit_used,
    {euros('greatest(sub_cents + tax_cents - held_cents, 0)')} AS final_amount, tax_id"""
_AMOUNT_NAMES = ("rental_amount", "late_fee", "damage_fee", "shipping_fee", "subtotal_amount", "tax_amount",
                 "total_amount", "deposit_used", "final_amount", "tax_id")
_add("sp7_create_invoice", _INVOICE_TABLES,
     "SELECT request_id, asked_id AS rental_id, "
     + ", ".join(f"CASE WHEN code IS NULL THEN {n} END AS {n}" for n in _AMOUNT_NAMES)
     + f", source, CAST(code AS BIGINT) AS code, {_message()} AS message"
     + f" FROM (SELECT request_id, asked_id, source, code, {_AMOUNTS} FROM decided)",
     CHARGES, _INVOICE_DECIDED)
_add("sp7_invoice_rows", _INVOICE_TABLES,
     f"""SELECT {_code('IN', 'n', 3)} AS invoice_id, {_code('INV', 'n', 5)} AS invoice_number,
                'PENDING' AS status, {_AMOUNTS}, {NOW} AS invoice_date,
                {NOW} + INTERVAL 7 DAY AS payment_due_date, {NOW} AS created_at, 'FINAL' AS invoice_type,
                rental_id
         FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM decided WHERE code IS NULL)""",
     CHARGES, _INVOICE_DECIDED)

_add("sp8_pay_invoice", _PAY,
     f"""SELECT request_id, invoice_id, CASE WHEN code IS NULL THEN rental_id END AS rental_id, payment_method,
                CASE WHEN code IS NULL THEN CAST(final_amount AS DOUBLE) END AS amount,
                CASE WHEN code IS NOT NULL THEN 'pay_invoice' END AS source,
                CAST(code AS BIGINT) AS code, {_message("'pay_invoice'")} AS message FROM decided""",
     _PAY_DECIDED)
_add("sp8_payment_rows", _PAY,
     f"""SELECT {_code('PM', 'n', 5)} AS payment_id, {_code('TX', 'n', 5)} AS transaction_code, payment_method,
                'RENTAL' AS payment_type, 'COMPLETED' AS payment_status, CAST(final_amount AS DOUBLE) AS amount,
                {NOW} AS payment_date, {NOW} AS created_at, invoice_id, rental_id
         FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM decided WHERE code IS NULL)""",
     _PAY_DECIDED)

# Refunds in units of 1/864000 cent, so that nothing is rounded before the status is decided.
_REFUND = f"""refunded AS MATERIALIZED (
    SELECT d.deposit_id, d.rental_id, d.deposit_amount,
           CAST(d.deposit_amount * 100 AS HUGEINT) * 864000 AS whole,
           CAST(d.deposit_amount * 100 AS HUGEINT) * 864000 - coalesce(l.late_top, 0)
               - coalesce(x.damage_cents, 0) * 864000 AS rest
    FROM deposits d LEFT JOIN late l ON l.rental_id = d.rental_id
    LEFT JOIN (SELECT rental_id, sum(damage_cents) AS damage_cents FROM damage GROUP BY 1) x
           ON x.rental_id = d.rental_id
    WHERE d.status IN ('HELD', 'USED') AND d.rental_id IN (SELECT rental_id FROM rental_commands)),
refund AS MATERIALIZED (
    SELECT *, {half_up('greatest(rest, 0)', '864000')} AS refund_cents,
           CASE WHEN greatest(rest, 0) = whole THEN 'REFUNDED' ELSE 'PARTIAL_REFUND' END AS status
    FROM refunded)"""
_REFUND_TABLES = ("rental_commands", "deposits", "rentals", "rental_items", "returns", "equipments")
_add("sp9_process_refund", _REFUND_TABLES,
     f"""SELECT *, {_message()} AS message FROM (
         SELECT c.request_id, f.deposit_id, c.rental_id, CAST(f.deposit_amount AS DOUBLE) AS deposit_amount,
                {euros('f.refund_cents')} AS refund_amount, f.status,
                CASE WHEN f.deposit_id IS NOT NULL THEN {NOW} END AS refund_date,
                CASE WHEN f.deposit_id IS NULL THEN 'process_refund' END AS source,
                CAST(CASE WHEN r.rental_id IS NULL THEN -20001 WHEN f.deposit_id IS NULL THEN -1403 END AS BIGINT) AS code
         FROM (SELECT *, row_number() OVER (PARTITION BY rental_id ORDER BY request_id) AS turn FROM rental_commands) c
         LEFT JOIN rentals r ON r.rental_id = c.rental_id
         LEFT JOIN refund f ON f.rental_id = c.rental_id AND c.turn = 1)""",
     VALUES, LATE, DAMAGE, _REFUND)
_add("sp9_refund_payment_rows", _REFUND_TABLES,
     f"""SELECT {_code('P', 'n', 4)} AS payment_id, {_code('TX', 'n', 5)} AS transaction_code,
                'CASH' AS payment_method, 'REFUND' AS payment_type, 'COMPLETED' AS payment_status,
                {euros('refund_cents')} AS amount, {NOW} AS payment_date, rental_id
         FROM (SELECT *, row_number() OVER (ORDER BY deposit_id) AS n FROM refund)""",
     VALUES, LATE, DAMAGE, _REFUND)

# In this stock every running unit is accounted for, so no completion overdraws it.
_COMPLETE_TABLES = (*_INVOICE_TABLES, "inventory_running", "invoices")
_COMPLETE = f"""decided AS MATERIALIZED (
    SELECT c.request_id, c.rental_id AS asked_id, p.*,
           CASE WHEN p.rental_id IS NULL THEN 'complete_rental/-20001'
                WHEN p.status NOT IN ('BORROWING', 'OVERDUE') THEN 'complete_rental/-20002'
                WHEN EXISTS (SELECT 1 FROM rental_items i LEFT JOIN inventory_running v
                             ON v.equipment_id = i.equipment_id
                             WHERE i.rental_id = c.rental_id AND v.equipment_id IS NULL) THEN 'stock_in/-1403'
                WHEN {_PRICE_VERDICT} IS NOT NULL THEN {_PRICE_VERDICT}
                WHEN row_number() OVER (PARTITION BY c.rental_id ORDER BY c.request_id) > 1
                THEN 'complete_rental/-20002'
           END AS verdict
    FROM rental_commands c LEFT JOIN priced p ON p.rental_id = c.rental_id)"""
_add("sp10_complete_rental", _COMPLETE_TABLES,
     f"""SELECT *, {_message()} AS message FROM (
         SELECT request_id, asked_id AS rental_id,
                CASE WHEN verdict IS NULL
                     THEN {euros('greatest(sub_cents + tax_cents - held_cents, 0)')} END AS final_amount,
                split_part(verdict, '/', 1) AS source, CAST(split_part(verdict, '/', 2) AS BIGINT) AS code
         FROM decided)""",
     CHARGES, _COMPLETE)
_add("sp10_rentals_after_complete", _COMPLETE_TABLES,
     f"""SELECT r.rental_id, CASE WHEN d.asked_id IS NULL THEN r.status ELSE 'RETURNED' END AS status,
                CASE WHEN d.asked_id IS NULL THEN r.return_date ELSE {NOW} END AS return_date,
                CASE WHEN d.asked_id IS NULL THEN r.updated_at ELSE {NOW} END AS updated_at
         FROM rentals r LEFT JOIN decided d ON d.asked_id = r.rental_id AND d.verdict IS NULL""",
     CHARGES, _COMPLETE)
_add("sp10_items_after_complete", _COMPLETE_TABLES,
     """SELECT i.rental_item_id, i.rental_id,
               CASE WHEN d.asked_id IS NULL THEN i.item_status ELSE 'RETURNED' END AS item_status
        FROM rental_items i LEFT JOIN decided d ON d.asked_id = i.rental_id AND d.verdict IS NULL""",
     CHARGES, _COMPLETE)
_add("sp10_invoice_rows", _COMPLETE_TABLES,
     f"""SELECT {_code('IN', 'n', 3)} AS invoice_id, {_code('INV', 'n', 5)} AS invoice_number,
                'PENDING' AS status, {_AMOUNTS}, {NOW} AS invoice_date,
                {NOW} + INTERVAL 7 DAY AS payment_due_date, {NOW} AS created_at, 'FINAL' AS invoice_type,
                rental_id
         FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM decided d WHERE verdict IS NULL
               AND NOT EXISTS (SELECT 1 FROM invoices x WHERE x.rental_id = d.asked_id AND x.invoice_type = 'FINAL'))""",
     CHARGES, _COMPLETE)
_add("sp10_inventory_after_complete", _COMPLETE_TABLES,
     """SELECT v.equipment_id, CAST(v.total_quantity AS BIGINT) AS total_quantity,
               CAST(v.available_quantity + coalesce(u.units, 0) AS BIGINT) AS available_quantity,
               CAST(v.rented_quantity - coalesce(u.units, 0) AS BIGINT) AS rented_quantity
        FROM inventory_running v LEFT JOIN (
            SELECT i.equipment_id, sum(i.quantity) AS units FROM rental_items i
            JOIN decided d ON d.asked_id = i.rental_id AND d.verdict IS NULL GROUP BY 1) u
          ON u.equipment_id = v.equipment_id""",
     CHARGES, _COMPLETE)

# ---------------------------------------------------------------- triggers

_ITEMS = f"""arriving AS MATERIALIZED (
    SELECT i.rental_item_id, i.rental_id, i.equipment_id,
           CASE WHEN i.rental_item_id % 47 = 0 THEN 0 ELSE i.quantity END AS quantity, i.days,
           CASE WHEN i.rental_item_id % 43 <> 0 THEN i.price_per_day END AS price_per_day,
           CASE WHEN i.rental_item_id % 41 = 0 THEN 'BROKEN' ELSE i.item_status END AS item_status,
           e.equipment_type, e.status, e.category_id, e.mount_type
    FROM rental_items i JOIN equipments e ON e.equipment_id = i.equipment_id),
later AS MATERIALIZED (
    SELECT *, CASE WHEN quantity <= 0 THEN 'item_check/-20040'
                   WHEN price_per_day IS NULL THEN 'item_check/-20041'
                   WHEN item_status = 'BROKEN' THEN 'item_check/-20042'
                   WHEN status <> 'AVAILABLE' THEN 'item_available/-20050' END AS late
    FROM arriving),
firsts AS MATERIALIZED (
    SELECT * FROM later WHERE late IS NULL
    QUALIFY row_number() OVER (PARTITION BY rental_id ORDER BY rental_item_id) = 1),
seconds AS MATERIALIZED (
    SELECT x.* FROM later x JOIN firsts m ON m.rental_id = x.rental_id
    WHERE x.late IS NULL AND x.equipment_id <> m.equipment_id
      AND (x.equipment_type = 'MAIN' OR {_PAIR.format(m='m', x='x')} IS NULL)
    QUALIFY row_number() OVER (PARTITION BY x.rental_id ORDER BY x.rental_item_id) = 1),
mains AS MATERIALIZED (
    SELECT x.*, CASE WHEN m.rental_item_id < x.rental_item_id AND m.equipment_id <> x.equipment_id
                     THEN m.equipment_id
                     WHEN s.rental_item_id < x.rental_item_id AND s.equipment_id <> x.equipment_id
                     THEN s.equipment_id END AS main_id
    FROM later x LEFT JOIN firsts m ON m.rental_id = x.rental_id
    LEFT JOIN seconds s ON s.rental_id = x.rental_id)"""
_add("tr1_check_new_items", ("rental_items", "equipments"),
     f"""SELECT rental_item_id, rental_id, equipment_id,
                CASE WHEN verdict IS NULL THEN CAST(quantity * days * price_per_day AS DOUBLE) END AS subtotal,
                source, code, {_message()} AS message
         FROM (SELECT *, split_part(verdict, '/', 1) AS source, CAST(split_part(verdict, '/', 2) AS BIGINT) AS code
               FROM (SELECT x.*, coalesce(CASE WHEN x.equipment_type = 'ACCESSORY' AND x.main_id IS NOT NULL
                            THEN 'compatibility/' || CAST({_PAIR.format(m='m', x='x')} AS VARCHAR) END, x.late) AS verdict
                     FROM mains x LEFT JOIN equipments m ON m.equipment_id = x.main_id))""",
     _ITEMS)

# Stored items come before all that arrive, are sound whatever they hold, and are not judged again.
_MORE_ITEMS = f"""arriving AS MATERIALIZED (
    SELECT i.rental_item_id, i.rental_id, i.equipment_id, abs(i.rental_item_id) % 2 AS fresh,
           CASE WHEN abs(i.rental_item_id) % 2 = 1 AND i.rental_item_id % 47 = 0 THEN 0 ELSE i.quantity END AS quantity, i.days,
           CASE WHEN abs(i.rental_item_id) % 2 = 0 OR i.rental_item_id % 43 <> 0 THEN i.price_per_day END AS price_per_day,
           CASE WHEN i.rental_item_id % 41 = 0 THEN 'BROKEN' ELSE i.item_status END AS item_status,
           e.equipment_type, e.status, e.category_id, e.mount_type
    FROM rental_items i JOIN equipments e ON e.equipment_id = i.equipment_id),
later AS MATERIALIZED (
    SELECT *, CASE WHEN fresh = 0 THEN NULL WHEN quantity <= 0 THEN 'item_check/-20040'
                   WHEN price_per_day IS NULL THEN 'item_check/-20041'
                   WHEN item_status = 'BROKEN' THEN 'item_check/-20042'
                   WHEN status <> 'AVAILABLE' THEN 'item_available/-20050' END AS late
    FROM arriving),
firsts AS MATERIALIZED (
    SELECT * FROM later WHERE late IS NULL
    QUALIFY row_number() OVER (PARTITION BY rental_id ORDER BY fresh, rental_item_id) = 1),
seconds AS MATERIALIZED (
    SELECT x.* FROM later x JOIN firsts m ON m.rental_id = x.rental_id
    WHERE x.late IS NULL AND x.equipment_id <> m.equipment_id
      AND (x.fresh = 0 OR x.equipment_type = 'MAIN' OR {_PAIR.format(m='m', x='x')} IS NULL)
    QUALIFY row_number() OVER (PARTITION BY x.rental_id ORDER BY x.fresh, x.rental_item_id) = 1),
mains AS MATERIALIZED (
    SELECT x.*, CASE WHEN (m.fresh, m.rental_item_id) < (x.fresh, x.rental_item_id) AND m.equipment_id <> x.equipment_id
                     THEN m.equipment_id
                     WHEN (s.fresh, s.rental_item_id) < (x.fresh, x.rental_item_id) AND s.equipment_id <> x.equipment_id
                     THEN s.equipment_id END AS main_id
    FROM later x LEFT JOIN firsts m ON m.rental_id = x.rental_id
    LEFT JOIN seconds s ON s.rental_id = x.rental_id
    WHERE x.fresh = 1)"""
_add("tr1_check_second_batch", ("rental_items", "equipments"),
     f"""SELECT rental_item_id, rental_id, equipment_id,
                CASE WHEN verdict IS NULL THEN CAST(quantity * days * price_per_day AS DOUBLE) END AS subtotal,
                source, code, {_message()} AS message
         FROM (SELECT *, split_part(verdict, '/', 1) AS source, CAST(split_part(verdict, '/', 2) AS BIGINT) AS code
               FROM (SELECT x.*, coalesce(CASE WHEN x.equipment_type = 'ACCESSORY' AND x.main_id IS NOT NULL
                            THEN 'compatibility/' || CAST({_PAIR.format(m='m', x='x')} AS VARCHAR) END, x.late) AS verdict
                     FROM mains x LEFT JOIN equipments m ON m.equipment_id = x.main_id))""",
     _MORE_ITEMS)


def _log(table: str, thing: str, label: str, key: str) -> str:
    return f"""CASE abs({key}) % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS action,
        '{table.upper()}' AS table_name, CAST({key} AS VARCHAR) AS record_id, {NOW} AS action_time,
        CASE abs({key}) % 3 WHEN 0 THEN 'Inserted' WHEN 1 THEN 'Updated' ELSE 'Deleted' END
            || ' {thing} ' || CAST({label} AS VARCHAR) AS description"""


def _guarded(name: str, table: str, thing: str, label: str, key: str, source: str,
             guards: tuple[tuple[str, int], ...]) -> None:
    code = "CASE " + " ".join(
        f"WHEN abs(t.{key}) % 3 = 2 AND EXISTS (SELECT 1 FROM {c} x WHERE x.{key} = t.{key}) THEN {n}"
        for c, n in guards) + " END"
    _add(name, (table, *[c for c, _ in guards]),
         f"""SELECT action, table_name, record_id, action_time, description,
                    CASE WHEN code IS NOT NULL THEN '{source}' END AS source, CAST(code AS BIGINT) AS code,
                    {_message(f"'{source}'")} AS message
             FROM (SELECT {_log(table, thing, f't.{label}', f't.{key}')}, {code} AS code FROM {table} t)""")


_guarded("tr2_audit_customers", "customers", "customer", "username", "customer_id", "customer_delete",
         (("rentals", -20060),))
_guarded("tr3_audit_equipments", "equipments", "equipment", "equipment_name", "equipment_id",
         "equipment_delete", (("rental_items", -20061),))
_guarded("tr4_audit_rentals", "rentals", "rental", "rental_code", "rental_id", "rental_delete",
         (("rental_items", -20062), ("invoices", -20063)))
_add("tr5_audit_rental_items", ("rental_items",),
     f"SELECT {_log('rental_items', 'rental item', 'equipment_id', 'rental_item_id')} FROM rental_items")
_add("tr6_audit_invoices", ("invoices",),
     f"SELECT {_log('invoices', 'invoice', 'invoice_number', 'invoice_id')} FROM invoices")

_STATUS = """statuses AS (
    SELECT e.equipment_id, e.status AS old_status,
           CASE WHEN EXISTS (SELECT 1 FROM rental_items i WHERE i.equipment_id = e.equipment_id
                             AND i.item_status = 'BORROWING') THEN 'MAINTENANCE'
                WHEN EXISTS (SELECT 1 FROM rental_items i WHERE i.equipment_id = e.equipment_id
                             AND i.item_status IN ('DAMAGED', 'LOST')) THEN 'DISABLED'
                ELSE 'AVAILABLE' END AS new_status
    FROM equipments e
    WHERE e.equipment_id IN (SELECT equipment_id FROM rental_items WHERE item_status <> 'BORROWING'))"""
_add("tr7_equipment_status", ("rental_items", "equipments"), "SELECT * FROM statuses", _STATUS)
_add("rp7_equipment_status_before_after", ("rental_items", "equipments"),
     "SELECT * FROM statuses WHERE old_status <> new_status", _STATUS)
_add("tr7_status_log", ("rental_items", "equipments"),
     f"""SELECT 'UPDATE' AS action, 'EQUIPMENTS' AS table_name, CAST(i.equipment_id AS VARCHAR) AS record_id,
                {NOW} AS action_time,
                'Updated equipment status to ' || s.new_status || ' due to rental item '
                || CAST(i.rental_item_id AS VARCHAR) || ' changed from BORROWING to ' || i.item_status AS description, '{CLIENT}' AS ip_address
         FROM rental_items i JOIN statuses s ON s.equipment_id = i.equipment_id
         WHERE i.item_status <> 'BORROWING'""",
     _STATUS)
_add("tr8_equipment_available", ("rental_items", "equipments"),
     f"""SELECT i.rental_item_id, i.equipment_id, e.status AS equipment_status,
                CASE WHEN e.status <> 'AVAILABLE' THEN 'item_available' END AS source,
                CAST(CASE WHEN e.status <> 'AVAILABLE' THEN -20050 END AS BIGINT) AS code,
                CASE WHEN e.status <> 'AVAILABLE' THEN '{REFUSALS["item_available", -20050]} '
                     || CAST(i.equipment_id AS VARCHAR) || '. Status: ' || e.status END AS message
         FROM rental_items i JOIN equipments e ON e.equipment_id = i.equipment_id""")
_add("tr9_rental_totals", ("rentals", "rental_items"),
     """SELECT r.rental_id, CAST(coalesce(sum(i.subtotal), 0) AS DOUBLE) AS total_amount
        FROM rentals r LEFT JOIN rental_items i ON i.rental_id = r.rental_id GROUP BY 1""")

for _name, _table, _key, _codes in ID_TRIGGERS:
    _parts_sql = [f"{_key} AS arrival"]
    for _every, (_column, (_prefix, _pad)) in zip((4, 5), _codes.items()):
        _n = f"sum(CASE WHEN {_key} % {_every} <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY {_key})"
        _kept = f"WHEN {_key} % {_every} = 0 THEN CAST({_column} AS VARCHAR)"
        _parts_sql.append(f"CASE {_kept} ELSE {_code(_prefix, f'CAST({_n} AS BIGINT)', _pad)} END AS {_column}")
    _add(_name, (_table,), f"SELECT {', '.join(_parts_sql)} FROM {_table}")

# ---------------------------------------------------------------- data quality


def _broken(table: str) -> str:
    """The table with the broken values in place, under the name bad_<table>."""
    swaps = BROKEN.get(table)
    replace = " REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in swaps.items()) + ")" if swaps else ""
    return f"bad_{table} AS MATERIALIZED (SELECT *{replace} FROM {table})"


def _key(table: str) -> str:
    return " || '/' || ".join(
        f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in schemas.PRIMARY_KEYS[table])


def _violations(rule: str, table: str, detail: str, where: str, key: str | None = None) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{table}' AS table_name, {key or _key(table)} AS key,
               coalesce(CAST({detail} AS VARCHAR), 'NULL') AS detail FROM bad_{table} WHERE {where}"""


def _quality(name: str, selects: list[str], tables: list[str]) -> None:
    wanted = tuple(dict.fromkeys(tables))
    _add(name, wanted, " UNION ALL ".join(selects), *[_broken(t) for t in wanted])


_quality(
    "dq1_primary_keys",
    [
        f"""SELECT 'pk:{t}' AS rule_id, '{t}' AS table_name, {_key(t)} AS key, CAST(count(*) AS VARCHAR) AS detail
            FROM bad_{t} GROUP BY {', '.join(k)} HAVING count(*) > 1 OR {' OR '.join(f'{c} IS NULL' for c in k)}"""
        for t, k in schemas.PRIMARY_KEYS.items()
    ],
    list(schemas.TABLES),
)
_quality(
    "dq2_unique",
    [
        f"""SELECT 'unique:{t}.{c}' AS rule_id, '{t}' AS table_name, CAST({c} AS VARCHAR) AS key,
                   CAST(count(*) AS VARCHAR) AS detail
            FROM bad_{t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"""
        for t, c in schemas.UNIQUE
    ],
    [t for t, _ in schemas.UNIQUE],
)
_quality(
    "dq3_foreign_keys",
    [
        _violations(f"fk:{t}.{c}", t, c,
                    f"{c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM bad_{p} WHERE {k} IS NOT NULL)")
        for t, c, p, k in schemas.FOREIGN_KEYS
    ],
    [n for t, _, p, _ in schemas.FOREIGN_KEYS for n in (t, p)],
)
_quality(
    "dq4_not_null",
    [
        _violations(f"null:{t}.{c.name}", t, "'NULL'", f"{c.name} IS NULL")
        for t in schemas.TABLES
        for c in schemas.columns(t)
        if c.required and c.name not in schemas.PRIMARY_KEYS[t]
    ],
    list(schemas.TABLES),
)
_quality(
    "dq5_enumerations",
    [
        _violations(f"enum:{t}.{c}", t, c, f"{c} NOT IN ({', '.join(repr(x) for x in v)})")
        for t, c, v in schemas.ENUMS
    ],
    [t for t, _, _ in schemas.ENUMS],
)
_quality(
    "dq6_flags",
    [_violations(f"flag:{t}.{c}", t, c, f"{c} NOT IN (0, 1)") for t, c in schemas.FLAGS],
    [t for t, _ in schemas.FLAGS],
)
_quality(
    "dq7_ranges",
    [_violations(f"range:{t}.{n}", t, s, f"NOT ({h})") for t, n, s, h in schemas.RANGES],
    [t for t, _, _, _ in schemas.RANGES],
)
_quality(
    "dq8_payment_references",
    [_violations("reference:payments", "payments", "payment_type", f"NOT ({schemas.PAYMENT_REFERENCE})")],
    ["payments"],
)
_quality(
    "dq9_bucket_sums",
    [_violations("sum:inventory", "inventory", "total_quantity", f"NOT ({schemas.BUCKET_SUM})")],
    ["inventory"],
)

# ---------------------------------------------------------------- settlement and streams

_add("st1_overdue_rentals", ("rentals",),
     f"""SELECT rental_id, rental_code, customer_id, due_date FROM rentals
         WHERE status = 'BORROWING' AND due_date < {NOW}""")
_add("st2_deposit_settlement", (*_REFUND_TABLES, "invoices"),
     f"""SELECT d.rental_id, CAST(d.deposit_amount AS DOUBLE) AS deposit_amount, CAST(b.total AS DOUBLE) AS invoice_total,
                CAST(least(d.deposit_amount, b.total) AS DOUBLE) AS deducted,
                CAST(greatest(d.deposit_amount - b.total, 0) AS DOUBLE) AS refund,
                CAST(greatest(b.total - d.deposit_amount, 0) AS DOUBLE) AS extra_charge,
                CAST(b.used AS DOUBLE) AS deposit_used, {euros('coalesce(f.refund_cents, 0)')} AS refunded_by_rule,
                {euros('greatest(CAST((b.used - d.deposit_amount) * 100 AS HUGEINT) + coalesce(f.refund_cents, 0), 0)')} AS counted_twice
         FROM deposits d
         JOIN (SELECT rental_id, sum(total_amount) AS total, sum(coalesce(deposit_used, 0)) AS used
               FROM invoices WHERE invoice_type = 'FINAL' GROUP BY 1) b ON b.rental_id = d.rental_id
         LEFT JOIN refund f ON f.rental_id = d.rental_id""",
     VALUES, LATE, DAMAGE, _REFUND)
_add("st3_overlapping_rentals", ("rentals", "rental_items"),
     """SELECT a.equipment_id, a.rental_id, a.held_from, a.held_to, count(*) AS overlaps
        FROM held a JOIN held b ON b.equipment_id = a.equipment_id AND b.rental_id <> a.rental_id
         AND a.held_from < b.held_to AND b.held_from < a.held_to
        GROUP BY 1, 2, 3, 4""",
     """held AS MATERIALIZED (SELECT DISTINCT i.equipment_id, r.rental_id,
                              coalesce(r.start_date, r.rental_date) AS held_from, r.due_date AS held_to
                              FROM rentals r JOIN rental_items i ON i.rental_id = r.rental_id
                              WHERE r.status = 'BORROWING')""")
_add("st4_stock_drift", ("inventory_half_rented", "rental_items"),
     """SELECT * FROM (
            SELECT v.equipment_id, CAST(v.total_quantity AS BIGINT) AS total_quantity,
                   CAST(v.available_quantity AS BIGINT) AS available_quantity,
                   CAST(v.rented_quantity AS BIGINT) AS rented_quantity,
                   CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS borrowed_quantity,
                   CAST(v.rented_quantity - coalesce(sum(i.quantity), 0) AS BIGINT) AS rented_drift
            FROM inventory_half_rented v LEFT JOIN rental_items i
              ON i.equipment_id = v.equipment_id AND i.item_status = 'BORROWING'
            GROUP BY v.equipment_id, v.total_quantity, v.available_quantity, v.rented_quantity)
        WHERE rented_drift <> 0""")
_SQL["str1_audit_stream"] = """
    SELECT CASE o_orderstatus WHEN 'P' THEN 'INSERT' WHEN 'O' THEN 'UPDATE' ELSE 'DELETE' END AS action,
           'RENTALS' AS table_name, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS action_time,
           CASE o_orderstatus WHEN 'P' THEN 'Inserted' WHEN 'O' THEN 'Updated' ELSE 'Deleted' END
               || ' rental RC' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 9 THEN CAST(o_orderkey AS VARCHAR)
                                       ELSE lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS description
    FROM orders"""
_SQL["str2_running_totals"] = """
    SELECT l_orderkey AS rental_id,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 0 ELSE 1 END
                    * CAST(l_quantity AS BIGINT) * l_linenumber
                    * CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE p_size + 5 END) AS DOUBLE) AS total_amount
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"""

_FEED = f"""WITH changes AS (
    SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'I' WHEN 'O' THEN 'U' ELSE 'D' END AS op,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END AS due FROM orders
), told AS (
    SELECT k, op, due,
           (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = c.k AND l_shipdate <= c.due)
           - (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = c.k AND l_returnflag = 'R'
                AND l_shipdate + INTERVAL 20 DAY <= c.due) AS items,
           (SELECT count(*) FROM orders o WHERE o.o_orderkey = c.k AND o.o_orderkey % 5 = 0
                AND o.o_orderdate + INTERVAL 10 DAY <= c.due) AS invoices
    FROM changes c
), judged AS (
    SELECT *, CASE WHEN op = 'D' AND items > 0 THEN -20062 WHEN op = 'D' AND invoices > 0 THEN -20063 END AS code FROM told)
SELECT CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END AS action, 'RENTALS' AS table_name,
       CAST(k AS VARCHAR) AS record_id, due AS action_time,
       CASE op WHEN 'I' THEN 'Inserted' WHEN 'U' THEN 'Updated' ELSE 'Deleted' END || ' rental ' || {_code('RC', 'k', 9)} AS description,
       CASE WHEN code IS NOT NULL THEN 'rental_delete' END AS source, CAST(code AS BIGINT) AS code,
       {_message("'rental_delete'")} AS message
FROM judged"""
_SQL["tr4_audit_rental_feed"] = _FEED
_SQL["str3_guarded_audit_stream"] = _FEED
_SQL["str4_latest_returns"] = """
    SELECT l_orderkey AS rental_id, count(*) AS "rows", CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS amount,
           max(l_shipdate) AS latest_return
    FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_linenumber % 2 = 0) GROUP BY 1"""

_SQL["rp7_status_at"] = """
    WITH last AS (
        SELECT l_partkey, l_shipdate,
               arg_max(CASE l_returnflag WHEN 'N' THEN 'MAINTENANCE' WHEN 'A' THEN 'DISABLED' ELSE 'AVAILABLE' END,
                       l_orderkey * 100 + l_linenumber) AS status
        FROM lineitem GROUP BY 1, 2)
    SELECT o_custkey AS equipment_id, o_orderdate AS at, o_orderkey AS order_id, status
    FROM orders ASOF LEFT JOIN last ON l_partkey = o_custkey AND o_orderdate >= l_shipdate"""
_SQL["sp7_tax_by_date"] = f"""
    WITH taxes AS (
        SELECT {_code('TX', 's_suppkey', 4)} AS tax_id, s_suppkey % 13 AS rate, s_suppkey % 7 <> 0 AS active,
               TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 37 % 2400 AS INTEGER)) AS since,
               TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 37 % 2400 + s_suppkey % 41 AS INTEGER)) AS until FROM supplier
    ), picked AS (
        SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS HUGEINT) AS cents, tax_id, rate
        FROM orders LEFT JOIN taxes ON active AND o_orderdate BETWEEN since AND until
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY since DESC, tax_id) = 1)
    SELECT o_orderkey AS order_id, o_orderdate AS invoice_date, tax_id,
           CAST(CAST((cents * rate + 50) // 100 AS BIGINT) AS DOUBLE) / 100 AS tax_amount FROM picked"""
