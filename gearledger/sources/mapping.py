"""Rental tables as SQL projections of the driver's order tables.

Every text below is plain SQL that Spark and DuckDB both run: Spark builds the lazy rental
DataFrames from it, and the SQL oracle inlines the same text as common table expressions, so
both sides start from one definition of the data. ``{name}`` refers to another text or to a
driver table, ``{ts}`` to the engine's zone-free timestamp type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.numbering import number_in_group
from ..session import settle, small_tasks, tune

DRIVER_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

# Arrival order of the lines of one rental.
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)

MAPPING: dict[str, str] = {
    "shop_info": """
        SELECT s_suppkey AS shop_id, s_name AS shop_name, 'Street of ' || s_name AS shop_address,
               'HCM' AS city, 'District ' || cast(s_nationkey AS varchar(10)) AS district,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at,
               cast(CASE WHEN s_suppkey % 89 = 7 THEN NULL
                         ELSE 10.75 + (s_suppkey % 10) * 0.005 END AS decimal(9,6)) AS latitude,
               cast(106.65 + (s_suppkey % 7) * 0.005 AS decimal(9,6)) AS longitude
        FROM {supplier}""",
    "customers": """
        SELECT c_custkey AS customer_id, 'user' || cast(c_custkey AS varchar(20)) AS username,
               'hash' || cast(c_custkey AS varchar(20)) AS password_hash, c_name AS full_name,
               'user' || cast(c_custkey AS varchar(20)) || '@example.com' AS email,
               '09' || lpad(cast(c_custkey AS varchar(20)), 8, '0') AS phone,
               c_mktsegment || ' quarter' AS address,
               CASE WHEN c_custkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at,
               cast(CASE WHEN c_custkey % 97 = 0 THEN NULL
                         ELSE 10.70 + (c_custkey % 40) * 0.004 END AS decimal(9,6)) AS latitude,
               cast(106.60 + (c_custkey % 37) * 0.006 AS decimal(9,6)) AS longitude
        FROM {customer}""",
    "employees": """
        SELECT cast(id AS bigint) AS employee_id, 'emp' || cast(id AS varchar(2)) AS username,
               'hash' AS password_hash, 'Employee ' || cast(id AS varchar(2)) AS full_name,
               'emp' || cast(id AS varchar(2)) || '@example.com' AS email,
               '0910' AS phone, role, 'ACTIVE' AS status,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at
        FROM (VALUES (0, 'ADMIN'), (1, 'STAFF'), (2, 'MANAGER'), (3, 'SUPPORT'), (4, 'SALES'))
             AS v(id, role)""",
    "categories": """
        SELECT category_id, category_name, category_name || ' equipment' AS description,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at
        FROM (VALUES ('CAT01', 'Camera'), ('CAT02', 'Lens'), ('CAT03', 'Lighting'),
                     ('CAT04', 'Tripod'), ('CAT05', 'Audio'), ('CAT06', 'Accessories'))
             AS v(category_id, category_name)""",
    "taxes": """
        SELECT tax_id, tax_name, tax_name AS description,
               cast(rate AS decimal(5,2)) AS tax_rate, is_active,
               cast(starts AS {ts}) AS effective_from, cast(ends AS {ts}) AS effective_to,
               cast(starts AS {ts}) AS created_at, cast(starts AS {ts}) AS updated_at
        FROM (VALUES ('T0001', 'VAT 10%', 10, 1, '2024-01-01 00:00:00', '2099-12-31 00:00:00'),
                     ('T0002', 'VAT 8%', 8, 1, '2023-01-01 00:00:00', '2023-12-31 00:00:00'),
                     ('T0003', 'VAT 5%', 5, 0, '2022-01-01 00:00:00', '2022-12-31 00:00:00'))
             AS v(tax_id, tax_name, rate, is_active, starts, ends)""",
    "equipments": """
        SELECT p_partkey AS equipment_id, p_name AS equipment_name,
               CASE WHEN p_partkey % 6 = 5 THEN 'ACCESSORY' ELSE 'MAIN' END AS equipment_type,
               CASE WHEN p_partkey % 17 = 0 THEN 'MAINTENANCE'
                    WHEN p_partkey % 23 = 0 THEN 'DISABLED' ELSE 'AVAILABLE' END AS status,
               p_name || ' / ' || p_type AS description,
               cast(p_retailprice AS decimal(10,2)) AS equipment_value,
               cast(p_retailprice AS decimal(10,2)) AS purchase_price,
               cast(CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE p_size + 5 END AS decimal(10,2))
                   AS rental_price_per_day,
               cast(CASE WHEN p_partkey % 3 = 0 THEN 0.10 WHEN p_partkey % 3 = 1 THEN 0.12
                         ELSE 0.15 END AS decimal(5,2)) AS depreciation_rate,
               p_size AS total_usage_days,
               cast(date '2015-01-01' + cast(p_partkey % 3400 AS int) AS {ts}) AS purchase_date,
               p_brand AS brand, p_type AS model,
               CASE p_size % 5 WHEN 1 THEN 'RF' WHEN 2 THEN 'E' WHEN 3 THEN 'Z' WHEN 4 THEN 'X'
                    ELSE NULL END AS mount_type,
               'CAT0' || cast(p_partkey % 6 + 1 AS varchar(1)) AS category_id,
               CASE WHEN p_retailprice >= 950 THEN 1 ELSE 0 END AS is_high_value,
               cast(CASE WHEN p_partkey % 6 = 5 THEN 0.00 WHEN p_partkey % 13 = 0 THEN NULL
                         WHEN p_partkey % 4 = 0 THEN 0.30 ELSE 0.20 END AS decimal(5,2))
                   AS deposit_rate,
               cast(date '2015-01-01' + cast(p_partkey % 3400 AS int) AS {ts}) AS created_at
        FROM {part}""",
    "inventory": """
        SELECT p_partkey AS inventory_id, p_size * 12 AS total_quantity,
               p_size * 12 AS available_quantity, 0 AS rented_quantity,
               0 AS maintenance_quantity, 0 AS damaged_quantity, 0 AS lost_quantity,
               cast('2024-01-01 00:00:00' AS {ts}) AS last_updated, p_partkey AS equipment_id
        FROM {part} WHERE p_partkey % 19 <> 0""",
    # Half of every stock is out on rent: the starting point of the return batches.
    "inventory_half_rented": """
        SELECT p_partkey AS inventory_id, p_size * 12 AS total_quantity,
               p_size * 6 AS available_quantity, p_size * 6 AS rented_quantity,
               0 AS maintenance_quantity, 0 AS damaged_quantity, 0 AS lost_quantity,
               cast('2024-01-01 00:00:00' AS {ts}) AS last_updated, p_partkey AS equipment_id
        FROM {part} WHERE p_partkey % 19 <> 0""",
    # Stock in which exactly the units of the running rentals are out.
    "inventory_running": """
        SELECT p_partkey AS inventory_id,
               cast(p_size * 12 + coalesce(u.units, 0) AS int) AS total_quantity,
               p_size * 12 AS available_quantity,
               cast(coalesce(u.units, 0) AS int) AS rented_quantity,
               0 AS maintenance_quantity, 0 AS damaged_quantity, 0 AS lost_quantity,
               cast('2024-01-01 00:00:00' AS {ts}) AS last_updated, p_partkey AS equipment_id
        FROM {part}
        LEFT JOIN (SELECT i.equipment_id AS eq, sum(i.quantity) AS units
                   FROM {rental_items} i JOIN {rentals} r ON r.rental_id = i.rental_id
                   WHERE r.status = 'BORROWING' GROUP BY i.equipment_id) u ON u.eq = p_partkey""",
    "equipment_accessories": """
        SELECT m.p_partkey AS equipment_id, m.p_partkey + 5 AS accessory_id,
               cast(1 + m.p_partkey % 4 AS int) AS quantity,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at
        FROM {part} m JOIN {part} a ON a.p_partkey = m.p_partkey + 5
        WHERE m.p_partkey % 6 = 0""",
    "equipment_images": """
        SELECT p_partkey * 2 AS image_id,
               'img/' || cast(p_partkey AS varchar(20)) || '.jpg' AS image_url, 1 AS is_primary,
               cast('2015-01-01 00:00:00' AS {ts}) AS created_at, p_partkey AS equipment_id
        FROM {part}
        UNION ALL
        SELECT p_partkey * 2 + 1, 'img/' || cast(p_partkey AS varchar(20)) || '-back.jpg', 0,
               cast('2015-01-01 00:00:00' AS {ts}), p_partkey
        FROM {part} WHERE p_partkey % 3 = 0""",
    "rentals": """
        SELECT o_orderkey AS rental_id,
               'RC' || lpad(cast(o_orderkey AS varchar(12)), 9, '0') AS rental_code,
               CASE o_orderpriority WHEN '5-LOW' THEN 'PICKUP'
                    WHEN '4-NOT SPECIFIED' THEN 'RETURN' ELSE 'NORMAL' END AS rental_type,
               CASE o_orderstatus WHEN 'F' THEN 'RETURNED' WHEN 'O' THEN 'BORROWING'
                    ELSE 'CREATED' END AS status,
               cast(NULL AS varchar(20)) AS payment_status, cast(NULL AS varchar(255)) AS notes,
               cast(o_totalprice AS decimal(10,2)) AS total_amount,
               cast(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 <> 0
                         THEN cast(o_totalprice AS decimal(12,2)) * 0.10
                         ELSE 0 END AS decimal(10,2)) AS deposit_required,
               o_orderdate AS rental_date,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS start_date,
               o_orderdate + interval '1' day * cast(3 + o_orderkey % 10 AS int) AS due_date,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + interval '5' day END
                   AS return_date,
               o_orderdate AS created_at, o_orderdate AS updated_at,
               o_custkey AS customer_id, o_orderkey % 5 AS employee_id,
               o_orderkey % (SELECT count(*) FROM {supplier}) AS shop_id,
               cast(NULL AS varchar(100)) AS customer_name,
               cast(NULL AS varchar(15)) AS customer_phone,
               cast(NULL AS varchar(255)) AS customer_address,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS customer_confirmed,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS confirmed_at,
               cast(NULL AS varchar(1000)) AS contract_terms
        FROM {orders}""",
    "numbered_lines": f"""
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})
                  AS rn
        FROM {{lineitem}}""",
    # Lines beyond the 999th of one order get ids below zero, so that ids stay unique: room for
    # 10^9 lines of each of 9 * 10^9 orders in a bigint.
    "item_source": """
        SELECT CASE WHEN rn < 1000 THEN l_orderkey * 1000 + rn
                    ELSE -(l_orderkey * 1000000000 + rn) END AS rental_item_id,
               l_orderkey AS rental_id, l_partkey AS equipment_id, cast(l_quantity AS int) AS quantity,
               l_linenumber AS days, e.rental_price_per_day AS price_per_day,
               cast(cast(l_quantity AS int) * l_linenumber * e.rental_price_per_day
                    AS decimal(10,2)) AS subtotal,
               CASE WHEN l_returnflag = 'N' THEN 'BORROWING' WHEN l_returnflag = 'R'
                    THEN 'RETURNED' WHEN l_linestatus = 'F' THEN 'DAMAGED' ELSE 'LOST' END
                   AS item_status,
               cast(cast(round(l_discount * 100) AS int) * 10 AS decimal(5,2)) AS damage_share,
               l_shipdate
        FROM {numbered_lines} JOIN {equipments} e ON e.equipment_id = l_partkey""",
    "rental_items": """
        SELECT rental_item_id, rental_id, equipment_id, quantity, days, price_per_day, subtotal,
               item_status
        FROM {item_source}""",
    "rental_item_media": """
        SELECT rental_item_id * 2 AS media_id, rental_item_id, 'IMAGE' AS media_type,
               'before.jpg' AS media_path, 'BEFORE_DELIVERY' AS capture_stage,
               l_shipdate AS created_at
        FROM {item_source}
        UNION ALL
        SELECT rental_item_id * 2 + 1, rental_item_id, 'VIDEO', 'after.mp4', 'AFTER_RETURN',
               l_shipdate
        FROM {item_source} WHERE item_status <> 'BORROWING'""",
    "returns": """
        SELECT i.rental_item_id AS return_id,
               r.due_date + interval '1' hour * cast((i.rental_item_id % 11 - 5) * 24
                   + i.quantity % 24 AS int) AS return_date,
               CASE WHEN i.item_status = 'RETURNED' THEN 'GOOD' WHEN i.item_status = 'LOST'
                    THEN 'LOST' WHEN i.days = 7 THEN 'BROKEN' ELSE 'DAMAGED' END
                   AS condition_status,
               i.damage_share AS damage_percent,
               cast(0 AS decimal(10,2)) AS damage_fee, cast(0 AS decimal(10,2)) AS late_fee,
               cast(NULL AS varchar(255)) AS notes, 'PENDING' AS inspection_status,
               r.employee_id AS checked_by, r.due_date AS checked_at,
               i.rental_item_id AS rental_item_id
        FROM {item_source} i JOIN {rentals} r ON r.rental_id = i.rental_id
        WHERE i.item_status <> 'BORROWING'""",
    "deposits": """
        SELECT o_orderkey AS deposit_id,
               cast(cast(o_totalprice AS decimal(12,2)) * 0.10 AS decimal(10,2))
                   AS deposit_amount,
               cast(NULL AS decimal(10,2)) AS refund_amount,
               cast(NULL AS decimal(10,2)) AS extra_charge_amount,
               CASE o_orderkey % 3 WHEN 0 THEN 'HELD' WHEN 1 THEN 'USED' ELSE 'REFUNDED' END
                   AS status,
               o_orderdate AS deposit_date, cast(NULL AS {ts}) AS refund_date,
               o_orderdate AS created_at, o_orderkey AS rental_id,
               o_orderkey * 1000 + 1 AS payment_id
        FROM {orders} WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 0""",
    "invoice_source": """
        SELECT o_orderkey AS invoice_id,
               'INV' || lpad(cast(o_orderkey AS varchar(12)), 9, '0') AS invoice_number,
               CASE o_orderkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PAID' ELSE 'PARTIAL' END
                   AS status,
               cast(o_totalprice AS decimal(10,2)) AS rental_amount,
               cast(o_orderkey % 7 * 10 AS decimal(10,2)) AS late_fee,
               cast(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 11 END
                    AS decimal(10,2)) AS damage_fee,
               cast(CASE o_orderkey % 3 WHEN 0 THEN 20000 WHEN 1 THEN 50000 ELSE 0 END
                    AS decimal(10,2)) AS shipping_fee,
               cast(CASE WHEN o_orderkey % 4 <> 0
                         THEN cast(o_totalprice AS decimal(12,2)) * 0.10
                         ELSE 0 END AS decimal(10,2)) AS deposit_used,
               o_orderdate AS invoice_date, o_orderkey AS rental_id
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "invoice_totals": """
        SELECT *, cast(rental_amount + late_fee + coalesce(damage_fee, cast(0 AS decimal(10,2)))
                       + shipping_fee AS decimal(10,2)) AS subtotal_amount
        FROM {invoice_source}""",
    "invoices": """
        SELECT invoice_id, invoice_number, status, cast(NULL AS varchar(255)) AS notes,
               rental_amount, late_fee, damage_fee, shipping_fee, subtotal_amount,
               cast(subtotal_amount * 0.10 AS decimal(10,2)) AS tax_amount,
               cast(subtotal_amount + cast(subtotal_amount * 0.10 AS decimal(10,2))
                    AS decimal(10,2)) AS total_amount,
               deposit_used,
               cast(subtotal_amount + cast(subtotal_amount * 0.10 AS decimal(10,2))
                    - deposit_used + CASE WHEN invoice_id % 50 = 0 THEN 1 ELSE 0 END
                    AS decimal(10,2)) AS final_amount,
               invoice_date, invoice_date + interval '7' day AS payment_due_date,
               invoice_date AS created_at, 'FINAL' AS invoice_type,
               CASE WHEN invoice_id % 10 = 0 THEN 'T0002' ELSE 'T0001' END AS tax_id, rental_id
        FROM {invoice_totals}""",
    "payments": """
        SELECT i.rental_item_id AS payment_id,
               CASE i.rental_item_id % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'CARD'
                    WHEN 2 THEN 'BANK_TRANSFER' ELSE 'E_WALLET' END AS payment_method,
               CASE WHEN i.days = 1 THEN 'DEPOSIT' ELSE 'RENTAL' END AS payment_type,
               CASE i.days WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PENDING' ELSE 'COMPLETED' END
                   AS payment_status,
               'TX' || cast(i.rental_item_id AS varchar(20)) AS transaction_code,
               i.subtotal AS amount,
               v.invoice_date + interval '1' day * i.days AS payment_date,
               v.invoice_date AS created_at, cast(NULL AS varchar(255)) AS notes,
               CASE WHEN i.days = 1 THEN NULL ELSE v.invoice_id END AS invoice_id,
               i.rental_id AS rental_id
        FROM {rental_items} i JOIN {invoice_source} v ON v.rental_id = i.rental_id""",
    "shipments": """
        SELECT rental_item_id AS shipment_id, cast(NULL AS varchar(255)) AS shipping_address,
               'DELIVERY' AS shipping_method,
               CASE WHEN days = 1 THEN 'OUTBOUND' ELSE 'RETURN' END AS shipment_type,
               'DELIVERED' AS shipping_status,
               cast(CASE WHEN quantity > 40 THEN 70000 WHEN quantity > 20 THEN 50000
                         ELSE 20000 END AS decimal(10,2)) AS shipping_fee,
               l_shipdate AS shipped_date, l_shipdate AS delivered_date,
               l_shipdate AS created_at, rental_id
        FROM {item_source} WHERE days <= 2""",
    "system_log": """
        SELECT event_id AS log_id,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                    ELSE 'UPDATE' END AS action,
               CASE user_id % 3 WHEN 0 THEN 'CUSTOMERS' WHEN 1 THEN 'RENTALS' ELSE 'INVOICES' END
                   AS table_name,
               cast(user_id AS varchar(20)) AS record_id, ts AS action_time,
               props AS description, cast(NULL AS varchar(50)) AS ip_address
        FROM {events}""",
    # Command batches: one command per source row.
    "create_rental_commands": """
        SELECT i.rental_item_id AS request_id,
               CASE WHEN i.rental_item_id % 41 = 0 THEN -1 ELSE r.customer_id END AS customer_id,
               r.employee_id, r.shop_id,
               CASE WHEN i.rental_item_id % 43 = 0 THEN -1 ELSE i.equipment_id END
                   AS equipment_id,
               CASE WHEN i.rental_item_id % 47 = 0 THEN 0
                    WHEN i.rental_item_id % 53 <> 0 THEN i.quantity END AS quantity,
               CASE WHEN i.rental_item_id % 59 <> 0 THEN i.days END AS days, r.rental_date, r.due_date,
               CASE WHEN i.rental_item_id % 31 = 0 THEN 0
                    WHEN i.rental_item_id % 37 = 0 THEN NULL ELSE 1 END AS customer_confirm
        FROM {rental_items} i JOIN {rentals} r ON r.rental_id = i.rental_id""",
    "rental_commands": """
        SELECT o_orderkey * 10 AS request_id,
               CASE WHEN o_orderkey % 50 = 49 THEN -o_orderkey ELSE o_orderkey END AS rental_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'CARD'
                    WHEN 2 THEN 'BANK_TRANSFER' ELSE 'E_WALLET' END AS payment_method
        FROM {orders}
        UNION ALL
        SELECT o_orderkey * 10 + 1, o_orderkey, 'CASH' FROM {orders} WHERE o_orderkey % 20 = 3""",
    "pay_invoice_commands": """
        SELECT request_id, rental_id AS invoice_id, payment_method FROM {rental_commands}""",
    "return_item_commands": """
        SELECT r.return_id AS request_id,
               CASE WHEN r.return_id % 61 = 0 THEN -1 ELSE r.rental_item_id END
                   AS rental_item_id,
               CASE WHEN r.return_id % 67 <> 0 THEN r.condition_status END
                   AS condition_status, r.return_date
        FROM {returns} r""",
    "compatibility_commands": """
        SELECT i.rental_item_id AS request_id,
               CASE WHEN i.rental_item_id % 53 = 0 THEN -1
                    ELSE i.equipment_id - i.equipment_id % 6 * cast(i.days % 2 AS bigint) END
                   AS main_equipment_id,
               CASE WHEN i.rental_item_id % 59 = 0 THEN -1
                    ELSE i.equipment_id - i.equipment_id % 6 + i.days % 6 END
                   AS extra_equipment_id
        FROM {rental_items} i""",
}

# The commands of ``create_rental_commands`` with the joins in the order that moves least: lines stay
# where they were numbered for their orders, and only then go to the equipments.
NARROW_COMMANDS = """
    SELECT request_id, CASE WHEN request_id % 41 = 0 THEN -1 ELSE customer_id END AS customer_id,
           employee_id, shop_id,
           CASE WHEN request_id % 43 = 0 THEN -1 ELSE l_partkey END AS equipment_id,
           CASE WHEN request_id % 47 = 0 THEN 0
                WHEN request_id % 53 <> 0 THEN cast(l_quantity AS int) END AS quantity,
           CASE WHEN request_id % 59 <> 0 THEN l_linenumber END AS days, rental_date, due_date,
           CASE WHEN request_id % 31 = 0 THEN 0
                WHEN request_id % 37 = 0 THEN NULL ELSE 1 END AS customer_confirm
    FROM (SELECT CASE WHEN rn < 1000 THEN l_orderkey * 1000 + rn
                      ELSE -(l_orderkey * 1000000000 + rn) END AS request_id,
                 l_partkey, l_quantity, l_linenumber,
                 r.customer_id, r.employee_id, r.shop_id, r.rental_date, r.due_date
          FROM {lines} JOIN {rentals} r ON r.rental_id = l_orderkey) i
    JOIN {equipments} e ON e.equipment_id = l_partkey"""

_REF = re.compile(r"\{(\w+)\}")


def references(name: str) -> list[str]:
    """Other mapping texts that a text reads, in order of appearance."""
    seen = dict.fromkeys(_REF.findall(MAPPING[name]))
    return [ref for ref in seen if ref in MAPPING]


class RentalTables:
    """Lazy rental tables over one folder of driver tables.

    ``tables["rentals"]`` is a DataFrame; nothing is read until an action needs it, and
    Catalyst prunes the columns a query does not use down to the Parquet scan.
    """

    def __init__(self, spark: SparkSession, folder: str):
        tune(spark)
        small_tasks(spark)
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def settle(self, name: str) -> None:
        """Write a derived table once; what is built on it from now on reads the copy.

        For queries that need an expensive table several times.
        """
        self._frames[name] = settle(self[name])

    def _build(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.driver(name)
        if name == "numbered_lines":
            return number_in_group(
                self["lineitem"], ["l_orderkey"], list(LINE_ORDER), "rn"
            )
        if name == "create_rental_commands":
            # Lines that are equal up to the quantity give equal commands in either order.
            order = list(LINE_ORDER[: LINE_ORDER.index("l_quantity") + 1])
            narrow = self["lineitem"].select("l_orderkey", *order)
            lines = number_in_group(narrow, ["l_orderkey"], order, "rn")
            return self.spark.sql(
                NARROW_COMMANDS, lines=lines, rentals=self["rentals"], equipments=self["equipments"]
            )
        refs = dict.fromkeys(_REF.findall(MAPPING[name]))
        frames = {ref: self[ref] for ref in refs if ref != "ts"}
        text = MAPPING[name].replace("{ts}", "TIMESTAMP_NTZ")
        return self.spark.sql(text, **frames)


def oracle_ctes(*names: str) -> str:
    """The same tables as CTE definitions (without WITH), dependencies first."""
    ordered: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in ordered:
            return
        for ref in references(name):
            visit(ref)
        ordered[name] = None

    for name in names:
        visit(name)

    def text(name: str) -> str:
        return _REF.sub(
            lambda m: "TIMESTAMP" if m.group(1) == "ts" else m.group(1), MAPPING[name]
        )

    return ",\n".join(f"{name} AS MATERIALIZED ({text(name)})" for name in ordered)
