"""Every registered query: a name and a function of (session, driver folder).

The operators work on rental DataFrames; here they meet the mapped driver tables. Results
leave with DOUBLE for decimals and BIGINT for whole numbers, so that engines with different
decimal types can be compared value by value; inside, money stays DECIMAL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .functions import sqlfuncs
from .operators import (
    audit, billing, checks, fees, numbering, quality, rentals, settlement, stock, timeline,
)
from .operators.rejects import Decision
from .plans import lookups, reports, views
from .session import new_path
from .sources import schemas, store
from .sources.mapping import RentalTables
from .streaming import jobs, keyed

AS_OF = "2024-07-01 00:00:00"
STORED_PARTS = 16  # parts of the tables that the stored upsert and delete write
CLIENT = "192.0.2.10"  # an address reserved for documentation

Query = Callable[[RentalTables], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        return fn

    return register


def edge(df: DataFrame) -> DataFrame:
    """Comparable result types at the edge of a query."""
    casts = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            casts[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            casts[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(casts) if casts else df


# Queries that read the numbered items several times write them once instead.
ITEMS_ONCE = (
    "dq1_", "dq3_", "dq4_", "tr1_check", "tr11_", "tr12_", "tr14_", "sp7_", "sp9_", "sp10_",
    "rp2_", "rp3_", "vw5_", "fn4_", "src1_",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str, fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables = RentalTables(spark, folder)
            if name.startswith(ITEMS_ONCE):
                tables.settle("item_source")
            return edge(fn(tables))

        return run

    return {name: bind(name, fn) for name, fn in _QUERIES.items()}


# ---------------------------------------------------------------- sources and sinks


@query("src1_table_scan")
def _(t: RentalTables) -> DataFrame:
    """Row count of all eighteen tables and of their required columns, one scan each."""
    frames = []
    for table in schemas.TABLES:
        names = [c.name for c in schemas.columns(table) if c.required]
        filled = reduce(lambda a, b: a + b, [F.count(F.col(n)) for n in names])
        frames.append(
            t[table].agg(F.count("*").alias("row_count"), filled.alias("required_values"))
            .withColumn("table_name", F.lit(table))
        )
    return reduce(DataFrame.unionByName, frames)


def _return_batch(t: RentalTables) -> DataFrame:
    return t["rental_items"].where("item_status = 'BORROWING'").select(
        F.col("rental_item_id").alias("return_id"),
        C.clock(AS_OF).alias("return_date"),
        F.lit("GOOD").alias("condition_status"),
        F.lit(None).cast("decimal(10,2)").alias("late_fee"),
        "rental_item_id",
    )


@query("snk1_insert_with_defaults")
def _(t: RentalTables) -> DataFrame:
    return store.append(t["returns"], _return_batch(t), "returns", AS_OF).select(
        "return_id", "return_date", "condition_status", "damage_percent", "damage_fee",
        "late_fee", "inspection_status", "rental_item_id",
    )


@query("snk2_insert_returning_ids")
def _(t: RentalTables) -> DataFrame:
    """The deposit row carries the id its payment row received."""
    payments, deposits = billing.deposit_rows(_deposit_decision(t), AS_OF)
    return deposits.select("rental_id", "deposit_id", "payment_id").join(
        payments.select("payment_id", "transaction_code", "amount"), "payment_id"
    )


@query("snk3_keyed_upsert")
def _(t: RentalTables) -> DataFrame:
    paid = billing.paid_invoices(
        billing.pay_invoices(t["pay_invoice_commands"], t["invoices"])
    )
    return store.upsert(t["invoices"], paid, "invoice_id").select(
        "invoice_id", "status", "final_amount"
    )


@query("snk3_upsert_by_parts")
def _(t: RentalTables) -> DataFrame:
    """The upsert on a stored table, of which only the parts of paid invoices are rewritten."""
    paid = billing.paid_invoices(
        billing.pay_invoices(t["pay_invoice_commands"], t["invoices"])
    )
    path = store.write_keyed(
        t["invoices"], new_path(t.spark, "keyed"), "invoices", "invoice_id", STORED_PARTS
    )
    store.upsert_keyed(path, paid, "invoice_id")
    return store.read_keyed(t.spark, path).select("invoice_id", "status", "final_amount")


def _rental_delete_request(t: RentalTables) -> tuple[DataFrame, str, list]:
    return (
        t["rentals"].where("status = 'CREATED' OR due_date < TIMESTAMP_NTZ '1998-01-01'"),
        "rental_id",
        [
            (t["rental_items"], "rental_id", ("rental_delete", -20062)),
            (t["invoices"], "rental_id", ("rental_delete", -20063)),
        ],
    )


def _rental_delete(t: RentalTables) -> tuple[DataFrame, Decision]:
    return store.delete(t["rentals"], *_rental_delete_request(t))


@query("snk4_guarded_delete")
def _(t: RentalTables) -> DataFrame:
    kept, _refused = _rental_delete(t)
    return kept.select("rental_id", "rental_code", "status")


@query("snk4_delete_by_parts")
def _(t: RentalTables) -> DataFrame:
    """The guarded delete on a stored table, of which only the parts of deleted rows are rewritten."""
    path = store.write_keyed(
        t["rentals"], new_path(t.spark, "keyed"), "rentals", "rental_id", STORED_PARTS
    )
    store.delete_keyed(path, *_rental_delete_request(t))
    return store.read_keyed(t.spark, path).select("rental_id", "rental_code", "status")


@query("snk4_guarded_delete_rejects")
def _(t: RentalTables) -> DataFrame:
    return _rental_delete(t)[1].rejects


# ---------------------------------------------------------------- lookups


@query("fl1_equipment_by_type_status")
def _(t: RentalTables) -> DataFrame:
    return lookups.equipment_by_type(t["equipments"], "MAIN", "AVAILABLE")


@query("fl2_equipment_by_category")
def _(t: RentalTables) -> DataFrame:
    return lookups.equipment_by_category(t["equipments"], "CAT02")


@query("fl3_equipment_by_make")
def _(t: RentalTables) -> DataFrame:
    return lookups.equipment_by_make(t["equipments"], "Brand#17")


@query("fl3_equipment_by_make_and_mount")
def _(t: RentalTables) -> DataFrame:
    return lookups.equipment_by_make(t["equipments"], "Brand#17", "ECONOMY", "Z")


@query("fl4_customers_by_status")
def _(t: RentalTables) -> DataFrame:
    return lookups.customers_by_status(t["customers"], "INACTIVE")


@query("fl5_customers_in_box")
def _(t: RentalTables) -> DataFrame:
    return lookups.customers_in_box(t["customers"], 10.75, 10.80, 106.65, 106.75)


@query("fl5_customers_in_box_by_place")
def _(t: RentalTables) -> DataFrame:
    """The box on a table whose files are laid out by place."""
    path = store.write_by_place(
        t["customers"], new_path(t.spark, "placed"), "customers", STORED_PARTS
    )
    customers = t.spark.read.parquet(path)
    return lookups.customers_in_box(customers, 10.75, 10.80, 106.65, 106.75)


@query("fl6_rental_report")
def _(t: RentalTables) -> DataFrame:
    return lookups.rental_report(t["rentals"], "1996-01-01 00:00:00", "1999-01-01 00:00:00")


@query("fl7_rentals_of_employee")
def _(t: RentalTables) -> DataFrame:
    return lookups.rentals_of(t["rentals"], t["customers"], 3)


@query("fl8_items_per_equipment_status")
def _(t: RentalTables) -> DataFrame:
    return lookups.items_per_status(t["rental_items"])


@query("fl9_items_of_rentals")
def _(t: RentalTables) -> DataFrame:
    return lookups.items_of_rentals(t["rental_items"], t["rentals"], "BORROWING")


@query("fl10_invoices_of_rentals")
def _(t: RentalTables) -> DataFrame:
    return lookups.invoices_of_rentals(t["invoices"], t["rentals"])


@query("fl11_unpaid_invoices_by_day")
def _(t: RentalTables) -> DataFrame:
    unpaid = lookups.unpaid_invoices(
        t["invoices"], "1996-01-01 00:00:00", "1999-01-01 00:00:00"
    )
    return unpaid.withColumn("invoice_day", F.col("invoice_day").cast("timestamp_ntz"))


@query("fl12_payments_of_invoices")
def _(t: RentalTables) -> DataFrame:
    return lookups.payments_of_invoices(t["payments"], t["invoices"])


@query("fl13_payments_by_date")
def _(t: RentalTables) -> DataFrame:
    return lookups.payments_by_date(
        t["payments"], "1997-01-01 00:00:00", "1998-01-01 00:00:00"
    )


@query("fl14_log_by_time")
def _(t: RentalTables) -> DataFrame:
    return lookups.log_between(t["system_log"], "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("fl15_log_by_table")
def _(t: RentalTables) -> DataFrame:
    return lookups.log_of_table(t["system_log"], "RENTALS")


# ---------------------------------------------------------------- views and reports


@query("vw1_inventory_status")
def _(t: RentalTables) -> DataFrame:
    return views.inventory_status(
        t["inventory"], t["equipments"], t["rental_items"], ordered=True
    )


@query("vw2_available_equipment")
def _(t: RentalTables) -> DataFrame:
    return views.available_equipment(
        t["equipments"], t["inventory"], t["rental_items"], ordered=True
    )


@query("vw3_rental_details")
def _(t: RentalTables) -> DataFrame:
    return views.rental_details(
        t["rentals"], t["customers"], t["employees"], t["rental_items"], t["equipments"],
        ordered=True,
    )


@query("vw4_invoice_full")
def _(t: RentalTables) -> DataFrame:
    return views.invoice_full(
        t["invoices"], t["rentals"], t["payments"], t["deposits"], ordered=True
    )


@query("vw5_return_analysis")
def _(t: RentalTables) -> DataFrame:
    return views.return_analysis(
        t["returns"], t["rental_items"], t["rentals"], t["equipments"], ordered=True
    )


@query("rp1_equipment_values")
def _(t: RentalTables) -> DataFrame:
    """The value rule called as a SQL function from a SQL query."""
    name = sqlfuncs.register(t.spark)
    return t.spark.sql(
        f"""SELECT equipment_id, equipment_name,
                   {name}(purchase_price, depreciation_rate, purchase_date,
                          TIMESTAMP_NTZ '{AS_OF}') AS equipment_value
            FROM {{equipments}}""",
        equipments=t["equipments"],
    )


@query("rp2_late_fee_report")
def _(t: RentalTables) -> DataFrame:
    return fees.late_fees(t["rentals"], t["rental_items"], t["returns"])


@query("rp3_damage_fee_report")
def _(t: RentalTables) -> DataFrame:
    return fees.damage_fees(
        t["returns"], t["rental_items"], t["equipments"], AS_OF
    ).select("return_id", "damage_fee")


@query("rp4_invoice_recomputation")
def _(t: RentalTables) -> DataFrame:
    return fees.invoice_totals(t["invoices"], t["taxes"])


@query("rp5_shipping_totals")
def _(t: RentalTables) -> DataFrame:
    return reports.shipping_totals(t["shipments"], t["rentals"])


@query("rp6_audit_log")
def _(t: RentalTables) -> DataFrame:
    return reports.audit_log(t["system_log"]).select(
        "log_id", "action", "table_name", "record_id", "action_time", "description"
    )


@query("rp7_equipment_status_before_after")
def _(t: RentalTables) -> DataFrame:
    return audit.status_changes(
        _status_changes(t), t["rental_items"], t["equipments"]
    ).where("old_status <> new_status")


# ---------------------------------------------------------------- business functions


@query("fn1_equipment_value")
def _(t: RentalTables) -> DataFrame:
    return fees.equipment_values(t["equipments"], AS_OF)


@query("fn2_deposit")
def _(t: RentalTables) -> DataFrame:
    return fees.equipment_deposits(t["equipments"], AS_OF)


@query("fn3_late_fee")
def _(t: RentalTables) -> DataFrame:
    return fees.late_fees(t["rentals"], t["rental_items"], t["returns"]).select(
        "rental_id", "late_fee"
    )


@query("fn4_damage_fee")
def _(t: RentalTables) -> DataFrame:
    return fees.damage_fees(t["returns"], t["rental_items"], t["equipments"], AS_OF).select(
        "return_id", "rental_id", "damage_fee"
    )


@query("fn5_invoice_total")
def _(t: RentalTables) -> DataFrame:
    """Every third rental's invoice names a tax that does not exist."""
    invoices = t["invoices"].withColumn(
        "tax_id",
        F.when(F.col("invoice_id") % 3 == 0, "T0009")
        .when(F.col("invoice_id") % 3 == 1, "T0002")
        .otherwise(F.col("tax_id")),
    )
    return fees.invoice_totals(invoices, t["taxes"]).select("invoice_id", "calculated_final")


@query("fn6_shipping_fee")
def _(t: RentalTables) -> DataFrame:
    return fees.shipping_fees(t["rentals"], t["shop_info"], t["customers"]).outcome(
        "rental_id", "distance_km", "shipping_fee"
    )


@query("fn7_generated_codes")
def _(t: RentalTables) -> DataFrame:
    numbered = numbering.dense_number(t["rentals"].select("rental_id"), "rental_id", "n")
    return numbered.select(
        "rental_id",
        C.code_text("RC", F.col("n"), 5).alias("rental_code"),
        C.code_text("RE", F.col("n"), 3).alias("short_code"),
    )


# ---------------------------------------------------------------- procedures


@query("sp1_check_compatibility")
def _(t: RentalTables) -> DataFrame:
    return checks.check_compatibility(t["compatibility_commands"], t["equipments"]).outcome(
        "request_id", "main_equipment_id", "extra_equipment_id"
    )


@query("sp1_compatible_lens_counts")
def _(t: RentalTables) -> DataFrame:
    return checks.compatible_lens_counts(t["equipments"])


def _rent_requests(t: RentalTables) -> DataFrame:
    """Each item is one request for stock, in id order."""
    return t["rental_items"].select(
        F.col("rental_item_id").alias("request_id"),
        F.col("rental_item_id").alias("seq"),
        "equipment_id",
        F.when(F.col("rental_item_id") % 47 == 0, 0)
        .when(F.col("rental_item_id") % 53 != 0, F.col("quantity"))
        .alias("quantity"),
    )


@query("sp2_update_inventory_on_rent")
def _(t: RentalTables) -> DataFrame:
    return stock.rent_out(_rent_requests(t), t["inventory"]).outcome(
        "request_id", "equipment_id", "quantity"
    )


@query("sp2_inventory_after_rent")
def _(t: RentalTables) -> DataFrame:
    taken = stock.rent_out(_rent_requests(t), t["inventory"]).accepted
    return stock.inventory_after_rent(taken, t["inventory"], AS_OF).select(
        "equipment_id", "total_quantity", "available_quantity", "rented_quantity",
        "last_updated",
    )


def _returned(t: RentalTables) -> Decision:
    commands = t["return_item_commands"].select(
        "request_id", F.col("request_id").alias("seq"), "rental_item_id", "condition_status"
    )
    return stock.take_back(commands, t["rental_items"], t["inventory_half_rented"])


@query("sp3_update_inventory_on_return")
def _(t: RentalTables) -> DataFrame:
    return _returned(t).outcome(
        "request_id", "rental_item_id", "condition_status", "equipment_id", "quantity"
    )


@query("sp3_inventory_after_return")
def _(t: RentalTables) -> DataFrame:
    return stock.inventory_after_return(
        _returned(t).accepted, t["inventory_half_rented"], AS_OF
    ).select(
        "equipment_id", "total_quantity", "available_quantity", "rented_quantity",
        "damaged_quantity", "lost_quantity", "last_updated",
    )


def _created(t: RentalTables) -> rentals.NewRentals:
    return rentals.create_rentals(
        t["create_rental_commands"], t["customers"], t["equipments"],
        t["equipment_accessories"], t["inventory"], AS_OF,
    )


@query("sp4_create_rental")
def _(t: RentalTables) -> DataFrame:
    created = _created(t)
    rows = rentals.rental_rows(created, AS_OF).select(
        "request_id", "rental_id", "rental_code", "total_amount", "deposit_required",
        "customer_name",
    )
    return created.decision.outcome("request_id", "equipment_id").join(
        rows, "request_id", "left"
    )


@query("sp4_create_rental_items")
def _(t: RentalTables) -> DataFrame:
    created = _created(t)
    return rentals.item_rows(created, rentals.rental_rows(created, AS_OF))


@query("sp4_inventory_after_create")
def _(t: RentalTables) -> DataFrame:
    created = _created(t)
    return stock.inventory_after_rent(created.lines, t["inventory"], AS_OF).select(
        "equipment_id", "total_quantity", "available_quantity", "rented_quantity"
    )


def _deposit_decision(t: RentalTables) -> Decision:
    return billing.deposit_payments(
        t["rental_commands"], t["rentals"], t["rental_items"], t["equipments"],
        t["deposits"], AS_OF,
    )


@query("sp5_create_deposit_payment")
def _(t: RentalTables) -> DataFrame:
    return _deposit_decision(t).outcome(
        "request_id", "rental_id", "payment_method", "deposit_amount"
    )


@query("sp5_rental_deposit_required")
def _(t: RentalTables) -> DataFrame:
    changes = _deposit_decision(t).accepted.select(
        "rental_id", F.col("deposit_amount").alias("deposit_required"),
        C.clock(AS_OF).alias("updated_at"),
    )
    return store.upsert(t["rentals"], changes, "rental_id").select(
        "rental_id", "deposit_required", "updated_at"
    )


@query("sp6_confirm_pickup")
def _(t: RentalTables) -> DataFrame:
    return rentals.confirm_pickups(t["rental_commands"], t["rentals"]).outcome(
        "request_id", "rental_id"
    )


@query("sp6_rentals_after_pickup")
def _(t: RentalTables) -> DataFrame:
    decision = rentals.confirm_pickups(t["rental_commands"], t["rentals"])
    return store.upsert(
        t["rentals"], rentals.picked_up_rentals(decision, AS_OF), "rental_id"
    ).select("rental_id", "status", "customer_confirmed", "confirmed_at", "start_date")


@query("sp6_pickup_media")
def _(t: RentalTables) -> DataFrame:
    decision = rentals.confirm_pickups(t["rental_commands"], t["rentals"])
    return rentals.pickup_media(decision, t["rental_items"], AS_OF)


@query("sp6_items_after_pickup")
def _(t: RentalTables) -> DataFrame:
    decision = rentals.confirm_pickups(t["rental_commands"], t["rentals"])
    return rentals.picked_up_items(decision, t["rental_items"]).select(
        "rental_item_id", "rental_id", "item_status"
    )


def _invoices(t: RentalTables) -> Decision:
    return billing.create_invoices(
        t["rental_commands"], t["rentals"], t["rental_items"], t["returns"], t["equipments"],
        t["shop_info"], t["customers"], t["deposits"], t["taxes"], AS_OF,
    )


@query("sp7_create_invoice")
def _(t: RentalTables) -> DataFrame:
    """Flagship: every command priced into an invoice or refused with a reason."""
    return _invoices(t).outcome("request_id", "rental_id", *billing.INVOICE_AMOUNTS, "tax_id")


@query("sp7_invoice_rows")
def _(t: RentalTables) -> DataFrame:
    return billing.invoice_rows(_invoices(t), AS_OF)


@query("sp8_pay_invoice")
def _(t: RentalTables) -> DataFrame:
    return billing.pay_invoices(t["pay_invoice_commands"], t["invoices"]).outcome(
        "request_id", "invoice_id", "rental_id", "payment_method", "amount"
    )


@query("sp8_payment_rows")
def _(t: RentalTables) -> DataFrame:
    decision = billing.pay_invoices(t["pay_invoice_commands"], t["invoices"])
    return billing.payment_rows(decision, AS_OF)


def _refunds(t: RentalTables) -> Decision:
    return billing.refunds(
        t["rental_commands"], t["deposits"], t["rentals"], t["rental_items"], t["returns"],
        t["equipments"], AS_OF,
    )


@query("sp9_process_refund")
def _(t: RentalTables) -> DataFrame:
    return _refunds(t).outcome(
        "request_id", "deposit_id", "rental_id", "deposit_amount", "refund_amount", "status", "refund_date"
    )


@query("sp9_refund_payment_rows")
def _(t: RentalTables) -> DataFrame:
    return billing.refund_payment_rows(_refunds(t), AS_OF).select(
        "payment_id", "transaction_code", "payment_method", "payment_type", "payment_status",
        "amount", "payment_date", "rental_id",
    )


def _completed(t: RentalTables) -> rentals.Completed:
    return rentals.complete_rentals(
        t["rental_commands"], t["rentals"], t["rental_items"], t["returns"], t["equipments"],
        t["inventory_running"], t["shop_info"], t["customers"], t["deposits"], t["invoices"],
        t["taxes"], AS_OF,
    )


@query("sp10_complete_rental")
def _(t: RentalTables) -> DataFrame:
    return _completed(t).decision.outcome("request_id", "rental_id", "final_amount")


@query("sp10_inventory_after_complete")
def _(t: RentalTables) -> DataFrame:
    return _completed(t).inventory.select(
        "equipment_id", "total_quantity", "available_quantity", "rented_quantity"
    )


@query("sp10_rentals_after_complete")
def _(t: RentalTables) -> DataFrame:
    changes = rentals.completed_rentals(_completed(t).decision, AS_OF)
    return store.upsert(t["rentals"], changes, "rental_id").select(
        "rental_id", "status", "return_date", "updated_at"
    )


@query("sp10_items_after_complete")
def _(t: RentalTables) -> DataFrame:
    return rentals.completed_items(_completed(t).decision, t["rental_items"]).select(
        "rental_item_id", "rental_id", "item_status"
    )


@query("sp10_invoice_rows")
def _(t: RentalTables) -> DataFrame:
    return billing.invoice_rows(_completed(t).drafts, AS_OF)


# ---------------------------------------------------------------- triggers


def _arriving(items: DataFrame) -> DataFrame:
    """Items with some broken values."""
    return items.withColumns(
        {
            "quantity": F.when(F.col("rental_item_id") % 47 == 0, 0).otherwise(
                F.col("quantity")
            ),
            "price_per_day": F.when(F.col("rental_item_id") % 43 != 0, F.col("price_per_day")),
            "item_status": F.when(F.col("rental_item_id") % 41 == 0, "BROKEN").otherwise(
                F.col("item_status")
            ),
        }
    )


@query("tr1_check_new_items")
def _(t: RentalTables) -> DataFrame:
    """The whole item table as one insert batch, in id order, into an empty table."""
    none = t["rental_items"].where(F.lit(False))
    return checks.check_items(_arriving(t["rental_items"]), none, t["equipments"]).outcome(
        "rental_item_id", "rental_id", "equipment_id", "subtotal"
    )


@query("tr1_check_second_batch")
def _(t: RentalTables) -> DataFrame:
    """Every second item arrives where the others are stored already."""
    second = F.pmod(F.col("rental_item_id"), F.lit(2)) == 1
    stored = t["rental_items"].where(~second)
    return checks.check_items(_arriving(t["rental_items"].where(second)), stored, t["equipments"]).outcome(
        "rental_item_id", "rental_id", "equipment_id", "subtotal"
    )


def _change(df: DataFrame, key: str, label: str) -> DataFrame:
    """A change set over a whole table: the key decides between insert, update and delete."""
    op = F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), (F.abs(key) % 3 + 1).cast("int"))
    return df.select(op.alias("op"), F.col(key).alias("record_id"), F.col(label).alias("label"))


_LOG = ("action", "table_name", "record_id", "action_time", "description")


@query("tr2_audit_customers")
def _(t: RentalTables) -> DataFrame:
    guard = (t["rentals"], "customer_id", ("customer_delete", -20060))
    changes = _change(t["customers"], "customer_id", "username")
    return audit.audit(changes, "CUSTOMERS", "customer", AS_OF, [guard]).outcome(*_LOG)


@query("tr3_audit_equipments")
def _(t: RentalTables) -> DataFrame:
    guard = (t["rental_items"], "equipment_id", ("equipment_delete", -20061))
    changes = _change(t["equipments"], "equipment_id", "equipment_name")
    return audit.audit(changes, "EQUIPMENTS", "equipment", AS_OF, [guard]).outcome(*_LOG)


@query("tr4_audit_rentals")
def _(t: RentalTables) -> DataFrame:
    guards = [
        (t["rental_items"], "rental_id", ("rental_delete", -20062)),
        (t["invoices"], "rental_id", ("rental_delete", -20063)),
    ]
    changes = _change(t["rentals"], "rental_id", "rental_code")
    return audit.audit(changes, "RENTALS", "rental", AS_OF, guards).outcome(*_LOG)


@query("tr5_audit_rental_items")
def _(t: RentalTables) -> DataFrame:
    changes = _change(t["rental_items"], "rental_item_id", "equipment_id")
    return audit.audit(changes, "RENTAL_ITEMS", "rental item", AS_OF).accepted


@query("tr6_audit_invoices")
def _(t: RentalTables) -> DataFrame:
    changes = _change(t["invoices"], "invoice_id", "invoice_number")
    return audit.audit(changes, "INVOICES", "invoice", AS_OF).accepted


def _status_changes(t: RentalTables) -> DataFrame:
    """Items that left BORROWING."""
    return t["rental_items"].where("item_status <> 'BORROWING'").select(
        "rental_item_id",
        "equipment_id",
        F.lit("BORROWING").alias("old_item_status"),
        F.col("item_status").alias("new_item_status"),
    )


@query("tr7_equipment_status")
def _(t: RentalTables) -> DataFrame:
    return audit.status_changes(_status_changes(t), t["rental_items"], t["equipments"])


@query("tr7_status_log")
def _(t: RentalTables) -> DataFrame:
    return audit.status_log(_status_changes(t), t["rental_items"], AS_OF, CLIENT)


@query("tr8_equipment_available")
def _(t: RentalTables) -> DataFrame:
    told = checks.check_available(t["rental_items"], t["equipments"]).outcome(
        "rental_item_id", "equipment_id", "equipment_status"
    )
    return told.withColumn("message", checks.with_status("message"))


@query("tr9_rental_totals")
def _(t: RentalTables) -> DataFrame:
    return audit.rental_totals(t["rentals"], t["rental_items"])


# name, table, key, {column: (prefix, pad)}
ID_TRIGGERS: tuple[tuple[str, str, str, dict[str, tuple[str, int]]], ...] = (
    ("tr10_rental_ids", "rentals", "rental_id",
     {"rental_id": ("RE", 3), "rental_code": ("RC", 5)}),
    ("tr11_rental_item_ids", "rental_items", "rental_item_id", {"rental_item_id": ("RI", 3)}),
    ("tr12_return_ids", "returns", "return_id", {"return_id": ("RT", 3)}),
    ("tr13_invoice_ids", "invoices", "invoice_id",
     {"invoice_id": ("IN", 3), "invoice_number": ("INV", 5)}),
    ("tr14_payment_ids", "payments", "payment_id",
     {"payment_id": ("PY", 3), "transaction_code": ("TX", 5)}),
    ("tr15_deposit_ids", "deposits", "deposit_id", {"deposit_id": ("DP", 3)}),
    ("tr16_system_log_ids", "system_log", "log_id", {"log_id": ("LG", 3)}),
)


def _id_trigger(table: str, key: str, codes: dict[str, tuple[str, int]]) -> Query:
    def run(t: RentalTables) -> DataFrame:
        """Rows arrive with a missing id (and code) unless their key is a multiple of 4 (5)."""
        arriving: list[Column] = [F.col(key).alias("arrival")]
        for every, name in zip((4, 5), codes):
            arriving.append(
                F.when(F.col(key) % every == 0, F.col(name).cast("string")).alias(name)
            )
        return audit.fill_codes(t[table].select(*arriving), "arrival", codes)

    return run


for _name, _table, _key, _codes in ID_TRIGGERS:
    query(_name)(_id_trigger(_table, _key, _codes))


# ---------------------------------------------------------------- data quality

# Broken values put into the mapped tables, so that every rule family has something to find:
# table -> {column: expression that both engines evaluate}.
BROKEN: dict[str, dict[str, str]] = {
    "customers": {
        "customer_id": "CASE WHEN customer_id % 100 = 11 THEN customer_id + 1"
                       " WHEN customer_id % 100 = 13 THEN NULL ELSE customer_id END",
        "email": "CASE WHEN customer_id % 90 = 0 THEN 'same@example.com' ELSE email END",
        "status": "CASE WHEN customer_id % 70 = 1 THEN 'BLOCKED' ELSE status END",
        "phone": "CASE WHEN customer_id % 110 = 2 THEN NULL ELSE phone END",
    },
    "equipments": {
        "category_id": "CASE WHEN equipment_id % 300 = 7 THEN 'CAT09' ELSE category_id END",
        "equipment_type": "CASE WHEN equipment_id % 400 = 3 THEN 'SPARE' ELSE equipment_type END",
    },
    "rentals": {
        "rental_code": "CASE WHEN rental_id % 300 = 4 THEN 'RC-DOUBLE' ELSE rental_code END",
        "customer_id": "CASE WHEN rental_id % 200 = 7 THEN -5 ELSE customer_id END",
        "status": "CASE WHEN rental_id % 150 = 3 THEN 'ACTIVE' ELSE status END",
        "due_date": "CASE WHEN rental_id % 250 = 9 THEN NULL ELSE due_date END",
        "payment_status": "CASE WHEN rental_id % 100 = 5 THEN 'OWING' ELSE payment_status END",
    },
    "rental_items": {
        "rental_item_id": "CASE WHEN days = 7 AND quantity = 50 THEN equipment_id"
                          " ELSE rental_item_id END",
        "item_status": "CASE WHEN equipment_id % 500 = 1 THEN 'BROKEN' ELSE item_status END",
        "quantity": "CASE WHEN equipment_id % 400 = 2 THEN NULL ELSE quantity END",
    },
    "returns": {
        "damage_percent": "cast(damage_percent * 2 - 50 AS decimal(5,2))",
        "checked_by": "CASE WHEN return_id % 300 = 8 THEN 9 ELSE checked_by END",
    },
    "deposits": {
        "deposit_amount": "CASE WHEN deposit_id % 60 = 1 THEN -deposit_amount"
                          " ELSE deposit_amount END",
        "refund_amount": "CASE WHEN deposit_id % 60 = 2 THEN cast(99999 AS decimal(10,2))"
                         " WHEN deposit_id % 60 = 3 THEN cast(-1 AS decimal(10,2)) END",
        "extra_charge_amount": "CASE WHEN deposit_id % 80 = 5 THEN cast(-2 AS decimal(10,2)) END",
    },
    "payments": {
        "payment_method": "CASE WHEN payment_id % 900 = 1 THEN 'GOLD' ELSE payment_method END",
        "payment_type": "CASE WHEN payment_id % 5 = 1 THEN 'EXTRA' ELSE payment_type END",
        "rental_id": "CASE WHEN payment_id % 7 = 2 THEN NULL ELSE rental_id END",
        "transaction_code": "CASE WHEN payment_id % 800 = 3 THEN 'TX-DOUBLE'"
                            " WHEN payment_id % 800 = 4 THEN NULL ELSE transaction_code END",
    },
    "inventory": {
        "available_quantity": "CASE WHEN equipment_id % 25 = 0 THEN available_quantity - 100"
                              " ELSE available_quantity END",
        "lost_quantity": "CASE WHEN equipment_id % 40 = 1 THEN -1 ELSE lost_quantity END",
    },
    "equipment_images": {
        "is_primary": "CASE WHEN image_id % 90 = 0 THEN 2 ELSE is_primary END",
    },
}


class _Checked:
    """The mapped tables with the broken values in place."""

    def __init__(self, tables: RentalTables):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        df = self.tables[name]
        # One projection, so that an expression sees the other columns unbroken.
        broken = {c: F.expr(e).cast(dict(df.dtypes)[c]) for c, e in BROKEN.get(name, {}).items()}
        return df.withColumns(broken) if broken else df


def _dq(family: str) -> Query:
    return lambda t: quality.check(_Checked(t), [family])


for _number, _family in enumerate(quality.FAMILIES, start=1):
    query(f"dq{_number}_{_family}")(_dq(_family))


# ---------------------------------------------------------------- settlement


@query("st1_overdue_rentals")
def _(t: RentalTables) -> DataFrame:
    return settlement.overdue(t["rentals"], AS_OF)


@query("st2_deposit_settlement")
def _(t: RentalTables) -> DataFrame:
    return settlement.deposit_settlement(t["deposits"], t["invoices"], _refunds(t).accepted)


@query("st3_overlapping_rentals")
def _(t: RentalTables) -> DataFrame:
    return settlement.overlapping_rentals(t["rentals"], t["rental_items"])


@query("st4_stock_drift")
def _(t: RentalTables) -> DataFrame:
    return settlement.stock_drift(t["inventory_half_rented"], t["rental_items"])


# ---------------------------------------------------------------- streaming


@query("str1_audit_stream")
def _(t: RentalTables) -> DataFrame:
    feed = jobs.file_stream(t.spark, f"{t.folder}/orders.parquet").select(
        F.when(F.col("o_orderstatus") == "P", "I")
        .when(F.col("o_orderstatus") == "O", "U")
        .otherwise("D")
        .alias("op"),
        F.col("o_orderkey").alias("record_id"),
        C.code_text("RC", F.col("o_orderkey"), 9).alias("label"),
        F.col("o_orderdate").alias("change_time"),
    )
    return jobs.run_audit(feed, "RENTALS", "rental")


@query("str2_running_totals")
def _(t: RentalTables) -> DataFrame:
    """Items are inserted; returned ones double their subtotal later, lost ones go away."""
    prices = t["equipments"].select(
        F.col("equipment_id").alias("l_partkey"), "rental_price_per_day"
    )
    subtotal = C.money(
        F.col("l_quantity").cast("int") * F.col("l_linenumber") * F.col("rental_price_per_day")
    )
    none = F.lit(None).cast("decimal(10,2)")

    def change(old: Column, new: Column) -> Column:
        return F.struct(old.alias("old_subtotal"), new.alias("new_subtotal"))

    lost = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    feed = (
        jobs.file_stream(t.spark, f"{t.folder}/lineitem.parquet")
        .join(prices, "l_partkey")
        .withColumn("_s", subtotal)
        .select(
            F.col("l_orderkey").alias("rental_id"),
            F.inline(
                F.array_compact(
                    F.array(
                        change(none, F.col("_s")),
                        F.when(
                            F.col("l_returnflag") == "R",
                            change(F.col("_s"), C.money(F.col("_s") * 2)),
                        ),
                        F.when(lost, change(F.col("_s"), none)),
                    )
                )
            ),
        )
    )
    return jobs.run_totals(feed)


def _rental_feeds(orders: DataFrame, again: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of rentals, and the items and invoices that come to them and leave them."""
    changes = orders.select(
        F.when(F.col("o_orderstatus") == "P", "I").when(F.col("o_orderstatus") == "O", "U").otherwise("D").alias("op"),
        F.col("o_orderkey").alias("record_id"),
        C.code_text("RC", F.col("o_orderkey"), 9).alias("label"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '30' DAY ELSE o_orderdate END").alias("change_time"),
    )
    items = lines.select(
        F.lit(0).alias("guard"), F.col("l_orderkey").alias("record_id"),
        F.inline(F.array_compact(F.array(
            F.struct(F.lit("I").alias("op"), F.col("l_shipdate").alias("change_time")),
            F.when(F.col("l_returnflag") == "R", F.struct(F.lit("D").alias("op"), F.expr("l_shipdate + INTERVAL '20' DAY").alias("change_time"))),
        ))),
    )
    invoices = again.where("o_orderkey % 5 = 0").select(
        F.lit(1).alias("guard"), F.col("o_orderkey").alias("record_id"), F.lit("I").alias("op"),
        F.expr("o_orderdate + INTERVAL '10' DAY").alias("change_time"),
    )
    return changes, items.unionByName(invoices)


RENTAL_GUARDS = (("rental_delete", -20062), ("rental_delete", -20063))


@query("tr4_audit_rental_feed")
def _(t: RentalTables) -> DataFrame:
    """Deletes of a timed feed against the children that are there at that time."""
    read = lambda name: t.spark.read.parquet(f"{t.folder}/{name}.parquet")
    feeds = _rental_feeds(read("orders"), read("orders"), read("lineitem"))
    return audit.audit_feed(*feeds, "RENTALS", "rental", RENTAL_GUARDS).outcome(*_LOG)


@query("str3_guarded_audit_stream")
def _(t: RentalTables) -> DataFrame:
    """The same feed as a stream: the children of every rental are its state."""
    stream = lambda name: jobs.file_stream(t.spark, f"{t.folder}/{name}.parquet")
    feeds = _rental_feeds(stream("orders"), stream("orders"), stream("lineitem"))
    return keyed.run_guarded_audit(*feeds, "RENTALS", "rental", RENTAL_GUARDS).outcome(*_LOG)


@query("str4_latest_returns")
def _(t: RentalTables) -> DataFrame:
    """Items returned per rental: number, value and latest return; some returns are taken back later."""
    undone = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 2 == 0)
    feed = jobs.file_stream(t.spark, f"{t.folder}/lineitem.parquet").select(
        F.col("l_orderkey").alias("rental_id"), F.col("l_shipdate").alias("return_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.explode(F.array_compact(F.array(F.lit("I"), F.when(undone, F.lit("D"))))).alias("op"),
    )
    kept = keyed.run_tracked(keyed.row_changes(feed, "rental_id", "return_date", "amount"))
    return keyed.as_results(kept, "rental_id", "latest_return", "amount")


# ---------------------------------------------------------------- values by time


@query("rp7_status_at")
def _(t: RentalTables) -> DataFrame:
    """The status that an equipment had got from its items at the time of each order."""
    lines = t.spark.read.parquet(f"{t.folder}/lineitem.parquet")
    orders = t.spark.read.parquet(f"{t.folder}/orders.parquet")
    events = lines.select(
        F.col("l_partkey").alias("equipment_id"), F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "MAINTENANCE").when(F.col("l_returnflag") == "A", "DISABLED").otherwise("AVAILABLE").alias("status"),
    )
    moments = orders.select(F.col("o_custkey").alias("equipment_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order_id"))
    return timeline.as_of(events, moments, ["equipment_id"], "at", ["l_orderkey", "l_linenumber"], ["status"])


@query("sp7_tax_by_date")
def _(t: RentalTables) -> DataFrame:
    """Orders taxed at their own date, by terms that overlap and leave gaps."""
    orders = t.spark.read.parquet(f"{t.folder}/orders.parquet")
    suppliers = t.spark.read.parquet(f"{t.folder}/supplier.parquet")
    since = F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(cast(s_suppkey * 37 % 2400 AS INT))")
    taxes = suppliers.select(
        C.code_text("TX", F.col("s_suppkey"), 4).alias("tax_id"), F.expr("cast(s_suppkey % 13 AS decimal(5,2))").alias("tax_rate"),
        F.expr("cast(s_suppkey % 7 <> 0 AS int)").alias("is_active"), since.alias("effective_from"),
        (since + F.expr("make_dt_interval(cast(s_suppkey % 41 AS INT))")).alias("effective_to"),
    )
    rows = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("invoice_date"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    return billing.taxes_by_date(rows, "invoice_date", taxes).select(
        "order_id", "invoice_date", "tax_id", C.percent_of(F.col("amount"), F.col("tax_rate")).alias("tax_amount")
    )
