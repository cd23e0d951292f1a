"""The reporting views. ``ordered=True`` adds the view's sort, at the edge of the plan.

Each sort ends in a unique key: equal leading values can then be split over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _sorted(df: DataFrame, ordered: bool, *keys: Column) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


def borrowed_units(items: DataFrame) -> DataFrame:
    """Borrowed units per equipment, reduced before any join."""
    return (
        items.where(F.col("item_status") == "BORROWING")
        .groupBy("equipment_id")
        .agg(F.sum("quantity").alias("_borrowed"))
    )


def inventory_status(
    inventory: DataFrame, equipments: DataFrame, items: DataFrame, ordered: bool = False
) -> DataFrame:
    """Total, borrowed and available units of every stocked equipment."""
    borrowed = F.coalesce("_borrowed", F.lit(0))
    view = (
        inventory.select("equipment_id", "total_quantity")
        .join(
            equipments.select(
                "equipment_id",
                "equipment_name",
                "equipment_type",
                F.col("status").alias("equipment_status"),
            ),
            "equipment_id",
        )
        .join(borrowed_units(items), "equipment_id", "left")
        .select(
            "equipment_id",
            "equipment_name",
            "equipment_type",
            "equipment_status",
            "total_quantity",
            borrowed.alias("borrowed_quantity"),
            (F.col("total_quantity") - borrowed).alias("available_quantity"),
        )
    )
    return _sorted(view, ordered, F.asc("equipment_name"), F.asc("equipment_id"))


def available_equipment(
    equipments: DataFrame, inventory: DataFrame, items: DataFrame, ordered: bool = False
) -> DataFrame:
    """AVAILABLE equipment with price and free units; no stock row counts as 0."""
    view = (
        equipments.where(F.col("status") == "AVAILABLE")
        .select(
            "equipment_id",
            "equipment_name",
            "equipment_type",
            F.col("status").alias("equipment_status"),
            "rental_price_per_day",
        )
        .join(inventory.select("equipment_id", "total_quantity"), "equipment_id", "left")
        .join(borrowed_units(items), "equipment_id", "left")
        .withColumn(
            "available_quantity",
            F.coalesce("total_quantity", F.lit(0)) - F.coalesce("_borrowed", F.lit(0)),
        )
        .drop("total_quantity", "_borrowed")
    )
    return _sorted(view, ordered, F.asc("equipment_name"), F.asc("equipment_id"))


def rental_details(
    rentals: DataFrame,
    customers: DataFrame,
    employees: DataFrame,
    items: DataFrame,
    equipments: DataFrame,
    ordered: bool = False,
) -> DataFrame:
    """Rentals with customer, employee, items and equipment; rentals without items stay.

    Items are joined to rentals (both sides can be split if one rental is huge), and the
    rentals without items are added; an outer join could not split its inner side.
    """
    heads = (
        rentals.select(
            "rental_id", "rental_code", "rental_type", F.col("status").alias("rental_status"),
            "total_amount", "deposit_required", "rental_date", "due_date", "return_date",
            "customer_id", "employee_id",
        )
        .join(
            customers.select("customer_id", F.col("full_name").alias("customer_name")),
            "customer_id",
        )
        .join(
            employees.select("employee_id", F.col("full_name").alias("employee_name")),
            "employee_id",
        )
    )
    lines = items.select(
        "rental_id", "rental_item_id", "equipment_id", "quantity", "days", "price_per_day",
        "subtotal", "item_status",
    )
    named = equipments.select(
        "equipment_id", "equipment_name", F.col("equipment_id").alias("_known")
    )
    filled = (
        lines.join(heads, "rental_id")
        .join(named, "equipment_id", "left")
        .withColumn("equipment_id", F.col("_known"))
        .drop("_known")
    )
    used = items.select("rental_id").distinct()
    view = filled.unionByName(
        heads.join(used, "rental_id", "left_anti"), allowMissingColumns=True
    )
    return _sorted(
        view,
        ordered,
        F.desc_nulls_first("rental_date"),
        F.asc("rental_code"),
        F.asc("rental_item_id"),
    )


def invoice_full(
    invoices: DataFrame,
    rentals: DataFrame,
    payments: DataFrame,
    deposits: DataFrame,
    ordered: bool = False,
) -> DataFrame:
    """Invoices with everything paid on them, whatever its state, and the deposits held."""
    paid = (
        payments.where(F.col("invoice_id").isNotNull())
        .groupBy("invoice_id")
        .agg(F.sum("amount").alias("_paid"))
    )
    held = deposits.groupBy("rental_id").agg(F.sum("deposit_amount").alias("_held"))
    zero = C.dec(0, 10, 2)
    view = (
        invoices.select(
            "invoice_id", "invoice_number", F.col("status").alias("invoice_status"),
            "rental_id", "subtotal_amount", "tax_amount", "total_amount", "deposit_used",
            "final_amount", "invoice_date", "payment_due_date",
        )
        .join(rentals.select("rental_id", "rental_code"), "rental_id")
        .join(paid, "invoice_id", "left")
        .join(held, "rental_id", "left")
        .withColumns(
            {
                "total_paid": F.coalesce("_paid", zero),
                "total_deposit": F.coalesce("_held", zero),
            }
        )
        .drop("_paid", "_held")
    )
    return _sorted(view, ordered, F.desc_nulls_first("invoice_date"), F.asc("invoice_id"))


def return_analysis(
    returns: DataFrame,
    items: DataFrame,
    rentals: DataFrame,
    equipments: DataFrame,
    ordered: bool = False,
) -> DataFrame:
    """Returns with the days (and fractions of days) each came back late."""
    late = C.seconds_between(F.col("due_date"), F.col("return_date"))
    view = (
        returns.select("return_id", "return_date", "rental_item_id")
        .join(
            items.select(
                "rental_item_id", "rental_id", "equipment_id", "quantity", "days", "item_status"
            ),
            "rental_item_id",
        )
        .join(rentals.select("rental_id", "due_date"), "rental_id")
        .join(equipments.select("equipment_id", "equipment_name"), "equipment_id")
        .withColumn(
            "late_days",
            F.when(F.col("return_date").isNull(), F.lit(None).cast("double"))
            .when(late > 0, late.cast("double") / float(C.SECONDS_PER_DAY))
            .otherwise(0.0),
        )
    )
    return _sorted(view, ordered, F.desc_nulls_first("return_date"), F.asc("return_id"))
