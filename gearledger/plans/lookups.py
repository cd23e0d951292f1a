"""Parameterised lookups. Filters and column lists reach the file scan by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows with start <= column < end."""
    return df.where((F.col(column) >= ts(start)) & (F.col(column) < ts(end)))


def equipment_by_type(equipments: DataFrame, kind: str, status: str) -> DataFrame:
    return equipments.where((F.col("equipment_type") == kind) & (F.col("status") == status)).select(
        "equipment_id", "equipment_name", "equipment_type", "status"
    )


def equipment_by_category(equipments: DataFrame, category: str) -> DataFrame:
    return equipments.where(F.col("category_id") == category).select(
        "equipment_id", "equipment_name", "category_id"
    )


def equipment_by_make(
    equipments: DataFrame, brand: str, model: str | None = None, mount: str | None = None
) -> DataFrame:
    """By brand, then optionally model, then optionally mount type: an ordered prefix."""
    rows = equipments.where(F.col("brand") == brand)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if mount is not None:
        rows = rows.where(F.col("mount_type") == mount)
    return rows.select("equipment_id", "brand", "model", "mount_type")


def customers_by_status(customers: DataFrame, status: str) -> DataFrame:
    return customers.where(F.col("status") == status).select(
        "customer_id", "full_name", "status"
    )


def customers_in_box(
    customers: DataFrame, south: float, north: float, west: float, east: float
) -> DataFrame:
    return customers.where(
        F.col("latitude").between(F.lit(str(south)).cast("decimal(9,6)"), F.lit(str(north)).cast("decimal(9,6)"))
        & F.col("longitude").between(F.lit(str(west)).cast("decimal(9,6)"), F.lit(str(east)).cast("decimal(9,6)"))
    ).select("customer_id", "latitude", "longitude")


def rental_report(rentals: DataFrame, start: str, end: str) -> DataFrame:
    """Rentals per status and month inside a date range."""
    return (
        between_dates(rentals, "rental_date", start, end)
        .groupBy("status", F.date_trunc("month", "rental_date").cast("timestamp_ntz").alias("month"))
        .agg(F.count("*").alias("rental_count"), F.sum("total_amount").alias("total_amount"))
    )


def rentals_of(rentals: DataFrame, customers: DataFrame, employee_id: int) -> DataFrame:
    """Rentals an employee handled, with the customer's name."""
    return (
        rentals.where(F.col("employee_id") == employee_id)
        .select("rental_id", "customer_id", "employee_id")
        .join(customers.select("customer_id", "full_name"), "customer_id")
    )


def items_per_status(items: DataFrame) -> DataFrame:
    """Items and units per equipment and status: the stock check."""
    return items.groupBy("equipment_id", "item_status").agg(
        F.count("*").alias("item_count"), F.sum("quantity").alias("units")
    )


def items_of_rentals(items: DataFrame, rentals: DataFrame, status: str) -> DataFrame:
    """Item count and rent of every rental in a status."""
    per_rental = items.groupBy("rental_id").agg(
        F.count("*").alias("item_count"), F.sum("subtotal").alias("rent")
    )
    return rentals.where(F.col("status") == status).select("rental_id").join(per_rental, "rental_id")


def invoices_of_rentals(invoices: DataFrame, rentals: DataFrame) -> DataFrame:
    return invoices.select("invoice_id", "rental_id", "status", "final_amount").join(
        rentals.select("rental_id", "customer_id"), "rental_id"
    )


def unpaid_invoices(invoices: DataFrame, start: str, end: str) -> DataFrame:
    """Unpaid invoices and what they owe, per day."""
    return (
        between_dates(
            invoices.where(F.col("status").isin("PENDING", "PARTIAL")), "invoice_date", start, end
        )
        .groupBy(F.to_date("invoice_date").alias("invoice_day"))
        .agg(F.count("*").alias("invoice_count"), F.sum("final_amount").alias("amount_due"))
    )


def payments_of_invoices(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Payments and paid amount per invoice and payment status."""
    return (
        payments.where(F.col("invoice_id").isNotNull())
        .groupBy("invoice_id", "payment_status")
        .agg(F.count("*").alias("payment_count"), F.sum("amount").alias("amount"))
        .join(invoices.select("invoice_id"), "invoice_id", "left_semi")
    )


def payments_by_date(payments: DataFrame, start: str, end: str) -> DataFrame:
    return (
        between_dates(payments, "payment_date", start, end)
        .select("payment_id", "payment_date", "payment_type", "amount")
        .orderBy("payment_date", "payment_id")
    )


def log_between(log: DataFrame, start: str, end: str) -> DataFrame:
    return (
        between_dates(log, "action_time", start, end)
        .select("log_id", "action", "table_name", "action_time")
        .orderBy(F.desc("action_time"), "log_id")
    )


def log_of_table(log: DataFrame, table: str) -> DataFrame:
    return log.where(F.col("table_name") == table).select(
        "log_id", "action", "table_name", "record_id"
    )
