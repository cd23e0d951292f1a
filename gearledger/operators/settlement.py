"""Overdue rentals, deposit settlement, overlapping rentals and stock drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import settle
from .numbering import running_total, time_slices


def overdue(rentals: DataFrame, as_of: str) -> DataFrame:
    """Running rentals past their due date."""
    return rentals.where(
        (F.col("status") == "BORROWING") & (F.col("due_date") < C.clock(as_of))
    ).select("rental_id", "rental_code", "customer_id", "due_date")


def deposit_settlement(
    deposits: DataFrame, invoices: DataFrame, refunded: DataFrame
) -> DataFrame:
    """Settle each deposit against the final invoices: refund, deduction or extra charge.

    ``refunded`` is the result of the refund rule. The invoice already subtracts the deposit
    that the refund rule pays back; ``counted_twice`` shows that overlap.
    """
    billed = (
        invoices.where(F.col("invoice_type") == "FINAL")
        .groupBy("rental_id")
        .agg(
            F.sum("total_amount").alias("invoice_total"),
            F.sum(F.coalesce("deposit_used", C.dec(0, 10, 2))).alias("deposit_used"),
        )
    )
    paid_back = refunded.groupBy("rental_id").agg(F.sum("refund_amount").alias("_back"))
    held = F.col("deposit_amount")
    zero = F.lit(0).cast("decimal(20,2)")
    back = F.coalesce("_back", zero)
    return (
        deposits.select("rental_id", "deposit_amount")
        .join(billed, "rental_id")
        .join(paid_back, "rental_id", "left")
        .select(
            "rental_id",
            "deposit_amount",
            "invoice_total",
            F.least(held, F.col("invoice_total")).alias("deducted"),
            F.greatest(held - F.col("invoice_total"), zero).alias("refund"),
            F.greatest(F.col("invoice_total") - held, zero).alias("extra_charge"),
            "deposit_used",
            back.alias("refunded_by_rule"),
            F.greatest(F.col("deposit_used") + back - held, zero).alias("counted_twice"),
        )
    )


def overlapping_rentals(rentals: DataFrame, items: DataFrame) -> DataFrame:
    """Running rentals that hold an equipment while others hold it too, with their number.

    Pairs are never formed. The number of intervals [start, due) overlapping one interval is
    (starts before its end) - (ends up to its start) - itself, and both counts are running
    totals over the equipment's timeline, cut into days.
    """
    held = (
        items.select("rental_id", "equipment_id")
        .distinct()
        .join(
            rentals.where("status = 'BORROWING'").select(
                "rental_id",
                F.coalesce("start_date", "rental_date").alias("held_from"),
                F.col("due_date").alias("held_to"),
            ),
            "rental_id",
        )
        .where("held_from < held_to")
    )
    held = settle(held)
    timeline = (
        held.select(
            "equipment_id",
            F.inline(
                F.array(
                    F.struct(F.col("held_from").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                    F.struct(F.col("held_to").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")),
                )
            ),
        )
        .groupBy("equipment_id", "at")
        .agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        .withColumns(time_slices("at"))
    )
    counted = running_total(
        timeline, ["equipment_id"], [*time_slices("at"), "at"], {"starts_before": "s", "ends_before": "e"}
    )
    starts = counted.select("equipment_id", F.col("at").alias("held_to"), "starts_before")
    ends = counted.select(
        "equipment_id", F.col("at").alias("held_from"),
        (F.col("ends_before") + F.col("e")).alias("ends_upto"),
    )
    return (
        held.join(starts, ["equipment_id", "held_to"])
        .join(ends, ["equipment_id", "held_from"])
        .select(
            "equipment_id",
            "rental_id",
            "held_from",
            "held_to",
            (F.col("starts_before") - F.col("ends_upto") - 1).alias("overlaps"),
        )
        .where("overlaps > 0")
    )


def stock_drift(inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Stocked equipment whose stored buckets disagree with its borrowed items."""
    out = (
        items.where(F.col("item_status") == "BORROWING")
        .groupBy("equipment_id")
        .agg(F.sum("quantity").alias("_out"))
    )
    borrowed = F.coalesce("_out", F.lit(0))
    rented = F.coalesce("rented_quantity", F.lit(0))
    return (
        inventory.select(
            "equipment_id", "total_quantity", "available_quantity", "rented_quantity"
        )
        .join(out, "equipment_id", "left")
        .select(
            "equipment_id",
            "total_quantity",
            "available_quantity",
            "rented_quantity",
            borrowed.alias("borrowed_quantity"),
            (rented - borrowed).alias("rented_drift"),
        )
        .where("rented_drift <> 0")
    )
