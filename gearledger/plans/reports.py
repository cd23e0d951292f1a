"""Report queries that accompany the fee rules and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shipping_totals(shipments: DataFrame, rentals: DataFrame) -> DataFrame:
    """Shipping fees paid per rental, reduced before the rentals are looked up."""
    return (
        shipments.groupBy("rental_id")
        .agg(F.sum("shipping_fee").alias("total_shipping_fee"))
        .join(rentals.select("rental_id"), "rental_id", "left_semi")
    )


def audit_log(log: DataFrame) -> DataFrame:
    """The audit log, newest first; the id splits rows of one moment."""
    return log.orderBy(F.desc_nulls_first("action_time"), F.asc("log_id"))
