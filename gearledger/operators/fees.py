"""Values, deposits and fees over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .rejects import Decision, first_refusal, refuse


def _value(now: Column) -> Column:
    return C.equipment_value(
        F.col("purchase_price"), F.col("depreciation_rate"), F.col("purchase_date"), now
    )


def equipment_values(equipments: DataFrame, as_of: str) -> DataFrame:
    """Current value of every equipment."""
    return equipments.select(
        "equipment_id", _value(C.clock(as_of)).alias("equipment_value")
    )


def equipment_deposits(equipments: DataFrame, as_of: str) -> DataFrame:
    """Deposit for one unit of every equipment."""
    return equipments.select(
        "equipment_id",
        C.unit_deposit(
            F.col("purchase_price"),
            F.col("depreciation_rate"),
            F.col("purchase_date"),
            F.col("deposit_rate"),
            C.clock(as_of),
        ).alias("deposit"),
    )


def _last_returns(items: DataFrame, returns: DataFrame) -> DataFrame:
    return (
        returns.select("rental_item_id", "return_date")
        .join(items.select("rental_item_id", "rental_id"), "rental_item_id")
        .groupBy("rental_id")
        .agg(F.max("return_date").alias("last_return"))
    )


def _daily_bases(items: DataFrame) -> DataFrame:
    return items.groupBy("rental_id").agg(
        F.sum(F.col("price_per_day") * F.col("quantity")).alias("daily_base")
    )


def late_fees(rentals: DataFrame, items: DataFrame, returns: DataFrame) -> DataFrame:
    """Late fee per rental: last return of any item against the due date, all items priced."""
    return (
        rentals.select("rental_id", "due_date")
        .join(_last_returns(items, returns), "rental_id", "left")
        .join(_daily_bases(items), "rental_id", "left")
        .select(
            "rental_id",
            "due_date",
            "last_return",
            C.late_fee(F.col("due_date"), F.col("last_return"), F.col("daily_base")).alias(
                "late_fee"
            ),
        )
    )


def damage_fees(
    returns: DataFrame, items: DataFrame, equipments: DataFrame, as_of: str
) -> DataFrame:
    """Damage fee of every return; a return without its item or equipment costs nothing."""
    priced = (
        returns.select(
            "return_id", "rental_item_id", "return_date", "condition_status", "damage_percent"
        )
        .join(
            items.select("rental_item_id", "rental_id", "equipment_id", "quantity"),
            "rental_item_id",
            "left",
        )
        .join(
            equipments.select(
                "equipment_id", "purchase_price", "depreciation_rate", "purchase_date"
            ),
            "equipment_id",
            "left",
        )
    )
    fee = C.damage_fee(
        F.col("condition_status"),
        F.col("damage_percent"),
        F.col("quantity"),
        _value(C.clock(as_of)),
    )
    return priced.select(
        "return_id",
        "rental_item_id",
        "rental_id",
        "return_date",
        F.when(F.col("purchase_price").isNull(), C.dec(0, 10, 2)).otherwise(fee).alias(
            "damage_fee"
        ),
    )


def invoice_totals(invoices: DataFrame, taxes: DataFrame) -> DataFrame:
    """Final amount recomputed from the invoice parts; an unknown tax gives 0."""
    part = {
        name: F.coalesce(F.col(name), C.dec(0, 10, 2))
        for name in ("rental_amount", "late_fee", "damage_fee", "shipping_fee", "deposit_used")
    }
    joined = invoices.join(
        taxes.select("tax_id", F.coalesce("tax_rate", C.dec(0, 5, 2)).alias("rate")),
        "tax_id",
        "left",
    ).withColumn(
        "_subtotal",
        C.money(
            part["rental_amount"] + part["late_fee"] + part["damage_fee"] + part["shipping_fee"]
        ),
    )
    total = C.money(F.col("_subtotal") + C.percent_of(F.col("_subtotal"), F.col("rate")))
    final = C.floor_zero(C.money(total - part["deposit_used"]))
    return joined.select(
        "invoice_id",
        F.when(F.col("rate").isNull(), C.dec(0, 10, 2)).otherwise(final).alias(
            "calculated_final"
        ),
        "final_amount",
    )


def shipping_fees(rentals: DataFrame, shops: DataFrame, customers: DataFrame) -> Decision:
    """Shipping fee per rental from the distance between shop and customer."""
    located = (
        rentals.select("rental_id", "rental_type", "shop_id", "customer_id")
        .join(
            shops.select(
                "shop_id",
                F.lit(True).alias("_shop"),
                F.col("latitude").alias("_lat1"),
                F.col("longitude").alias("_lon1"),
            ),
            "shop_id",
            "left",
        )
        .join(
            customers.select(
                "customer_id",
                F.lit(True).alias("_customer"),
                F.col("latitude").alias("_lat2"),
                F.col("longitude").alias("_lon2"),
            ),
            "customer_id",
            "left",
        )
    )
    place = [F.col(c) for c in ("_lat1", "_lon1", "_lat2", "_lon2")]
    method = F.upper("rental_type")
    pickup = F.coalesce(method == "PICKUP", F.lit(False))
    back = F.coalesce(method == "RETURN", F.lit(False))
    km = C.distance_km(*place)
    free = C.dec(0, 10, 2)
    decided = located.withColumns(
        {
            "distance_km": F.when(~pickup & ~back, km),
            "shipping_fee": F.when(pickup | back, free).otherwise(C.distance_fee(km)),
            "refusal": first_refusal(
                (
                    F.col("_shop").isNull() | F.col("_customer").isNull(),
                    refuse("shipping_fee", -20023),
                ),
                (
                    ~pickup & (place[0].isNull() | place[1].isNull()),
                    refuse("shipping_fee", -20022),
                ),
                (
                    ~pickup & (place[2].isNull() | place[3].isNull()),
                    refuse("shipping_fee", -20020),
                ),
                (~pickup & ~back & (km > C.FAR_KM), refuse("shipping_fee", -20021)),
            ),
        }
    )
    fee = F.when(F.col("refusal").isNull(), F.col("shipping_fee"))
    return Decision(
        decided.withColumn("shipping_fee", fee).select(
            "rental_id", "distance_km", "shipping_fee", "refusal"
        ),
        "rental_id",
    )


def rental_charges(
    rentals: DataFrame, items: DataFrame, returns: DataFrame, equipments: DataFrame, as_of: str
) -> DataFrame:
    """Rent, late fee (unrounded) and damage fee of each given rental.

    Items and returns are reduced to one row per rental before they meet the rentals, and the
    returns are joined once for both the last return and the damage.
    """
    wanted = rentals.select("rental_id", "due_date")
    rents = items.groupBy("rental_id").agg(
        F.sum("subtotal").alias("rental_amount"),
        F.sum(F.col("price_per_day") * F.col("quantity")).alias("daily_base"),
    )
    returned = (
        damage_fees(returns, items, equipments, as_of)
        .groupBy("rental_id")
        .agg(
            F.max("return_date").alias("last_return"),
            F.sum("damage_fee").alias("damage_fee"),
        )
    )
    return (
        wanted.join(rents, "rental_id", "left")
        .join(returned, "rental_id", "left")
        .select(
            "rental_id",
            F.coalesce("rental_amount", C.dec(0, 10, 2)).alias("rental_amount"),
            C.late_fee(F.col("due_date"), F.col("last_return"), F.col("daily_base")).alias(
                "late_fee"
            ),
            F.coalesce("damage_fee", C.dec(0, 10, 2)).alias("damage_fee"),
        )
    )
