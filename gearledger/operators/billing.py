"""Deposits, invoices, payments and refunds as batch transforms of command tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import settle
from . import fees
from . import timeline
from .numbering import dense_number, top_key
from .rejects import Decision, first_refusal, refuse

# The written rule names a status the rental table does not allow; these are the states in
# which a picked-up rental can be.
INVOICE_STATUSES = ("BORROWING", "OVERDUE", "RETURNED")
PICKUP_STATUSES = ("CREATED", "CONFIRMED")
REFUND_STATUSES = ("HELD", "USED")


def first_of(commands: DataFrame, key: str) -> DataFrame:
    """Mark the first command of each key; the later ones meet the state it left behind.

    ``min`` per key aggregates map-side, so a key that repeats endlessly stays small.
    """
    firsts = commands.groupBy(key).agg(F.min("request_id").alias("_first"))
    return (
        commands.join(firsts, key)
        .withColumn("_repeat", F.col("request_id") > F.col("_first"))
        .drop("_first")
    )


def with_codes(df: DataFrame, order: str, **codes: tuple[str, int, int]) -> DataFrame:
    """Add generated ids: ``name=(prefix, pad, last number in use)``."""
    df = settle(df)
    numbered = dense_number(df, order, "_n", top_key(df, order))
    return numbered.withColumns(
        {
            name: C.code_text(prefix, F.col("_n") + last, pad)
            for name, (prefix, pad, last) in codes.items()
        }
    ).drop("_n")


def valid_tax(taxes: DataFrame, as_of: str) -> Column:
    """The tax in force as one (tax_id, tax_rate) value, NULL if there is none.

    Active, clock within validity, latest start first, then lowest id. It is a scalar
    subquery: one aggregated row, evaluated once, and no join.
    """
    now = C.clock(as_of)
    rank = F.struct(
        (-F.unix_micros(F.col("effective_from").cast("timestamp"))).alias("start"), "tax_id"
    )
    return (
        taxes.where(
            (F.col("is_active") == 1)
            & now.between(F.col("effective_from"), F.col("effective_to"))
        )
        .agg(F.min_by(F.struct("tax_id", "tax_rate"), rank).alias("tax"))
        .scalar()
    )


def taxes_by_date(rows: DataFrame, date: str, taxes: DataFrame) -> DataFrame:
    """The rows with the tax (tax_id, tax_rate) in force on each row's own date, NULL where none is.

    The same choice as ``valid_tax``, date by date, without comparing rows with validity ranges.
    """
    rank = F.struct((-F.unix_micros(F.col("effective_from").cast("timestamp"))).alias("start"), F.col("tax_id"))
    value = F.struct("tax_id", "tax_rate")
    found = timeline.in_force(rows, date, taxes.where("is_active = 1"), "effective_from", "effective_to", rank, value, "_tax")
    return found.select(*rows.columns, F.col("_tax.tax_id").alias("tax_id"), F.col("_tax.tax_rate").alias("tax_rate"))


def deposit_payments(
    commands: DataFrame,
    rentals: DataFrame,
    items: DataFrame,
    equipments: DataFrame,
    deposits: DataFrame,
    as_of: str,
) -> Decision:
    """Deposit per command: unit deposit * quantity over items whose deposit rate is above 0."""
    rate = equipments.select(
        "equipment_id",
        F.when(
            F.col("deposit_rate") > 0,
            C.unit_deposit(
                F.col("purchase_price"),
                F.col("depreciation_rate"),
                F.col("purchase_date"),
                F.col("deposit_rate"),
                C.clock(as_of),
            ),
        ).alias("unit"),
    )
    due = (
        items.select("rental_id", "equipment_id", "quantity")
        .join(rate, "equipment_id", "left")
        .groupBy("rental_id")
        .agg(F.coalesce(F.sum(F.col("unit") * F.col("quantity")), F.lit(0)).alias("_due"))
    )
    decided = (
        first_of(commands, "rental_id")
        .join(rentals.select("rental_id", F.lit(True).alias("_rental")), "rental_id", "left")
        .join(due, "rental_id", "left")
        .join(
            deposits.groupBy("rental_id").agg(F.lit(True).alias("_deposit")),
            "rental_id",
            "left",
        )
        .withColumn(
            "refusal",
            first_refusal(
                (F.col("_rental").isNull(), refuse("deposit_payment", -20001)),
                (F.col("_due").isNull(), refuse("deposit_payment", -20004)),
                (F.col("_deposit").isNotNull(), refuse("deposit_payment", -20002)),
                (C.too_large(F.col("_due")), refuse("precision", -6502)),
                (F.col("_due") <= 0, refuse("deposit_payment", -20003)),
                (F.col("_repeat"), refuse("deposit_payment", -20002)),
            ),
        )
        .withColumn(
            "deposit_amount", F.when(F.col("refusal").isNull(), C.money(F.col("_due")))
        )
    )
    return Decision(
        decided.select(
            "request_id", "rental_id", "payment_method", "deposit_amount", "refusal"
        ),
        "request_id",
    )


def deposit_rows(
    decision: Decision, as_of: str, last_payment: int = 0, last_deposit: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The payment and deposit rows of the accepted deposit commands, with their ids."""
    now = C.clock(as_of)
    coded = with_codes(
        decision.accepted,
        "request_id",
        payment_id=("PY", 3, last_payment),
        transaction_code=("TX", 5, last_payment),
        deposit_id=("DP", 3, last_deposit),
    )
    payments = coded.select(
        "payment_id",
        "payment_method",
        F.lit("DEPOSIT").alias("payment_type"),
        F.lit("COMPLETED").alias("payment_status"),
        "transaction_code",
        C.stored(F.col("deposit_amount")).alias("amount"),
        now.alias("payment_date"),
        now.alias("created_at"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("bigint").alias("invoice_id"),
        "rental_id",
    )
    deposits = coded.select(
        "deposit_id",
        C.stored(F.col("deposit_amount")).alias("deposit_amount"),
        F.lit("HELD").alias("status"),
        now.alias("deposit_date"),
        now.alias("created_at"),
        "rental_id",
        "payment_id",
    )
    return payments, deposits


def invoice_drafts(
    rentals: DataFrame,
    items: DataFrame,
    returns: DataFrame,
    equipments: DataFrame,
    shops: DataFrame,
    customers: DataFrame,
    deposits: DataFrame,
    taxes: DataFrame,
    as_of: str,
) -> Decision:
    """Price every given rental as an invoice; refused where shipping or tax is missing."""
    charges = fees.rental_charges(rentals, items, returns, equipments, as_of)
    shipping = fees.shipping_fees(rentals, shops, customers).frame
    used = deposits.groupBy("rental_id").agg(F.sum("deposit_amount").alias("deposit_used"))
    amounts = [
        F.col(name)
        for name in (
            "rental_amount", "late_fee", "damage_fee", "deposit_used", "subtotal_amount",
            "tax_amount", "total_amount",
        )
    ]
    priced = (
        charges.join(shipping.drop("distance_km"), "rental_id")
        .join(used, "rental_id", "left")
        .withColumn("_tax", valid_tax(taxes, as_of))
        .withColumns(
            {
                "tax_id": F.col("_tax.tax_id"),
                "tax_rate": F.col("_tax.tax_rate"),
                "rental_amount": C.money(F.col("rental_amount")),
                "late_fee": C.money(F.col("late_fee")),
                "damage_fee": C.money(F.col("damage_fee")),
                "deposit_used": C.money(F.coalesce("deposit_used", F.lit(0))),
            }
        )
        .withColumn(
            "subtotal_amount",
            C.money(
                F.col("rental_amount")
                + F.col("late_fee")
                + F.col("damage_fee")
                + F.col("shipping_fee")
            ),
        )
        .withColumn("tax_amount", C.percent_of(F.col("subtotal_amount"), F.col("tax_rate")))
        .withColumn("total_amount", C.money(F.col("subtotal_amount") + F.col("tax_amount")))
        .withColumn(
            "final_amount",
            C.floor_zero(C.money(F.col("total_amount") - F.col("deposit_used"))),
        )
        .withColumn(
            "refusal",
            # In the order in which the amounts come up.
            F.coalesce(
                first_refusal((C.too_large(*amounts[:3]), refuse("precision", -6502))),
                F.col("refusal"),
                first_refusal(
                    (C.too_large(*amounts[3:5]), refuse("precision", -6502)),
                    (F.col("tax_id").isNull(), refuse("create_invoice", -1403)),
                    (C.too_large(*amounts[5:]), refuse("precision", -6502)),
                ),
            ),
        )
    )
    return Decision(priced.drop("tax_rate", "_tax"), "rental_id")


INVOICE_AMOUNTS = (
    "rental_amount", "late_fee", "damage_fee", "shipping_fee", "subtotal_amount", "tax_amount",
    "total_amount", "deposit_used", "final_amount",
)


def create_invoices(
    commands: DataFrame,
    rentals: DataFrame,
    items: DataFrame,
    returns: DataFrame,
    equipments: DataFrame,
    shops: DataFrame,
    customers: DataFrame,
    deposits: DataFrame,
    taxes: DataFrame,
    as_of: str,
    eligible: tuple[str, ...] = INVOICE_STATUSES,
) -> Decision:
    """Invoice every command whose rental exists in an eligible status."""
    asked = commands.select("request_id", "rental_id")
    open_rentals = rentals.where(F.col("status").isin(*eligible)).join(
        asked.select("rental_id"), "rental_id", "left_semi"
    )
    drafts = invoice_drafts(
        open_rentals, items, returns, equipments, shops, customers, deposits, taxes, as_of
    ).frame.withColumnRenamed("refusal", "_draft")
    decided = (
        asked.join(rentals.select("rental_id", "status"), "rental_id", "left")
        .join(drafts, "rental_id", "left")
        .withColumn(
            "refusal",
            F.coalesce(
                first_refusal(
                    (F.col("status").isNull(), refuse("create_invoice", -20001)),
                    (~F.col("status").isin(*eligible), refuse("create_invoice", -20002)),
                ),
                F.col("_draft"),
            ),
        )
    )
    kept = [
        F.when(F.col("refusal").isNull(), F.col(name)).alias(name)
        for name in (*INVOICE_AMOUNTS, "tax_id")
    ]
    return Decision(decided.select("request_id", "rental_id", *kept, "refusal"), "request_id")


def invoice_rows(decision: Decision, as_of: str, last: int = 0) -> DataFrame:
    """The invoice rows of the accepted commands, with ids, dates and status."""
    now = C.clock(as_of)
    return with_codes(
        decision.accepted,
        "request_id",
        invoice_id=("IN", 3, last),
        invoice_number=("INV", 5, last),
    ).select(
        "invoice_id",
        "invoice_number",
        F.lit("PENDING").alias("status"),
        *[C.stored(F.col(name)).alias(name) for name in INVOICE_AMOUNTS],
        now.alias("invoice_date"),
        C.plus_days(now, C.PAYMENT_TERM_DAYS).alias("payment_due_date"),
        now.alias("created_at"),
        F.lit("FINAL").alias("invoice_type"),
        "tax_id",
        "rental_id",
    )


def pay_invoices(commands: DataFrame, invoices: DataFrame) -> Decision:
    """Pay pending invoices in full; anything else is refused."""
    pending = invoices.where(F.col("status") == "PENDING").select(
        "invoice_id", "rental_id", "final_amount"
    )
    decided = (
        first_of(commands.select("request_id", "invoice_id", "payment_method"), "invoice_id")
        .join(pending, "invoice_id", "left")
        .withColumn(
            "refusal",
            first_refusal(
                (
                    F.col("final_amount").isNull() | F.col("_repeat"),
                    refuse("pay_invoice", -20010),
                )
            ),
        )
    )
    accepted = F.col("refusal").isNull()
    return Decision(
        decided.select(
            "request_id",
            "invoice_id",
            F.when(accepted, F.col("rental_id")).alias("rental_id"),
            "payment_method",
            F.when(accepted, F.col("final_amount")).alias("amount"),
            "refusal",
        ),
        "request_id",
    )


def _payment(kind: str, method: Column, invoice: Column, as_of: str) -> list[Column]:
    now = C.clock(as_of)
    return [
        method.alias("payment_method"),
        F.lit(kind).alias("payment_type"),
        F.lit("COMPLETED").alias("payment_status"),
        F.col("amount"),
        now.alias("payment_date"),
        now.alias("created_at"),
        invoice.alias("invoice_id"),
        F.col("rental_id"),
    ]


def payment_rows(decision: Decision, as_of: str, last: int = 0) -> DataFrame:
    """The payment rows of paid invoices."""
    return with_codes(
        decision.accepted,
        "request_id",
        payment_id=("PM", 5, last),
        transaction_code=("TX", 5, last),
    ).select(
        "payment_id",
        "transaction_code",
        *_payment("RENTAL", F.col("payment_method"), F.col("invoice_id"), as_of),
    )


def paid_invoices(decision: Decision) -> DataFrame:
    """Status changes of the paid invoices, for a keyed upsert."""
    return decision.accepted.select("invoice_id", F.lit("PAID").alias("status"))


def refunds(
    commands: DataFrame,
    deposits: DataFrame,
    rentals: DataFrame,
    items: DataFrame,
    returns: DataFrame,
    equipments: DataFrame,
    as_of: str,
) -> Decision:
    """Refund of every open deposit of the asked rentals: deposit - late fee - damage, floor 0.

    The fees stay unrounded until the refund is stored, and the new status is decided on the
    unrounded refund. A command has one row per deposit it refunds, or one with its refusal;
    a repeated command finds no open deposit any more.
    """
    asked = first_of(commands.select("request_id", "rental_id"), "rental_id").join(
        rentals.select("rental_id", F.lit(True).alias("_rental")), "rental_id", "left"
    )
    open_deposits = (
        deposits.where(F.col("status").isin(*REFUND_STATUSES))
        .select("deposit_id", "rental_id", "deposit_amount")
        .join(asked.where("NOT _repeat").select("rental_id"), "rental_id")
    )
    charged = fees.rental_charges(
        rentals.join(open_deposits.select("rental_id"), "rental_id", "left_semi"),
        items,
        returns,
        equipments,
        as_of,
    )
    left = (
        F.col("deposit_amount")
        - F.coalesce("late_fee", F.lit(0)).cast("decimal(30,8)")
        - F.coalesce("damage_fee", F.lit(0)).cast("decimal(20,2)")
    )
    exact = F.when(left < 0, C.dec(0, 10, 2)).otherwise(left)
    refunded = open_deposits.join(charged, "rental_id", "left").select(
        "deposit_id",
        "rental_id",
        "deposit_amount",
        C.stored(exact).alias("refund_amount"),  # at most the deposit
        F.when(exact == F.col("deposit_amount"), "REFUNDED")
        .otherwise("PARTIAL_REFUND")
        .alias("status"),
        C.clock(as_of).alias("refund_date"),
        F.lit(False).alias("_repeat"),
    )
    decided = asked.join(refunded, ["rental_id", "_repeat"], "left").withColumn(
        "refusal",
        first_refusal(
            (F.col("_rental").isNull(), refuse("process_refund", -20001)),
            (F.col("deposit_id").isNull(), refuse("process_refund", -1403)),
        ),
    )
    kept = ("deposit_id", "deposit_amount", "refund_amount", "status", "refund_date")
    accepted = [F.when(F.col("refusal").isNull(), F.col(c)).alias(c) for c in kept]
    return Decision(decided.select("request_id", "rental_id", *accepted, "refusal"), "request_id")


def refund_payment_rows(decision: Decision, as_of: str, last: int = 0) -> DataFrame:
    """The cash payment rows of the refunds, numbered by deposit."""
    now_paid = decision.accepted.withColumnRenamed("refund_amount", "amount")
    return with_codes(
        now_paid,
        "deposit_id",
        payment_id=("P", 4, last),
        transaction_code=("TX", 5, last),
    ).select(
        "payment_id",
        "transaction_code",
        *_payment("REFUND", F.lit("CASH"), F.lit(None).cast("bigint"), as_of),
    )
