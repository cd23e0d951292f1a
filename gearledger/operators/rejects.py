"""Refusals as data: every refused row becomes (source, code, message, key)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The refusal vocabulary. Codes repeat between sources, so the pair is the key.
REFUSALS: dict[tuple[str, int], str] = {
    ("shipping_fee", -20020): "Customer coordinates missing",
    ("shipping_fee", -20021): "Shipping not supported",
    ("shipping_fee", -20022): "Shop coordinates missing",
    ("shipping_fee", -20023): "Rental or customer/shop data not found",
    ("compatibility", -20042): "Main equipment not found",
    ("compatibility", -20043): "Extra equipment not found",
    ("compatibility", -20044): "Main equipment must be a CAMERA",
    ("compatibility", -20045): "Missing mount information",
    ("compatibility", -20046): "Lens is not compatible with camera",
    ("compatibility", -20047): "Flash trigger not compatible",
    ("stock_out", -20010): "Quantity must be greater than 0",
    ("stock_out", -20011): "Not enough inventory available",
    ("stock_out", -1403): "no data found",
    ("stock_out", -1407): "cannot update to NULL",
    ("stock_in", -20020): "Invalid condition status",
    ("stock_in", -1403): "no data found",
    ("stock_in", -2290): "check constraint violated",
    ("create_rental", -20050): "Customer or equipment not found",
    ("create_rental", -20060): "Customer must accept terms before rental",
    ("create_rental", -1400): "cannot insert NULL",
    ("deposit_payment", -20001): "Rental not found",
    ("deposit_payment", -20002): "Deposit already exists",
    ("deposit_payment", -20003): "Invalid deposit amount",
    ("deposit_payment", -20004): "No rental items found",
    ("confirm_pickup", -20001): "Rental không tồn tại hoặc không hợp lệ để confirm pickup.",
    ("create_invoice", -20001): "Rental not found",
    ("create_invoice", -20002): "Invoice can only be created for ACTIVE rentals",
    ("create_invoice", -1403): "no data found",
    ("pay_invoice", -20010): "Invoice không tồn tại hoặc đã thanh toán",
    ("process_refund", -20001): "Rental not found",
    ("process_refund", -1403): "No deposit found to refund",
    ("complete_rental", -20001): "Rental không tồn tại",
    ("complete_rental", -20002): "Rental không hợp lệ để hoàn",
    ("item_check", -20040): "Quantity must be greater than 0",
    ("item_check", -20041): "Days and price_per_day cannot be NULL",
    ("item_check", -20042): "Invalid item_status",
    ("item_check", -1403): "no data found",
    ("item_available", -20050): "Cannot rent equipment",
    ("precision", -6502): "numeric or value error",
    ("customer_delete", -20060): "Cannot delete customer; linked rentals exist.",
    ("equipment_delete", -20061): "Cannot delete equipment; linked rental items exist.",
    ("rental_delete", -20062): "Cannot delete rental; linked rental items exist.",
    ("rental_delete", -20063): "Cannot delete rental; linked invoices exist.",
}

REFUSAL_TYPE = "struct<source:string,code:int>"


def refuse(source: str, code: int) -> Column:
    """The refusal value of a rule; the pair has to be in the vocabulary."""
    if (source, code) not in REFUSALS:
        raise KeyError((source, code))
    return F.struct(F.lit(source).alias("source"), F.lit(code).alias("code"))


def no_refusal() -> Column:
    return F.lit(None).cast(REFUSAL_TYPE)


def first_refusal(*rules: tuple[Column, Column]) -> Column:
    """The first rule whose condition is true decides; a NULL condition does not refuse."""
    chain = F
    for condition, refusal in rules:
        chain = chain.when(F.coalesce(condition, F.lit(False)), refusal)
    return chain.otherwise(no_refusal())


def message_of(refusal: Column) -> Column:
    pairs: list[Column] = []
    for (source, code), text in REFUSALS.items():
        pairs += [F.lit(f"{source}{code}"), F.lit(text)]
    key = F.concat(refusal["source"], refusal["code"].cast("string"))
    return F.try_element_at(F.create_map(*pairs), key)


@dataclass(frozen=True)
class Decision:
    """A command batch with one ``refusal`` per row: NULL means accepted."""

    frame: DataFrame
    key: str

    @property
    def accepted(self) -> DataFrame:
        return self.frame.where(F.col("refusal").isNull()).drop("refusal")

    @property
    def rejects(self) -> DataFrame:
        refusal = F.col("refusal")
        return self.frame.where(refusal.isNotNull()).select(
            refusal["source"].alias("source"),
            refusal["code"].alias("code"),
            message_of(refusal).alias("message"),
            F.col(self.key).cast("string").alias("key"),
        )

    def outcome(self, *columns: str) -> DataFrame:
        """Every command with its result columns, and the refusal spelled out."""
        refusal = F.col("refusal")
        return self.frame.select(
            *columns,
            refusal["source"].alias("source"),
            refusal["code"].alias("code"),
            message_of(refusal).alias("message"),
        )
