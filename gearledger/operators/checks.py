"""Compatibility of equipment pairs and validation of new rental items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .rejects import Decision, first_refusal, refuse

# Fixed values of the compatibility rule.
CAMERA, LENS, LIGHT = "CAT01", "CAT02", "CAT03"
ITEM_STATUSES = ("BORROWING", "RETURNED", "DAMAGED", "LOST")


def traits(equipments: DataFrame, prefix: str) -> DataFrame:
    """The columns of an equipment that the compatibility rule reads, under a prefix."""
    return equipments.select(
        F.col("equipment_id").alias(f"{prefix}_equipment_id"),
        F.lit(True).alias(f"{prefix}_found"),
        F.col("category_id").alias(f"{prefix}_category"),
        F.col("mount_type").alias(f"{prefix}_mount"),
    )


def pair_refusal(main: dict[str, Column], extra: dict[str, Column]) -> Column:
    """First broken compatibility rule of a (main, extra) pair, in the stated order."""
    lens = extra["category"] == LENS
    light = extra["category"] == LIGHT
    differ = main["mount"] != extra["mount"]
    return first_refusal(
        (main["found"].isNull(), refuse("compatibility", -20042)),
        (extra["found"].isNull(), refuse("compatibility", -20043)),
        (main["category"] != CAMERA, refuse("compatibility", -20044)),
        (
            lens & (main["mount"].isNull() | extra["mount"].isNull()),
            refuse("compatibility", -20045),
        ),
        (lens & differ, refuse("compatibility", -20046)),
        (light & differ, refuse("compatibility", -20047)),
    )


def _side(prefix: str) -> dict[str, Column]:
    return {name: F.col(f"{prefix}_{name}") for name in ("found", "category", "mount")}


def check_compatibility(pairs: DataFrame, equipments: DataFrame) -> Decision:
    """Decide every (main, extra) pair."""
    decided = (
        pairs.join(traits(equipments, "main"), "main_equipment_id", "left")
        .join(traits(equipments, "extra"), "extra_equipment_id", "left")
        .withColumn("refusal", pair_refusal(_side("main"), _side("extra")))
    )
    return Decision(decided.select(*pairs.columns, "refusal"), "request_id")


def compatible_lens_counts(equipments: DataFrame) -> DataFrame:
    """Number of compatible lenses per camera, counted per mount instead of listing pairs."""
    lenses = (
        equipments.where((F.col("category_id") == LENS) & F.col("mount_type").isNotNull())
        .groupBy("mount_type")
        .agg(F.count("*").alias("lens_count"))
    )
    return (
        equipments.where(F.col("category_id") == CAMERA)
        .select("equipment_id", "mount_type")
        .join(lenses, "mount_type", "left")
        .select(
            "equipment_id", "mount_type", F.coalesce("lens_count", F.lit(0)).alias("lens_count")
        )
    )


def item_refusal(status_of_equipment: Column, found: Column) -> tuple[Column, Column]:
    """Refusals of a new item before and after the compatibility rule."""
    before = first_refusal((found.isNull(), refuse("item_check", -1403)))
    after = first_refusal(
        (
            F.col("quantity").isNull() | (F.col("quantity") <= 0),
            refuse("item_check", -20040),
        ),
        (
            F.col("days").isNull() | F.col("price_per_day").isNull(),
            refuse("item_check", -20041),
        ),
        (~F.col("item_status").isin(*ITEM_STATUSES), refuse("item_check", -20042)),
        (
            C.too_large(
                C.line_total(F.col("quantity"), F.col("days"), F.col("price_per_day"))
            ),
            refuse("precision", -6502),
        ),
        (status_of_equipment != "AVAILABLE", refuse("item_available", -20050)),
    )
    return before, after


def check_items(new_items: DataFrame, existing: DataFrame, equipments: DataFrame) -> Decision:
    """Validate a batch of new items that arrive in id order after the existing ones.

    An accessory is checked against the first accepted item of its rental that holds another
    equipment. That item is one of two: the rental's first accepted item, or, for items of
    the same equipment, the first accepted item of any other equipment. Both are ``min``
    aggregates, so no rental is ever sorted in one task.
    """
    fields = ["rental_item_id", "rental_id", "equipment_id", "quantity", "days",
              "price_per_day", "item_status"]
    rows = (
        existing.select(*fields, F.lit(0).alias("_new"))
        .unionByName(new_items.select(*fields, F.lit(1).alias("_new")))
        .join(
            equipments.select(
                "equipment_id",
                F.lit(True).alias("_found"),
                F.col("equipment_type").alias("_type"),
                F.col("status").alias("_status"),
                F.col("category_id").alias("_category"),
                F.col("mount_type").alias("_mount"),
            ),
            "equipment_id",
            "left",
        )
    )
    before, after = item_refusal(F.col("_status"), F.col("_found"))
    rows = rows.withColumns(
        {
            "_before": before,
            "_after": after,
            "_at": F.struct("_new", "rental_item_id"),
        }
    ).withColumn(
        "_sound",
        (F.col("_new") == 0) | (F.col("_before").isNull() & F.col("_after").isNull()),
    )
    holder = F.struct("_at", "equipment_id", "_found", "_category", "_mount")
    own = {"found": F.col("_found"), "category": F.col("_category"), "mount": F.col("_mount")}

    def seen(name: str) -> dict[str, Column]:
        return {
            "found": F.col(f"{name}._found"),
            "category": F.col(f"{name}._category"),
            "mount": F.col(f"{name}._mount"),
        }

    accessory = F.coalesce(F.col("_type") == "ACCESSORY", F.lit(False))
    first = rows.where("_sound").groupBy("rental_id").agg(F.min(holder).alias("_first"))
    rows = rows.join(first, "rental_id", "left")
    stands = (
        (F.col("_new") == 0)
        | ~accessory
        | pair_refusal(seen("_first"), own).isNull()
    )
    second = (
        rows.where(
            F.col("_sound") & (F.col("equipment_id") != F.col("_first.equipment_id")) & stands
        )
        .groupBy("rental_id")
        .agg(F.min(holder).alias("_second"))
    )
    rows = rows.where("_new = 1").join(second, "rental_id", "left")

    def is_main(name: str) -> Column:
        return F.coalesce(
            (F.col(f"{name}._at") < F.col("_at"))
            & (F.col(f"{name}.equipment_id") != F.col("equipment_id")),
            F.lit(False),
        )

    fit = F.when(is_main("_first"), pair_refusal(seen("_first"), own)).when(
        is_main("_second"), pair_refusal(seen("_second"), own)
    )
    subtotal = C.line_total(F.col("quantity"), F.col("days"), F.col("price_per_day"))
    refusal = F.coalesce(F.col("_before"), F.when(accessory, fit), F.col("_after"))
    decided = rows.withColumn("refusal", refusal).withColumn(
        "subtotal", F.when(F.col("refusal").isNull(), subtotal)
    )
    return Decision(decided.select(*fields, "subtotal", "refusal"), "rental_item_id")


def with_status(message: str) -> Column:
    """The message of an unavailable equipment names it and its status."""
    named = F.concat(
        F.col(message), F.lit(" "), F.col("equipment_id").cast("string"), F.lit(". Status: "),
        F.col("equipment_status"),
    )
    return F.when(F.col("code") == -20050, named).otherwise(F.col(message))


def check_available(new_items: DataFrame, equipments: DataFrame) -> Decision:
    """Refuse items whose equipment is not AVAILABLE (or unknown)."""
    decided = new_items.select("rental_item_id", "equipment_id").join(
        equipments.select("equipment_id", F.col("status").alias("equipment_status")),
        "equipment_id",
        "left",
    )
    refusal = first_refusal(
        (F.col("equipment_status").isNull(), refuse("item_check", -1403)),
        (F.col("equipment_status") != "AVAILABLE", refuse("item_available", -20050)),
    )
    return Decision(
        decided.withColumn("refusal", refusal).select(
            "rental_item_id", "equipment_id", "equipment_status", "refusal"
        ),
        "rental_item_id",
    )
