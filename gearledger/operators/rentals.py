"""Creating, picking up and completing rentals as batch transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import settle
from . import billing
from .checks import pair_refusal, traits
from .numbering import dense_number_by_time, key_slices, running_total, top_key
from .rejects import Decision, first_refusal, refuse
from .stock import allocate, inventory_after_return

COMPLETE_STATUSES = ("BORROWING", "OVERDUE")
MAX_QUANTITY = 99_999  # five digits


@dataclass(frozen=True)
class NewRentals:
    """Decided create-rental commands and the item lines of the accepted ones."""

    decision: Decision
    lines: DataFrame


def create_rentals(
    commands: DataFrame,
    customers: DataFrame,
    equipments: DataFrame,
    accessories: DataFrame,
    inventory: DataFrame,
    as_of: str,
) -> NewRentals:
    """Create rentals in (rental_date, request_id) order, each with its default accessories.

    A request fails as a whole. The refusals follow the order of the steps: terms, customer
    and equipment, the main item, its stock, then accessory by accessory.
    """
    stocked = inventory.select("equipment_id", F.lit(True).alias("_stocked"))
    priced = (
        commands.join(
            customers.select(
                "customer_id",
                F.lit(True).alias("_customer"),
                F.col("full_name").alias("customer_name"),
                F.col("phone").alias("customer_phone"),
                F.col("address").alias("customer_address"),
            ),
            "customer_id",
            "left",
        )
        .join(
            equipments.select(
                "equipment_id",
                F.col("status").alias("_status"),
                F.col("rental_price_per_day").alias("price_per_day"),
                F.col("category_id").alias("main_category"),
                F.col("mount_type").alias("main_mount"),
                F.lit(True).alias("main_found"),
                C.unit_deposit(
                    F.col("purchase_price"),
                    F.col("depreciation_rate"),
                    F.col("purchase_date"),
                    F.col("deposit_rate"),
                    C.clock(as_of),
                ).alias("_unit"),
            ),
            "equipment_id",
            "left",
        )
        .join(stocked, "equipment_id", "left")
    )
    unknown = refuse("create_rental", -20050)
    subtotal = C.line_total(F.col("quantity"), F.col("days"), F.col("price_per_day"))
    deposit = C.money(F.col("_unit") * F.col("quantity"))
    early = first_refusal(
        (F.col("customer_confirm") == 0, refuse("create_rental", -20060)),
        (F.col("_customer").isNull() | F.col("main_found").isNull(), unknown),
        (C.too_large(subtotal, deposit), refuse("precision", -6502)),
        # The rental row comes before its items, and its total may not be NULL.
        (subtotal.isNull(), refuse("create_rental", -1400)),
        (F.col("quantity") <= 0, refuse("item_check", -20040)),
        (F.col("_status") != "AVAILABLE", refuse("item_available", -20050)),
        (F.col("_stocked").isNull(), unknown),
    )
    checked = settle(
        priced.withColumns(
            {
                "_early": early,
                "subtotal": subtotal,
                "deposit": deposit,
            }
        ).drop("_status", "_unit", "_customer", "_stocked")
    )
    sound = dense_number_by_time(
        checked.where("_early IS NULL").select(
            "request_id", "rental_date", "equipment_id", "quantity", "days", "price_per_day",
            "subtotal", "main_category", "main_mount", "main_found",
        ),
        "rental_date",
        "request_id",
        "seq",
        top_key(checked, "request_id"),
    )
    sound = settle(sound)

    # Accessory lines with their first refusal; _at is the position inside the request.
    extra = (
        sound.join(
            accessories.select(
                "equipment_id", "accessory_id", F.col("quantity").alias("_per_unit")
            ),
            "equipment_id",
        )
        .join(
            traits(equipments, "extra")
            .withColumnRenamed("extra_equipment_id", "accessory_id")
            .join(
                equipments.select(
                    F.col("equipment_id").alias("accessory_id"),
                    F.col("status").alias("_extra_status"),
                ),
                "accessory_id",
            ),
            "accessory_id",
            "left",
        )
        .join(
            stocked.select(
                F.col("equipment_id").alias("accessory_id"),
                F.lit(True).alias("_extra_stocked"),
            ),
            "accessory_id",
            "left",
        )
    )
    units = F.col("_per_unit").cast("bigint") * F.col("quantity")
    names = ("found", "category", "mount")
    fit = pair_refusal(
        {n: F.col(f"main_{n}") for n in names}, {n: F.col(f"extra_{n}") for n in names}
    )
    late = F.coalesce(
        fit,
        first_refusal(
            (units.isNull() | (units <= 0), refuse("item_check", -20040)),
            (units > MAX_QUANTITY, refuse("precision", -6502)),
            (F.col("_extra_status") != "AVAILABLE", refuse("item_available", -20050)),
            (F.col("_extra_stocked").isNull(), unknown),
        ),
    )
    zero = C.dec(0, 10, 2)
    extra_lines = extra.select(
        "request_id",
        "seq",
        F.struct(F.lit(1).alias("kind"), F.col("accessory_id").alias("id")).alias("_at"),
        F.col("accessory_id").alias("equipment_id"),
        F.least(units, F.lit(MAX_QUANTITY + 1)).cast("int").alias("quantity"),
        "days",
        zero.alias("price_per_day"),
        zero.alias("subtotal"),
        late.alias("_late"),
    )
    main_lines = sound.select(
        "request_id",
        "seq",
        F.struct(F.lit(0).alias("kind"), F.col("equipment_id").alias("id")).alias("_at"),
        "equipment_id",
        "quantity",
        "days",
        "price_per_day",
        "subtotal",
        F.lit(None).cast("struct<source:string,code:int>").alias("_late"),
    )
    lines = settle(main_lines.unionByName(extra_lines))
    doomed = (
        lines.where("_late IS NOT NULL")
        .groupBy("request_id")
        .agg(F.min(F.struct("_at", "_late")).alias("_doom"))
    )
    marked = lines.drop("_late").join(doomed, "request_id", "left")
    stock = inventory.select(
        "equipment_id", F.coalesce("available_quantity", F.lit(0)).alias("capacity")
    )
    served = allocate(
        marked.where("_doom IS NULL"),
        stock,
        probes=marked.where(F.col("_at") < F.col("_doom._at")),
    )
    decided = (
        checked.join(sound.select("request_id", "seq"), "request_id", "left")
        .join(doomed, "request_id", "left")
        .join(served, "request_id", "left")
        .withColumn(
            "refusal",
            F.coalesce(
                F.col("_early"),
                first_refusal((~F.col("served"), refuse("stock_out", -20011))),
                F.col("_doom._late"),
            ),
        )
        .select(
            "request_id", "seq", "customer_id", "employee_id", "shop_id", "equipment_id",
            "quantity", "days", "rental_date", "due_date", "subtotal", "deposit",
            "customer_name", "customer_phone", "customer_address", "refusal",
        )
    )
    decision = Decision(settle(decided), "request_id")
    kept = lines.join(decision.accepted.select("request_id"), "request_id", "left_semi")
    return NewRentals(decision, kept.drop("_late"))


def rental_rows(created: NewRentals, as_of: str, last: int = 0) -> DataFrame:
    """Rental rows of the accepted requests, with generated ids and the customer snapshot."""
    now = C.clock(as_of)
    return billing.with_codes(
        created.decision.accepted,
        "seq",
        rental_id=("RE", 3, last),
        rental_code=("RC", 5, last),
    ).select(
        "request_id",
        "rental_id",
        "rental_code",
        F.lit("NORMAL").alias("rental_type"),
        F.lit("CREATED").alias("status"),
        C.stored(F.col("subtotal")).alias("total_amount"),
        C.stored(F.col("deposit")).alias("deposit_required"),
        "rental_date",
        "due_date",
        now.alias("created_at"),
        now.alias("updated_at"),
        "customer_id",
        "employee_id",
        "shop_id",
        F.lit(1).alias("customer_confirmed"),
        now.alias("confirmed_at"),
        "customer_name",
        "customer_phone",
        "customer_address",
        F.lit("Standard rental agreement").alias("contract_terms"),
    )


def item_rows(created: NewRentals, rentals: DataFrame, last: int = 0) -> DataFrame:
    """Item rows of the created rentals: main item first, then accessories by id."""
    slices = key_slices("seq")
    placed = settle(
        created.lines.withColumns(
            {**slices, "_kind": F.col("_at.kind"), "_one": F.lit(1)}
        )
    )
    numbered = running_total(
        placed, [], [*slices, "seq", "_kind", "equipment_id"], {"_n": "_one"}
    )
    return numbered.join(rentals.select("request_id", "rental_id"), "request_id").select(
        C.code_text("RI", F.col("_n") + 1 + last, 3).alias("rental_item_id"),
        "rental_id",
        "equipment_id",
        "quantity",
        "days",
        "price_per_day",
        "subtotal",
        F.lit("BORROWING").alias("item_status"),
    )


def confirm_pickups(commands: DataFrame, rentals: DataFrame) -> Decision:
    """Pick up rentals that are created or confirmed; a second pickup is refused."""
    decided = (
        billing.first_of(commands.select("request_id", "rental_id"), "rental_id")
        .join(rentals.select("rental_id", F.col("status").alias("_status")), "rental_id", "left")
        .withColumn(
            "refusal",
            first_refusal(
                (
                    F.col("_status").isNull()
                    | ~F.col("_status").isin(*billing.PICKUP_STATUSES)
                    | F.col("_repeat"),
                    refuse("confirm_pickup", -20001),
                )
            ),
        )
    )
    return Decision(decided.select("request_id", "rental_id", "refusal"), "request_id")


def picked_up_rentals(decision: Decision, as_of: str) -> DataFrame:
    """Changes of the picked-up rentals, for a keyed upsert."""
    now = C.clock(as_of)
    return decision.accepted.select(
        "rental_id",
        F.lit("BORROWING").alias("status"),
        F.lit(1).alias("customer_confirmed"),
        now.alias("confirmed_at"),
        now.alias("start_date"),
        now.alias("updated_at"),
    )


def pickup_media(decision: Decision, items: DataFrame, as_of: str, last: int = 0) -> DataFrame:
    """One placeholder image per item of the picked-up rentals."""
    taken = items.select("rental_item_id", "rental_id").join(
        decision.accepted.select("rental_id"), "rental_id", "left_semi"
    )
    return billing.with_codes(taken, "rental_item_id", media_id=("MD", 5, last)).select(
        "media_id",
        "rental_item_id",
        F.lit("IMAGE").alias("media_type"),
        F.lit("placeholder_before_delivery.jpg").alias("media_path"),
        F.lit("BEFORE_DELIVERY").alias("capture_stage"),
        C.clock(as_of).alias("created_at"),
    )


def items_with_status(decision: Decision, items: DataFrame, status: str) -> DataFrame:
    """The item table after the items of all accepted rentals take a status."""
    hit = decision.accepted.select("rental_id").distinct().withColumn("_hit", F.lit(True))
    changed = F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("item_status"))
    return items.join(hit, "rental_id", "left").withColumn("item_status", changed).drop("_hit")


def picked_up_items(decision: Decision, items: DataFrame) -> DataFrame:
    """The item table after the pickups: items of picked-up rentals are out."""
    return items_with_status(decision, items, "BORROWING")


@dataclass(frozen=True)
class Completed:
    """Decided completions, with the inventory they lead to and the invoices they need."""

    decision: Decision
    inventory: DataFrame
    drafts: Decision


def complete_rentals(
    commands: DataFrame,
    rentals: DataFrame,
    items: DataFrame,
    returns: DataFrame,
    equipments: DataFrame,
    inventory: DataFrame,
    shops: DataFrame,
    customers: DataFrame,
    deposits: DataFrame,
    invoices: DataFrame,
    taxes: DataFrame,
    as_of: str,
) -> Completed:
    """Complete running rentals: all items back as good, then an invoice unless one exists.

    A completion fails as a whole, so a rental whose invoice cannot be priced keeps its stock.
    A repeated command finds the rental returned if the first one went through; otherwise it
    is judged again, against what is left then (never more than before).
    """
    status = rentals.select("rental_id", F.col("status").alias("_status"))
    asked = settle(
        billing.first_of(commands.select("request_id", "rental_id"), "rental_id")
        .join(status, "rental_id", "left")
        .withColumn(
            "_early",
            first_refusal(
                (F.col("_status").isNull(), refuse("complete_rental", -20001)),
                (~F.col("_status").isin(*COMPLETE_STATUSES), refuse("complete_rental", -20002)),
            ),
        )
    )
    open_commands = asked.where("_early IS NULL").select("request_id", "rental_id", "_repeat")
    open_rentals = rentals.join(open_commands.select("rental_id"), "rental_id", "left_semi")
    billed = invoices.where("invoice_type = 'FINAL'").select("rental_id")
    drafts = billing.invoice_drafts(
        open_rentals.join(billed, "rental_id", "left_anti"),
        items, returns, equipments, shops, customers, deposits, taxes, as_of,
    ).frame.select(
        "rental_id", F.lit(True).alias("_priced"), *billing.INVOICE_AMOUNTS, "tax_id",
        F.col("refusal").alias("_draft"),
    )
    stock = inventory.select(
        "equipment_id", F.coalesce("rented_quantity", F.lit(0)).alias("capacity")
    )
    lines = (
        items.select("rental_id", "equipment_id", "quantity")
        .join(open_rentals.select("rental_id"), "rental_id", "left_semi")
        .join(stock, "equipment_id", "left")
    )
    unstocked = (
        lines.where("capacity IS NULL").groupBy("rental_id").agg(F.lit(True).alias("_unstocked"))
    )
    known = settle(
        open_commands.join(drafts, "rental_id", "left").join(unstocked, "rental_id", "left")
    )
    queue = lines.select("rental_id", "equipment_id", "quantity").join(
        known.where("_unstocked IS NULL").select(
            "rental_id",
            "request_id",
            F.col("request_id").alias("seq"),
            (F.col("_draft").isNotNull() | F.col("_repeat")).alias("_probe"),
        ),
        "rental_id",
    )
    served = allocate(queue.where("NOT _probe"), stock, probes=queue.where("_probe"))
    judged = settle(
        asked.join(known.drop("rental_id", "_repeat"), "request_id", "left")
        .join(served, "request_id", "left")
        .withColumn(
            "_judged",
            F.coalesce(
                F.col("_early"),
                first_refusal(
                    (F.col("_unstocked"), refuse("stock_in", -1403)),
                    (~F.col("served"), refuse("stock_in", -2290)),
                ),
                F.col("_draft"),
            ),
        )
        .select(
            "request_id", "rental_id", "_repeat", "_priced", *billing.INVOICE_AMOUNTS, "tax_id",
            "_judged",
        )
    )
    done = judged.where("NOT _repeat AND _judged IS NULL").select(
        "rental_id", F.lit(True).alias("_done")
    )
    decided = judged.join(done, "rental_id", "left").withColumn(
        "refusal",
        F.coalesce(
            first_refusal(
                (F.col("_repeat") & F.col("_done"), refuse("complete_rental", -20002))
            ),
            F.col("_judged"),
        ),
    )
    decision = Decision(
        decided.select(
            "request_id",
            "rental_id",
            F.when(F.col("refusal").isNull(), F.col("final_amount")).alias("final_amount"),
            "refusal",
        ),
        "request_id",
    )
    priced = decided.where("_priced").select(
        "request_id", "rental_id", *billing.INVOICE_AMOUNTS, "tax_id", "refusal"
    )
    back = (
        items.select("rental_id", "equipment_id", "quantity")
        .join(decision.accepted.select("rental_id"), "rental_id", "left_semi")
        .withColumn("condition_status", F.lit("GOOD"))
    )
    return Completed(
        decision, inventory_after_return(back, inventory, as_of), Decision(priced, "request_id")
    )


def completed_items(decision: Decision, items: DataFrame) -> DataFrame:
    """The item table after the completions: everything of a completed rental is back."""
    return items_with_status(decision, items, "RETURNED")


def completed_rentals(decision: Decision, as_of: str) -> DataFrame:
    """Changes of the completed rentals, for a keyed upsert."""
    now = C.clock(as_of)
    return decision.accepted.select(
        "rental_id",
        F.lit("RETURNED").alias("status"),
        now.alias("return_date"),
        now.alias("updated_at"),
    )
