"""Audit rows of change sets, delete guards, and the recompute steps after item changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .numbering import key_slices, range_scan, running_total
from .rejects import Decision, first_refusal, refuse

# The wording of the audit log.
ACTIONS = {"I": "INSERT", "U": "UPDATE", "D": "DELETE"}
VERBS = {"I": "Inserted", "U": "Updated", "D": "Deleted"}


def _by_op(op: Column, texts: dict[str, str]) -> Column:
    chain = F
    for letter, text in texts.items():
        chain = chain.when(op == letter, F.lit(text))
    return chain


def audit_columns(table: str, thing: str, when: Column) -> list[Column]:
    """Log columns of changes with ``op``, ``record_id`` and ``label``; batch and stream."""
    op = F.col("op")
    return [
        _by_op(op, ACTIONS).alias("action"),
        F.lit(table).alias("table_name"),
        F.col("record_id").cast("string").alias("record_id"),
        when.alias("action_time"),
        F.concat(_by_op(op, VERBS), F.lit(f" {thing} "), C.said(F.col("label"))).alias(
            "description"
        ),
    ]


def audit(
    changes: DataFrame,
    table: str,
    thing: str,
    as_of: str,
    guards: list[tuple[DataFrame, str, tuple[str, int]]] = (),
) -> Decision:
    """Log rows of a change set; a delete that still has children is refused.

    A guard is (child table, its foreign key, refusal); guards are tested in order.
    """
    rows = changes.select("op", "record_id", "label")
    rules = []
    for i, (child, key, refusal) in enumerate(guards):
        used = child.groupBy(F.col(key).alias("record_id")).agg(F.lit(True).alias(f"_g{i}"))
        rows = rows.join(used, "record_id", "left")
        rules.append(((F.col("op") == "D") & F.col(f"_g{i}").isNotNull(), refuse(*refusal)))
    refusal = first_refusal(*rules) if rules else F.lit(None).cast("struct<source:string,code:int>")
    return Decision(
        rows.select(*audit_columns(table, thing, C.clock(as_of)), refusal.alias("refusal")),
        "record_id",
    )


# Refusals (source, code) of a delete, one per kind of child, in the order they are tested.
Guards = Sequence[tuple[str, int]]


def guard_events(changes: DataFrame, children: DataFrame) -> DataFrame:
    """Changes and their records' children as one sequence of events; children of one moment come first."""
    none = F.lit(None)
    came = children.select(
        "record_id", "change_time", F.lit(0).alias("kind"), F.col("guard").cast("int").alias("guard"),
        F.when(F.col("op") == "D", -1).otherwise(1).cast("long").alias("delta"),
        none.cast("string").alias("op"), none.cast("string").alias("label"),
    )
    asked = changes.select(
        "record_id", "change_time", F.lit(1).alias("kind"), none.cast("int").alias("guard"),
        F.lit(0).cast("long").alias("delta"), "op", F.col("label").cast("string").alias("label"),
    )
    return came.unionByName(asked)


def guarded_rows(rows: DataFrame, used: list[Column], table: str, thing: str, guards: Guards) -> Decision:
    """Log rows of changes, deletes refused where a guard's children are in use."""
    rules = [((F.col("op") == "D") & hit, refuse(*guard)) for hit, guard in zip(used, guards)]
    return Decision(
        rows.select(*audit_columns(table, thing, F.col("change_time")), first_refusal(*rules).alias("refusal")), "record_id"
    )


def audit_feed(changes: DataFrame, children: DataFrame, table: str, thing: str, guards: Guards) -> Decision:
    """Log rows of a timed change feed; a delete is refused while children are there at its time.

    ``changes``: (op, record_id, label, change_time); ``children``: (guard, op, record_id,
    change_time), where guard counts ``guards`` from 0. The children there before a change are
    a running sum, scanned in ranges, so a record of very many children is split.
    """
    deltas = {f"_d{i}": F.when(F.col("guard") == i, F.col("delta")).otherwise(0) for i in range(len(guards))}
    events = guard_events(changes, children).withColumns(deltas)
    scanned = range_scan(events, ["record_id"], ["change_time", "kind"], {f"_n{i}": f"_d{i}" for i in range(len(guards))})
    used = [F.coalesce(F.col(f"_n{i}"), F.lit(0)) > 0 for i in range(len(guards))]
    return guarded_rows(scanned.where("kind = 1"), used, table, thing, guards)


def equipment_status(items: DataFrame) -> DataFrame:
    """Status an equipment gets from its items: borrowed, then damaged or lost, else free."""
    borrowed = F.max(F.col("item_status") == "BORROWING")
    broken = F.max(F.col("item_status").isin("DAMAGED", "LOST"))
    return items.groupBy("equipment_id").agg(
        F.when(borrowed, "MAINTENANCE").when(broken, "DISABLED").otherwise("AVAILABLE").alias(
            "new_status"
        )
    )


def status_changes(
    changes: DataFrame, items_after: DataFrame, equipments: DataFrame
) -> DataFrame:
    """Equipment status before and after a batch of item status changes."""
    touched = changes.select("equipment_id").distinct()
    return (
        equipments.select("equipment_id", F.col("status").alias("old_status"))
        .join(touched, "equipment_id", "left_semi")
        .join(equipment_status(items_after), "equipment_id")
        .select("equipment_id", "old_status", "new_status")
    )


def status_log(
    changes: DataFrame, items_after: DataFrame, as_of: str, ip_address: str | None = None
) -> DataFrame:
    """One audit row per item status change, naming the status the equipment received.

    ``ip_address`` is the client's, where the caller knows one.
    """
    text = F.concat(
        F.lit("Updated equipment status to "),
        F.col("new_status"),
        F.lit(" due to rental item "),
        C.said(F.col("rental_item_id")),
        F.lit(" changed from "),
        C.said(F.col("old_item_status")),
        F.lit(" to "),
        C.said(F.col("new_item_status")),
    )
    return changes.join(equipment_status(items_after), "equipment_id").select(
        F.lit("UPDATE").alias("action"),
        F.lit("EQUIPMENTS").alias("table_name"),
        F.col("equipment_id").cast("string").alias("record_id"),
        C.clock(as_of).alias("action_time"),
        text.alias("description"),
        F.lit(ip_address).cast("string").alias("ip_address"),
    )


def rental_totals(rentals: DataFrame, items: DataFrame) -> DataFrame:
    """Total of every rental from its items; no items give 0."""
    totals = items.groupBy("rental_id").agg(F.sum("subtotal").alias("_total"))
    return (
        rentals.select("rental_id")
        .join(totals, "rental_id", "left")
        .select("rental_id", F.coalesce("_total", C.dec(0, 10, 2)).alias("total_amount"))
    )


def fill_codes(
    df: DataFrame, order: str, codes: dict[str, tuple[str, int]], start: int = 1
) -> DataFrame:
    """Give generated codes to rows whose code column is NULL, numbered in ``order``.

    ``codes`` maps a column to (prefix, pad); each column counts its own missing values.
    """
    gaps = {
        f"_gap_{name}": F.col(name).isNull().cast("int") for name in codes
    }
    slices = key_slices(order)
    counted = running_total(
        df.withColumns({**slices, **gaps}),
        [],
        [*slices, order],
        {f"_n_{name}": f"_gap_{name}" for name in codes},
    )
    filled = {
        name: F.coalesce(
            F.col(name), C.code_text(prefix, F.col(f"_n_{name}") + start, pad)
        )
        for name, (prefix, pad) in codes.items()
    }
    return counted.withColumns(filled).drop(
        *slices, *gaps, *[f"_n_{name}" for name in codes]
    )
