"""Constraint checks: violations(rule_id, table_name, key, detail) over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..sources import schemas as S

Tables = Mapping[str, DataFrame]


def key_text(table: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in S.PRIMARY_KEYS[table]]
    return F.concat_ws("/", *parts)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _violation(rule: Column, table: str, key: Column, detail: Column) -> list[Column]:
    return [
        rule.alias("rule_id"),
        F.lit(table).alias("table_name"),
        key.alias("key"),
        F.coalesce(detail.cast("string"), F.lit("NULL")).alias("detail"),
    ]


def _rows(tables: Tables, table: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Row rules (rule id, broken, detail) of one table in a single pass over it."""
    found = F.array(
        *[
            F.when(
                F.coalesce(broken, F.lit(False)),
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.coalesce(detail.cast("string"), F.lit("NULL")).alias("detail"),
                ),
            )
            for rule, broken, detail in rules
        ]
    )
    hits = tables[table].select(key_text(table).alias("key"), F.explode(F.array_compact(found)).alias("v"))
    return hits.select(*_violation(F.col("v.rule"), table, F.col("key"), F.col("v.detail")))


def _stacked(tables: Tables, entries: Mapping[str, list[Column]]) -> DataFrame:
    """The entries of every table (structs of one shape; null: none) as rows, one scan per table."""
    return _union(
        [
            tables[table].select(F.inline(F.array_compact(F.array(*listed))))
            for table, listed in entries.items()
        ]
    )


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _repeated(tables: Tables, primary: bool, single: bool) -> DataFrame:
    """Key rules by one aggregation over the stacked values of all tables.

    Primary keys may be neither NULL nor used twice; unique columns only not used twice.
    """
    # A row is (number of the rule, key text, shape): small, as nearly all keys are groups of their
    # own. The shape marks NULL parts and tells where the parts of a longer key end.
    entries: dict[str, list[Column]] = {}
    names: list[tuple[str, str]] = []

    def add(rule: str, table: str, key: tuple[str, ...], present: Column) -> None:
        parts = [F.coalesce(_text(c), F.lit("NULL")) for c in key]
        sizes = [F.length(_text(c)).cast("string") if len(key) > 1 else F.lit("") for c in key]
        entry = F.struct(
            F.lit(len(names)).alias("rule"),
            F.concat_ws("/", *parts).alias("key"),
            F.concat_ws(",", *[F.when(F.col(c).isNull(), "-").otherwise(n) for c, n in zip(key, sizes)]).alias("shape"),
        )
        names.append((rule, table))
        entries.setdefault(table, []).append(F.when(present, entry))

    if primary:
        for table, key in S.PRIMARY_KEYS.items():
            add(f"pk:{table}", table, key, F.lit(True))
    if single:
        for table, column in S.UNIQUE:
            add(f"unique:{table}.{column}", table, (column,), F.col(column).isNotNull())
    groups = _stacked(tables, entries).groupBy("rule", "key", "shape").agg(F.count("*").alias("n"))
    # NULL parts only reach this point in primary keys.
    broken = groups.where((F.col("n") > 1) | F.col("shape").contains("-"))

    def named(at: int) -> Column:
        return F.element_at(F.array(*[F.lit(name[at]) for name in names]), F.col("rule") + 1)

    return broken.select(
        named(0).alias("rule_id"), named(1).alias("table_name"), "key",
        F.col("n").cast("string").alias("detail"),
    )


def primary_keys(tables: Tables) -> DataFrame:
    """Keys that are NULL or used more than once."""
    return _repeated(tables, primary=True, single=False)


def unique(tables: Tables) -> DataFrame:
    """Values of unique columns used more than once; NULL may repeat."""
    return _repeated(tables, primary=False, single=True)


TARGETS: tuple[tuple[str, str], ...] = tuple(
    dict.fromkeys((parent, column) for _, _, parent, column in S.FOREIGN_KEYS)
)


def foreign_keys(tables: Tables) -> DataFrame:
    """Rows whose parent does not exist; a NULL reference passes.

    Every table is scanned once: it stacks its own keys and the values that refer to others, and
    one aggregation, combined before the shuffle, tells by a bit per rule who mentions a value;
    bit 0 is the parent itself. Values without that bit are written down. Only tables whose
    rules have such values are scanned again to list the rows; nothing of them is shuffled
    while the values are few enough for Spark to broadcast them by their written size.
    """
    entries: dict[str, list[Column]] = {}

    def add(table: str, column: str, target: int, bit: int) -> None:
        entry = F.struct(
            F.lit(target).alias("target"), _text(column).alias("value"),
            F.lit(1 << bit).cast("bigint").alias("bits"),
        )
        entries.setdefault(table, []).append(F.when(F.col(column).isNotNull(), entry))

    for target, (parent, column) in enumerate(TARGETS):
        add(parent, column, target, 0)
    for bit, (table, column, *parent) in enumerate(S.FOREIGN_KEYS, start=1):
        add(table, column, TARGETS.index(tuple(parent)), bit)
    mentioned = _stacked(tables, entries).groupBy("target", "value").agg(
        F.bit_or("bits").alias("bits")
    )
    orphans = settle(mentioned.where(F.col("bits").bitwiseAND(1) == 0))
    # One row: the union of all bits, so at most one flag per rule reaches the driver.
    broken = orphans.agg(F.bit_or("bits")).first()[0] or 0
    frames = []
    for bit, (table, column, *parent) in enumerate(S.FOREIGN_KEYS, start=1):
        if broken >> bit & 1:
            lost = orphans.where(
                (F.col("target") == TARGETS.index(tuple(parent)))
                & (F.col("bits").bitwiseAND(1 << bit) != 0)
            ).select(F.col("value").alias("_value"))
            needed = dict.fromkeys([*S.PRIMARY_KEYS[table], column])
            rows = tables[table].select(*needed).join(lost, _text(column) == F.col("_value"))
            frames.append(
                rows.select(
                    *_violation(
                        F.lit(f"fk:{table}.{column}"), table, key_text(table), F.col(column)
                    )
                )
            )
    if not frames:
        nothing = _violation(F.lit("fk"), "", F.col("value"), F.col("value"))
        return orphans.where(F.lit(False)).select(*nothing)
    return _union(frames)


Rules = dict[str, list[tuple[str, Column, Column]]]


def _not_null() -> Rules:
    rules: Rules = {}
    for table in S.TABLES:
        for c in S.columns(table):
            if c.required and c.name not in S.PRIMARY_KEYS[table]:
                rules.setdefault(table, []).append(
                    (f"null:{table}.{c.name}", F.col(c.name).isNull(), F.lit("NULL"))
                )
    return rules


def _enumerations() -> Rules:
    rules: Rules = {}
    for table, column, values in S.ENUMS:
        rules.setdefault(table, []).append(
            (f"enum:{table}.{column}", ~F.col(column).isin(*values), F.col(column))
        )
    return rules


def _flags() -> Rules:
    rules: Rules = {}
    for table, column in S.FLAGS:
        rules.setdefault(table, []).append(
            (f"flag:{table}.{column}", ~F.col(column).isin(0, 1), F.col(column))
        )
    return rules


def _ranges() -> Rules:
    rules: Rules = {}
    for table, name, shown, holds in S.RANGES:
        rules.setdefault(table, []).append(
            (f"range:{table}.{name}", ~F.expr(holds), F.col(shown))
        )
    return rules


def _payment_references() -> Rules:
    broken = ~F.expr(S.PAYMENT_REFERENCE)
    return {"payments": [("reference:payments", broken, F.col("payment_type"))]}


def _bucket_sums() -> Rules:
    return {"inventory": [("sum:inventory", ~F.expr(S.BUCKET_SUM), F.col("total_quantity"))]}


ROW_RULES: dict[str, Callable[[], Rules]] = {
    "not_null": _not_null,
    "enumerations": _enumerations,
    "flags": _flags,
    "ranges": _ranges,
    "payment_references": _payment_references,
    "bucket_sums": _bucket_sums,
}


def row_rules(tables: Tables, families: list[str]) -> DataFrame:
    """Broken row rules of the families named, one scan per table for all of them."""
    merged: Rules = {}
    for family in families:
        for table, rules in ROW_RULES[family]().items():
            merged.setdefault(table, []).extend(rules)
    return _union([_rows(tables, table, rules) for table, rules in merged.items()])


def not_null(tables: Tables) -> DataFrame:
    """NULLs in required columns."""
    return row_rules(tables, ["not_null"])


def enumerations(tables: Tables) -> DataFrame:
    """Values outside their list; NULL passes."""
    return row_rules(tables, ["enumerations"])


def flags(tables: Tables) -> DataFrame:
    """Flags other than 0 and 1."""
    return row_rules(tables, ["flags"])


def ranges(tables: Tables) -> DataFrame:
    """Numbers outside their range; NULL passes."""
    return row_rules(tables, ["ranges"])


def payment_references(tables: Tables) -> DataFrame:
    """Payments whose type does not fit their references."""
    return row_rules(tables, ["payment_references"])


def bucket_sums(tables: Tables) -> DataFrame:
    """Inventory rows whose buckets do not add up to the total."""
    return row_rules(tables, ["bucket_sums"])


FAMILIES: tuple[str, ...] = ("primary_keys", "unique", "foreign_keys", *ROW_RULES)


def check(tables: Tables, families: list[str] | None = None) -> DataFrame:
    """All violations of the chosen rule families (all families: None).

    Key rules share one scan per table, row rules another, references a third.
    """
    chosen = FAMILIES if families is None else families
    frames = []
    if {"primary_keys", "unique"} & set(chosen):
        frames.append(_repeated(tables, "primary_keys" in chosen, "unique" in chosen))
    if "foreign_keys" in chosen:
        frames.append(foreign_keys(tables))
    if by_row := [family for family in ROW_RULES if family in chosen]:
        frames.append(row_rules(tables, by_row))
    return _union(frames)
