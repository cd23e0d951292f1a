"""Running totals and dense numbers without a hot task.

A window over a whole table, or over one popular key, sends everything to a single task. Here
the order is cut into levels from coarse to fine; each level is aggregated first (partial
aggregation runs map-side) and totalled in a window that only sees the distinct values of that
level inside one coarser value, after what comes before that one. No window ever sees more rows
than one level has distinct values, whatever the skew. Slices are functions of the values, so
a lost executor recomputes the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import settle

# A group up to this many rows may be sorted by one task.
GROUP_ROWS = 5_000_000
# Width of a slice of a whole-number key, as a power of two.
SLICE_BITS = 20
# Copies of one identical row handed to one task when they are written out again.
COPY_BLOCK = 1_000_000


def running_total(
    df: DataFrame, group: list[str], levels: list[str], totals: dict[str, str]
) -> DataFrame:
    """Add one column per entry ``out: value``: the sum of value over earlier rows of the group.

    ``levels`` orders the group from coarse to fine and identifies a row inside it. The rows are
    added up to the finest level, those sums to the next and so on; what comes before a coarse
    value then opens the window of its finer ones as a row of its own. The rows themselves are
    shuffled once, by the finest level, never by a coarse value that all of them may share.
    The input is read twice, so an expensive one should be settled first.
    """
    sums = [f"_sum_{out}" for out in totals]
    depths = len(levels) - 1
    steps: list[DataFrame] = []
    finer = df.select(*group, *levels[:-1], *[F.col(v).alias(s) for s, v in zip(sums, totals.values())])
    for depth in reversed(range(depths)):
        finer = finer.groupBy(*group, *levels[: depth + 1]).agg(*[F.sum(s).alias(s) for s in sums])
        steps.insert(0, finer)

    def scanned(rows: DataFrame, depth: int, opening: DataFrame | None) -> DataFrame:
        """The sums of earlier rows of one coarser value, from what comes before it."""
        marked = rows.withColumn("_row", F.lit(1))
        if opening is not None:
            marked = marked.unionByName(opening.withColumn("_row", F.lit(0)), allowMissingColumns=True)
        earlier = (
            Window.partitionBy(*group, *levels[:depth])
            .orderBy("_row", levels[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        added = {f"_before{s}": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}
        return marked.withColumns(added).where("_row = 1")

    opening = None
    for depth, step in enumerate(steps):
        opening = scanned(step, depth, opening).select(
            *group, *levels[: depth + 1], *[F.col(f"_before{s}").alias(s) for s in sums]
        )
    rows = df.withColumns({s: F.col(v) for s, v in zip(sums, totals.values())})
    return scanned(rows, depths, opening).select(
        *[c for c in df.columns if c not in totals],
        *[F.col(f"_before_sum_{out}").cast("bigint").alias(out) for out in totals],
    )


def top_key(df: DataFrame, key: str) -> int:
    """Largest size of a whole-number key (of a settled frame: a scan of one column)."""
    return df.agg(F.max(F.abs(key))).first()[0] or 0


def key_slices(key: str, top: int | None = None) -> dict[str, Column]:
    """Coarser levels above a bigint key, each with at most 2^20 values inside the next.

    ``top``, the largest size of a key, saves the levels that would have a single value.
    """
    slices = {}
    if top is None or top >= 1 << 2 * SLICE_BITS:
        slices["_high"] = F.shiftright(key, 2 * SLICE_BITS)
    if top is None or top >= 1 << SLICE_BITS:
        slices["_mid"] = F.shiftright(key, SLICE_BITS)
    return slices


def time_slices(time: str) -> dict[str, Column]:
    """Coarser levels above a time: the day, and the second of at most 86,400 in it.

    What is left inside a second are its at most 10^6 microseconds.
    """
    return {"_day": F.to_date(time), "_second": F.date_trunc("second", F.col(time))}


def dense_number(df: DataFrame, key: str, out: str, top: int | None = None) -> DataFrame:
    """Number the rows from 1 in the order of a unique bigint key."""
    # The whole table is one group here: always at least one level above the rows.
    slices = key_slices(key, top) or {"_mid": F.shiftright(key, SLICE_BITS // 2)}
    sliced = df.withColumns({**slices, "_one": F.lit(1)})
    numbered = running_total(sliced, [], [*slices, key], {out: "_one"})
    return numbered.withColumn(out, F.col(out) + 1).drop(*slices, "_one")


def dense_number_by_time(
    df: DataFrame, time: str, key: str, out: str, top: int | None = None
) -> DataFrame:
    """Number the rows from 1 in the order of (time, unique bigint key)."""
    slices = {**time_slices(time), **key_slices(key, top)}
    sliced = df.withColumns({**slices, "_one": F.lit(1)})
    levels = [*time_slices(time), time, *key_slices(key, top), key]
    numbered = running_total(sliced, [], levels, {out: "_one"})
    return numbered.withColumn(out, F.col(out) + 1).drop(*slices, "_one")


def number_in_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    A table of at most ``group_rows`` rows cannot hold a larger group, so one window is safe
    (the row count of a Parquet scan comes from the footers). A larger table is first counted
    per group; groups above the bound are numbered by levels, the others by the window. The
    null group counts as a group like any other.
    """
    plain = Window.partitionBy(*group).orderBy(*order)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(plain).cast("bigint"))

    total = df.count()
    if total <= group_rows:
        return numbered(df)
    # The bound does not grow with the table, and the list of groups stays a table.
    counts = df.groupBy(*group).count().where(F.col("count") > group_rows)
    hot = settle(counts.select(*[F.col(g).alias(f"_hot_{g}") for g in group]))
    if hot.isEmpty():
        return numbered(df)
    same = [F.col(g).eqNullSafe(F.col(f"_hot_{g}")) for g in group]
    rare = df.join(hot, same, "left_anti")
    popular = df.join(hot, same, "left_semi")
    return numbered(rare).unionByName(_number_by_levels(popular, group, order, out))


def _number_by_levels(
    df: DataFrame, group: list[str], order: list[str], out: str
) -> DataFrame:
    """Number groups too large for one task; equal rows are counted, then written out again."""
    columns = df.columns
    rest = [c for c in columns if c not in group and c not in order]
    levels: list[str] = []
    slices: dict[str, Column] = {}
    for name in order + rest:
        if dict(df.dtypes)[name] == "bigint":
            slices[f"_s_{name}"] = F.shiftright(name, SLICE_BITS)
            levels.append(f"_s_{name}")
        levels.append(name)
    blocks = df.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumns(slices)
    placed = running_total(blocks, group, levels, {"_before": "_copies"})
    # Copies are spread over the cluster in blocks before the rows are written out.
    starts = placed.select(
        *columns,
        "_before",
        "_copies",
        F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(COPY_BLOCK))).alias("_from"),
    ).repartition(F.col("_before") + F.col("_from"))
    last = F.least(F.col("_from") + COPY_BLOCK, F.col("_copies")) - 1
    return starts.select(
        *columns,
        "_before",
        F.explode(F.sequence(F.col("_from"), last)).alias("_copy"),
    ).select(*columns, (F.col("_before") + F.col("_copy") + 1).cast("bigint").alias(out))


def range_scan(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    totals: dict[str, str],
    fold: Callable[[str], Column] = F.sum,
) -> DataFrame:
    """Add one column per entry ``out: value``: the fold of value over earlier rows of the group,
    NULL for its first row.

    The rows are cut into sampled ranges of (group, order); equal rows are told apart by their
    place, so a popular group, or one repeated row, spreads over as many ranges as it fills. A
    window sees one group inside one range, and only a range that begins inside a group takes
    over what the ranges before it summed up: at most one row per range. One path for every
    size; the cut rows are written once, so a lost executor finds the same ranges again.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    cut = settle(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(g).asc_nulls_first() for g in group], *keys, F.col("_tie").asc())
        .withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*keys, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*group, "_part").agg(*[fold(v).alias(f"_sum_{out}") for out, v in totals.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranges.withColumns({f"_from_{out}": fold(f"_sum_{out}").over(before) for out in totals})
        .withColumn("_first", F.min("_part").over(Window.partitionBy(*group)))
        .where("_part > _first")
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), *[f"_from_{out}" for out in totals])
    )
    same = [F.col("_part") == F.col("_p")] + [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    scanned = cut.withColumns({f"_in_{out}": fold(v).over(inside) for out, v in totals.items()}).join(carried, same, "left")
    both = {out: fold_two(fold, F.col(f"_from_{out}"), F.col(f"_in_{out}")) for out in totals}
    return scanned.select(*df.columns, *[c.alias(out) for out, c in both.items()])


def fold_two(fold: Callable[[str], Column], a: Column, b: Column) -> Column:
    """What ``fold`` makes of two partial results, either of which may be NULL."""
    if fold is F.sum:
        both = a + b
    elif fold is F.bit_xor:
        both = a.bitwiseXOR(b)
    elif fold is F.max:
        both = F.greatest(a, b)
    else:
        raise ValueError("folds: sum, max, bit_xor")
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
