"""Stock allocation: first come, first served, all or nothing per request.

Requests reserve units of one or more equipments in a global order. Served one after another
that is a single-task job, so the work is cut down first:

* an equipment whose whole demand fits its stock refuses nobody: its lines drop out;
* an equipment that shares no request with another contested one is independent. Its lines,
  if there are not too many for one task, stream past a counter in request order, with the
  equipments spread over the cluster;
* contested equipments that requests tie together form connected components, and requests of
  different components never meet: each component is served in order by its own group, many of
  them at once, whole requests tested in windows;
* a component (or a single equipment) with so many lines that it would keep one task busy for
  too long is decided in parallel rounds.

A round looks, per line, at the units asked for by earlier undecided requests. A request
whose every line fits even if all of those are served is accepted; a request with a line
larger than the remaining stock is refused; the others wait for the next round, with the
accepted units taken off. That may happen without regard to order, because a request is only
accepted when everything undecided before it fits as well. Before it does so, each round
serves the earliest undecided requests, ``HEAD_LINES`` lines of them, one after another, each
component in its own group: everything before them is decided, so that is the sequential answer
too. Every round therefore decides at least that many lines, however long the chains of
dependent requests are, and the rounds end with the sequential answer. The units ahead are running totals over slices of the order (see ``numbering``): a popular
equipment never becomes one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import new_path, settle
from .components import components
from .numbering import key_slices, running_total, top_key
from .rejects import Decision, first_refusal, refuse

# Lines of one equipment, or of one component, that may stream through one task.
STREAM_LINES = 2_000_000
# Lines whose requests are tested at once when a component is served.
WINDOW_LINES = 4096
# Lines that a round serves in order before it judges the others at once.
HEAD_LINES = 100_000

CONDITIONS = ("GOOD", "DAMAGED", "LOST")


def _ahead(lines: DataFrame, value: str, out: str, top: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier lines of the same equipment."""
    slices = key_slices("seq", top)
    return running_total(
        lines.withColumns(slices) if slices else lines,
        ["equipment_id"],
        [*slices, "seq"],
        {out: value},
    ).drop(*slices)


def _server() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function that serves lines sorted by equipment and order.

    Built as a closure, so that it travels to the executors without this package there.
    """

    def take(units: np.ndarray, left: int) -> tuple[np.ndarray, int]:
        """Which lines of one equipment fit in order, and what is left after them."""
        served = np.zeros(len(units), bool)
        waiting = np.flatnonzero(units <= left)
        while len(waiting):
            total = np.cumsum(units[waiting])
            fit = int(np.searchsorted(total, left, side="right"))
            served[waiting[:fit]] = True
            left -= int(total[fit - 1]) if fit else 0
            # What is left only shrinks: larger lines are refused for good.
            waiting = waiting[fit:]
            waiting = waiting[units[waiting] <= left]
        return served, left

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for batch in batches:
            equipment = batch["equipment_id"].to_numpy()
            units, capacity = batch["quantity"].to_numpy(np.int64), batch["capacity"].to_numpy(np.int64)
            served = np.zeros(len(batch), bool)
            edges = np.flatnonzero(np.append(True, equipment[1:] != equipment[:-1])) if len(batch) else []
            for start, end in zip(edges, np.append(edges[1:], len(batch)).astype(int)):
                if equipment[start] != current:
                    current, left = equipment[start], int(capacity[start])
                served[start:end], left = take(units[start:end], left)
            yield pd.DataFrame({"request_id": batch["request_id"], "served": served})

    return serve


def _in_order(window: int = WINDOW_LINES) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function that serves whole requests one after another, sorted by (component, seq).

    A window of requests is tested at once: those before the first one that no longer fits are
    served, that one is refused, and so is every later one with a line above what is left.
    """

    def decide(request: np.ndarray, equipment: np.ndarray, units: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Which requests (numbered in order, one number per line) are served; takes from ``left``."""
        served = np.zeros(int(request[-1]) + 1, bool)
        by_equipment = np.argsort(equipment, kind="stable")
        request, equipment, units = request[by_equipment], equipment[by_equipment], units[by_equipment]
        while len(request):
            # What no longer fits by itself is refused with its whole request.
            low = np.unique(request[units > left[equipment]])
            keep = ~np.isin(request, low)
            request, equipment, units = request[keep], equipment[keep], units[keep]
            if not len(request):
                break
            total = np.cumsum(units)
            heads = np.flatnonzero(np.append(True, equipment[1:] != equipment[:-1]))
            before = np.repeat(total[heads] - units[heads], np.diff(np.append(heads, len(units))))
            over = request[total - before > left[equipment]]
            stop = over.min() if len(over) else served.size
            ready = request < stop
            served[request[ready]] = True
            np.subtract.at(left, equipment[ready], units[ready])
            # The one that stops the others has a line above what is left now.
            request, equipment, units = request[~ready], equipment[~ready], units[~ready]
        return served

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict = {}
        component, held = None, None

        def judge(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal component, left
            last = rows["component"].iloc[-1]
            fresh = rows.drop_duplicates("equipment_id")
            for e, capacity in zip(fresh["equipment_id"], fresh["capacity"]):
                left.setdefault(e, int(capacity))
            names, place = np.unique(rows["equipment_id"].to_numpy(), return_inverse=True)
            stock = np.array([left[e] for e in names], np.int64)
            seq = rows["seq"].to_numpy()
            part = rows["component"].to_numpy()
            starts = np.append(True, (seq[1:] != seq[:-1]) | (part[1:] != part[:-1]))
            number, firsts = np.cumsum(starts) - 1, np.flatnonzero(starts)
            units, served = rows["quantity"].to_numpy(np.int64), []
            # Windows end between requests.
            cuts = firsts[np.unique(np.searchsorted(firsts, np.arange(0, len(rows), window)).clip(max=len(firsts) - 1))]
            cuts = np.unique(np.append(cuts, [0, len(rows)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                served.append(decide(number[a:b] - number[a], place[a:b], units[a:b], stock))
            left.update(zip(names.tolist(), stock.tolist()))
            if last != component:
                # Nothing of an earlier component is asked for again.
                own = set(rows["equipment_id"][part == last])
                left = {e: n for e, n in left.items() if e in own}
                component = last
            return pd.DataFrame({"request_id": rows["request_id"].iloc[firsts].to_numpy(), "served": np.concatenate(served)})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # The last request may go on in the next batch.
            seq, part = rows["seq"].to_numpy(), rows["component"].to_numpy()
            ends = np.flatnonzero((seq != seq[-1]) | (part != part[-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield judge(rows.iloc[:cut])
            held = rows.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield judge(held)

    return serve


def _in_components(lines: DataFrame) -> DataFrame:
    """(request_id, served) of lines served in order, every component in one group."""
    schema = lines.select("request_id").schema.add("served", "boolean")
    spread = lines.repartition("component").sortWithinPartitions("component", "seq")
    return spread.mapInPandas(_in_order(), schema)


def _with_components(lines: DataFrame) -> DataFrame:
    """Contested lines with the component of their equipment, written once."""
    least = lines.groupBy("request_id").agg(F.min("equipment_id").alias("a"), F.max("equipment_id").alias("_z")).where("a < _z")
    links = lines.join(least.select("request_id", "a"), "request_id").select("a", F.col("equipment_id").alias("b")).distinct()
    named = components(settle(links)).withColumnRenamed("node", "equipment_id")
    return settle(lines.join(named, "equipment_id", "left").withColumn("component", F.coalesce("component", "equipment_id")))


def _rounds(lines: DataFrame, head_lines: int = HEAD_LINES) -> DataFrame:
    """Decide lines (request_id, seq, equipment_id, quantity, capacity, component) round by round."""
    spark = lines.sparkSession
    folder = new_path(spark, "rounds")
    top = top_key(lines, "seq")

    def less(rest: DataFrame, served: DataFrame) -> DataFrame:
        """The lines with the units of served ones taken off."""
        used = served.groupBy("equipment_id").agg(F.sum("quantity").alias("_used"))
        return rest.join(used, "equipment_id", "left").select(
            "request_id", "seq", "equipment_id", "quantity",
            (F.col("capacity") - F.coalesce("_used", F.lit(0))).alias("capacity"),
            "component",
        )

    waiting, number = lines, 0
    while True:
        # Whole requests, so a few lines more than asked for.
        last = waiting.select("seq").orderBy("seq").limit(head_lines).agg(F.max("seq")).first()[0]
        head = waiting.where(F.col("seq") <= F.lit(last))
        first = settle(head.join(_in_components(head), "request_id"))
        rest = settle(less(waiting.where(F.col("seq") > F.lit(last)), first.where("served")))
        never = rest.groupBy("request_id").agg(
            F.max(F.col("quantity") > F.col("capacity")).alias("_never")
        )
        judged = rest.join(never, "request_id")
        sure = (
            _ahead(judged.where("NOT _never"), "quantity", "ahead", top)
            .groupBy("request_id")
            .agg(F.min(F.col("ahead") + F.col("quantity") <= F.col("capacity")).alias("_sure"))
        )
        # served: true, false, or NULL while undecided
        state = judged.join(sure, "request_id", "left").select(
            *rest.columns,
            F.when(F.col("_never"), False).when(F.col("_sure"), True).alias("served"),
        )
        path = f"{folder}/round={number}"
        first.select(*state.columns).unionByName(state).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if state.where("served IS NULL").isEmpty():
            break
        later = state.where(F.col("seq") > F.lit(last))
        waiting = less(later.where("served IS NULL").drop("served"), later.where("served"))
        number += 1
    rounds = spark.read.schema(state.schema).parquet(f"{folder}/round=*")
    return rounds.where("served IS NOT NULL").select("request_id", "served").distinct()


def allocate(
    lines: DataFrame,
    stock: DataFrame,
    probes: DataFrame | None = None,
    stream_lines: int = STREAM_LINES,
    head_lines: int = HEAD_LINES,
) -> DataFrame:
    """Serve requests in ``seq`` order; returns (request_id, served).

    ``lines``: request_id, seq (bigint, unique per request), equipment_id, quantity > 0.
    ``stock``: equipment_id, capacity. ``probes``: lines of requests that are refused for
    another reason later on; they take nothing but learn whether their units were there.
    """
    units = F.sum("quantity").cast("bigint").alias("quantity")
    capacity = stock.select("equipment_id", F.col("capacity").cast("bigint").alias("capacity"))
    grouped = settle(lines.groupBy("request_id", "seq", "equipment_id").agg(units))
    demand = (
        grouped.groupBy("equipment_id")
        .agg(F.sum("quantity").alias("_asked"), F.count("*").alias("_lines"))
        .join(capacity, "equipment_id", "left")
        .withColumn("capacity", F.coalesce("capacity", F.lit(0).cast("bigint")))
        .where("_asked > capacity")
        .select("equipment_id", "capacity", (F.col("_lines") > stream_lines).alias("_popular"))
    )
    contested = settle(grouped.join(demand, "equipment_id"))
    # A request with one contested line depends on that equipment alone.
    several = contested.groupBy("request_id").agg((F.count("*") > 1).alias("_several"))
    entangled = (
        contested.join(several.where("_several"), "request_id", "left_semi")
        .select("equipment_id")
        .union(contested.where("_popular").select("equipment_id"))
        .distinct()
        .withColumn("_entangled", F.lit(True))
    )
    fields = ("request_id", "seq", "equipment_id", "quantity", "capacity")
    sorted_out = settle(
        contested.join(entangled, "equipment_id", "left").select(*fields, "_entangled")
    )
    alone = sorted_out.where("_entangled IS NULL").select(*fields)
    served = (
        alone.repartition("equipment_id")
        .sortWithinPartitions("equipment_id", "seq")
        .mapInPandas(_server(), alone.select("request_id").schema.add("served", "boolean"))
    )
    tangled = sorted_out.where("_entangled").select(*fields)
    if not tangled.isEmpty():
        tangled = _with_components(tangled)
        large = settle(tangled.groupBy("component").agg(F.count("*").alias("_lines")).where(F.col("_lines") > stream_lines))
        served = served.unionByName(_in_components(tangled.join(large, "component", "left_anti").select(*fields, "component")))
        if not large.isEmpty():
            rest = tangled.join(large, "component", "left_semi").select(*fields, "component")
            served = served.unionByName(_rounds(settle(rest), head_lines))
    free = (
        grouped.select("request_id")
        .distinct()
        .join(contested.select("request_id"), "request_id", "left_anti")
        .withColumn("served", F.lit(True))
    )
    decided = served.unionByName(free)
    if probes is None:
        return decided
    decided = settle(decided)
    # Order every probe against the units really taken before it.
    won = grouped.join(decided.where("served"), "request_id", "left_semi")
    asked = probes.groupBy("request_id", "seq", "equipment_id").agg(units)
    rows = settle(
        won.withColumn("_take", F.col("quantity")).unionByName(
            asked.withColumn("_take", F.lit(0).cast("bigint"))
        )
    )
    probed = (
        _ahead(rows, "_take", "_gone", top_key(rows, "seq"))
        .where("_take = 0")
        .join(capacity, "equipment_id", "left")
        .groupBy("request_id")
        .agg(
            F.min(
                F.col("_gone") + F.col("quantity") <= F.coalesce("capacity", F.lit(0))
            ).alias("served")
        )
    )
    return decided.unionByName(probed)


def rent_out(requests: DataFrame, inventory: DataFrame) -> Decision:
    """Reserve single-equipment requests: (request_id, seq, equipment_id, quantity)."""
    stock = inventory.select(
        "equipment_id", F.coalesce("available_quantity", F.lit(0)).alias("capacity")
    )
    known = requests.join(stock, "equipment_id", "left")
    early = first_refusal(
        (F.col("quantity") <= 0, refuse("stock_out", -20010)),
        (F.col("capacity").isNull(), refuse("stock_out", -1403)),
        # No comparison stops a NULL quantity before the update does.
        (F.col("quantity").isNull(), refuse("stock_out", -1407)),
    )
    checked = settle(known.withColumn("_early", early).drop("capacity"))
    served = allocate(checked.where("_early IS NULL"), stock)
    decided = checked.join(served, "request_id", "left").withColumn(
        "refusal",
        F.coalesce("_early", first_refusal((~F.col("served"), refuse("stock_out", -20011)))),
    )
    return Decision(decided.select(*requests.columns, "refusal"), "request_id")


def inventory_after_rent(taken: DataFrame, inventory: DataFrame, as_of: str) -> DataFrame:
    """Move the units of accepted (equipment_id, quantity) rows from available to rented."""
    used = taken.groupBy("equipment_id").agg(F.sum("quantity").alias("_used"))
    moved = F.coalesce("_used", F.lit(0)).cast("int")
    return inventory.join(used, "equipment_id", "left").withColumns(
        {
            "available_quantity": F.col("available_quantity") - moved,
            "rented_quantity": F.coalesce("rented_quantity", F.lit(0)) + moved,
            "last_updated": F.when(F.col("_used").isNotNull(), C.clock(as_of)).otherwise(
                F.col("last_updated")
            ),
        }
    ).drop("_used")


def take_back(commands: DataFrame, items: DataFrame, inventory: DataFrame) -> Decision:
    """Return single items: (request_id, seq, rental_item_id, condition_status).

    A NULL condition is accepted without effect, as no rule refuses it.

    The rented bucket may not fall below zero (the buckets have to sum to the total), so a
    return that would overdraw it is refused: the same first-come allocation, on that bucket.
    """
    stock = inventory.select(
        "equipment_id", F.coalesce("rented_quantity", F.lit(0)).alias("capacity")
    )
    known = commands.join(
        items.select("rental_item_id", "equipment_id", "quantity"), "rental_item_id", "left"
    ).join(stock, "equipment_id", "left")
    early = first_refusal(
        (~F.col("condition_status").isin(*CONDITIONS), refuse("stock_in", -20020)),
        (F.col("quantity").isNull(), refuse("stock_in", -1403)),
        (F.col("capacity").isNull(), refuse("stock_in", -1403)),
    )
    checked = settle(known.withColumn("_early", early).drop("capacity"))
    # A NULL condition passes the check and moves no bucket.
    served = allocate(checked.where("_early IS NULL AND condition_status IS NOT NULL"), stock)
    decided = checked.join(served, "request_id", "left").withColumn(
        "refusal",
        F.coalesce("_early", first_refusal((~F.col("served"), refuse("stock_in", -2290)))),
    )
    return Decision(
        decided.select(*commands.columns, "equipment_id", "quantity", "refusal"), "request_id"
    )


def inventory_after_return(returned: DataFrame, inventory: DataFrame, as_of: str) -> DataFrame:
    """Add returned (equipment_id, quantity, condition_status) rows to their buckets."""
    def units(condition: str):
        return F.sum(
            F.when(F.col("condition_status") == condition, F.col("quantity")).otherwise(0)
        ).cast("int")

    delta = returned.where("condition_status IS NOT NULL").groupBy("equipment_id").agg(
        units("GOOD").alias("_good"),
        units("DAMAGED").alias("_damaged"),
        units("LOST").alias("_lost"),
    )
    change = {c: F.coalesce(c, F.lit(0)) for c in ("_good", "_damaged", "_lost")}
    back = change["_good"] + change["_damaged"] + change["_lost"]

    def bucket(name: str):
        return F.coalesce(name, F.lit(0))

    return inventory.join(delta, "equipment_id", "left").withColumns(
        {
            "available_quantity": bucket("available_quantity") + change["_good"],
            "damaged_quantity": bucket("damaged_quantity") + change["_damaged"],
            "lost_quantity": bucket("lost_quantity") + change["_lost"],
            "rented_quantity": F.greatest(bucket("rented_quantity") - back, F.lit(0)),
            "last_updated": F.when(F.col("_good").isNotNull(), C.clock(as_of)).otherwise(
                F.col("last_updated")
            ),
        }
    ).drop("_good", "_damaged", "_lost")
