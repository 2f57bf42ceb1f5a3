"""Production planning as set operations: slots, brand affinity, filling slots in order of deadline, scenarios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.functions import percent, round_to
from plantmetrics.functions.relational import attach_row, with_row_index, with_running_sum
from plantmetrics.operators.oee import line_capacity, oee_by

# Fixed values.
SHIFT_HOURS = 8
SHIFTS_PER_DAY = 3
DEFAULT_AFFINITY = 0.5
DEFAULT_CAPACITY = 130
NO_DEADLINE = "9999-12-31"
BIN = 512


def slot_grid(log: DataFrame, days: int = 5) -> DataFrame:
    """Day by line by shift with the line's capacity; as many rows as the plan has slots."""
    lines = line_capacity(log)
    return (
        lines.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(SHIFTS_PER_DAY))))
        .select("day", "line_id", "shift", F.coalesce("capacity", F.lit(DEFAULT_CAPACITY)).alias("capacity"))
    )


def affinity(log: DataFrame) -> DataFrame:
    return oee_by(log, "line_id", "brand").select("line_id", "brand", F.col("oee").alias("affinity"))


def brand_slots(slots: DataFrame, brands: DataFrame, log: DataFrame) -> DataFrame:
    """Every slot for every brand with the affinity of its line, 0.5 where the pair never ran."""
    names = brands.agg(F.sort_array(F.collect_set("brand")).alias("names"))
    grid = attach_row(slots, names, "b").withColumn("brand", F.explode("b.names")).drop("b")
    known = affinity(log)
    score = F.coalesce(round_to(F.col("affinity"), 9), F.lit(DEFAULT_AFFINITY))
    return grid.join(known, ["line_id", "brand"], "left").withColumn("affinity", score)


def affinity_rank(slots: DataFrame, brands: DataFrame, log: DataFrame) -> DataFrame:
    """Slots in the order each brand would take them: best line first, then day and shift."""
    order = W.partitionBy("brand").orderBy(F.desc("affinity"), "day", "shift", "line_id")
    return brand_slots(slots, brands, log).withColumn("rank", F.row_number().over(order))


def lanes(slots: DataFrame, brands: DataFrame, log: DataFrame) -> DataFrame:
    """Each slot given to the brand its line suits best, with running capacity [lo, hi) per brand."""
    best = W.partitionBy("day", "line_id", "shift").orderBy(F.desc("affinity"), "brand")
    chosen = brand_slots(slots, brands, log).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    running = W.partitionBy("brand").orderBy(F.desc("affinity"), "day", "shift", "line_id")
    hi = F.sum("capacity").over(running.rowsBetween(W.unboundedPreceding, 0))
    return chosen.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("capacity"))


def line_brands(lines: DataFrame, brands: DataFrame, log: DataFrame) -> DataFrame:
    """Each line with the brand it suits best: the highest affinity, 0.5 where the pair never ran, ties to the first name.

    Only pairs that ran are rows; of the brands that never ran on a line the first name stands for all.
    """
    known = affinity(log).join(brands.select("brand").distinct(), "brand", "left_semi")
    pair = F.struct((-round_to(F.col("affinity"), 9)).alias("neg"), "brand")
    ran = known.groupBy("line_id").agg(F.min(pair).alias("best"), F.collect_set("brand").alias("ran"))
    names = brands.agg(F.sort_array(F.collect_set("brand")).alias("names"))
    framed = attach_row(lines.select("line_id").distinct().join(ran, "line_id", "left"), names, "b")
    never = F.get(F.array_except("b.names", F.coalesce("ran", F.array().cast("array<string>"))), F.lit(0))
    fallback = F.when(never.isNotNull(), F.struct(F.lit(-DEFAULT_AFFINITY).alias("neg"), never.alias("brand")))
    chosen = framed.withColumn("chosen", F.least("best", fallback))
    return chosen.select("line_id", F.col("chosen.brand").alias("brand"), (-F.col("chosen.neg")).alias("affinity"))


def exclusive_fill(orders: DataFrame, slots: DataFrame, log: DataFrame) -> DataFrame:
    """Quantity of each order made in each slot, where a slot serves one order.

    Slots belong to the brand that their line suits best and are taken by falling affinity, then day, shift and line; the orders
    of a brand come by deadline, then larger first. An order takes whole slots until its quantity is met, and what is left of
    the last one stays idle. Every order takes a slot at least, so of each brand only as many orders are looked at as it has
    slots: a task holds a brand's part of the plan, whatever the number of orders. Orders without a quantity and slots without
    capacity take no part.
    """
    best = line_brands(slots, orders.select("brand"), log)
    order = W.partitionBy("brand").orderBy(F.desc("affinity"), "day", "shift", "line_id")
    lane = slots.where(F.col("capacity") > 0).join(best, "line_id").withColumn("place", F.row_number().over(order) - 1)
    lane = lane.select("brand", "place", "day", "shift", "line_id", F.col("capacity").cast("long").alias("capacity"))
    room = lane.groupBy("brand").agg(F.count(F.lit(1)).alias("_slots"))
    due = F.coalesce("deadline", F.lit(NO_DEADLINE).cast("date")).alias("due")
    asked = orders.where(F.col("qty") > 0).select("brand", "order_id", "model", F.col("qty").cast("long").alias("qty"), due)
    asked = with_row_index(asked.withColumn("_neg", -F.col("qty")), ["brand"], ["due", "_neg", "order_id"], "position")
    asked = asked.join(room, "brand").where(F.col("position") < F.col("_slots"))

    def fill(own: pd.DataFrame, queue: pd.DataFrame) -> pd.DataFrame:
        own, queue = own.sort_values("place"), queue.sort_values("position")
        ends = own["capacity"].cumsum().to_numpy()
        used, rows = 0, []
        for line in queue.itertuples(index=False):
            if used == len(own):
                break
            before = ends[used - 1] if used else 0
            last = min(int(np.searchsorted(ends, before + line.qty)), len(own) - 1)
            taken = own.iloc[used : last + 1]
            rest = line.qty - (np.r_[before, ends[used:last]] - before)
            rows.append(
                taken.assign(order_id=line.order_id, model=line.model, qty=np.minimum(taken["capacity"].to_numpy(), rest))
            )
            used = last + 1
        columns = ["day", "line_id", "shift", "brand", "model", "order_id", "qty"]
        return pd.concat([own.iloc[:0].assign(order_id=0, model="", qty=0), *rows])[columns]

    schema = ", ".join(
        f"{name} {kind.simpleString()}"
        for name, kind in (
            ("day", slots.schema["day"].dataType),
            ("line_id", slots.schema["line_id"].dataType),
            ("shift", slots.schema["shift"].dataType),
            ("brand", orders.schema["brand"].dataType),
            ("model", orders.schema["model"].dataType),
            ("order_id", orders.schema["order_id"].dataType),
            ("qty", T.LongType()),
        )
    )
    filled = lane.groupBy("brand").cogroup(asked.groupBy("brand")).applyInPandas(fill, schema)
    return filled.withColumn("start_hour", (F.col("shift") - 1) * SHIFT_HOURS).withColumn("end_hour", F.col("shift") * SHIFT_HOURS)


def queue(orders: DataFrame) -> DataFrame:
    """Orders with running quantity [lo, hi) per brand, by deadline (open ones last), then larger first."""
    due = F.coalesce("deadline", F.lit(NO_DEADLINE).cast("date"))
    keyed = orders.withColumn("due", due).withColumn("_neg", -F.col("qty"))
    placed = with_running_sum(keyed, ["brand"], ["due", "_neg", "order_id"], "qty", "hi")
    return placed.withColumn("lo", F.col("hi") - F.col("qty")).drop("_neg")


def order_positions(orders: DataFrame) -> DataFrame:
    """0-based place of every order by deadline, then quantity, then id."""
    keyed = orders.withColumn("due", F.coalesce("deadline", F.lit(NO_DEADLINE).cast("date"))).withColumn(
        "_neg", -F.col("qty")
    )
    return with_row_index(keyed, [], ["due", "_neg", "order_id"], "position").drop("_neg")


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BIN), F.floor((hi - 1) / BIN))


def capacity_fill(orders: DataFrame, slots: DataFrame, log: DataFrame) -> DataFrame:
    """Quantity of each order made in each slot: the overlap of the two running ranges within a brand.

    Ranges are cut into bins, so orders meet only the slots near them and no brand is joined as a whole.
    Orders that start beyond the brand's capacity cannot be placed and leave before the join.
    """
    lane = lanes(slots, orders.select("brand").distinct(), log)
    room = lane.groupBy("brand").agg(F.max("hi").alias("room"))
    waiting = queue(orders).join(room, "brand").where(F.col("lo") < F.col("room"))
    o = waiting.select(
        "brand", "order_id", "model", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"),
        F.explode(_bins(F.col("lo"), F.col("hi"))).alias("bin"),
    )
    s = lane.where(F.col("capacity") > 0).select(
        "brand", "day", "line_id", "shift", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"),
        F.explode(_bins(F.col("lo"), F.col("hi"))).alias("bin"),
    )
    start, end = F.greatest("o_lo", "s_lo"), F.least("o_hi", "s_hi")
    met = o.join(s, ["brand", "bin"]).where((start < end) & (F.floor(start / BIN) == F.col("bin")))
    return met.select(
        "day",
        "line_id",
        "shift",
        "brand",
        "model",
        "order_id",
        (end - start).alias("qty"),
        ((F.col("shift") - 1) * SHIFT_HOURS).alias("start_hour"),
        (F.col("shift") * SHIFT_HOURS).alias("end_hour"),
    )


def unplaced(orders: DataFrame, schedule: DataFrame) -> DataFrame:
    """What is left of each order after the plan."""
    made = schedule.groupBy("order_id").agg(F.sum("qty").alias("placed"))
    return orders.join(made, "order_id", "left").select(
        "order_id",
        "brand",
        "qty",
        F.coalesce("placed", F.lit(0)).alias("placed"),
        (F.col("qty") - F.coalesce("placed", F.lit(0))).alias("remaining"),
    )


def fulfilment(orders: DataFrame, schedule: DataFrame) -> DataFrame:
    ordered = orders.agg(F.sum("qty").alias("total_ordered"))
    done = schedule.agg(
        F.coalesce(F.sum("qty"), F.lit(0)).alias("total_scheduled"),
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct("day", "line_id", "shift").alias("slots_used"),
    )
    return attach_row(ordered, done, "d").select(
        "total_ordered",
        "d.total_scheduled",
        round_to(percent(F.col("d.total_scheduled"), F.col("total_ordered")), 1).alias("fulfillment_pct"),
        "d.entries",
        "d.slots_used",
    )


def resequence(schedule: DataFrame) -> DataFrame:
    """Per day and line: entries of a brand side by side, renumbered, with new hours."""
    order = W.partitionBy("day", "line_id").orderBy("brand", "shift", "order_id")
    return (
        schedule.withColumn("shift", F.row_number().over(order))
        .withColumn("start_hour", (F.col("shift") - 1) * SHIFT_HOURS)
        .withColumn("end_hour", F.col("shift") * SHIFT_HOURS)
    )


def gantt_rows(schedule: DataFrame) -> DataFrame:
    """Bars on one time axis in hours since the start of the plan."""
    return schedule.select(
        "line_id",
        "brand",
        "order_id",
        ((F.col("day") - 1) * 24 + F.col("start_hour")).alias("x_start"),
        (F.col("end_hour") - F.col("start_hour")).alias("width"),
    )


def daily_mean(log: DataFrame, *keys: str) -> DataFrame:
    """Output per day, then the mean over days (per key, if any)."""
    days = log.groupBy(*keys, "date").agg(F.sum("actual_qty").alias("day_output"))
    mean = F.avg("day_output").alias("daily_output")
    return days.groupBy(*keys).agg(mean) if keys else days.agg(mean)


def what_if(log: DataFrame, removed_line: str = "L4") -> DataFrame:
    """Three scenarios against today's daily output and score, one row each."""
    base = daily_mean(log)
    score = log.agg(F.avg("oee_score").alias("oee"))
    lines = log.groupBy("line_id").agg(F.count_distinct("shift").alias("shifts")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("shifts") < SHIFTS_PER_DAY).alias("short_lines")
    )
    gone = daily_mean(log.where(F.col("line_id") == removed_line)).withColumnRenamed("daily_output", "line_output")
    row = base
    for name, frame in (("s", score), ("l", lines), ("g", gone)):
        row = attach_row(row, frame, name)
    now = F.col("daily_output")
    extra = now / F.col("l.lines") / SHIFTS_PER_DAY * F.col("l.short_lines")
    scenarios = F.array(
        F.struct(F.lit("add_shift_3").alias("scenario"), (now + extra).alias("projected"), F.lit(0.97).alias("f")),
        F.struct(
            F.lit(f"remove_line_{removed_line}").alias("scenario"),
            (now - F.coalesce("g.line_output", F.lit(0.0))).alias("projected"),
            F.lit(1.02).alias("f"),
        ),
        F.struct(F.lit("increase_capacity_10pct").alias("scenario"), (now * 1.10).alias("projected"), F.lit(0.98).alias("f")),
    )
    return row.withColumn("x", F.explode(scenarios)).select(
        "x.scenario",
        round_to(now, 0).alias("current_daily_output"),
        round_to(F.col("x.projected"), 0).alias("projected_daily_output"),
        round_to((F.col("x.projected") - now) / now * 100, 1).alias("change_pct"),
        round_to(F.col("s.oee"), 4).alias("current_oee"),
        round_to(F.col("s.oee") * F.col("x.f"), 4).alias("projected_oee"),
    )
