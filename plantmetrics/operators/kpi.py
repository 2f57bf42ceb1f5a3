"""Twenty indicators from five tables, with status, trend, alerts and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import percent, round_to, safe_div
from plantmetrics.functions.relational import attach_row
from plantmetrics.operators.oee import SHIFT_MINUTES

TREND_BAND = 0.5
STATUSES = ["green", "yellow", "red"]


def status(value: Column, target: Column, warning: Column, direction: Column) -> Column:
    """Traffic light by direction; the critical limit is carried in the table but does not decide."""
    lower = F.when(value <= target, "green").when(value <= warning, "yellow").otherwise("red")
    higher = F.when(value >= target, "green").when(value >= warning, "yellow").otherwise("red")
    zero = F.when(value == 0, "green").when(value <= warning, "yellow").otherwise("red")
    return F.when(direction == lookups.LOWER, lower).when(direction == lookups.HIGHER, higher).otherwise(zero)


def per_day(log: DataFrame) -> DataFrame:
    """Sums of the production log per day and brand: all that the indicators need of it, in one pass."""
    return log.groupBy("date", "brand").agg(
        F.count(F.lit(1)).alias("shifts"),
        *[F.sum(c).alias(c) for c in ("actual_qty", "defect_qty", "oee_score", "changeover_minutes", "downtime_minutes", "operator_count")],
    )


def production_sums(days: DataFrame, brands: list[str]) -> DataFrame:
    """Totals over the daily sums of ``per_day``."""
    per_brand = []
    for i, brand in enumerate(brands, 1):
        mine = F.col("brand") == brand
        rate = safe_div(F.sum(F.when(mine, F.col("defect_qty"))), F.sum(F.when(mine, F.col("actual_qty"))))
        per_brand.append(F.coalesce(rate, F.lit(0.0)).alias(f"brand{i}"))
    shifts = F.sum("shifts")
    return days.agg(
        F.coalesce(shifts, F.lit(0)).alias("shifts"),
        F.sum("actual_qty").alias("actual"),
        F.sum("defect_qty").alias("defect_qty"),
        F.try_divide(F.sum("oee_score"), shifts).alias("oee"),
        F.try_divide(F.sum("changeover_minutes"), shifts).alias("changeover"),
        F.sum("downtime_minutes").alias("downtime"),
        F.try_divide(F.sum("operator_count"), shifts).alias("operators"),
        *per_brand,
    )


def kpi_values(
    days: DataFrame,
    defects: DataFrame,
    inventory: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    score: DataFrame,
    brands: list[str],
) -> DataFrame:
    """One row per indicator: kpi_id, value. ``days`` comes from ``per_day``; ``score`` is one row with ``smsi_score``."""
    d = defects.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("action") == "rework").alias("rework"),
        F.count_if(F.col("action") == "scrap").alias("scrap"),
        F.count_if(F.col("detection_point") == "customer_return").alias("returns"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )
    i = inventory.agg(
        F.sum("consumption_rate_daily").alias("rate"),
        F.sum(F.col("current_stock") * F.col("unit_price_eur")).alias("stock_value"),
        F.avg("unit_price_eur").alias("price"),
        F.count_if(F.col("current_stock") <= 0).alias("stockouts"),
    )
    o = orders.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("delay_days") <= 0).alias("ok"),
        F.avg("quality_score").alias("quality"),
    )
    p = products.agg(F.avg("carbon_footprint_kg").alias("carbon"), F.avg("weight_grams").alias("weight"))
    row = production_sums(days, brands)
    for name, frame in (("d", d), ("i", i), ("o", o), ("p", p), ("s", score.select("smsi_score"))):
        row = attach_row(row, frame, name)
    rate = safe_div(F.col("defect_qty"), F.col("actual"))
    fpy = F.when(F.col("actual") > 0, (1 - F.try_divide("defect_qty", "actual")) * 100).otherwise(95.0)
    turnover = safe_div(F.col("i.rate") * 365 * F.col("i.price"), F.col("i.stock_value"))
    values = {
        "overall_defect_rate": round_to(rate, 4),
        **{f"brand{n}_defect_rate": round_to(F.col(f"brand{n}"), 4) for n in range(1, len(brands) + 1)},
        "on_time_delivery": round_to(percent(F.col("o.ok"), F.col("o.n"), 95.0), 1),
        "oee_average": round_to(F.col("oee") * 100, 1),
        "customer_return_rate": round_to(safe_div(F.col("d.returns"), F.col("actual")), 4),
        "rework_rate": round_to(safe_div(F.col("d.rework"), F.col("d.records")), 4),
        "scrap_rate": round_to(safe_div(F.col("d.scrap"), F.col("d.records")), 4),
        "first_pass_yield": round_to(fpy, 1),
        "changeover_time_avg": round_to(F.col("changeover"), 1),
        "downtime_pct": round_to(percent(F.col("downtime"), F.col("shifts") * SHIFT_MINUTES), 1),
        "inventory_turnover": round_to(turnover, 1),
        "stockout_incidents": F.col("i.stockouts").cast("double"),
        "supplier_quality_score": round_to(F.col("o.quality"), 2),
        "training_hours_per_emp": round_to(F.col("operators") * 4, 1),
        "safety_incidents": F.floor(F.col("d.critical") / 50).cast("double"),
        "energy_per_unit_kwh": round_to(F.col("p.carbon") * 0.35, 2),
        "waste_per_unit_kg": round_to(rate * (F.col("p.weight") / 1000), 4),
        "smsi_score": F.col("s.smsi_score"),
    }
    flat = row.select(*[v.alias(k) for k, v in values.items()])
    return flat.unpivot([], list(values), "kpi_id", "value")


def half_trends(days: DataFrame) -> DataFrame:
    """Five indicators in the first and second half of the date range of ``per_day``; the others have no trend."""
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    split = attach_row(days, span, "span")
    shifts = F.sum("shifts")
    early = 2 * F.datediff("date", "span.a") <= F.datediff("span.b", "span.a")
    halves = split.groupBy(early.alias("early")).agg(
        (F.sum("oee_score") / shifts * 100).alias("oee_average"),
        safe_div(F.sum("defect_qty"), F.sum("actual_qty")).alias("overall_defect_rate"),
        (F.sum("downtime_minutes") / (shifts * SHIFT_MINUTES) * 100).alias("downtime_pct"),
        (F.sum("changeover_minutes") / shifts).alias("changeover_time_avg"),
        F.when(F.sum("actual_qty") > 0, (1 - F.try_divide(F.sum("defect_qty"), F.sum("actual_qty"))) * 100)
        .otherwise(95.0)
        .alias("first_pass_yield"),
    )
    ids = ["oee_average", "overall_defect_rate", "downtime_pct", "changeover_time_avg", "first_pass_yield"]
    long = halves.unpivot(["early"], ids, "kpi_id", "value")
    pairs = long.groupBy("kpi_id").agg(
        F.max(F.when(F.col("early"), F.col("value"))).alias("first_half"),
        F.max(F.when(~F.col("early"), F.col("value"))).alias("second_half"),
    )
    change = F.col("second_half") - F.col("first_half")
    label = F.when(F.abs(change) < TREND_BAND, "stable").when(change > 0, "up").otherwise("down")
    return pairs.withColumn("trend", F.coalesce(F.when(change.isNotNull(), label), F.lit("stable")))


def board(values: DataFrame, trends: DataFrame, thresholds: DataFrame) -> DataFrame:
    """All indicators of the threshold table with value (0 when missing), status and trend."""
    joined = thresholds.join(values, "kpi_id", "left").join(trends.select("kpi_id", "trend"), "kpi_id", "left")
    value = F.coalesce("value", F.lit(0.0))
    return joined.select(
        "position",
        "kpi_id",
        "name",
        value.alias("value"),
        "target",
        status(value, F.col("target"), F.col("warning"), F.col("direction")).alias("status"),
        F.coalesce("trend", F.lit("stable")).alias("trend"),
    )


def alerts(kpis: DataFrame) -> DataFrame:
    """Yellow and red indicators, red ones first, then by name."""
    return (
        kpis.where(F.col("status").isin("yellow", "red"))
        .select("kpi_id", "name", "value", "target", "status", "trend")
        .orderBy(F.when(F.col("status") == "red", 0).otherwise(1), "name")
    )


def rollup(kpis: DataFrame) -> DataFrame:
    return kpis.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )


def dashboard(scores: DataFrame, performance: DataFrame, sustainability: DataFrame, kpis: DataFrame) -> DataFrame:
    """One document: the brands' report blocks, indicator counts and alerts."""
    blocks = [
        ("scorecards", scores),
        ("performance", performance),
        ("sustainability", sustainability),
        ("alerts", alerts(kpis)),
    ]
    frame = rollup(kpis).select(F.struct("total", *STATUSES).alias("kpi_summary"))
    for name, part in blocks:
        packed = part.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*part.columns)))).alias("rows"))
        frame = attach_row(frame, packed, name)
    return frame.select(F.to_json(F.struct("kpi_summary", *[F.col(f"{n}.rows").alias(n) for n, _ in blocks])).alias("document"))
