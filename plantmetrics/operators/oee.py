"""Equipment effectiveness: ratios of sums, losses, benchmarks, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions import (
    clip,
    month_start,
    percent,
    round_to,
    safe_div,
    truncate,
    week_end,
)

# Minutes of a shift, shares of lost speed and of start-up rejects.
SHIFT_MINUTES = 480
SPEED_LOSS_SHARE = 0.6
MINOR_STOP_SHARE = 0.4
STARTUP_SHARE = 0.15

RATIOS = ["availability", "performance", "quality", "oee"]


def output_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("shifts"),
        F.sum("planned_qty").alias("planned"),
        F.sum("actual_qty").alias("actual"),
        F.sum("defect_qty").alias("defects"),
        F.sum("downtime_minutes").alias("downtime"),
        F.sum("changeover_minutes").alias("changeover"),
    ]


def with_ratios(sums: DataFrame) -> DataFrame:
    """Availability, performance, quality and their product from the sums, unrounded."""
    minutes = F.col("shifts") * SHIFT_MINUTES
    return (
        sums.withColumn(
            "availability", clip((minutes - F.col("downtime") - F.col("changeover")) / minutes, 0.0, 1.0)
        )
        .withColumn("performance", clip(safe_div(F.col("actual"), F.col("planned")), 0.0, 1.0))
        .withColumn("quality", clip(safe_div(F.col("actual") - F.col("defects"), F.col("actual")), 0.0, 1.0))
        .withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))
    )


def oee_by(log: DataFrame, *keys: Column | str) -> DataFrame:
    """Ratios per key; one shuffle of pre-aggregated sums."""
    return with_ratios(log.groupBy(*keys).agg(*output_sums()))


def oee_line_period(log: DataFrame, period: str = "monthly") -> DataFrame:
    """Per line and month (labelled by its first day) or week (by its Sunday); empty periods are absent."""
    label = month_start(F.col("date")) if period == "monthly" else week_end(F.col("date"))
    return oee_by(log, "line_id", label.alias("period")).select(
        "line_id", "period", *[round_to(F.col(c), 4).alias(c) for c in RATIOS]
    )


def line_average(by_period: DataFrame) -> DataFrame:
    """Mean over lines per period."""
    return by_period.groupBy("period").agg(F.avg("oee").alias("avg_oee"))


def _metric(value: Column, position: int, name: str) -> Column:
    return F.struct(value.alias("value"), F.lit(position).alias("position"), F.lit(name).alias("metric"))


def benchmark(log: DataFrame) -> DataFrame:
    """All-time ratios per line with best and worst metric and rank by OEE; ties by line name."""
    lowest = F.array(*[_metric(F.col(m), i, m) for i, m in enumerate(RATIOS[:3])])
    highest = F.array(*[_metric(-F.col(m), i, m) for i, m in enumerate(RATIOS[:3])])
    ranked = oee_by(log, "line_id").select(
        "line_id",
        round_to(F.col("oee"), 4).alias("avg_oee"),
        *[round_to(F.col(m), 4).alias(m) for m in RATIOS[:3]],
        F.array_min(highest)["metric"].alias("best_metric"),
        F.array_min(lowest)["metric"].alias("worst_metric"),
    )
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("avg_oee"), "line_id")))


def best_worst(frame: DataFrame, label: str = "line_id", value: str = "avg_oee") -> DataFrame:
    """Labels with the highest and the lowest value; ties go to the first name."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))
    worst = F.min(F.struct(F.col(value).alias("v"), F.col(label).alias("l")))
    return frame.agg(best.alias("b"), worst.alias("w")).select(
        F.col("b.l").alias("best"),
        (-F.col("b.v")).alias("best_value"),
        F.col("w.l").alias("worst"),
        F.col("w.v").alias("worst_value"),
    )


def current_oee(by_period: DataFrame) -> DataFrame:
    """Latest period per line against the one before; a single period compares with itself."""
    by_line = W.partitionBy("line_id")
    change = F.col("oee") - F.col("previous_oee")
    return (
        by_period.withColumn("previous_oee", F.lag("oee").over(by_line.orderBy("period")))
        .withColumn("previous_oee", F.coalesce("previous_oee", "oee"))
        .withColumn("_rn", F.row_number().over(by_line.orderBy(F.desc("period"))))
        .where(F.col("_rn") == 1)
        .select("line_id", "period", *RATIOS, "previous_oee", trend_label(change).alias("trend"))
    )


def trend_label(change: Column, band: float = 0.01) -> Column:
    return F.when(change > band, "improving").when(change < -band, "declining").otherwise("stable")


def line_capacity(log: DataFrame) -> DataFrame:
    """Mean output of a shift per line, as a whole number."""
    return log.groupBy("line_id").agg(truncate(F.avg("actual_qty")).alias("capacity"))


def six_big_losses(log: DataFrame) -> DataFrame:
    """Losses per line in minutes and units."""
    sums = log.groupBy("line_id").agg(*output_sums())
    available = F.col("shifts") * SHIFT_MINUTES - F.col("downtime") - F.col("changeover")
    cycle = safe_div(available, F.col("planned"))
    missed = F.col("planned") - F.col("actual")
    startup = truncate(F.col("defects") * STARTUP_SHARE)
    return (
        sums.withColumn("speed_loss_min", truncate(missed * cycle * SPEED_LOSS_SHARE))
        .withColumn("minor_stops_min", truncate(missed * cycle * MINOR_STOP_SHARE))
        .select(
            "line_id",
            F.col("downtime").alias("breakdowns_min"),
            F.col("changeover").alias("setup_changeover_min"),
            "minor_stops_min",
            "speed_loss_min",
            (F.col("defects") - startup).alias("defects_units"),
            startup.alias("startup_rejects_units"),
            (F.col("downtime") + F.col("changeover") + F.col("speed_loss_min") + F.col("minor_stops_min")).alias(
                "total_loss_minutes"
            ),
            F.col("planned").alias("theoretical_output"),
            F.col("actual").alias("actual_output"),
        )
    )


def loss_steps(log: DataFrame) -> DataFrame:
    """Plant-wide loss percentages as ordered steps: step, stage, loss_pct."""
    s = log.agg(*output_sums())
    availability = (F.col("downtime") + F.col("changeover")) / (F.col("shifts") * SHIFT_MINUTES) * 100
    performance = F.when(F.col("planned") > 0, (1 - F.try_divide("actual", "planned")) * 100).otherwise(0.0)
    return s.select(
        availability.alias("a"), performance.alias("p"), percent(F.col("defects"), F.col("actual")).alias("q")
    ).select(
        F.expr(
            "stack(5, 1, 'theoretical', 0.0D, 2, 'availability_loss', a, 3, 'performance_loss', p,"
            " 4, 'quality_loss', q, 5, 'final_oee', 0.0D) as (step, stage, loss_pct)"
        ),
        ((1 - F.col("a") / 100) * (1 - F.col("p") / 100) * (1 - F.col("q") / 100) * 100).alias("final_oee"),
    )


def loss_waterfall(log: DataFrame) -> DataFrame:
    """Height and base of each step of the chart: full bar, three losses hanging from it, final OEE."""
    running = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    left = 100 - F.sum("loss_pct").over(running)
    is_loss = F.col("stage").endswith("loss")
    return loss_steps(log).select(
        "step",
        "stage",
        F.when(F.col("stage") == "theoretical", F.lit(100.0))
        .when(is_loss, F.col("loss_pct"))
        .otherwise(F.col("final_oee"))
        .alias("height_pct"),
        F.when(is_loss, left).otherwise(F.lit(0.0)).alias("base_pct"),
    )


def remaining_after_loss(log: DataFrame) -> DataFrame:
    """What is left of 100 percent after each loss."""
    running = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return (
        loss_steps(log)
        .where(F.col("stage") != "final_oee")
        .select("step", "stage", (100 - F.sum("loss_pct").over(running)).alias("remaining_pct"))
    )


def brand_output(log: DataFrame) -> DataFrame:
    """Output per brand with its share of the total."""
    per_brand = log.groupBy("brand").agg(
        F.sum("actual_qty").alias("actual_qty"),
        F.sum("planned_qty").alias("planned_qty"),
        F.avg("oee_score").alias("avg_oee"),
        F.count(F.lit(1)).alias("rows"),
    )
    return per_brand.withColumn("share_pct", F.col("actual_qty") / F.sum("actual_qty").over(W.partitionBy()) * 100)


def table_profile(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("oee_score").alias("mean_score"),
    )


def annualised(log: DataFrame, target: float = 0.81, baseline: float = 0.76, value_per_unit: float = 12.0):
    """Totals scaled to a year by the span of the dates, with gap and value per line."""
    per_line = oee_by(log, "line_id")
    span = log.agg((F.datediff(F.max("date"), F.min("date")) / F.lit(30.44)).alias("m"))
    months = span.select(F.greatest("m", F.lit(1.0)).alias("m")).scalar()
    line_planned = truncate(F.col("planned") / F.col("months") * 12)
    extra = truncate(line_planned * (target - baseline))
    return per_line.withColumn("months", months).select(
        "line_id",
        round_to(F.col("oee"), 4).alias("current_oee"),
        F.lit(target).alias("target_oee"),
        round_to((target - round_to(F.col("oee"), 4)) * 100, 1).alias("gap_pp"),
        line_planned.alias("annual_planned_qty"),
        truncate(F.col("actual") / F.col("months") * 12).alias("annual_actual_qty"),
        truncate(F.col("defects") / F.col("months") * 12).alias("annual_defects"),
        truncate(F.col("downtime") / F.col("months") * 12).alias("annual_downtime_min"),
        extra.alias("annual_extra_pairs"),
        (extra * value_per_unit).alias("annual_value_eur"),
    )
