"""Weekly demand: calendar aggregation with gap filling, feature matrix, forecast calendar and allocation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions import (
    iso_week,
    month_start,
    season_flag,
    week_end,
    weekday0,
)
from plantmetrics.functions.ordered import with_decayed_mean
from plantmetrics.functions.relational import attach_row

# Window lengths in rows of a weekly series, named after the days they stand for.
ROLLING_ROWS = {7: 1, 14: 2, 30: 4}
STD_DAYS = [7, 14]
CI_FACTOR = 1.96

CALENDAR = ["month", "quarter", "day_of_week", "week_of_year", "is_high_season"]
FEATURES = [
    *CALENDAR, "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", "rolling_mean_30",
    "lag_7", "lag_14", "lag_30", "trend", "ewm_mean_7",
]


def period_label(day: Column, freq: str) -> Column:
    return week_end(day) if freq == "W" else F.last_day(month_start(day))


def spine(log: DataFrame, freq: str = "W") -> DataFrame:
    """Every period between the first and the last date, as one column ``date``."""
    span = log.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    if freq == "W":
        steps = F.sequence(week_end(F.col("a")), week_end(F.col("b")), F.expr("interval 7 days"))
        return span.select(F.explode(steps).alias("date"))
    steps = F.sequence(month_start(F.col("a")), month_start(F.col("b")), F.expr("interval 1 month"))
    return span.select(F.explode(steps).alias("m")).select(F.last_day("m").alias("date"))


def demand_total(log: DataFrame, freq: str = "W", series: str = "all") -> DataFrame:
    """Output per period; periods without rows count 0."""
    sums = log.groupBy(period_label(F.col("date"), freq).alias("date")).agg(F.sum("actual_qty").alias("demand"))
    return (
        spine(log, freq)
        .join(sums, "date", "left")
        .select(F.lit(series).alias("series"), "date", F.coalesce("demand", F.lit(0)).cast("bigint").alias("demand"))
    )


def demand_by_brand(log: DataFrame, freq: str = "W") -> DataFrame:
    """Long form: one row per brand and period, aligned over all brands, gaps 0."""
    sums = log.groupBy("brand", period_label(F.col("date"), freq).alias("date")).agg(
        F.sum("actual_qty").alias("demand")
    )
    dates = spine(log, freq).agg(F.sort_array(F.collect_set("date")).alias("dates"))
    brands = sums.select("brand").distinct()
    grid = attach_row(brands, dates, "s").select("brand", F.explode("s.dates").alias("date"))
    return grid.join(sums, ["brand", "date"], "left").select(
        F.col("brand").alias("series"), "date", F.coalesce("demand", F.lit(0)).cast("bigint").alias("demand")
    )


def demand_wide(long: DataFrame, brands: Sequence[str]) -> DataFrame:
    """One column per brand."""
    return long.groupBy("date").pivot("series", list(brands)).agg(F.sum("demand")).na.fill(0)


def seasonality(log: DataFrame) -> DataFrame:
    """Mean output by month of the year and by weekday, in one pass."""
    frame = log.select(F.month("date").alias("month"), weekday0(F.col("date")).alias("weekday"), "actual_qty")
    means = frame.groupingSets([["month"], ["weekday"]], "month", "weekday").agg(
        F.avg("actual_qty").alias("mean_output")
    )
    return means.select(
        F.when(F.col("month").isNotNull(), "month").otherwise("weekday").alias("dimension"),
        F.coalesce("month", "weekday").alias("position"),
        "mean_output",
    )


def _by_series() -> W:
    return W.partitionBy("series").orderBy("date")


def with_calendar(weekly: DataFrame) -> DataFrame:
    day = F.col("date")
    return weekly.withColumns(
        {
            "month": F.month(day),
            "quarter": F.quarter(day),
            "day_of_week": weekday0(day),
            "week_of_year": iso_week(day),
            "is_high_season": season_flag(day),
        }
    )


def with_rolling(weekly: DataFrame, leak_free: bool = False) -> DataFrame:
    """Trailing means and sample deviations; ``leak_free`` ends every window at the row before."""
    end = -1 if leak_free else 0
    columns = {}
    for days, rows in ROLLING_ROWS.items():
        frame = _by_series().rowsBetween(end - rows + 1, end)
        columns[f"rolling_mean_{days}"] = F.avg("demand").over(frame)
        if days in STD_DAYS:
            columns[f"rolling_std_{days}"] = F.coalesce(F.stddev_samp("demand").over(frame), F.lit(0.0))
    return weekly.withColumns(columns)


def with_lags(weekly: DataFrame) -> DataFrame:
    return weekly.withColumns(
        {f"lag_{days}": F.lag("demand", rows).over(_by_series()) for days, rows in ROLLING_ROWS.items()}
    )


def with_trend(weekly: DataFrame) -> DataFrame:
    return weekly.withColumn("trend", F.row_number().over(_by_series()) - 1)


def with_ewm(weekly: DataFrame, span: int = 1, name: str = "ewm_mean_7", leak_free: bool = False) -> DataFrame:
    """Exponentially weighted mean with weights (1 - 2/(span+1))^age over all rows so far.

    With span 1 only the row itself (``leak_free``: the one before) has a weight. Otherwise the sums run along the rows in range
    partitions and are handed on from one to the next, so a series may have any length.
    """
    keep = 1.0 - 2.0 / (span + 1)
    if keep <= 0:
        demand = F.col("demand").cast("double")
        return weekly.withColumn(name, F.lag(demand).over(_by_series()) if leak_free else demand)
    return with_decayed_mean(weekly, ["series"], ["date"], "demand", keep, name, before=leak_free)


def backfill(weekly: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULL by the next value of the series that is not NULL."""
    ahead = _by_series().rowsBetween(0, W.unboundedFollowing)
    return weekly.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in columns})


def feature_matrix(weekly: DataFrame, leak_free: bool = False) -> DataFrame:
    """Fifteen features per series and week.

    By default the one-row windows equal the target itself; ``leak_free=True`` ends all windows one row
    earlier, for models that must not see the week they predict.
    """
    frame = with_ewm(with_trend(with_lags(with_rolling(with_calendar(weekly), leak_free))), leak_free=leak_free)
    late = ["rolling_mean_7", "rolling_mean_14", "rolling_mean_30", "ewm_mean_7"] if leak_free else []
    return backfill(frame, ["lag_7", "lag_14", "lag_30", *late]).select("series", "date", "demand", *FEATURES)


def split_time(weekly: DataFrame, ratio: float = 0.80) -> DataFrame:
    """Mark the first floor(ratio * n) rows of each series, in date order, as training rows."""
    n = F.count(F.lit(1)).over(W.partitionBy("series"))
    position = F.row_number().over(_by_series())
    return weekly.withColumn("is_train", position <= F.floor(n * ratio))


def brand_week_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("series").agg(
        F.avg("demand").alias("weekly_avg"), F.stddev_samp("demand").alias("weekly_std")
    )


def future_weeks(weekly: DataFrame, horizon_days: int = 30) -> DataFrame:
    """The next max(days // 7, 1) Sundays after the last week of each series."""
    weeks = max(horizon_days // 7, 1)
    last = weekly.groupBy("series").agg(F.max("date").alias("last"))
    steps = F.sequence(F.date_add("last", 7), F.date_add("last", 7 * weeks), F.expr("interval 7 days"))
    return last.select("series", F.posexplode(steps).alias("step", "date"))


def future_features(features: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Feature rows for future weeks: calendar anew, trend advanced, all else carried from the last row."""
    carried = [c for c in FEATURES if c not in CALENDAR and c != "trend"]
    last = features.groupBy("series").agg(
        F.max_by(F.struct("trend", *carried), "date").alias("row"), F.max("date").alias("last_date")
    )
    weeks = future_weeks(features, horizon_days)
    frame = with_calendar(weeks.join(last, "series"))
    return frame.select(
        "series",
        "date",
        *CALENDAR,
        *[F.col(f"row.{c}").alias(c) for c in carried],
        (F.col("row.trend") + F.col("step") + 1).alias("trend"),
    )


def with_band(forecast: DataFrame, training: DataFrame, value: str = "forecast") -> DataFrame:
    """Add value -/+ 1.96 deviations of the training demand of the series."""
    spread = training.groupBy("series").agg(F.stddev_samp("demand").alias("_std"))
    margin = CI_FACTOR * F.col("_std")
    return (
        forecast.join(spread, "series")
        .withColumn("lower_bound", F.col(value) - margin)
        .withColumn("upper_bound", F.col(value) + margin)
        .drop("_std")
    )


def allocate_to_brands(forecast: DataFrame, long: DataFrame, value: str = "forecast") -> DataFrame:
    """Brand forecast: the total forecast times the brand's share of past demand.

    The forecast holds one row per future week, so it travels as an array next to each brand.
    """
    per_brand = long.groupBy("series").agg(F.sum("demand").alias("brand_demand"))
    shares = per_brand.select(
        F.col("series").alias("brand"),
        (F.col("brand_demand") / F.sum("brand_demand").over(W.partitionBy())).alias("share"),
    )
    weeks = forecast.agg(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))).alias("weeks"))
    return (
        attach_row(shares, weeks, "f")
        .select("brand", "share", F.explode("f.weeks").alias("w"))
        .select("brand", F.col("w.date").alias("date"), (F.col("w.v") * F.col("share")).alias(value))
    )
