"""Defect analysis: Pareto, pivots, trends against output, inspectors, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions import month_label, percent, round_to
from plantmetrics.functions.relational import attach_row
from plantmetrics.functions.selection import hash_of, rows_at

# Severity weights and the order of detection points.
SEVERITY_WEIGHT = {"minor": 1, "major": 2, "critical": 3}
DETECTION_ORDER = ["incoming", "inline", "final", "customer_return"]


def ordinal(value: Column, mapping: dict[str, int]) -> Column:
    """Number of a label; unknown labels give NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, value)


def value_share(df: DataFrame, key: str) -> DataFrame:
    """Count and percent per value; counts are aggregated before the total is taken."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(W.partitionBy()) * 100)


def pareto(df: DataFrame, key: str = "defect_type") -> DataFrame:
    """Counts in falling order with percent and cumulative percent; ties by name."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    ranked = W.orderBy(F.desc("count"), key)
    running = F.sum("count").over(ranked.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("count").over(W.partitionBy())
    return counts.select(
        key,
        "count",
        F.row_number().over(ranked).alias("rank"),
        running.alias("cumulative"),
        round_to(F.col("count") / total * 100, 1).alias("percent"),
        round_to(running / total * 100, 1).alias("cumulative_pct"),
    )


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties by name: at most k rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), key).limit(k)


def keep_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent; the k-row side is small by construction."""
    return df.join(F.broadcast(top_values(df, key, k).select(key)), key, "left_semi")


def ranked_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values with their rank; k rows."""
    return top_values(df, key, k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), key)))


def brand_type_pivot(df: DataFrame, k: int = 5) -> DataFrame:
    """Brand by the k most frequent defect types, one column per rank; absent pairs count 0.

    Pivoting on the rank keeps the column list known in advance, so no job runs to find it.
    """
    ranks = ranked_top(df, "defect_type", k).select("defect_type", "rank")
    cells = df.groupBy("brand", "defect_type").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.join(F.broadcast(ranks), "defect_type").groupBy("brand").pivot("rank", list(range(1, k + 1)))
    counts = wide.agg(F.sum("n")).na.fill(0)
    return counts.select("brand", *[F.col(str(i)).alias(f"top_{i}") for i in range(1, k + 1)])


def monthly_defects(defects: DataFrame) -> DataFrame:
    return defects.groupBy(month_label(F.col("date")).alias("month"), "brand").agg(
        F.count(F.lit(1)).alias("defects")
    )


def monthly_output(log: DataFrame) -> DataFrame:
    return log.groupBy(month_label(F.col("date")).alias("month"), "brand").agg(
        F.sum("actual_qty").alias("production")
    )


def defect_rate_trend(defects: DataFrame, log: DataFrame) -> DataFrame:
    """Defects, output and rate per month and brand, plus an Overall series over the joined rows."""
    joined = monthly_defects(defects).join(monthly_output(log), ["month", "brand"])
    per_series = joined.groupingSets([["month", "brand"], ["month"]], "month", "brand").agg(
        F.sum("defects").alias("defects"), F.sum("production").alias("production")
    )
    return per_series.select(
        "month",
        F.coalesce("brand", F.lit("Overall")).alias("brand"),
        "defects",
        "production",
        round_to(F.col("defects") / F.col("production") * 100, 3).alias("defect_rate_pct"),
    )


def common_months(defects: DataFrame, log: DataFrame) -> DataFrame:
    """Months present on both sides."""
    label = month_label(F.col("date")).alias("month")
    return defects.select(label).intersect(log.select(label))


def monthly_rate(defects: DataFrame, log: DataFrame) -> DataFrame:
    """Overall rate per common month."""
    d = monthly_defects(defects).groupBy("month").agg(F.sum("defects").alias("defects"))
    p = monthly_output(log).groupBy("month").agg(F.sum("production").alias("production"))
    return d.join(p, "month").withColumn("rate_pct", F.col("defects") / F.col("production") * 100)


def moving_average(monthly: DataFrame, value: str = "rate_pct", rows: int = 3) -> DataFrame:
    """Trailing mean over the last ``rows`` months of an aggregated series."""
    frame = W.orderBy("month").rowsBetween(1 - rows, 0)
    return monthly.withColumn("moving_avg", F.avg(value).over(frame))


def inspector_stats(defects: DataFrame) -> DataFrame:
    return defects.groupBy("inspector_id").agg(
        F.count(F.lit(1)).alias("count"), F.avg(ordinal(F.col("severity"), SEVERITY_WEIGHT)).alias("avg_severity")
    )


def in_listed_order(counts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the listed values with their position; values that do not occur are absent."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i + 1)])
    return (
        counts.withColumn("position", F.try_element_at(table, F.col(key)))
        .where(F.col("position").isNotNull())
        .orderBy("position")
    )


def detection_share(defects: DataFrame) -> DataFrame:
    shares = value_share(defects.where(F.col("detection_point").isin(DETECTION_ORDER)), "detection_point")
    return in_listed_order(shares, "detection_point", DETECTION_ORDER)


def brand_rates(defects: DataFrame, log: DataFrame) -> DataFrame:
    """Defect rate per brand for brands present on both sides."""
    d = defects.groupBy("brand").agg(F.count(F.lit(1)).alias("defects"))
    p = log.groupBy("brand").agg(F.sum("actual_qty").alias("production"))
    return d.join(p, "brand").withColumn(
        "defect_rate_pct", round_to(F.col("defects") / F.col("production") * 100, 2)
    )


def qc_summary(defects: DataFrame, log: DataFrame) -> DataFrame:
    """One row: output, defects, rate, the leading type with its share, mean inspection time."""
    by_type = defects.groupBy("defect_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("inspection_time_seconds").alias("seconds")
    )
    leader = F.min(F.struct((-F.col("n")).alias("neg"), F.col("defect_type").alias("type")))
    totals = by_type.agg(
        F.sum("n").alias("total_defects"), F.sum("seconds").alias("seconds"), leader.alias("leader")
    )
    output = log.agg(F.sum("actual_qty").alias("total_inspections"))
    joined = attach_row(totals, output, "o")
    return joined.select(
        F.col("o.total_inspections").alias("total_inspections"),
        "total_defects",
        round_to(percent(F.col("total_defects"), F.col("o.total_inspections")), 2).alias("defect_rate_percent"),
        F.col("leader.type").alias("top_defect_type"),
        (-F.col("leader.neg")).alias("top_defect_count"),
        round_to(percent(-F.col("leader.neg"), F.col("total_defects")), 1).alias("top_defect_percent"),
        round_to(F.col("seconds") / F.col("total_defects"), 1).alias("avg_inspection_time_seconds"),
    )


def expand_by_count(df: DataFrame, count: str, unit: str = "unit") -> DataFrame:
    """One row per counted unit, numbered from 1; rows with count 0 give none."""
    return df.where(F.col(count) > 0).withColumn(unit, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count)


def fixed_sample(df: DataFrame, n: int, key: list[str], seed: int = 42, replace: bool = False) -> DataFrame:
    """Exactly n rows, the same for the same seed.

    Without replacement: the n rows with the smallest key hash, of which a task keeps at most n. With replacement: every draw
    names a position in hash order, and only the buckets of hashes that hold a drawn position are put in order.
    """
    if not replace:
        return df.withColumn("_h", hash_of(key, seed)).orderBy("_h", *key).limit(n).drop("_h")
    size = df.agg(F.count(F.lit(1))).scalar()
    digest = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(number, size).alias("_position"))
    return rows_at(df, key, draws, "_position", seed).drop("_position")
