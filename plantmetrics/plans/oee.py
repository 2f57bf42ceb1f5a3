"""Queries on the production log: scans, effectiveness, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import clip, round_to, safe_div
from plantmetrics.functions.relational import with_trailing
from plantmetrics.operators import oee
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, clip01, div, pct, r

LOG_COLUMNS = [
    "date", "shift", "line_id", "brand", "model_name", "planned_qty", "actual_qty", "defect_qty",
    "downtime_minutes", "changeover_minutes", "operator_count", "machine_id",
]

SUMS = """count(*) AS shifts, sum(planned_qty) AS planned, sum(actual_qty) AS actual, sum(defect_qty) AS defects,
          sum(downtime_minutes) AS downtime, sum(changeover_minutes) AS changeover"""


def ratios(keys: str, source: str = "production_log") -> str:
    """Keys, sums, unrounded ratios."""
    return f"""
        SELECT *, availability * performance * quality AS oee FROM (
            SELECT *, {clip01("CAST(shifts * 480 - downtime - changeover AS DOUBLE) / (shifts * 480)")} AS availability,
                   {clip01(div("actual", "planned"))} AS performance,
                   {clip01(div("actual - defects", "actual"))} AS quality
            FROM (SELECT {keys}, {SUMS} FROM {source} GROUP BY ALL))"""


LINE_MONTH = ratios("line_id, CAST(date_trunc('month', date) AS DATE) AS period")
LINE_WEEK = ratios("line_id, CAST(date_trunc('week', date) AS DATE) + 6 AS period")
ROUNDED = ", ".join(f"{r(c, 4)} AS {c}" for c in oee.RATIOS)
MONTHLY = f"SELECT line_id, period, {ROUNDED} FROM ({LINE_MONTH})"
BENCHMARK = f"""
    SELECT *, CAST(row_number() OVER (ORDER BY avg_oee DESC, line_id) AS INT) AS rank FROM (
        SELECT line_id, {r("oee", 4)} AS avg_oee, {r("availability", 4)} AS availability,
               {r("performance", 4)} AS performance, {r("quality", 4)} AS quality,
               CASE WHEN availability >= performance AND availability >= quality THEN 'availability'
                    WHEN performance >= quality THEN 'performance' ELSE 'quality' END AS best_metric,
               CASE WHEN availability <= performance AND availability <= quality THEN 'availability'
                    WHEN performance <= quality THEN 'performance' ELSE 'quality' END AS worst_metric
        FROM ({ratios("line_id")}))"""
TREND = "CASE WHEN {0} > 0.01 THEN 'improving' WHEN {0} < -0.01 THEN 'declining' ELSE 'stable' END"


@query("scan_production", f"SELECT {', '.join(LOG_COLUMNS)}, {r('oee_score', 6)} AS oee_score FROM production_log")
def scan_production(t):
    return t.production_log.select(*LOG_COLUMNS, round_to(F.col("oee_score"), 6).alias("oee_score"))


@query("oee_line_period", MONTHLY)
def oee_line_period(t):
    return oee.oee_line_period(t.production_log)


@query("oee_line_period_weekly", f"SELECT line_id, period, {ROUNDED} FROM ({LINE_WEEK})")
def oee_line_period_weekly(t):
    return oee.oee_line_period(t.production_log, "weekly")


@query("oee_benchmark", BENCHMARK)
def oee_benchmark(t):
    return oee.benchmark(t.production_log)


@query("win_rank_line", f"SELECT line_id, avg_oee, rank FROM ({BENCHMARK})")
def win_rank_line(t):
    return oee.benchmark(t.production_log).select("line_id", "avg_oee", "rank")


@query(
    "best_worst_line",
    f"""WITH b AS ({BENCHMARK})
    SELECT (SELECT line_id FROM b ORDER BY avg_oee DESC, line_id LIMIT 1) AS best, max(avg_oee) AS best_value,
           (SELECT line_id FROM b ORDER BY avg_oee, line_id LIMIT 1) AS worst, min(avg_oee) AS worst_value FROM b""",
)
def best_worst_line(t):
    return oee.best_worst(oee.benchmark(t.production_log))


@query("oee_line_brand", f"SELECT line_id, brand, {r('oee', 6)} AS oee FROM ({ratios('line_id, brand')})")
def oee_line_brand(t):
    return oee.oee_by(t.production_log, "line_id", "brand").select(
        "line_id", "brand", round_to(F.col("oee"), 6).alias("oee")
    )


@query(
    "line_capacity",
    "SELECT line_id, CAST(trunc(avg(actual_qty)) AS BIGINT) AS capacity FROM production_log GROUP BY line_id",
)
def line_capacity(t):
    return oee.line_capacity(t.production_log)


@query(
    "six_big_losses",
    f"""
    WITH s AS (SELECT line_id, {SUMS} FROM production_log GROUP BY line_id),
    c AS (SELECT *, {div("shifts * 480 - downtime - changeover", "planned")} AS cycle FROM s),
    l AS (SELECT *, CAST(trunc((planned - actual) * cycle * 0.6) AS BIGINT) AS speed_loss_min,
                 CAST(trunc((planned - actual) * cycle * CAST(0.4 AS DOUBLE)) AS BIGINT) AS minor_stops_min,
                 CAST(trunc(defects * CAST(0.15 AS DOUBLE)) AS BIGINT) AS startup_rejects_units FROM c)
    SELECT line_id, {big("downtime")} AS breakdowns_min, {big("changeover")} AS setup_changeover_min, minor_stops_min,
           speed_loss_min, {big("defects - startup_rejects_units")} AS defects_units, startup_rejects_units,
           {big("downtime + changeover + speed_loss_min + minor_stops_min")} AS total_loss_minutes,
           {big("planned")} AS theoretical_output, {big("actual")} AS actual_output
    FROM l""",
)
def six_big_losses(t):
    return oee.six_big_losses(t.production_log)


LOSS_STEPS = f"""
    SELECT unnest([1, 2, 3, 4, 5]) AS step,
           unnest(['theoretical', 'availability_loss', 'performance_loss', 'quality_loss', 'final_oee']) AS stage,
           unnest([0.0, a, p, q, 0.0]) AS loss_pct,
           (1 - a / 100) * (1 - p / 100) * (1 - q / 100) * 100 AS final_oee
    FROM (SELECT CAST(downtime + changeover AS DOUBLE) / (shifts * 480) * 100 AS a,
                 CASE WHEN planned > 0 THEN (1 - CAST(actual AS DOUBLE) / planned) * 100 ELSE 0.0 END AS p,
                 {pct("defects", "actual")} AS q
          FROM (SELECT {SUMS} FROM production_log))"""


@query(
    "loss_waterfall",
    f"""
    SELECT step, stage,
           {r("CASE WHEN step = 1 THEN 100.0 WHEN step = 5 THEN final_oee ELSE loss_pct END", 6)} AS height_pct,
           {r("CASE WHEN step IN (1, 5) THEN 0.0 ELSE 100 - sum(loss_pct) OVER (ORDER BY step) END", 6)} AS base_pct
    FROM ({LOSS_STEPS})""",
)
def loss_waterfall(t):
    return oee.loss_waterfall(t.production_log).select(
        "step", "stage", *[round_to(F.col(c), 6).alias(c) for c in ("height_pct", "base_pct")]
    )


@query(
    "win_waterfall",
    f"""SELECT step, stage, {r("100 - sum(loss_pct) OVER (ORDER BY step)", 6)} AS remaining_pct
        FROM ({LOSS_STEPS}) WHERE step < 5""",
)
def win_waterfall(t):
    return oee.remaining_after_loss(t.production_log).withColumn("remaining_pct", round_to(F.col("remaining_pct"), 6))


@query(
    "win_current_vs_prev",
    f"""
    SELECT line_id, period, availability, performance, quality, oee, previous_oee,
           {TREND.format("(oee - previous_oee)")} AS trend
    FROM (SELECT *, coalesce(lag(oee) OVER (PARTITION BY line_id ORDER BY period), oee) AS previous_oee,
                 row_number() OVER (PARTITION BY line_id ORDER BY period DESC) AS rn FROM ({MONTHLY}))
    WHERE rn = 1""",
)
def win_current_vs_prev(t):
    return oee.current_oee(oee.oee_line_period(t.production_log))


@query("line_avg_align", f"SELECT period, {r('avg(oee)', 6)} AS avg_oee FROM ({MONTHLY}) GROUP BY period")
def line_avg_align(t):
    frame = oee.line_average(oee.oee_line_period(t.production_log))
    return frame.withColumn("avg_oee", round_to(F.col("avg_oee"), 6))


@query(
    "brand_output_stats",
    f"""
    SELECT brand, actual_qty, planned_qty, avg_oee, rows,
           {r("CAST(actual_qty AS DOUBLE) / sum(actual_qty) OVER () * 100", 6)} AS share_pct
    FROM (SELECT brand, {big("sum(actual_qty)")} AS actual_qty, {big("sum(planned_qty)")} AS planned_qty,
                 {r("avg(oee_score)", 6)} AS avg_oee, count(*) AS rows FROM production_log GROUP BY brand)""",
)
def brand_output_stats(t):
    return (
        oee.brand_output(t.production_log)
        .withColumn("avg_oee", round_to(F.col("avg_oee"), 6))
        .withColumn("share_pct", round_to(F.col("share_pct"), 6))
    )


@query(
    "win_share",
    f"""SELECT brand, {r("CAST(q AS DOUBLE) / sum(q) OVER () * 100", 6)} AS share_pct
        FROM (SELECT brand, sum(actual_qty) AS q FROM production_log GROUP BY brand)""",
)
def win_share(t):
    return oee.brand_output(t.production_log).select("brand", round_to(F.col("share_pct"), 6).alias("share_pct"))


@query(
    "table_profile",
    f"""SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date,
               {r("avg(oee_score)", 6)} AS mean_score FROM production_log""",
)
def table_profile(t):
    return oee.table_profile(t.production_log).withColumn("mean_score", round_to(F.col("mean_score"), 6))


@query(
    "annualise",
    f"""
    WITH m AS (SELECT greatest(CAST(date_diff('day', min(date), max(date)) AS DOUBLE) / 30.44, 1.0) AS months
               FROM production_log),
    p AS (SELECT *, {r("oee", 4)} AS o, CAST(trunc(CAST(planned AS DOUBLE) / months * 12) AS BIGINT) AS lp
          FROM ({ratios("line_id")}), m),
    e AS (SELECT *, CAST(trunc(lp * (CAST(0.81 AS DOUBLE) - CAST(0.76 AS DOUBLE))) AS BIGINT) AS extra FROM p)
    SELECT line_id, o AS current_oee, CAST(0.81 AS DOUBLE) AS target_oee,
           {r("(CAST(0.81 AS DOUBLE) - o) * 100", 1)} AS gap_pp, lp AS annual_planned_qty,
           CAST(trunc(CAST(actual AS DOUBLE) / months * 12) AS BIGINT) AS annual_actual_qty,
           CAST(trunc(CAST(defects AS DOUBLE) / months * 12) AS BIGINT) AS annual_defects,
           CAST(trunc(CAST(downtime AS DOUBLE) / months * 12) AS BIGINT) AS annual_downtime_min,
           extra AS annual_extra_pairs, extra * CAST(12.0 AS DOUBLE) AS annual_value_eur
    FROM e""",
)
def annualise(t):
    return oee.annualised(t.production_log)


@query(
    "filter_key",
    "SELECT date, shift, line_id, actual_qty, k1, k2, k3, k4 FROM production_log WHERE line_id = 'L3'",
)
def filter_key(t):
    return t.production_log.where(F.col("line_id") == "L3").select(
        "date", "shift", "line_id", "actual_qty", "k1", "k2", "k3", "k4"
    )


@query(
    "filter_positive",
    "SELECT date, line_id, brand, defect_qty, k1, k2, k3, k4 FROM production_log WHERE defect_qty > 0",
)
def filter_positive(t):
    return t.production_log.where(F.col("defect_qty") > 0).select(
        "date", "line_id", "brand", "defect_qty", "k1", "k2", "k3", "k4"
    )


@query(
    "expand_by_count",
    """SELECT line_id, brand, unit, count(*) AS n FROM (
           SELECT line_id, brand, unnest(generate_series(1, defect_qty)) AS unit FROM production_log WHERE defect_qty > 0)
       GROUP BY ALL""",
)
def expand_by_count(t):
    from plantmetrics.operators.quality import expand_by_count as expand

    units = expand(t.production_log.select("line_id", "brand", "defect_qty"), "defect_qty", "unit")
    return units.withColumn("unit", F.col("unit").cast("bigint")).groupBy("line_id", "brand", "unit").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "safe_ratio",
    f"SELECT k1, k2, k3, k4, {r(div('defect_qty', 'actual_qty'), 6)} AS defect_rate FROM production_log",
)
def safe_ratio(t):
    rate = safe_div(F.col("defect_qty"), F.col("actual_qty"))
    return t.production_log.select("k1", "k2", "k3", "k4", round_to(rate, 6).alias("defect_rate"))


@query(
    "clip01",
    f"""SELECT k1, k2, k3, k4, {r(clip01("CAST(480 - downtime_minutes * 2 - changeover_minutes AS DOUBLE) / 480"), 6)}
        AS availability FROM production_log""",
)
def clip01_rows(t):
    minutes = 480 - F.col("downtime_minutes") * 2 - F.col("changeover_minutes")
    return t.production_log.select("k1", "k2", "k3", "k4", round_to(clip(minutes / 480, 0.0, 1.0), 6).alias("availability"))


@query(
    "trend_label",
    f"""SELECT line_id, period, {TREND.format("change")} AS trend FROM (
           SELECT line_id, period, oee - lag(oee, 1, oee) OVER (PARTITION BY line_id ORDER BY period) AS change
           FROM ({MONTHLY}))""",
)
def trend_labels(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("line_id").orderBy("period")
    monthly = oee.oee_line_period(t.production_log)
    change = F.col("oee") - F.coalesce(F.lag("oee").over(order), F.col("oee"))
    return monthly.select("line_id", "period", oee.trend_label(change).alias("trend"))


@query(
    "win_rolling_downtime",
    f"""SELECT k1, k2, k3, k4, date, {r('''avg(downtime_minutes) OVER (PARTITION BY line_id
              ORDER BY date, shift, k1, k2, k3, k4 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)''', 6)} AS rolling_avg_downtime
        FROM production_log""",
)
def win_rolling_downtime(t):
    rolled = with_trailing(
        t.production_log.select("line_id", "date", "shift", "downtime_minutes", "k1", "k2", "k3", "k4"),
        ["line_id"],
        ["date", "shift", "k1", "k2", "k3", "k4"],
        "downtime_minutes",
        7,
        "rolling",
    )
    return rolled.select("k1", "k2", "k3", "k4", "date", round_to(F.col("rolling"), 6).alias("rolling_avg_downtime"))


@query("distinct_keys", "SELECT DISTINCT line_id, brand FROM production_log")
def distinct_keys(t):
    return t.production_log.select("line_id", "brand").distinct().orderBy("line_id", "brand")


@query(
    "date_calendar",
    """SELECT DISTINCT date, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
              CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(weekofyear(date) AS INT) AS week_of_year
       FROM production_log""",
)
def date_calendar(t):
    from plantmetrics.functions import iso_week, weekday0

    day = F.col("date")
    return t.production_log.select(
        "date",
        F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
        weekday0(day).alias("day_of_week"),
        iso_week(day).alias("week_of_year"),
    ).distinct()


@query("date_month_period", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM production_log GROUP BY 1")
def date_month_period(t):
    from plantmetrics.functions import month_label

    return t.production_log.groupBy(month_label(F.col("date")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_business_days",
    """SELECT d AS date FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d
           FROM (SELECT CAST(min(date) AS TIMESTAMP) AS a, CAST(max(date) AS TIMESTAMP) AS b FROM production_log))
       WHERE isodow(d) <= 5""",
)
def date_business_days(t):
    from plantmetrics.functions import is_business_day

    span = t.production_log.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    return days.where(is_business_day(F.col("date")))


@query(
    "season_flag",
    """SELECT DISTINCT date, CAST(month(date) IN (3, 4, 5, 6, 9, 10, 11) AS INT) AS is_high_season FROM production_log""",
)
def season_flags(t):
    from plantmetrics.functions import season_flag

    return t.production_log.select("date", season_flag(F.col("date")).alias("is_high_season")).distinct()
