"""Queries on weekly demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import demand
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, r
from plantmetrics.sources.star import BRANDS

WEEK = "CAST(date_trunc('week', date) AS DATE) + 6"
SPINE = f"""SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS date
            FROM (SELECT min({WEEK}) AS a, max({WEEK}) AS b FROM production_log)"""
TOTAL = f"""SELECT 'all' AS series, date, CAST(coalesce(d, 0) AS BIGINT) AS demand FROM ({SPINE})
            LEFT JOIN (SELECT {WEEK} AS date, sum(actual_qty) AS d FROM production_log GROUP BY 1) USING (date)"""
BY_BRAND = f"""SELECT series, date, CAST(coalesce(d, 0) AS BIGINT) AS demand
            FROM ({SPINE}) CROSS JOIN (SELECT DISTINCT brand AS series FROM production_log)
            LEFT JOIN (SELECT brand AS series, {WEEK} AS date, sum(actual_qty) AS d FROM production_log GROUP BY 1, 2)
            USING (series, date)"""
VIEWS = {"weekly_total": TOTAL, "weekly_brand": BY_BRAND}
OVER = "OVER (PARTITION BY series ORDER BY date {})"


def rows(k: int) -> str:
    return OVER.format(f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW")


MONTHLY_SPINE = """SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE))
            AS date FROM (SELECT CAST(min(date) AS TIMESTAMP) AS a, CAST(max(date) AS TIMESTAMP) AS b FROM production_log)"""
ROLLING = f"""{r(f"avg(demand) {rows(1)}", 6)} AS rolling_mean_7, {r(f"avg(demand) {rows(2)}", 6)} AS rolling_mean_14,
    {r(f"avg(demand) {rows(4)}", 6)} AS rolling_mean_30,
    {r(f"coalesce(stddev_samp(demand) {rows(1)}, 0.0)", 6)} AS rolling_std_7,
    {r(f"coalesce(stddev_samp(demand) {rows(2)}, 0.0)", 6)} AS rolling_std_14"""
LAGS = ", ".join(f"lag(demand, {k}) {OVER.format('')} AS lag_{d}" for d, k in ((7, 1), (14, 2), (30, 4)))
TREND = f"CAST(row_number() {OVER.format('')} - 1 AS INT) AS trend"
CALENDAR = """CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(isodow(date) - 1 AS INT) AS day_of_week,
    CAST(weekofyear(date) AS INT) AS week_of_year, CAST(month(date) IN (3, 4, 5, 6, 9, 10, 11) AS INT) AS is_high_season"""


def filled(column: str) -> str:
    frame = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"first_value({column} IGNORE NULLS) {OVER.format(frame)} AS {column}"


def both(t):
    """Total and brand series in one frame."""
    return demand.demand_total(t.production_log).unionByName(demand.demand_by_brand(t.production_log))


BOTH = "SELECT * FROM weekly_total UNION ALL SELECT * FROM weekly_brand"
VIEWS["weekly_both"] = BOTH
ROLLED = ["rolling_mean_7", "rolling_mean_14", "rolling_mean_30", "rolling_std_7", "rolling_std_14"]


def rounded(frame, columns, digits=6):
    return frame.withColumns({c: round_to(F.col(c), digits) for c in columns})


@query("weekly_demand", "SELECT date, demand FROM weekly_total", VIEWS)
def weekly_demand(t):
    return demand.demand_total(t.production_log).select("date", "demand")


@query(
    "monthly_demand",
    f"""SELECT date, CAST(coalesce(d, 0) AS BIGINT) AS demand FROM ({MONTHLY_SPINE})
        LEFT JOIN (SELECT last_day(date) AS date, sum(actual_qty) AS d FROM production_log GROUP BY 1) USING (date)""",
)
def monthly_demand(t):
    return demand.demand_total(t.production_log, "M").select("date", "demand")


WIDE = ", ".join(f"{big(f'sum(demand) FILTER (WHERE series = {chr(39)}{b}{chr(39)})')} AS {b}" for b in BRANDS)


@query("weekly_demand_brand", f"SELECT date, {WIDE} FROM weekly_brand GROUP BY date", VIEWS)
def weekly_demand_brand(t):
    return demand.demand_wide(demand.demand_by_brand(t.production_log), BRANDS)


@query("brand_outer_align", "SELECT series, date, demand FROM weekly_brand", VIEWS)
def brand_outer_align(t):
    return demand.demand_by_brand(t.production_log)


@query(
    "seasonality",
    f"""SELECT 'month' AS dimension, CAST(month(date) AS INT) AS position, {r("avg(actual_qty)", 6)} AS mean_output
        FROM production_log GROUP BY 2
        UNION ALL SELECT 'weekday', CAST(isodow(date) - 1 AS INT), {r("avg(actual_qty)", 6)} FROM production_log GROUP BY 2""",
)
def seasonality(t):
    return rounded(demand.seasonality(t.production_log), ["mean_output"])


@query("win_rolling_demand", f"SELECT series, date, {ROLLING} FROM weekly_both", VIEWS)
def win_rolling_demand(t):
    return rounded(demand.with_rolling(both(t)), ROLLED).select("series", "date", *ROLLED)


@query("win_lag", f"SELECT series, date, {LAGS} FROM weekly_both", VIEWS)
def win_lag(t):
    return demand.with_lags(both(t)).drop("demand")


@query("win_trend_index", f"SELECT series, date, {TREND} FROM weekly_both", VIEWS)
def win_trend_index(t):
    return demand.with_trend(both(t)).drop("demand")


@query(
    "win_backfill",
    f"""SELECT series, date, {", ".join(filled(f"lag_{d}") for d in (7, 14, 30))} FROM (SELECT series, date, {LAGS} FROM weekly_both)""",
    VIEWS,
)
def win_backfill(t):
    lagged = demand.with_lags(both(t)).drop("demand")
    return demand.backfill(lagged, ["lag_7", "lag_14", "lag_30"])


@query(
    "win_ewm",
    f"""WITH i AS (SELECT *, row_number() {OVER.format('')} AS rn FROM weekly_both)
        SELECT a.series, a.date, {r("sum(b.demand * pow(0.5, a.rn - b.rn)) / sum(pow(0.5, a.rn - b.rn))", 6)} AS ewm
        FROM i a JOIN i b ON a.series = b.series AND b.rn <= a.rn GROUP BY a.series, a.date""",
    VIEWS,
)
def win_ewm(t):
    return rounded(demand.with_ewm(both(t), span=3, name="ewm").drop("demand"), ["ewm"])


FEATURE_SQL = f"""
    SELECT series, date, demand, month, quarter, day_of_week, week_of_year, is_high_season,
           rolling_mean_7, rolling_std_7, rolling_mean_14, rolling_std_14, rolling_mean_30,
           {", ".join(filled(f"lag_{d}") for d in (7, 14, 30))}, trend, CAST(demand AS DOUBLE) AS ewm_mean_7
    FROM (SELECT *, {CALENDAR}, {ROLLING}, {LAGS}, {TREND} FROM weekly_both)"""


@query("feature_matrix", FEATURE_SQL, VIEWS)
def feature_matrix(t):
    return rounded(demand.feature_matrix(both(t)), [*ROLLED, "ewm_mean_7"])


@query(
    "feature_matrix_leak_free",
    f"""SELECT series, date, {filled("m7")}, {filled("m14")}, {filled("m30")} FROM (
        SELECT series, date, {r("avg(demand) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)", 6)} AS m7,
               {r("avg(demand) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)", 6)} AS m14,
               {r("avg(demand) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)", 6)} AS m30
        FROM weekly_both)""",
    VIEWS,
)
def feature_matrix_leak_free(t):
    frame = demand.feature_matrix(both(t), leak_free=True)
    return frame.select(
        "series", "date", *[round_to(F.col(f"rolling_mean_{d}"), 6).alias(f"m{d}") for d in (7, 14, 30)]
    )


@query(
    "win_split_80",
    f"""SELECT series, date, row_number() {OVER.format('')} <= floor(0.8 * count(*) OVER (PARTITION BY series)) AS is_train
        FROM weekly_both""",
    VIEWS,
)
def win_split_80(t):
    return demand.split_time(both(t)).drop("demand")


@query(
    "brand_week_stats",
    f"""SELECT series, {r("avg(demand)", 6)} AS weekly_avg, {r("stddev_samp(demand)", 6)} AS weekly_std
        FROM weekly_brand GROUP BY series""",
    VIEWS,
)
def brand_week_stats(t):
    return rounded(demand.brand_week_stats(demand.demand_by_brand(t.production_log)), ["weekly_avg", "weekly_std"])


@query(
    "date_future_weeks",
    """SELECT series, CAST(i AS INT) AS step, CAST(last + 7 * (i + 1) AS DATE) AS date
       FROM (SELECT series, CAST(max(date) AS DATE) AS last FROM weekly_both GROUP BY 1), (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS i)""",
    VIEWS,
)
def date_future_weeks(t):
    return demand.future_weeks(both(t), 30)


# A forecast that SQL can state too: the mean of the training weeks, carried forward.
TRAIN = f"""SELECT * FROM (SELECT *, row_number() {OVER.format('')} <= floor(0.8 * count(*) OVER (PARTITION BY series)) AS is_train
            FROM weekly_both) WHERE is_train"""
VIEWS["training_weeks"] = TRAIN


def mean_forecast(t):
    series = both(t)
    training = demand.split_time(series).where("is_train").select("series", "date", "demand")
    level = training.groupBy("series").agg(F.avg("demand").alias("forecast"))
    return demand.future_weeks(series, 30).join(level, "series").select("series", "date", "forecast"), training


FORECAST = """SELECT series, CAST(last + 7 * (i + 1) AS DATE) AS date, forecast, std
    FROM (SELECT series, CAST(max(date) AS DATE) AS last FROM weekly_both GROUP BY 1)
    JOIN (SELECT series, avg(demand) AS forecast, stddev_samp(demand) AS std FROM training_weeks GROUP BY 1) USING (series),
    (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS i)"""


@query(
    "math_ci_band",
    f"""SELECT series, date, {r("forecast", 6)} AS forecast, {r("forecast - 1.96 * std", 6)} AS lower_bound,
               {r("forecast + 1.96 * std", 6)} AS upper_bound FROM ({FORECAST})""",
    VIEWS,
)
def math_ci_band(t):
    forecast, training = mean_forecast(t)
    return rounded(demand.with_band(forecast, training), ["forecast", "lower_bound", "upper_bound"])


@query(
    "brand_alloc",
    f"""SELECT brand, date, {r("forecast * share", 6)} AS forecast FROM ({FORECAST}),
        (SELECT series AS brand, CAST(sum(demand) AS DOUBLE) / (SELECT sum(demand) FROM weekly_brand) AS share
         FROM weekly_brand GROUP BY 1) WHERE series = 'all'""",
    VIEWS,
)
def brand_alloc(t):
    forecast, _ = mean_forecast(t)
    total = forecast.where(F.col("series") == "all")
    return rounded(demand.allocate_to_brands(total, demand.demand_by_brand(t.production_log)), ["forecast"])
