"""Cost facts from the tables and the return on a list of programmes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.functions.relational import attach_row
from plantmetrics.lookups import values_sql

# Unit costs and reductions of the quality programme, shares of the trade programme.
UNIT_COST = {"scrap": 8.0, "rework": 3.5, "return": 18.0}
REDUCTION = {"scrap": 0.25, "rework": 0.15, "return": 0.30}
INSPECTION_SALARY_SAVING = (15 - 6) * 1200.0 * 12
TRADE_SALARY_SAVING = (2 - 1) * 1800.0 * 12
ERROR_SAVING = round(25_000 * (1 - 0.02 / 0.03), 2)
AGREEMENT_SHARE = 0.03
PENALTY_AVOIDED = (50_000 + 100_000) / 2
PORTFOLIO_INVESTMENT = 142_000.0
# programme, variant, gross saving, running cost, investment, saving of the third year only
FIXED_PROGRAMMES = [
    ("knowledge", "running_by_gross", 32431.2, 12_000.0, 0.0, 0.0),
    ("demand", "investment_by_net", 147_000.0, 0.0, 20_000.0, 0.0),
    ("effectiveness", "investment_by_net", 198_000.0, 0.0, 22_000.0, 0.0),
    ("reporting", "running_by_gross_single", 60_571.0, 8_000.0, 0.0, 0.0),
]


def qc_cost_facts(defects: DataFrame, log: DataFrame) -> DataFrame:
    """Counts, costs and savings of scrap, rework and customer returns, one row."""
    counts = defects.agg(
        F.count(F.lit(1)).alias("total_defects"),
        F.count_if(F.col("action") == "scrap").alias("scrap"),
        F.count_if(F.col("action") == "rework").alias("rework"),
        F.count_if(F.col("detection_point") == "customer_return").alias("return"),
    )
    row = attach_row(counts, log.agg(F.sum("actual_qty").alias("pairs")), "o")
    cost = {k: F.col(k) * c for k, c in UNIT_COST.items()}
    saving = sum((cost[k] * REDUCTION[k] for k in UNIT_COST), F.lit(0.0))
    return row.select(
        F.col("o.pairs").alias("total_pairs"),
        "total_defects",
        *[F.col(k).alias(f"{k}_count") for k in UNIT_COST],
        *[cost[k].alias(f"{k}_cost") for k in UNIT_COST],
        saving.alias("quality_saving"),
        (saving + INSPECTION_SALARY_SAVING).alias("gross_saving"),
    )


def trade_cost_facts(orders: DataFrame) -> DataFrame:
    """Order value, number of orders and the saving from agreements, one row."""
    sums = orders.agg(F.sum("total_eur").alias("v"), F.count(F.lit(1)).alias("total_shipments"))
    value = round_to(F.col("v"), 2)
    saving = round_to(value * AGREEMENT_SHARE, 2)
    return sums.select(
        value.alias("total_value_eur"),
        "total_shipments",
        saving.alias("agreement_saving"),
        (saving + TRADE_SALARY_SAVING + ERROR_SAVING).alias("gross_saving"),
    )


def programmes(spark: SparkSession, quality: DataFrame, trade: DataFrame) -> DataFrame:
    """Two programmes priced from the tables and four with agreed amounts."""
    names = "programme, variant, gross, running, investment, third_year"
    fixed = spark.sql(values_sql(FIXED_PROGRAMMES, names))

    def priced(frame: DataFrame, name: str, variant: str, running: float, investment: float, third: float) -> DataFrame:
        return frame.select(
            F.lit(name).alias("programme"),
            F.lit(variant).alias("variant"),
            F.col("gross_saving").alias("gross"),
            F.lit(running).alias("running"),
            F.lit(investment).alias("investment"),
            F.lit(third).alias("third_year"),
        )

    return (
        priced(quality, "quality", "investment_first_year", 36_000.0, 25_000.0, 0.0)
        .unionByName(priced(trade, "trade", "running_by_net", 24_000.0, 0.0, PENALTY_AVOIDED))
        .unionByName(fixed)
    )


def roi_projection(rows: DataFrame) -> DataFrame:
    """Net saving, months to pay back and three-year return; the formula variant is a column."""
    net = F.col("net")
    variant = F.col("variant")
    months = (
        F.when(variant == "investment_first_year", F.try_divide("investment", net) * 12)
        .when(variant == "running_by_net", F.try_divide("running", net) * 12)
        .when(variant == "running_by_gross", F.try_divide("running", "gross") * 12)
        .when(variant == "running_by_gross_single", F.try_divide(F.col("running"), F.col("gross") / 12))
        .otherwise(F.try_divide(F.col("investment"), net / 12))
    )
    total = net * 3 + F.col("third_year")
    roi = (
        F.when(
            variant == "investment_first_year",
            F.try_divide(total - F.col("investment"), F.col("investment") + F.col("running") * 3),
        )
        .when(variant.isin("running_by_net", "running_by_gross"), F.try_divide(total, F.col("running") * 3))
        .when(variant == "running_by_gross_single", F.try_divide(total, F.col("running")))
        .otherwise(F.try_divide(total, F.col("investment") * 3))
    )
    return rows.withColumn("net", F.col("gross") - F.col("running")).select(
        "programme",
        "variant",
        round_to(F.col("gross"), 2).alias("gross_saving"),
        round_to(net, 2).alias("net_saving"),
        F.when(net > 0, round_to(months, 1)).alias("payback_months"),
        round_to(roi * 100, 1).alias("roi_3yr_pct"),
    )


def roi_portfolio(projected: DataFrame, investment: float = PORTFOLIO_INVESTMENT) -> DataFrame:
    """All programmes against one investment."""
    total = F.col("total_saving")
    return projected.agg(round_to(F.sum("net_saving"), 2).alias("total_saving"), F.count(F.lit(1)).alias("programmes")).select(
        "programmes",
        "total_saving",
        round_to(total / investment * 100, 1).alias("roi_pct"),
        round_to(F.try_divide(F.lit(investment), total / 12), 1).alias("payback_months"),
    )
