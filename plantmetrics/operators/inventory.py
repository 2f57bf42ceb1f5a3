"""Inventory control: safety stock, order quantity, stock status, stock-out risk, savings."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics.functions import at_least, round_even, round_exact, round_to, truncate
from plantmetrics.operators.quality import ordinal

# Fixed values.
ORDER_COST = 50
HOLDING_SHARE = 0.20
DEMAND_STD_SHARE = 0.30
Z_95 = 1.645
STOCKOUT_EVENT_COST = 500
ORDERS_PER_YEAR = 24
STATUS_ORDER = {"critical": 0, "low": 1, "ok": 2, "overstocked": 3}
NO_DEMAND_DAYS = 999.0


def service_factor(level: float = 0.95) -> float:
    """Normal quantile of a service level; the usual 1.645 for 95 percent."""
    return Z_95 if level == 0.95 else abs(NormalDist().inv_cdf(level))


def safety_stock(level: float = 0.95) -> Column:
    sigma = F.col("consumption_rate_daily") * DEMAND_STD_SHARE
    return round_exact(service_factor(level) * sigma * F.sqrt(F.col("lead_time_days") / 7), 1)


def order_quantity() -> Column:
    """Economic order quantity; a price of zero falls back to a holding cost of 0.01."""
    holding = F.col("unit_price_eur") * HOLDING_SHARE
    holding = F.when(holding > 0, holding).otherwise(0.01)
    return round_even(F.sqrt(2 * (F.col("consumption_rate_daily") * 365) * ORDER_COST / holding))


def reorder_point() -> Column:
    return round_even(F.col("consumption_rate_daily") * F.col("lead_time_days") + safety_stock())


def days_of_stock() -> Column:
    rate = F.col("consumption_rate_daily")
    return F.when(rate > 0, round_exact(F.try_divide("current_stock", rate), 1)).otherwise(NO_DEMAND_DAYS)


def stock_status(days: Column, lead: Column) -> Column:
    return (
        F.when(days < lead, "critical")
        .when(days < 2 * lead, "low")
        .when(days > 4 * lead, "overstocked")
        .otherwise("ok")
    )


def risk_level(days: Column, lead: Column) -> Column:
    return F.when(days < lead, "high").when(days < 2 * lead, "medium").otherwise("low")


def optimise(inventory: DataFrame) -> DataFrame:
    """Stock parameters and status of every material, in one projection."""
    return (
        inventory.withColumn("days_of_stock", days_of_stock())
        .withColumn("status", stock_status(F.col("days_of_stock"), F.col("lead_time_days")))
        .select(
            "material_id",
            "material_name",
            "current_stock",
            truncate(reorder_point()).alias("optimal_reorder_point"),
            F.col("reorder_point").alias("current_reorder_point"),
            round_even(safety_stock()).alias("safety_stock"),
            truncate(order_quantity()).alias("eoq"),
            "days_of_stock",
            "lead_time_days",
            "unit_price_eur",
            "consumption_rate_daily",
            "status",
        )
    )


def stockout_risk(inventory: DataFrame, days_ahead: int = 30) -> DataFrame:
    """Materials that run out within the horizon, with a recommended order."""
    rate, lead = F.col("consumption_rate_daily"), F.col("lead_time_days")
    need = F.greatest(order_quantity(), rate * lead + safety_stock() - F.col("current_stock"))
    return (
        inventory.where(rate > 0)
        .withColumn("_days", F.try_divide("current_stock", rate))
        .where(F.col("_days") <= days_ahead)
        .withColumn("_need", need)
        .select(
            "material_id",
            "material_name",
            "current_stock",
            round_exact(F.col("_days"), 1).alias("days_until_stockout"),
            "lead_time_days",
            risk_level(F.col("_days"), lead).alias("risk_level"),
            truncate(round_even(F.col("_need"))).alias("recommended_order_qty"),
            round_exact(F.col("_need") * F.col("unit_price_eur"), 2).alias("estimated_cost"),
        )
    )


def by_urgency(risks: DataFrame) -> DataFrame:
    return risks.orderBy("days_until_stockout", "material_id")


def most_urgent(optimised: DataFrame, k: int = 20) -> DataFrame:
    """k materials by status order, then days of stock; the helper column goes again."""
    ranked = optimised.withColumn("_order", ordinal(F.col("status"), STATUS_ORDER))
    return ranked.orderBy("_order", "days_of_stock", "material_id").limit(k).drop("_order")


def most_valuable(optimised: DataFrame, k: int = 20) -> DataFrame:
    valued = optimised.withColumn("value", F.col("current_stock") * F.col("unit_price_eur"))
    return valued.orderBy(F.desc("value"), "material_id").limit(k)


def below_reorder(inventory: DataFrame, k: int = 5) -> DataFrame:
    """The first k materials, by id, whose stock is under the reorder point."""
    low = inventory.where(F.col("current_stock") < F.col("reorder_point"))
    return low.orderBy("material_id").limit(k).select("material_id", "material_name", "current_stock", "reorder_point")


def with_consumption(optimised: DataFrame, inventory: DataFrame) -> DataFrame:
    """Consumption rate by material; materials without one stay with NULL."""
    rates = inventory.select("material_id", F.col("consumption_rate_daily").alias("rate"))
    return optimised.join(rates, "material_id", "left")


def savings(optimised: DataFrame) -> DataFrame:
    """Capital freed, events avoided and ordering cost saved, as one row."""
    over, critical = F.col("status") == "overstocked", F.col("status") == "critical"
    excess = at_least(F.col("current_stock") - F.col("optimal_reorder_point") - F.col("safety_stock"), 0.0)
    orders = F.col("consumption_rate_daily") * 365 / F.greatest(F.col("eoq"), F.lit(1))
    sums = optimised.agg(
        F.count_if(over).alias("overstock_items"),
        F.coalesce(F.sum(F.when(over, excess * F.col("unit_price_eur"))), F.lit(0.0)).alias("excess"),
        F.count_if(critical).alias("critical_items"),
        F.count(F.lit(1)).alias("n"),
        F.sum(orders).alias("eoq_orders"),
    )
    current = F.col("n") * ORDERS_PER_YEAR * ORDER_COST
    optimal = truncate(round_even(round_to(F.col("eoq_orders") * ORDER_COST, 4)))
    holding = round_to(F.col("excess") * HOLDING_SHARE, 2)
    avoided = F.col("critical_items") * STOCKOUT_EVENT_COST
    return sums.select(
        "overstock_items",
        round_to(F.col("excess"), 2).alias("excess_inventory_value_eur"),
        holding.alias("holding_cost_saving_eur_year"),
        F.col("critical_items").alias("stockout_events_prevented"),
        avoided.alias("stockout_cost_avoided_eur"),
        current.alias("order_cost_current_eur"),
        optimal.alias("order_cost_optimal_eur"),
        (current - optimal).alias("order_cost_saving_eur"),
        round_to(holding + avoided + current - optimal, 2).alias("total_annual_saving_eur"),
    )


def overstock(inventory: DataFrame, limit_days: int = 90) -> DataFrame:
    """Days of stock, the overstock mark and the capital it ties up."""
    rate = F.col("consumption_rate_daily")
    days = F.when(rate > 0, F.try_divide("current_stock", rate)).otherwise(0.0)
    return inventory.select(
        "material_id",
        days.alias("days_of_stock"),
        (days > limit_days).alias("is_overstock"),
        F.when(days > limit_days, F.col("current_stock") * F.col("unit_price_eur")).otherwise(0.0).alias("tied_capital"),
    )


def exposure(inventory: DataFrame, orders: DataFrame) -> DataFrame:
    """Stock below its need, overstock and its capital, order totals and mean delay, as one row."""
    short = F.col("current_stock") < F.col("consumption_rate_daily") * F.col("lead_time_days")
    stock = inventory.agg(F.count(F.lit(1)).alias("total_materials"), F.count_if(short).alias("materials_below_need"))
    tied = overstock(inventory).agg(
        F.count_if("is_overstock").alias("materials_over_90_days"), F.sum("tied_capital").alias("tied_capital_eur")
    )
    po = orders.agg(
        F.count(F.lit(1)).alias("total_purchase_orders"),
        F.sum("total_eur").alias("total_po_value_eur"),
        F.avg("delay_days").alias("avg_delivery_delay_days"),
    )
    from plantmetrics.functions.relational import attach_row

    return attach_row(attach_row(stock, tied, "t"), po, "p").select(
        "total_materials", "materials_below_need", "t.*", "p.*"
    )


def risk_summary(risks: DataFrame) -> DataFrame:
    return risks.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("materials"), F.sum("estimated_cost").alias("order_value_eur")
    )


def stockout_heatmap(risks: DataFrame, k: int = 15, weeks: int = 4) -> DataFrame:
    """The k most urgent materials over the coming weeks with a level for the stock left."""
    top = by_urgency(risks).limit(k)
    daily = F.col("current_stock") / F.greatest(F.col("days_until_stockout"), F.lit(0.1))
    left = F.col("current_stock") - daily * F.col("week") * 7
    level = (
        F.when(left <= 0, 1.0)
        .when(left < daily * F.col("lead_time_days"), 0.7)
        .when(left < daily * F.col("lead_time_days") * 2, 0.4)
        .otherwise(0.1)
    )
    label = F.when(F.col("level") >= 0.9, "OUT").when(F.col("level") >= 0.6, "HIGH")
    return (
        top.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
        .withColumn("level", level)
        .withColumn("label", label.when(F.col("level") >= 0.3, "MED").otherwise("LOW"))
        .select("material_id", "week", "level", "label")
    )


def supplier_top(orders: DataFrame, k: int = 5) -> DataFrame:
    """The k suppliers with the highest order value and their delayed and incomplete orders."""
    per = orders.groupBy("supplier").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("total_eur").alias("total_eur"),
        F.count_if(F.col("delay_days") > 0).alias("delayed"),
        F.count_if(F.col("qty_received") < F.col("qty_ordered")).alias("incomplete"),
    )
    return (
        per.withColumn("total_eur", round_to(F.col("total_eur"), 2))
        .withColumn("delayed_pct", F.col("delayed") / F.col("orders") * 100)
        .withColumn("incomplete_pct", F.col("incomplete") / F.col("orders") * 100)
        .orderBy(F.desc("total_eur"), "supplier")
        .limit(k)
    )


def category_stats(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy("category")
        .agg(F.count(F.lit(1)).alias("items"), F.avg("unit_price_eur").alias("mean_price"))
        .orderBy(F.desc("items"), "category")
    )


def stock_days(inventory: DataFrame, category: str) -> DataFrame:
    """Mean days of stock in a category; materials without consumption do not count; none at all gives 0."""
    days = F.try_divide("current_stock", "consumption_rate_daily")
    return inventory.where(F.col("category") == category).agg(F.coalesce(F.avg(days), F.lit(0.0)).alias("stock_days"))
