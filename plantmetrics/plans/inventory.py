"""Queries on inventory and purchase orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import inventory as inv
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, r, rx
from plantmetrics.sources.readers import with_demand_std

INVENTORY_COLUMNS = [
    "material_id", "material_name", "category", "supplier", "country_origin", "current_stock", "reorder_point",
    "lead_time_days", "unit_price_eur", "consumption_rate_daily", "hs_code",
]
ORDER_COLUMNS = [
    "po_number", "date", "supplier", "material_id", "qty_ordered", "qty_received", "total_eur",
    "expected_delivery", "actual_delivery", "delay_days", "quality_score",
]

SS = rx("1.645 * (consumption_rate_daily * CAST(0.3 AS DOUBLE)) * sqrt(CAST(lead_time_days AS DOUBLE) / 7)", 1)
EOQ = """round_even(sqrt(2 * (consumption_rate_daily * 365) * 50 / (CASE WHEN unit_price_eur * CAST(0.2 AS DOUBLE) > 0
         THEN unit_price_eur * CAST(0.2 AS DOUBLE) ELSE 0.01 END)), 0)"""
DAYS = f"""CASE WHEN consumption_rate_daily > 0
           THEN {rx("CAST(current_stock AS DOUBLE) / consumption_rate_daily", 1)} ELSE 999.0 END"""
OPTIMISED = f"""
    SELECT *, CASE WHEN days_of_stock < lead_time_days THEN 'critical' WHEN days_of_stock < 2 * lead_time_days THEN 'low'
                   WHEN days_of_stock > 4 * lead_time_days THEN 'overstocked' ELSE 'ok' END AS status
    FROM (SELECT material_id, material_name, current_stock, {big(f"round_even(consumption_rate_daily * lead_time_days + {SS}, 0)")}
                 AS optimal_reorder_point, reorder_point AS current_reorder_point, round_even({SS}, 0) AS safety_stock,
                 {big(EOQ)} AS eoq, CAST({DAYS} AS DOUBLE) AS days_of_stock, lead_time_days, unit_price_eur,
                 consumption_rate_daily FROM inventory)"""
NEED = f"greatest({EOQ}, consumption_rate_daily * lead_time_days + {SS} - current_stock)"
RISKS = f"""
    SELECT material_id, material_name, current_stock, {rx("days", 1)} AS days_until_stockout, lead_time_days,
           CASE WHEN days < lead_time_days THEN 'high' WHEN days < 2 * lead_time_days THEN 'medium' ELSE 'low' END AS risk_level,
           {big("round_even(need, 0)")} AS recommended_order_qty, {rx("need * unit_price_eur", 2)} AS estimated_cost
    FROM (SELECT *, CAST(current_stock AS DOUBLE) / consumption_rate_daily AS days, {NEED} AS need
          FROM inventory WHERE consumption_rate_daily > 0) WHERE days <= 30"""
VIEWS = {"optimised_stock": OPTIMISED, "stock_risks": RISKS}


@query(
    "scan_inventory",
    f"""SELECT {', '.join(INVENTORY_COLUMNS)}, {r("consumption_rate_daily * 0.3", 6)} AS demand_std_daily FROM inventory""",
)
def scan_inventory(t):
    frame = with_demand_std(t.inventory).select(*INVENTORY_COLUMNS, "demand_std_daily")
    return frame.withColumn("demand_std_daily", round_to(F.col("demand_std_daily"), 6))


@query("scan_orders", f"SELECT {', '.join(ORDER_COLUMNS)} FROM purchase_orders")
def scan_orders(t):
    return t.purchase_orders.select(*ORDER_COLUMNS)


@query("math_safety_stock", f"SELECT material_id, {SS} AS safety_stock FROM inventory")
def math_safety_stock(t):
    return t.inventory.select("material_id", inv.safety_stock().alias("safety_stock"))


@query("math_eoq", f"SELECT material_id, {EOQ} AS eoq FROM inventory")
def math_eoq(t):
    return t.inventory.select("material_id", inv.order_quantity().alias("eoq"))


@query(
    "math_reorder_point",
    f"SELECT material_id, round_even(consumption_rate_daily * lead_time_days + {SS}, 0) AS reorder_point FROM inventory",
)
def math_reorder_point(t):
    return t.inventory.select("material_id", inv.reorder_point().alias("reorder_point"))


@query("inventory_optimize", "SELECT * FROM optimised_stock", VIEWS)
def inventory_optimize(t):
    return inv.optimise(t.inventory)


@query("stock_status", "SELECT material_id, days_of_stock, status FROM optimised_stock", VIEWS)
def stock_status(t):
    return inv.optimise(t.inventory).select("material_id", "days_of_stock", "status")


@query("stockout_risk", "SELECT * FROM stock_risks", VIEWS)
def stockout_risk(t):
    return inv.stockout_risk(t.inventory)


@query("risk_level", "SELECT material_id, risk_level FROM stock_risks", VIEWS)
def risk_level(t):
    return inv.stockout_risk(t.inventory).select("material_id", "risk_level")


@query(
    "sort_risks",
    """SELECT CAST(row_number() OVER (ORDER BY days_until_stockout, material_id) AS BIGINT) AS position, material_id,
              days_until_stockout FROM stock_risks ORDER BY position""",
    VIEWS,
)
def sort_risks(t):
    """Sorted by days left; the position is counted per value, so the sort is not a single task."""
    from plantmetrics.functions.relational import with_row_index

    risks = inv.stockout_risk(t.inventory).select("material_id", "days_until_stockout")
    placed = with_row_index(risks, [], ["days_until_stockout", "material_id"])
    return placed.select((F.col("row_idx") + 1).alias("position"), "material_id", "days_until_stockout").orderBy(
        "days_until_stockout", "material_id"
    )


@query("risk_summary", f"""SELECT risk_level, count(*) AS materials, {r("sum(estimated_cost)", 2)} AS order_value_eur
                           FROM stock_risks GROUP BY 1""", VIEWS)
def risk_summary(t):
    frame = inv.risk_summary(inv.stockout_risk(t.inventory))
    return frame.withColumn("order_value_eur", round_to(F.col("order_value_eur"), 2))


@query(
    "stockout_heatmap",
    """WITH w AS (SELECT material_id, current_stock, lead_time_days,
                         CAST(current_stock AS DOUBLE) / greatest(days_until_stockout, 0.1) AS daily, CAST(week AS INT) AS week
                  FROM (SELECT * FROM stock_risks ORDER BY days_until_stockout, material_id LIMIT 15),
                       (SELECT unnest([1, 2, 3, 4]) AS week)),
       l AS (SELECT *, CAST(CASE WHEN left_over <= 0 THEN 1.0 WHEN left_over < daily * lead_time_days THEN 0.7
                            WHEN left_over < daily * lead_time_days * 2 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS level
             FROM (SELECT *, current_stock - daily * week * 7 AS left_over FROM w))
       SELECT material_id, week, level, CASE WHEN level >= 0.9 THEN 'OUT' WHEN level >= 0.6 THEN 'HIGH'
              WHEN level >= 0.3 THEN 'MED' ELSE 'LOW' END AS label FROM l""",
    VIEWS,
)
def stockout_heatmap(t):
    return inv.stockout_heatmap(inv.stockout_risk(t.inventory))


RANKED = """SELECT * EXCLUDE (o) FROM (SELECT *, CASE status WHEN 'critical' THEN 0 WHEN 'low' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END AS o
            FROM optimised_stock) ORDER BY o, days_of_stock, material_id LIMIT 20"""


@query("topk_urgency", RANKED, VIEWS)
def topk_urgency(t):
    return inv.most_urgent(inv.optimise(t.inventory))


@query(
    "topk_value",
    f"""SELECT material_id, status, {r("value", 2)} AS value FROM (SELECT *, current_stock * unit_price_eur AS value FROM optimised_stock)
        ORDER BY value DESC, material_id LIMIT 20""",
    VIEWS,
)
def topk_value(t):
    top = inv.most_valuable(inv.optimise(t.inventory))
    return top.select("material_id", "status", round_to(F.col("value"), 2).alias("value"))


@query(
    "add_display_cols",
    f"""SELECT material_id, {r("current_stock * unit_price_eur", 2)} AS value, days_of_stock FROM optimised_stock""",
    VIEWS,
)
def add_display_cols(t):
    """A value column is added for display, the columns it came from are dropped."""
    stock = inv.optimise(t.inventory)
    shown = stock.withColumn("value", round_to(F.col("current_stock") * F.col("unit_price_eur"), 2))
    return shown.drop(*[c for c in stock.columns if c not in ("material_id", "days_of_stock")])


@query(
    "below_reorder",
    """SELECT material_id, material_name, current_stock, reorder_point FROM inventory
       WHERE current_stock < reorder_point ORDER BY material_id LIMIT 5""",
)
def below_reorder(t):
    return inv.below_reorder(t.inventory)


@query(
    "left_rate_join",
    """WITH o AS MATERIALIZED (SELECT material_id, eoq FROM optimised_stock),
            i AS MATERIALIZED (SELECT material_id, consumption_rate_daily FROM inventory)
       SELECT o.material_id, o.eoq, i.consumption_rate_daily AS rate FROM o LEFT JOIN i ON o.material_id = i.material_id""",
    VIEWS,
)
def left_rate_join(t):
    return inv.with_consumption(inv.optimise(t.inventory), t.inventory).select("material_id", "eoq", "rate")


@query(
    "inventory_savings",
    f"""WITH s AS (SELECT count(*) FILTER (WHERE status = 'overstocked') AS over,
            coalesce(sum(greatest(current_stock - optimal_reorder_point - safety_stock, 0.0) * unit_price_eur)
                     FILTER (WHERE status = 'overstocked'), 0.0) AS excess,
            count(*) FILTER (WHERE status = 'critical') AS crit, count(*) AS n,
            sum(CAST(consumption_rate_daily * 365 AS DOUBLE) / greatest(eoq, 1)) AS orders FROM optimised_stock),
        v AS (SELECT *, {big(f"round_even({r('orders * 50', 4)}, 0)")} AS optimal, {r("excess * CAST(0.2 AS DOUBLE)", 2)} AS holding FROM s)
        SELECT over AS overstock_items, {r("excess", 2)} AS excess_inventory_value_eur,
               holding AS holding_cost_saving_eur_year, crit AS stockout_events_prevented,
               crit * 500 AS stockout_cost_avoided_eur, n * 24 * 50 AS order_cost_current_eur,
               optimal AS order_cost_optimal_eur, n * 24 * 50 - optimal AS order_cost_saving_eur,
               {r("holding + crit * 500 + n * 24 * 50 - optimal", 2)} AS total_annual_saving_eur FROM v""",
    VIEWS,
)
def inventory_savings(t):
    return inv.savings(inv.optimise(t.inventory))


OVERSTOCK = """SELECT material_id, d AS days_of_stock, d > 90 AS is_overstock,
      CASE WHEN d > 90 THEN current_stock * unit_price_eur ELSE 0.0 END AS tied_capital
      FROM (SELECT *, CASE WHEN consumption_rate_daily > 0 THEN CAST(current_stock AS DOUBLE) / consumption_rate_daily ELSE 0.0 END AS d
            FROM inventory)"""


@query(
    "overstock_flag",
    f"""SELECT material_id, {r("days_of_stock", 6)} AS days_of_stock, is_overstock, {r("tied_capital", 2)} AS tied_capital
        FROM ({OVERSTOCK})""",
)
def overstock_flag(t):
    return inv.overstock(t.inventory).withColumns(
        {"days_of_stock": round_to(F.col("days_of_stock"), 6), "tied_capital": round_to(F.col("tied_capital"), 2)}
    )


@query(
    "inventory_exposure",
    f"""SELECT (SELECT count(*) FROM inventory) AS total_materials,
               (SELECT count(*) FROM inventory WHERE current_stock < consumption_rate_daily * lead_time_days) AS materials_below_need,
               (SELECT count(*) FROM ({OVERSTOCK}) WHERE is_overstock) AS materials_over_90_days,
               (SELECT {r("sum(tied_capital)", 2)} FROM ({OVERSTOCK})) AS tied_capital_eur,
               (SELECT count(*) FROM purchase_orders) AS total_purchase_orders,
               (SELECT {r("sum(total_eur)", 2)} FROM purchase_orders) AS total_po_value_eur,
               (SELECT {r("avg(delay_days)", 6)} FROM purchase_orders) AS avg_delivery_delay_days""",
)
def inventory_exposure(t):
    return inv.exposure(t.inventory, t.purchase_orders).withColumns(
        {
            "tied_capital_eur": round_to(F.col("tied_capital_eur"), 2),
            "total_po_value_eur": round_to(F.col("total_po_value_eur"), 2),
            "avg_delivery_delay_days": round_to(F.col("avg_delivery_delay_days"), 6),
        }
    )


@query(
    "supplier_topk",
    f"""SELECT *, {r("CAST(delayed AS DOUBLE) / orders * 100", 6)} AS delayed_pct,
               {r("CAST(incomplete AS DOUBLE) / orders * 100", 6)} AS incomplete_pct
        FROM (SELECT supplier, count(*) AS orders, {r("sum(total_eur)", 2)} AS total_eur,
                     count(*) FILTER (WHERE delay_days > 0) AS delayed,
                     count(*) FILTER (WHERE qty_received < qty_ordered) AS incomplete
              FROM purchase_orders GROUP BY 1) ORDER BY total_eur DESC, supplier LIMIT 5""",
)
def supplier_topk(t):
    return inv.supplier_top(t.purchase_orders).withColumns(
        {c: round_to(F.col(c), 6) for c in ("delayed_pct", "incomplete_pct")}
    )


@query(
    "category_stats",
    f"SELECT category, count(*) AS items, {r('avg(unit_price_eur)', 6)} AS mean_price FROM inventory GROUP BY 1",
)
def category_stats(t):
    return inv.category_stats(t.inventory).withColumn("mean_price", round_to(F.col("mean_price"), 6))


@query(
    "stock_days",
    f"""SELECT {r("coalesce(avg(CASE WHEN consumption_rate_daily <> 0 THEN CAST(current_stock AS DOUBLE) / consumption_rate_daily END), 0.0)", 6)}
        AS stock_days FROM inventory WHERE category = 'ECONOMY'""",
)
def stock_days(t):
    return inv.stock_days(t.inventory, "ECONOMY").withColumn("stock_days", round_to(F.col("stock_days"), 6))


@query(
    "date_diff_days",
    """SELECT po_number, CAST(expected_delivery - date AS INT) AS planned_days, CAST(actual_delivery - date AS INT) AS lead_days
       FROM purchase_orders""",
)
def date_diff_days(t):
    return t.purchase_orders.select(
        "po_number",
        F.datediff("expected_delivery", "date").alias("planned_days"),
        F.datediff("actual_delivery", "date").alias("lead_days"),
    )
