"""Queries on costs and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.lookups import values_sql
from plantmetrics.operators import finance
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, r

D = "CAST({} AS DOUBLE)".format
VIEWS = {
    "qc_facts": f"""SELECT total_pairs, total_defects, scrap AS scrap_count, rework AS rework_count, ret AS return_count,
        scrap * {D(8.0)} AS scrap_cost, rework * {D(3.5)} AS rework_cost, ret * {D(18.0)} AS return_cost,
        scrap * 8.0 * {D(0.25)} + rework * 3.5 * {D(0.15)} + ret * 18.0 * {D(0.3)} AS quality_saving
        FROM (SELECT count(*) AS total_defects, count(*) FILTER (WHERE action = 'scrap') AS scrap,
                     count(*) FILTER (WHERE action = 'rework') AS rework,
                     count(*) FILTER (WHERE detection_point = 'customer_return') AS ret FROM defect_log),
             (SELECT {big("sum(actual_qty)")} AS total_pairs FROM production_log)""",
    "trade_facts": f"""SELECT v AS total_value_eur, total_shipments, {r(f"v * {D(0.03)}", 2)} AS agreement_saving
        FROM (SELECT {r("sum(total_eur)", 2)} AS v, count(*) AS total_shipments FROM purchase_orders)""",
}
VIEWS["programme_rows"] = f"""
    SELECT 'quality' AS programme, 'investment_first_year' AS variant, quality_saving + {D(finance.INSPECTION_SALARY_SAVING)} AS gross,
           {D(36000)} AS running, {D(25000)} AS investment, {D(0)} AS third_year FROM qc_facts
    UNION ALL SELECT 'trade', 'running_by_net', agreement_saving + {D(finance.TRADE_SALARY_SAVING)} + {D(finance.ERROR_SAVING)},
           {D(24000)}, {D(0)}, {D(finance.PENALTY_AVOIDED)} FROM trade_facts
    UNION ALL {values_sql(finance.FIXED_PROGRAMMES, "programme, variant, gross, running, investment, third_year")}"""
VIEWS["projection"] = f"""
    SELECT programme, variant, {r("gross", 2)} AS gross_saving, {r("net", 2)} AS net_saving, CASE WHEN net > 0 THEN
           {r('''CASE variant WHEN 'investment_first_year' THEN investment / net * 12 WHEN 'running_by_net' THEN running / net * 12
                 WHEN 'running_by_gross' THEN running / gross * 12 WHEN 'running_by_gross_single' THEN running / (gross / 12)
                 ELSE investment / (net / 12) END''', 1)} END AS payback_months,
           {r('''CASE WHEN variant = 'investment_first_year' THEN (net * 3 + third_year - investment) / (investment + running * 3)
                 WHEN variant IN ('running_by_net', 'running_by_gross') THEN (net * 3 + third_year) / (running * 3)
                 WHEN variant = 'running_by_gross_single' THEN (net * 3 + third_year) / running
                 ELSE (net * 3 + third_year) / (investment * 3) END * 100''', 1)} AS roi_3yr_pct
    FROM (SELECT *, gross - running AS net FROM programme_rows)"""


def projected(t):
    quality = finance.qc_cost_facts(t.defect_log, t.production_log)
    rows = finance.programmes(t.spark, quality, finance.trade_cost_facts(t.purchase_orders))
    return finance.roi_projection(rows)


COSTS = ["scrap_cost", "rework_cost", "return_cost", "quality_saving"]


@query(
    "qc_cost_facts",
    f"""SELECT total_pairs, total_defects, scrap_count, rework_count, return_count, {", ".join(f"{r(c, 2)} AS {c}" for c in COSTS)},
               {r(f"quality_saving + {D(finance.INSPECTION_SALARY_SAVING)}", 2)} AS gross_saving FROM qc_facts""",
    VIEWS,
)
def qc_cost_facts(t):
    frame = finance.qc_cost_facts(t.defect_log, t.production_log)
    return frame.withColumns({c: round_to(F.col(c), 2) for c in [*COSTS, "gross_saving"]})


@query(
    "trade_cost_facts",
    f"""SELECT *, {r(f"agreement_saving + {D(finance.TRADE_SALARY_SAVING)} + {D(finance.ERROR_SAVING)}", 2)} AS gross_saving FROM trade_facts""",
    VIEWS,
)
def trade_cost_facts(t):
    frame = finance.trade_cost_facts(t.purchase_orders)
    return frame.withColumn("gross_saving", round_to(F.col("gross_saving"), 2))


@query("roi_projection", "SELECT * FROM projection", VIEWS)
def roi_projection(t):
    return projected(t)


@query(
    "roi_portfolio",
    f"""SELECT programmes, total_saving, {r(f"total_saving / {D(142000)} * 100", 1)} AS roi_pct,
               {r(f"{D(142000)} / (total_saving / 12)", 1)} AS payback_months
        FROM (SELECT count(*) AS programmes, {r("sum(net_saving)", 2)} AS total_saving FROM projection)""",
    VIEWS,
)
def roi_portfolio(t):
    return finance.roi_portfolio(projected(t))
