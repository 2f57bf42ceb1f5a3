"""Queries on brand reports and indicators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import half_open_quarter, round_to
from plantmetrics.operators import kpi, reports
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, div, pct, r, rx
from plantmetrics.session import materialise
from plantmetrics.sources.star import BRANDS

PERIOD = "1997-Q4"
AS_OF = dt.date(1998, 6, 30)
CATEGORY = "ECONOMY"
SENDER = "Plant"
IN_Q = "date >= DATE '1997-10-01' AND date < DATE '1998-01-01'"


def c100(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def trend(x: str) -> str:
    return f"CASE WHEN {x} > 0.01 THEN 'improving' WHEN {x} < -0.01 THEN 'declining' ELSE 'stable' END"


GRADE = """CASE WHEN {0} >= 90 THEN 'Gold' WHEN {0} >= 75 THEN 'Silver' WHEN {0} >= 60 THEN 'Bronze' ELSE 'Needs Improvement' END"""
D = "CAST({} AS DOUBLE)".format
VIEWS = {
    "q_log": f"SELECT * FROM production_log WHERE {IN_Q}",
    "q_defects": f"SELECT * FROM defect_log WHERE {IN_Q}",
    "q_orders": f"SELECT * FROM purchase_orders WHERE {IN_Q}",
    "out_brand": """SELECT brand, count(*) AS shifts, CAST(sum(actual_qty) AS BIGINT) AS actual, CAST(sum(planned_qty) AS BIGINT) AS planned,
        CAST(sum(defect_qty) AS BIGINT) AS defect_qty, count(DISTINCT model_name) AS models, count(DISTINCT machine_id) AS machines,
        avg(operator_count) AS operators FROM q_log GROUP BY 1""",
    "def_brand": """SELECT brand, count(*) AS records, count(*) FILTER (WHERE action = 'rework') AS rework,
        count(*) FILTER (WHERE detection_point = 'customer_return') AS returns,
        count(*) FILTER (WHERE severity = 'critical') AS critical FROM q_defects GROUP BY 1""",
    "prod_brand": """SELECT brand, avg(carbon_footprint_kg) AS carbon_mean, sum(carbon_footprint_kg) AS carbon_sum,
        avg(recyclability_score) AS recyclability, avg(weight_grams) AS weight_grams,
        avg(CASE WHEN regexp_matches(materials_composition, '(?i)recycled') THEN 1.0 ELSE 0.0 END) AS recycled_share
        FROM products_dpp GROUP BY 1""",
    "halves": """SELECT brand, max(half) AS half, avg(oee_score) FILTER (WHERE rn <= half) AS first_mean,
        avg(oee_score) FILTER (WHERE rn > half) AS second_mean FROM (
            SELECT brand, oee_score, row_number() OVER (PARTITION BY brand ORDER BY date, line_id, shift, k1, k2, k3, k4) AS rn,
                   count(*) OVER (PARTITION BY brand) // 2 AS half FROM q_log) GROUP BY 1""",
    "po_row": f"""SELECT CASE WHEN count(*) = 0 THEN 95.0 ELSE {r(pct("count(*) FILTER (WHERE delay_days <= 0)", "count(*)"), 1)} END AS otd,
        coalesce({r("avg(delay_days) + avg(expected_delivery - date)", 1)}, 30.0) AS lead_planned,
        coalesce({r("avg(actual_delivery - date)", 1)}, 30.0) AS lead_actual FROM q_orders""",
}
VIEWS["scored"] = f"""
    WITH a AS (SELECT o.*, coalesce(records, 0) AS records, coalesce(returns, 0) AS returns, half, first_mean, second_mean,
            {r(div("defect_qty", "actual"), 4)} AS defect_rate,
            {r(div("coalesce(rework, 0)", "coalesce(records, 0)"), 4)} AS rework_rate,
            {r(div("coalesce(returns, 0)", "actual"), 4)} AS return_rate,
            {r(f"least(100.0, {div('actual', 'planned')} * 100)", 1)} AS flexibility,
            {r("carbon_mean", 2)} AS carbon, {r("recyclability", 1)} AS recycling, CAST(otd AS DOUBLE) AS otd, lead_planned
        FROM out_brand o LEFT JOIN def_brand USING (brand) LEFT JOIN prod_brand USING (brand) LEFT JOIN halves USING (brand), po_row),
    b AS (SELECT *, {rx("recycling * 0.5", 1)} AS waste, {rx(c100("(15 - carbon) / 12 * 100"), 1)} AS energy,
                 {rx("(1 - defect_rate) * 100 - 90", 2)} AS cost, {rx("least(100.0, machines * 5.0)", 1)} AS technology FROM a),
    c AS (SELECT *, {rx(f"{c100(f'(1 - defect_rate / {D(0.15)}) * 100')} * 0.5 + {c100('(1 - rework_rate) * 100')} * {D(0.3)} + {c100(f'(1 - return_rate / {D(0.01)}) * 100')} * {D(0.2)}", 1)} AS q,
                 {rx(f"otd * {D(0.6)} + flexibility * {D(0.4)}", 1)} AS d,
                 {rx(f"energy * {D(0.35)} + recycling * {D(0.35)} + waste * {D(0.3)}", 1)} AS s,
                 least(100.0, {rx(f"technology * {D(0.4)} + least(100.0, models * 15.0) * {D(0.3)} + {c100('cost * 10')} * {D(0.3)}", 1)}) AS i FROM b),
    e AS (SELECT *, {rx(f"q * {D(0.4)} + d * 0.25 + s * {D(0.2)} + i * {D(0.15)}", 1)} AS smsi FROM c)
    SELECT brand, '{PERIOD}' AS period, smsi AS smsi_score, q AS quality_score, defect_rate, rework_rate, returns AS customer_returns,
           defect_rate < 0.025 AS aql_compliance, d AS delivery_score, otd AS on_time_delivery_pct,
           CAST(lead_planned AS DOUBLE) AS avg_lead_time_days, flexibility AS flexibility_score, s AS sustainability_score,
           carbon AS carbon_per_pair_kg, waste AS waste_reduction_pct, energy AS energy_efficiency, CAST(i AS DOUBLE) AS innovation_score,
           models AS process_improvements, technology AS technology_adoption, cost AS cost_optimization_pct,
           {GRADE.format("smsi")} AS overall_grade,
           CASE WHEN half > 0 THEN {trend("round(second_mean - first_mean, 9)")} ELSE 'stable' END AS trend
    FROM e"""
VIEWS["performed"] = f"""
    SELECT brand, actual AS total_units, {r(pct("actual", "planned"), 1)} AS planned_vs_actual_pct, top_models,
           {rx("1 - rate", 4)} AS fpy, rate AS defect_rate, top_defects, CASE WHEN rate < {D(0.035)} THEN 'pass' ELSE 'fail' END AS aql_status,
           CAST(otd AS DOUBLE) AS otd_pct, CAST(lead_actual AS DOUBLE) AS avg_lead_time, stock_days, critical_materials
    FROM (SELECT *, {r(div("defect_qty", "actual"), 4)} AS rate FROM out_brand)
    LEFT JOIN (SELECT brand, string_agg(model_name || ':' || CAST(units AS VARCHAR), ',' ORDER BY units DESC, model_name) AS top_models
               FROM (SELECT brand, model_name, CAST(sum(actual_qty) AS BIGINT) AS units FROM q_log GROUP BY 1, 2) GROUP BY 1) USING (brand)
    LEFT JOIN (SELECT brand, string_agg(defect_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, defect_type) AS top_defects
               FROM (SELECT brand, defect_type, count(*) AS n FROM q_defects GROUP BY 1, 2
                     QUALIFY row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, defect_type) <= 5) GROUP BY 1) USING (brand),
    po_row,
    (SELECT {r("coalesce(avg(CASE WHEN consumption_rate_daily <> 0 THEN CAST(current_stock AS DOUBLE) / consumption_rate_daily END), 0.0)", 1)}
            AS stock_days FROM inventory WHERE category = '{CATEGORY}'),
    (SELECT string_agg(material_id, ',' ORDER BY material_id) AS critical_materials FROM (
         SELECT material_id FROM inventory WHERE current_stock < reorder_point ORDER BY material_id LIMIT 5))"""
VIEWS["sustained"] = f"""
    SELECT brand, {r("carbon_sum", 1)} AS carbon_footprint_total, {r("carbon_mean", 2)} AS per_unit,
           {r("recycled_share * 100", 1)} AS recycled_content_pct, {r("defect_qty * (weight_grams / 1000)", 1)} AS waste_kg,
           rate AS defect_rate, {rx(c100("100 - coalesce(returns, 0) * 0.5 - rate * 500"), 1)} AS customer_satisfaction,
           operators <= 8 AS working_hours_compliance, coalesce(critical, 0) // 10 AS safety_incidents,
           {r("operators * 4 * 3", 1)} AS training_hours, actual AS total_units, {r(pct("actual", "planned"), 1)} AS efficiency
    FROM (SELECT *, {r(div("defect_qty", "actual"), 4)} AS rate FROM out_brand)
    LEFT JOIN def_brand USING (brand) LEFT JOIN prod_brand USING (brand)"""


def quarter(t):
    """(log, defects, orders) of the period, bounded at the scan and written once for all reports of a query."""
    if PERIOD not in t.kept:
        start, end = half_open_quarter(PERIOD)
        frames = t.production_between(start, end), t.defects_between(start, end), t.purchases_between(start, end)
        t.kept[PERIOD] = tuple(materialise(frame, "quarter") for frame in frames)
    return t.kept[PERIOD]


def days(t):
    """Daily sums of the whole production log, written once for values and trends."""
    if "days" not in t.kept:
        t.kept["days"] = materialise(kpi.per_day(t.production_log), "days")
    return t.kept["days"]


def scores(t):
    log, defects, orders = quarter(t)
    return reports.scorecard(log, defects, t.products_dpp, orders, PERIOD)


def performance(t):
    log, defects, orders = quarter(t)
    return reports.performance_report(log, defects, t.inventory, orders, PERIOD, CATEGORY)


def sustainability(t):
    log, defects, _ = quarter(t)
    return reports.sustainability_report(log, defects, t.products_dpp, PERIOD)


def quarter_log(t):
    return quarter(t)[0]


LOG = ["date", "line_id", "brand", "actual_qty", "k1", "k2", "k3", "k4"]


@query("filter_quarter", f"SELECT {', '.join(LOG)} FROM q_log", VIEWS)
def filter_quarter(t):
    return t.production_between(*half_open_quarter(PERIOD)).select(*LOG)


@query(
    "filter_quarter_orders",
    "SELECT po_number, expected_delivery FROM purchase_orders WHERE expected_delivery >= DATE '1997-10-01' AND expected_delivery < DATE '1998-01-01'",
)
def filter_quarter_orders(t):
    return reports.in_quarter(t.purchase_orders, PERIOD, "expected_delivery").select("po_number", "expected_delivery")


@query(
    "filter_date_range",
    "SELECT product_id, production_date FROM products_dpp WHERE production_date BETWEEN DATE '1997-10-01' AND DATE '1997-12-31'",
)
def filter_date_range(t):
    day = F.col("production_date")
    return t.products_dpp.where(day.between(dt.date(1997, 10, 1), dt.date(1997, 12, 31))).select("product_id", day)


@query(
    "str_parse_period",
    """SELECT DISTINCT period, CAST(split_part(period, '-', 1) AS INT) AS year, CAST(split_part(period, 'Q', 2) AS INT) AS quarter,
              CAST(split_part(period, 'Q', 2) AS INT) * 3 - 2 AS first_month, CAST(split_part(period, 'Q', 2) AS INT) * 3 AS last_month
       FROM (SELECT strftime(date, '%Y') || '-Q' || CAST(quarter(date) AS VARCHAR) AS period FROM purchase_orders)""",
)
def str_parse_period(t):
    from plantmetrics.functions import parse_period

    label = F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string"))
    periods = t.purchase_orders.select(label.alias("period")).distinct()
    return periods.withColumn("p", parse_period(F.col("period"))).select(
        "period",
        "p.year",
        "p.quarter",
        F.array_min("p.months").alias("first_month"),
        F.array_max("p.months").alias("last_month"),
    )


@query("smsi_scorecard", "SELECT * FROM scored", VIEWS)
def smsi_scorecard(t):
    return scores(t).select(
        "brand",
        "period",
        "smsi_score",
        F.col("quality.score").alias("quality_score"),
        "quality.defect_rate",
        "quality.rework_rate",
        "quality.customer_returns",
        "quality.aql_compliance",
        F.col("delivery.score").alias("delivery_score"),
        "delivery.on_time_delivery_pct",
        "delivery.avg_lead_time_days",
        "delivery.flexibility_score",
        F.col("sustainability.score").alias("sustainability_score"),
        "sustainability.carbon_per_pair_kg",
        "sustainability.waste_reduction_pct",
        "sustainability.energy_efficiency",
        F.col("innovation.score").alias("innovation_score"),
        "innovation.process_improvements",
        "innovation.technology_adoption",
        "innovation.cost_optimization_pct",
        "overall_grade",
        "trend",
    )


@query(
    "performance_report",
    "SELECT * FROM performed",
    VIEWS,
)
def performance_report(t):
    def listing(column, first, second):
        return F.array_join(
            F.transform(column, lambda m: F.concat(m[first], F.lit(":"), m[second].cast("string"))), ","
        )

    return performance(t).select(
        "brand",
        "production.total_units",
        "production.planned_vs_actual_pct",
        listing("production.top_models", "model", "units").alias("top_models"),
        "quality.fpy",
        "quality.defect_rate",
        listing("quality.top_defects", "type", "count").alias("top_defects"),
        "quality.aql_status",
        "delivery.otd_pct",
        "delivery.avg_lead_time",
        "inventory.stock_days",
        F.array_join(F.transform("inventory.critical_materials", lambda m: m["material_id"]), ",").alias("critical_materials"),
    )


@query("sustainability_report", "SELECT * FROM sustained", VIEWS)
def sustainability_report(t):
    return sustainability(t).select("brand", "sustainability.*", "quality.*", "social.*", "production.*")


@query(
    "model_output",
    f"""SELECT brand, model_name, {big("sum(actual_qty)")} AS units, {r("avg(oee_score)", 6)} AS oee_avg FROM production_log GROUP BY 1, 2""",
)
def model_output(t):
    frame = reports.model_output(t.production_log)
    return frame.withColumn("oee_avg", round_to(F.col("oee_avg"), 6))


@query(
    "top_defects",
    """SELECT brand, defect_type, count(*) AS count, CAST(row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, defect_type) AS INT) AS rank
       FROM q_defects GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, defect_type) <= 5""",
    VIEWS,
)
def top_defects(t):
    return reports.top_defects(quarter(t)[1])


@query(
    "otd_lead_time",
    "SELECT CAST(otd AS DOUBLE) AS otd_pct, CAST(lead_planned AS DOUBLE) AS lead_planned, CAST(lead_actual AS DOUBLE) AS lead_actual FROM po_row",
    VIEWS,
)
def otd_lead_time(t):
    return reports.on_time(quarter(t)[2])


@query(
    "win_half_rows",
    f"""SELECT brand, {big("half")} AS half, {r("first_mean", 6)} AS first_mean, {r("second_mean", 6)} AS second_mean FROM halves""",
    VIEWS,
)
def win_half_rows(t):
    frame = reports.half_means(quarter_log(t))
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("first_mean", "second_mean")})


@query(
    "distinct_counts",
    """SELECT (SELECT count(DISTINCT model_name) FROM production_log) AS models,
              (SELECT count(DISTINCT machine_id) FROM production_log) AS machines,
              (SELECT count(DISTINCT shift) FROM production_log) AS shifts,
              (SELECT count(DISTINCT hs_code_6digit) FROM products_dpp) AS codes,
              (SELECT count(DISTINCT country_origin) FROM products_dpp) AS origins""",
)
def distinct_counts(t):
    from plantmetrics.functions.relational import attach_row

    log = t.production_log.agg(
        F.count_distinct("model_name").alias("models"),
        F.count_distinct("machine_id").alias("machines"),
        F.count_distinct("shift").alias("shifts"),
    )
    products = t.products_dpp.agg(
        F.count_distinct("hs_code_6digit").alias("codes"), F.count_distinct("country_origin").alias("origins")
    )
    return attach_row(log, products, "p").select("models", "machines", "shifts", "p.*")


@query(
    "grade",
    f"""SELECT product_id, {GRADE.format("recyclability_score")} AS grade FROM products_dpp""",
)
def grade(t):
    return t.products_dpp.select("product_id", reports.grade(F.col("recyclability_score")).alias("grade"))


@query(
    "aql_gate",
    f"""SELECT line_id, brand, rate < {D(0.025)} AS strict_pass, CASE WHEN rate < {D(0.035)} THEN 'pass' ELSE 'fail' END AS loose_status
        FROM (SELECT line_id, brand, {r(div("sum(defect_qty)", "sum(actual_qty)"), 4)} AS rate FROM production_log GROUP BY 1, 2)""",
)
def aql_gate(t):
    from plantmetrics.functions import safe_div

    rates = t.production_log.groupBy("line_id", "brand").agg(
        round_to(safe_div(F.sum("defect_qty"), F.sum("actual_qty")), 4).alias("rate")
    )
    return rates.select(
        "line_id",
        "brand",
        reports.aql_pass(F.col("rate")).alias("strict_pass"),
        reports.aql_status(F.col("rate")).alias("loose_status"),
    )


@query(
    "weighted_score",
    f"""SELECT brand, {r(f"quality_score * {D(0.4)} + delivery_score * 0.25 + sustainability_score * {D(0.2)} + innovation_score * {D(0.15)}", 6)}
        AS score FROM scored""",
    VIEWS,
)
def weighted_score(t):
    parts = [F.col(f"{p}.score") for p in reports.WEIGHTS]
    return scores(t).select("brand", round_to(reports.weighted_score(*parts), 6).alias("score"))


@query(
    "score_vs_target",
    f"""SELECT brand, category, score, target, {r("score - target", 6)} AS gap FROM (
        SELECT brand, unnest(['quality', 'delivery', 'sustainability', 'innovation']) AS category,
               unnest([quality_score, delivery_score, sustainability_score, innovation_score]) AS score,
               unnest([{D(85)}, {D(90)}, {D(75)}, {D(70)}]) AS target FROM scored)""",
    VIEWS,
)
def score_vs_target(t):
    return reports.score_vs_target(scores(t)).withColumn("gap", round_to(F.col("gap"), 6))


@query(
    "report_alerts",
    """SELECT CAST((SELECT count(*) FROM scored WHERE brand = 'Brand1' AND smsi_score < 75)
            + (SELECT count(*) FROM performed WHERE brand = 'Brand2' AND aql_status = 'fail')
            + (SELECT count(*) FROM sustained WHERE brand = 'Brand3' AND per_unit > 10) AS BIGINT) AS active_alerts""",
    VIEWS,
)
def report_alerts(t):
    return reports.report_alerts(scores(t), performance(t), sustainability(t), BRANDS)


@query(
    "brand_comparison",
    f"""SELECT brand, unnest(['defect_pct', 'on_time_pct', 'fpy_pct', 'output_k']) AS metric,
               unnest([{r("rate * 100", 6)}, CAST(otd AS DOUBLE), {r("(1 - rate) * 100", 6)}, {r("CAST(actual AS DOUBLE) / 1000", 6)}]) AS value
        FROM (SELECT brand, defect_rate AS rate, on_time_delivery_pct AS otd FROM scored WHERE brand = 'Brand1'
              UNION ALL SELECT brand, defect_rate, otd_pct FROM performed WHERE brand = 'Brand2'
              UNION ALL SELECT brand, defect_rate, efficiency FROM sustained WHERE brand = 'Brand3') JOIN out_brand USING (brand)""",
    VIEWS,
)
def brand_comparison(t):
    frame = reports.brand_comparison(scores(t), performance(t), sustainability(t), quarter_log(t), PERIOD, BRANDS)
    return frame.withColumn("value", round_to(F.col("value"), 6))


def mail_sql(view: str, team: str, report: str, lines: list[tuple[str, str]]) -> str:
    figures = " || ".join(f"'{name}: ' || CAST({value} AS VARCHAR) || chr(10)" for name, value in lines)
    return f"""SELECT brand, lower(brand) || '-team@' || lower(brand) || '.com' AS recipient,
               '{SENDER}: ' || brand || ' {report} report, Q4 1997' AS subject, brand || '_{report}_Q4_1997.json' AS attachment,
               'To the ' || brand || ' {team} team,' || chr(10) || chr(10) || 'the {report} report for {PERIOD} is attached. Its main figures:'
               || chr(10) || {figures} || chr(10) || '{SENDER}' AS body FROM {view}"""


@query(
    "str_email_draft",
    mail_sql(
        "scored",
        "quality",
        "SMSI",
        [
            ("SMSI score", "smsi_score"),
            ("grade", "overall_grade"),
            ("quality score", "quality_score"),
            ("defect rate", "printf('%.2f', defect_rate * 100) || '%'"),
            ("delivered on time", "on_time_delivery_pct || '%'"),
            ("carbon per pair", "carbon_per_pair_kg || ' kg'"),
            ("trend", "trend"),
        ],
    ),
    VIEWS,
)
def str_email_draft(t):
    return reports.email_draft(scores(t), SENDER)


@query(
    "performance_mail",
    mail_sql(
        "performed",
        "operations",
        "performance",
        [
            ("units", "total_units"),
            ("first pass yield", "printf('%.2f', fpy * 100) || '%'"),
            ("AQL", "aql_status"),
            ("delivered on time", "otd_pct || '%'"),
            ("stock", "stock_days || ' days'"),
        ],
    ),
    VIEWS,
)
def performance_mail(t):
    return reports.performance_mail(performance(t), SENDER)


@query(
    "sustainability_mail",
    mail_sql(
        "sustained",
        "sustainability",
        "sustainability",
        [
            ("carbon", "carbon_footprint_total || ' kg'"),
            ("carbon per unit", "per_unit || ' kg'"),
            ("recycled content", "recycled_content_pct || '%'"),
            ("waste", "waste_kg || ' kg'"),
            ("efficiency", "efficiency || '%'"),
            ("safety incidents", "safety_incidents"),
        ],
    ),
    VIEWS,
)
def sustainability_mail(t):
    return reports.sustainability_mail(sustainability(t), SENDER)


@query(
    "report_calendar",
    """WITH q AS (SELECT brand, year, CAST(unnest([1, 2, 3, 4]) AS INT) AS quarter
                  FROM (SELECT DISTINCT brand, CAST(year(date) AS INT) AS year FROM production_log)),
       d AS (SELECT brand, CAST(year AS VARCHAR) || '-Q' || CAST(quarter AS VARCHAR) AS period, make_date(year, quarter * 3 - 2, 1) AS start,
                    make_date(year, quarter * 3, 28) AS "end", make_date(year, quarter * 3, 28) + 15 AS due FROM q)
       SELECT *, CAST("end" - start AS INT) AS window_days,
              CASE WHEN due < DATE '1998-06-30' THEN 'Done' WHEN start <= DATE '1998-06-30' AND DATE '1998-06-30' <= due THEN 'In Progress'
                   ELSE 'Planned' END AS state,
              CASE WHEN due < DATE '1998-06-30' THEN due - 5 END AS generated FROM d""",
)
def report_calendar(t):
    return reports.report_calendar(t.production_log, AS_OF)


# -- indicators ---------------------------------------------------------------------------------------
BRAND_RATE = ", ".join(
    f"{div(f'sum(defect_qty) FILTER (WHERE brand = {chr(39)}{b}{chr(39)})', f'sum(actual_qty) FILTER (WHERE brand = {chr(39)}{b}{chr(39)})')} AS b{i}"
    for i, b in enumerate(BRANDS, 1)
)
VIEWS["kpi_sums"] = f"""
    SELECT * FROM (SELECT count(*) AS shifts, sum(actual_qty) AS actual, sum(defect_qty) AS dq, avg(oee_score) AS oee, avg(changeover_minutes) AS chg,
                          sum(downtime_minutes) AS down, avg(operator_count) AS ops, {BRAND_RATE} FROM production_log),
         (SELECT count(*) AS records, count(*) FILTER (WHERE action = 'rework') AS rework, count(*) FILTER (WHERE action = 'scrap') AS scrap,
                 count(*) FILTER (WHERE detection_point = 'customer_return') AS returns,
                 count(*) FILTER (WHERE severity = 'critical') AS critical FROM defect_log),
         (SELECT sum(consumption_rate_daily) AS rate, sum(current_stock * unit_price_eur) AS stock_value, avg(unit_price_eur) AS price,
                 count(*) FILTER (WHERE current_stock <= 0) AS stockouts FROM inventory),
         (SELECT count(*) AS n, count(*) FILTER (WHERE delay_days <= 0) AS ok, avg(quality_score) AS qs FROM purchase_orders),
         (SELECT avg(carbon_footprint_kg) AS carbon, avg(weight_grams) AS weight FROM products_dpp),
         (SELECT smsi_score FROM scored WHERE brand = 'Brand1')"""
KPI_SQL = {
    "overall_defect_rate": r(div("dq", "actual"), 4),
    **{f"brand{i}_defect_rate": r(f"b{i}", 4) for i in (1, 2, 3)},
    "on_time_delivery": r(pct("ok", "n", "95.0"), 1),
    "oee_average": r("oee * 100", 1),
    "customer_return_rate": r(div("returns", "actual"), 4),
    "rework_rate": r(div("rework", "records"), 4),
    "scrap_rate": r(div("scrap", "records"), 4),
    "first_pass_yield": r("(1 - CAST(dq AS DOUBLE) / actual) * 100", 1),
    "changeover_time_avg": r("chg", 1),
    "downtime_pct": r(pct("down", "shifts * 480"), 1),
    "inventory_turnover": r(div("rate * 365 * price", "stock_value"), 1),
    "stockout_incidents": "CAST(stockouts AS DOUBLE)",
    "supplier_quality_score": r("qs", 2),
    "training_hours_per_emp": r("ops * 4", 1),
    "safety_incidents": "CAST(critical // 50 AS DOUBLE)",
    "energy_per_unit_kwh": r("carbon * 0.35", 2),
    "waste_per_unit_kg": r(f"{div('dq', 'actual')} * (weight / 1000)", 4),
    "smsi_score": "smsi_score",
}
VIEWS["kpi_vals"] = " UNION ALL ".join(f"SELECT '{k}' AS kpi_id, {v} AS value FROM kpi_sums" for k, v in KPI_SQL.items())
VIEWS["kpi_table"] = lookups.values_sql(
    lookups.kpi_rows(), "position, kpi_id, name, target, warning, critical, direction"
)
HALF = """SELECT {0} AS value FROM production_log, (SELECT min(date) AS a, max(date) AS b FROM production_log)
          WHERE (2 * (date - a) <= (b - a)) = {1}"""
HALF_SQL = {
    "oee_average": "avg(oee_score) * 100",
    "overall_defect_rate": "CAST(sum(defect_qty) AS DOUBLE) / sum(actual_qty)",
    "downtime_pct": "CAST(sum(downtime_minutes) AS DOUBLE) / (count(*) * 480) * 100",
    "changeover_time_avg": "avg(changeover_minutes)",
    "first_pass_yield": "(1 - CAST(sum(defect_qty) AS DOUBLE) / sum(actual_qty)) * 100",
}
VIEWS["kpi_halves"] = " UNION ALL ".join(
    f"SELECT '{k}' AS kpi_id, ({HALF.format(v, 'true')}) AS first_half, ({HALF.format(v, 'false')}) AS second_half"
    for k, v in HALF_SQL.items()
)
KPI_TREND = """CASE WHEN abs(second_half - first_half) < 0.5 THEN 'stable' WHEN second_half > first_half THEN 'up' ELSE 'down' END"""
VIEWS["kpi_full"] = f"""
    SELECT position, kpi_id, name, value, target,
           CASE direction WHEN 'lower_is_better' THEN CASE WHEN value <= target THEN 'green' WHEN value <= warning THEN 'yellow' ELSE 'red' END
                ELSE CASE WHEN value >= target THEN 'green' WHEN value >= warning THEN 'yellow' ELSE 'red' END END AS status,
           coalesce(trend, 'stable') AS trend
    FROM (SELECT t.*, coalesce(v.value, 0.0) AS value, h.trend FROM kpi_table t LEFT JOIN kpi_vals v USING (kpi_id)
          LEFT JOIN (SELECT kpi_id, {KPI_TREND} AS trend FROM kpi_halves) h USING (kpi_id))"""


def values(t):
    score = scores(t).where(F.col("brand") == BRANDS[0])
    return kpi.kpi_values(days(t), t.defect_log, t.inventory, t.purchase_orders, t.products_dpp, score, BRANDS)


def board(t):
    thresholds = lookups.kpi_thresholds(t.spark)
    return kpi.board(values(t), kpi.half_trends(days(t)), thresholds)


@query("kpi_values", "SELECT * FROM kpi_vals", VIEWS)
def kpi_values(t):
    return values(t)


@query(
    "win_half_dates",
    f"""SELECT kpi_id, {r("first_half", 6)} AS first_half, {r("second_half", 6)} AS second_half, {KPI_TREND} AS trend FROM kpi_halves""",
    VIEWS,
)
def win_half_dates(t):
    frame = kpi.half_trends(days(t))
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("first_half", "second_half")})


@query(
    "kpi_threshold_join",
    "SELECT position, t.kpi_id, name, target, warning, critical, direction, coalesce(value, 0.0) AS value FROM kpi_table t LEFT JOIN kpi_vals v ON v.kpi_id = t.kpi_id",
    VIEWS,
)
def kpi_threshold_join(t):
    joined = lookups.kpi_thresholds(t.spark).join(values(t), "kpi_id", "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(0.0)))


@query("kpi_status", "SELECT kpi_id, value, status FROM kpi_full", VIEWS)
def kpi_status(t):
    return board(t).select("kpi_id", "value", "status")


@query("kpi_board", "SELECT * FROM kpi_full", VIEWS)
def kpi_board(t):
    return board(t)


@query(
    "kpi_alerts",
    "SELECT kpi_id, name, value, target, status, trend FROM kpi_full WHERE status IN ('yellow', 'red')",
    VIEWS,
)
def kpi_alerts(t):
    return kpi.alerts(board(t))


@query(
    "kpi_rollup",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'green') AS green, count(*) FILTER (WHERE status = 'yellow') AS yellow,
              count(*) FILTER (WHERE status = 'red') AS red FROM kpi_full""",
    VIEWS,
)
def kpi_rollup(t):
    return kpi.rollup(board(t))


VIEWS["every_report"] = " UNION ALL ".join(
    f"SELECT brand, '{PERIOD}' AS period, '{kind}' AS report_type, brand || '_{kind}_Q4_1997' AS file_name, CAST({figure} AS DOUBLE) AS figure FROM {view}"
    for kind, view, figure in (
        ("SMSI", "scored", "smsi_score"),
        ("Performance", "performed", "total_units"),
        ("Sustainability", "sustained", "carbon_footprint_total"),
    )
)
FIGURES = ("$.smsi_score", "$.production.total_units", "$.sustainability.carbon_footprint_total")


def main_figure() -> F.Column:
    """The main figure of a report's JSON body: its score, its units or its carbon."""
    found = [F.get_json_object("body", path) for path in FIGURES]
    kind = F.col("report_type")
    chosen = F.when(kind == "SMSI", found[0]).when(kind == "Performance", found[1]).otherwise(found[2])
    return chosen.cast("double").alias("figure")


@query(
    "dashboard_doc",
    """SELECT (SELECT count(*) FROM kpi_full) AS total, (SELECT count(*) FROM kpi_full WHERE status = 'green') AS green,
              (SELECT count(*) FROM kpi_full WHERE status = 'yellow') AS yellow, (SELECT count(*) FROM kpi_full WHERE status = 'red') AS red,
              (SELECT CAST(count(*) AS INT) FROM scored) AS scorecards, (SELECT CAST(count(*) AS INT) FROM performed) AS performance,
              (SELECT CAST(count(*) AS INT) FROM sustained) AS sustainability,
              (SELECT CAST(count(*) AS INT) FROM kpi_full WHERE status IN ('yellow', 'red')) AS alerts""",
    VIEWS,
)
def dashboard_doc(t):
    """The document, and what is read back from it: indicator counts and the number of rows in each block."""
    indicators = materialise(board(t), "board")  # twenty rows, read by two blocks
    document = kpi.dashboard(scores(t), performance(t), sustainability(t), indicators)
    return document.select(
        *[F.get_json_object("document", f"$.kpi_summary.{k}").cast("bigint").alias(k) for k in ("total", *kpi.STATUSES)],
        *[
            F.size(F.from_json(F.get_json_object("document", f"$.{k}"), "array<string>")).alias(k)
            for k in ("scorecards", "performance", "sustainability", "alerts")
        ],
    )


@query("brand_reports", "SELECT brand, period, report_type, file_name, figure FROM every_report", VIEWS)
def brand_reports(t):
    """All reports in one envelope, each with the main figure of its body."""
    return all_reports(t).select("brand", "period", "report_type", "file_name", main_figure())


def all_reports(t):
    """The three kinds of report in one envelope."""
    return (
        reports.envelope(scores(t), "SMSI")
        .unionByName(reports.envelope(performance(t), "Performance"))
        .unionByName(reports.envelope(sustainability(t), "Sustainability"))
    )
