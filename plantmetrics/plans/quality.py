"""Queries on the defect log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import quality
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, pct, quoted, r

DEFECT_COLUMNS = [
    "date", "line_id", "brand", "model_name", "inspector_id", "defect_type", "severity", "action",
    "detection_point", "inspection_time_seconds", "photo_taken",
]
MONTH = "strftime(date, '%Y-%m')"
D_MONTH = f"SELECT {MONTH} AS month, brand, count(*) AS defects FROM defect_log GROUP BY 1, 2"
P_MONTH = f"SELECT {MONTH} AS month, brand, sum(actual_qty) AS production FROM production_log GROUP BY 1, 2"
JOINED = f"SELECT month, brand, defects, production FROM ({D_MONTH}) JOIN ({P_MONTH}) USING (month, brand)"
PARETO = """SELECT defect_type, count, CAST(row_number() OVER w AS INT) AS rank,
                   CAST(sum(count) OVER w AS BIGINT) AS cumulative, sum(count) OVER () AS total
            FROM (SELECT defect_type, count(*) AS count FROM defect_log GROUP BY 1)
            WINDOW w AS (ORDER BY count DESC, defect_type)"""
SEVERITY = "CASE severity WHEN 'minor' THEN 1 WHEN 'major' THEN 2 WHEN 'critical' THEN 3 END"


@query("scan_defects", f"SELECT {', '.join(DEFECT_COLUMNS)} FROM defect_log")
def scan_defects(t):
    return t.defect_log.select(*DEFECT_COLUMNS)


@query(
    "defect_pareto",
    f"""SELECT defect_type, count, rank, {r("CAST(count AS DOUBLE) / total * 100", 1)} AS percent,
               {r("CAST(cumulative AS DOUBLE) / total * 100", 1)} AS cumulative_pct FROM ({PARETO})""",
)
def defect_pareto(t):
    return quality.pareto(t.defect_log).drop("cumulative")


@query("win_cumulative", f"SELECT defect_type, rank, cumulative FROM ({PARETO})")
def win_cumulative(t):
    return quality.pareto(t.defect_log).select("defect_type", "rank", "cumulative")


@query(
    "head_k",
    "SELECT defect_type, count(*) AS count FROM defect_log GROUP BY 1 ORDER BY count DESC, defect_type LIMIT 3",
)
def head_k(t):
    return quality.top_values(t.defect_log, "defect_type", 3)


@query(
    "topk_semi",
    f"""SELECT {', '.join(DEFECT_COLUMNS)} FROM defect_log
        WHERE defect_type IN (SELECT defect_type FROM ({PARETO}) WHERE rank <= 5)""",
)
def topk_semi(t):
    return quality.keep_top(t.defect_log, "defect_type", 5).select(*DEFECT_COLUMNS)


@query(
    "brand_type_pivot",
    f"""SELECT brand, {", ".join(f"{big(f'coalesce(sum(n) FILTER (WHERE rank = {i}), 0)')} AS top_{i}" for i in range(1, 6))}
        FROM (SELECT brand, defect_type, count(*) AS n FROM defect_log GROUP BY 1, 2)
        JOIN (SELECT defect_type, rank FROM ({PARETO}) WHERE rank <= 5) USING (defect_type) GROUP BY brand""",
)
def brand_type_pivot(t):
    return quality.brand_type_pivot(t.defect_log)


@query(
    "defect_rate_trend",
    f"""SELECT month, coalesce(brand, 'Overall') AS brand, {big("sum(defects)")} AS defects,
               {big("sum(production)")} AS production,
               {r("CAST(sum(defects) AS DOUBLE) / sum(production) * 100", 3)} AS defect_rate_pct
        FROM ({JOINED}) GROUP BY GROUPING SETS ((month, brand), (month))""",
)
def defect_rate_trend(t):
    return quality.defect_rate_trend(t.defect_log, t.production_log)


RATE = f"""SELECT month, {big("sum(defects)")} AS defects, {big("sum(production)")} AS production,
                  CAST(sum(defects) AS DOUBLE) / sum(production) * 100 AS rate_pct
           FROM (SELECT month, sum(defects) AS defects FROM ({D_MONTH}) GROUP BY 1)
           JOIN (SELECT month, sum(production) AS production FROM ({P_MONTH}) GROUP BY 1) USING (month) GROUP BY month"""


@query("align_months", f"SELECT month, defects, production, {r('rate_pct', 6)} AS rate_pct FROM ({RATE})")
def align_months(t):
    frame = quality.monthly_rate(t.defect_log, t.production_log)
    return frame.withColumn("rate_pct", round_to(F.col("rate_pct"), 6))


@query(
    "win_ma3",
    f"""SELECT month, {r("avg(rate_pct) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", 6)} AS moving_avg
        FROM ({RATE})""",
)
def win_ma3(t):
    frame = quality.moving_average(quality.monthly_rate(t.defect_log, t.production_log))
    return frame.select("month", round_to(F.col("moving_avg"), 6).alias("moving_avg"))


@query("intersect_months", f"SELECT {MONTH} AS month FROM defect_log INTERSECT SELECT {MONTH} FROM production_log")
def intersect_months(t):
    return quality.common_months(t.defect_log, t.production_log)


@query(
    "inspector_stats",
    f"""SELECT inspector_id, count(*) AS count, {r(f"avg({SEVERITY})", 6)} AS avg_severity
        FROM defect_log GROUP BY 1""",
)
def inspector_stats(t):
    frame = quality.inspector_stats(t.defect_log)
    return frame.withColumn("avg_severity", round_to(F.col("avg_severity"), 6))


@query(
    "map_ordinal",
    f"SELECT severity, CAST({SEVERITY} AS INT) AS ordinal, count(*) AS n FROM defect_log GROUP BY 1, 2",
)
def map_ordinal(t):
    order = quality.ordinal(F.col("severity"), quality.SEVERITY_WEIGHT)
    return t.defect_log.groupBy("severity", order.alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))


DETECTION = f"""SELECT detection_point, count, {r("percent", 6)} AS percent, position FROM (
    SELECT detection_point, count, CAST(count AS DOUBLE) / sum(count) OVER () * 100 AS percent,
           CAST(list_position({quoted(quality.DETECTION_ORDER)}, detection_point) AS INT) AS position
    FROM (SELECT detection_point, count(*) AS count FROM defect_log GROUP BY 1)) WHERE position > 0"""


@query("detection_share", DETECTION)
def detection_share(t):
    return quality.detection_share(t.defect_log).withColumn("percent", round_to(F.col("percent"), 6))


@query("custom_order", f"SELECT position, detection_point FROM ({DETECTION})")
def custom_order(t):
    points = t.defect_log.select("detection_point").distinct()
    ordered = quality.in_listed_order(points, "detection_point", quality.DETECTION_ORDER)
    return ordered.select("position", "detection_point")


@query(
    "value_share",
    f"""SELECT label, value, count, {r("CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY label) * 100", 6)} AS percent
        FROM (SELECT 'severity' AS label, severity AS value, count(*) AS count FROM defect_log GROUP BY 2
              UNION ALL SELECT 'action', action, count(*) FROM defect_log GROUP BY 2
              UNION ALL SELECT 'defect_type', defect_type, count(*) FROM defect_log GROUP BY 2)""",
)
def value_share(t):
    """Shares of three labels; one pass over the joined log, then three small frames."""
    counts = t.defect_log.groupingSets(
        [["severity"], ["action"], ["defect_type"]], "severity", "action", "defect_type"
    ).agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window as W

    labelled = counts.select(
        F.when(F.col("severity").isNotNull(), "severity")
        .when(F.col("action").isNotNull(), "action")
        .otherwise("defect_type")
        .alias("label"),
        F.coalesce("severity", "action", "defect_type").alias("value"),
        "count",
    )
    total = F.sum("count").over(W.partitionBy("label"))
    return labelled.withColumn("percent", round_to(F.col("count") / total * 100, 6))


BRAND_RATES = f"""SELECT brand, defects, {big("production")} AS production,
           {r("CAST(defects AS DOUBLE) / production * 100", 2)} AS defect_rate_pct
    FROM (SELECT brand, count(*) AS defects FROM defect_log GROUP BY 1)
    JOIN (SELECT brand, sum(actual_qty) AS production FROM production_log GROUP BY 1) USING (brand)"""


@query("brand_rate_join", BRAND_RATES)
def brand_rate_join(t):
    return quality.brand_rates(t.defect_log, t.production_log)


@query(
    "qc_summary",
    f"""WITH t AS (SELECT defect_type, count(*) AS n, sum(inspection_time_seconds) AS s FROM defect_log GROUP BY 1),
    d AS (SELECT {big("sum(n)")} AS total_defects, sum(s) AS seconds FROM t),
    o AS (SELECT {big("sum(actual_qty)")} AS total_inspections FROM production_log),
    l AS (SELECT defect_type AS top_defect_type, n AS top_defect_count FROM t ORDER BY n DESC, defect_type LIMIT 1)
    SELECT total_inspections, total_defects, {r(pct("total_defects", "total_inspections"), 2)} AS defect_rate_percent,
           top_defect_type, top_defect_count, {r(pct("top_defect_count", "total_defects"), 1)} AS top_defect_percent,
           {r("CAST(seconds AS DOUBLE) / total_defects", 1)} AS avg_inspection_time_seconds
    FROM d, o, l""",
)
def qc_summary(t):
    return quality.qc_summary(t.defect_log, t.production_log)


@query(
    "union_rows",
    f"""SELECT {', '.join(DEFECT_COLUMNS)} FROM defect_log
        UNION ALL SELECT {', '.join(DEFECT_COLUMNS)} FROM defect_log WHERE severity = 'critical'""",
)
def union_rows(t):
    """The log with its critical rows appended once more."""
    log = t.defect_log.select(*DEFECT_COLUMNS)
    return log.unionByName(log.where(F.col("severity") == "critical"))


DRAWN = """SELECT k1, k2, k3, k4, date, line_id, row_number() OVER (ORDER BY md5(concat_ws('-', k1, k2, k3, k4, date, 42)), k1, k2, k3, k4, date) - 1 AS place
    FROM production_log"""


@query(
    "fixed_sample",
    f"""WITH placed AS MATERIALIZED ({DRAWN})
        SELECT k1, k2, k3, k4, date, line_id, 'without' AS kind FROM placed WHERE place < 500
        UNION ALL
        SELECT k1, k2, k3, k4, date, line_id, 'with' AS kind FROM placed
        JOIN (SELECT ('0x' || substr(md5(concat_ws('-', d, 42)), 1, 15))::BIGINT % (SELECT count(*) FROM production_log) AS place
              FROM (SELECT unnest(range(500)) AS d)) USING (place)""",
)
def fixed_sample(t):
    keyed = t.production_log.select("k1", "k2", "k3", "k4", "date", "line_id")
    keys = ["k1", "k2", "k3", "k4", "date"]
    once = quality.fixed_sample(keyed, 500, keys).withColumn("kind", F.lit("without"))
    again = quality.fixed_sample(keyed, 500, keys, replace=True).drop("draw").withColumn("kind", F.lit("with"))
    return once.unionByName(again)


@query(
    "report_top_defects",
    f"""SELECT brand, defect_type, count, rank FROM (
            SELECT brand, defect_type, count,
                   CAST(row_number() OVER (PARTITION BY brand ORDER BY count DESC, defect_type) AS INT) AS rank
            FROM (SELECT brand, defect_type, count(*) AS count FROM defect_log GROUP BY 1, 2)) WHERE rank <= 5""",
)
def report_top_defects(t):
    from pyspark.sql import Window as W

    counts = t.defect_log.groupBy("brand", "defect_type").agg(F.count(F.lit(1)).alias("count"))
    order = W.partitionBy("brand").orderBy(F.desc("count"), "defect_type")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
