"""Queries on production planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import planning
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oee import ratios
from plantmetrics.plans.oracle import big, pct, r
from plantmetrics.session import materialise

VIEWS = {
    "slots": """SELECT CAST(day AS INT) AS day, line_id, CAST(shift AS INT) AS shift, capacity
        FROM (SELECT line_id, CAST(trunc(avg(actual_qty)) AS BIGINT) AS capacity FROM production_log GROUP BY 1),
             (SELECT unnest([1, 2, 3, 4, 5]) AS day), (SELECT unnest([1, 2, 3]) AS shift)""",
    "brand_slot": f"""SELECT s.*, b.brand, coalesce({r("oee", 9)}, 0.5) AS affinity FROM slots s, (SELECT DISTINCT brand FROM orders_to_plan) b
        LEFT JOIN ({ratios("line_id, brand")}) a ON a.line_id = s.line_id AND a.brand = b.brand""",
    "lane": """SELECT *, hi - capacity AS lo FROM (
        SELECT *, CAST(sum(capacity) OVER (PARTITION BY brand ORDER BY affinity DESC, day, shift, line_id) AS BIGINT) AS hi FROM (
            SELECT * FROM brand_slot QUALIFY row_number() OVER (PARTITION BY day, line_id, shift ORDER BY affinity DESC, brand) = 1))""",
    "waiting": """SELECT *, hi - qty AS lo FROM (SELECT *, coalesce(deadline, DATE '9999-12-31') AS due,
        CAST(sum(qty) OVER (PARTITION BY brand ORDER BY coalesce(deadline, DATE '9999-12-31'), qty DESC, order_id) AS BIGINT) AS hi FROM orders_to_plan)""",
    "plan_rows": """SELECT day, line_id, shift, o.brand, model, order_id, least(o.hi, s.hi) - greatest(o.lo, s.lo) AS qty,
        CAST((shift - 1) * 8 AS INT) AS start_hour, CAST(shift * 8 AS INT) AS end_hour
        FROM waiting o JOIN lane s ON o.brand = s.brand AND o.lo < s.hi AND s.lo < o.hi""",
    "resequenced": """SELECT day, line_id, CAST(rn AS INT) AS shift, brand, model, order_id, qty, CAST((rn - 1) * 8 AS INT) AS start_hour,
        CAST(rn * 8 AS INT) AS end_hour FROM (
            SELECT *, row_number() OVER (PARTITION BY day, line_id ORDER BY brand, shift, order_id) AS rn FROM plan_rows)""",
}


def plan(t):
    return planning.capacity_fill(t.orders_to_plan, planning.slot_grid(t.production_log), t.production_log)


@query("slot_grid", "SELECT * FROM slots", VIEWS)
def slot_grid(t):
    return planning.slot_grid(t.production_log)


@query(
    "affinity_rank",
    """SELECT day, line_id, shift, brand, affinity,
              CAST(row_number() OVER (PARTITION BY brand ORDER BY affinity DESC, day, shift, line_id) AS INT) AS rank FROM brand_slot""",
    VIEWS,
)
def affinity_rank(t):
    slots = planning.slot_grid(t.production_log)
    ranked = planning.affinity_rank(slots, t.orders_to_plan.select("brand"), t.production_log)
    return ranked.select("day", "line_id", "shift", "brand", "affinity", "rank")


@query(
    "sort_orders",
    """SELECT order_id, due, qty, row_number() OVER (ORDER BY due, qty DESC, order_id) - 1 AS position FROM waiting""",
    VIEWS,
)
def sort_orders(t):
    return planning.order_positions(t.orders_to_plan).select("order_id", "due", "qty", "position")


@query("capacity_fill", "SELECT * FROM plan_rows", VIEWS)
def capacity_fill(t):
    return plan(t)


EXCLUSIVE = """WITH RECURSIVE places AS MATERIALIZED (
        SELECT brand, day, line_id, shift, capacity, hi,
               row_number() OVER (PARTITION BY brand ORDER BY affinity DESC, day, shift, line_id) AS place FROM lane WHERE capacity > 0),
    numbered AS MATERIALIZED (
        SELECT brand, order_id, model, qty, row_number() OVER (PARTITION BY brand ORDER BY due, qty DESC, order_id) AS position
        FROM waiting WHERE qty > 0),
    sizes AS MATERIALIZED (SELECT brand, count(*) AS n, max(hi) AS room FROM places GROUP BY brand),
    fill AS (
        SELECT brand, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS base,
               CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS reached FROM sizes
        UNION ALL
        SELECT f.brand, o.position, f.used, f.reached, coalesce(min(s.place), any_value(z.n)), coalesce(min(s.hi), any_value(z.room))
        FROM fill f JOIN numbered o ON o.brand = f.brand AND o.position = f.position + 1 JOIN sizes z ON z.brand = f.brand
        LEFT JOIN places s ON s.brand = f.brand AND s.place > f.used AND s.hi - f.reached >= o.qty
        WHERE f.used < z.n GROUP BY f.brand, o.position, f.used, f.reached)
    SELECT day, line_id, shift, brand, model, order_id, CAST(least(capacity, qty - (hi - capacity - base)) AS BIGINT) AS qty,
           CAST((shift - 1) * 8 AS INT) AS start_hour, CAST(shift * 8 AS INT) AS end_hour
    FROM fill JOIN numbered USING (brand, position) JOIN places USING (brand) WHERE place > before AND place <= used"""


@query("capacity_fill_exclusive", EXCLUSIVE, VIEWS)
def capacity_fill_exclusive(t):
    """The plan in which every slot serves one order."""
    slots = planning.slot_grid(t.production_log)
    return materialise(planning.exclusive_fill(t.orders_to_plan, slots, t.production_log), "exclusive-plan")


@query(
    "unplaced_orders",
    """SELECT order_id, brand, qty, CAST(coalesce(placed, 0) AS BIGINT) AS placed, CAST(qty - coalesce(placed, 0) AS BIGINT) AS remaining
       FROM orders_to_plan LEFT JOIN (SELECT order_id, sum(qty) AS placed FROM plan_rows GROUP BY 1) USING (order_id)""",
    VIEWS,
)
def unplaced_orders(t):
    return planning.unplaced(t.orders_to_plan, plan(t))


@query(
    "fulfilment",
    f"""SELECT total_ordered, total_scheduled, {r(pct("total_scheduled", "total_ordered"), 1)} AS fulfillment_pct, entries, slots_used
        FROM (SELECT {big("sum(qty)")} AS total_ordered FROM orders_to_plan),
             (SELECT {big("coalesce(sum(qty), 0)")} AS total_scheduled, count(*) AS entries,
                     count(DISTINCT (day, line_id, shift)) AS slots_used FROM plan_rows)""",
    VIEWS,
)
def fulfilment(t):
    return planning.fulfilment(t.orders_to_plan, plan(t))


@query("win_resequence", "SELECT * FROM resequenced", VIEWS)
def win_resequence(t):
    return planning.resequence(plan(t))


@query(
    "gantt_rows",
    """SELECT line_id, brand, order_id, CAST((day - 1) * 24 + start_hour AS INT) AS x_start, CAST(end_hour - start_hour AS INT) AS width
       FROM resequenced""",
    VIEWS,
)
def gantt_rows(t):
    return planning.gantt_rows(planning.resequence(plan(t)))


DAILY = "SELECT avg(d) FROM (SELECT sum(actual_qty) AS d FROM production_log {} GROUP BY date)"


@query(
    "daily_then_mean",
    f"""SELECT line_id, {r("avg(d)", 6)} AS daily_output FROM (SELECT line_id, date, sum(actual_qty) AS d FROM production_log GROUP BY 1, 2) GROUP BY 1""",
)
def daily_then_mean(t):
    frame = planning.daily_mean(t.production_log, "line_id")
    return frame.withColumn("daily_output", round_to(F.col("daily_output"), 6))


@query(
    "what_if",
    f"""WITH b AS (SELECT ({DAILY.format("")}) AS now, (SELECT avg(oee_score) FROM production_log) AS oee,
                ({DAILY.format("WHERE line_id = 'L4'")}) AS gone,
                (SELECT count(*) FROM (SELECT line_id FROM production_log GROUP BY 1)) AS lines,
                (SELECT count(*) FROM (SELECT line_id FROM production_log GROUP BY 1 HAVING count(DISTINCT shift) < 3)) AS short),
       s AS (SELECT now, oee, unnest(['add_shift_3', 'remove_line_L4', 'increase_capacity_10pct']) AS scenario,
                    unnest([now + now / lines / 3 * short, now - gone, now * CAST(1.10 AS DOUBLE)]) AS projected,
                    unnest([CAST(0.97 AS DOUBLE), CAST(1.02 AS DOUBLE), CAST(0.98 AS DOUBLE)]) AS f FROM b)
       SELECT scenario, {r("now", 0)} AS current_daily_output, {r("projected", 0)} AS projected_daily_output,
              {r("(projected - now) / now * 100", 1)} AS change_pct, {r("oee", 4)} AS current_oee, {r("oee * f", 4)} AS projected_oee FROM s""",
)
def what_if(t):
    return planning.what_if(t.production_log)
