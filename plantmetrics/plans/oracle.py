"""The same views in SQL, and the helpers that assemble a check query."""

from __future__ import annotations

import re

from plantmetrics.sources import star

# Whitespace as Python's str.split sees it; one spelling for both engines.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], position: str) -> str:
    return f"({quoted(values)})[CAST({position} AS INT) + 1]"


def r(expr: str, digits: int) -> str:
    """Half-up rounding of the decimal reading of a double."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def rx(expr: str, digits: int) -> str:
    """Rounding with ties judged on the exact binary value, to even."""
    scaled = f"(CAST(floor((abs(x) - floor(abs(x))) * CAST({2**60} AS DOUBLE)) AS HUGEINT) * {10**digits})"
    low = f"(CAST(floor(abs(x)) AS HUGEINT) * {10**digits} + {scaled} // {2**60})"
    left = f"({scaled} % {2**60})"
    up = f"(CASE WHEN {left} > {2**59} OR ({left} = {2**59} AND {low} % 2 = 1) THEN 1 ELSE 0 END)"
    value = f"sign(x) * CAST({low} + {up} AS DOUBLE) / CAST({10**digits} AS DOUBLE)"
    return f"list_transform([CAST(({expr}) AS DOUBLE)], lambda x: {value})[1]"


def div(n: str, d: str, default: str = "0.0") -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE {default} END)"


def pct(n: str, d: str, default: str = "0.0") -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) * 100 ELSE {default} END)"


def clip01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


VIEWS: dict[str, str] = {
    "production_log": """
        SELECT CAST(l_shipdate AS DATE) AS date, CAST((l_linenumber - 1) % 3 + 1 AS INT) AS shift,
               'L' || CAST(l_suppkey % 8 + 1 AS VARCHAR) AS line_id,
               'Brand' || CAST(l_partkey % 3 + 1 AS VARCHAR) AS brand,
               'Model' || CAST(l_partkey % 5 + 1 AS VARCHAR) AS model_name,
               CAST(l_quantity * 10 AS INT) AS planned_qty,
               CAST(floor(l_quantity * 10 * (1 - l_discount)) AS INT) AS actual_qty,
               CAST(floor(floor(l_quantity * 10 * (1 - l_discount)) * l_tax) AS INT) AS defect_qty,
               CAST((l_orderkey * 7 + l_linenumber) % 240 AS INT) AS downtime_minutes,
               CAST(l_partkey % 90 AS INT) AS changeover_minutes,
               CAST(4 + l_partkey % 9 AS INT) AS operator_count,
               'M' || CAST(l_suppkey % 20 AS VARCHAR) AS machine_id,
               (1 - l_discount) * (1 - l_tax) AS oee_score,
               l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
        FROM lineitem""",
    "defect_log": f"""
        SELECT CAST(l_shipdate AS DATE) AS date, 'L' || CAST(l_suppkey % 8 + 1 AS VARCHAR) AS line_id,
               'Brand' || CAST(l_partkey % 3 + 1 AS VARCHAR) AS brand,
               'Model' || CAST(l_partkey % 5 + 1 AS VARCHAR) AS model_name,
               'INS_' || lpad(CAST(l_suppkey % 15 + 1 AS VARCHAR), 2, '0') AS inspector_id,
               p_type AS defect_type,
               CASE WHEN o_orderpriority[1] = '1' THEN 'critical' WHEN o_orderpriority[1] IN ('2', '3') THEN 'major'
                    ELSE 'minor' END AS severity,
               CASE WHEN l_orderkey % 10 < 3 THEN 'scrap' WHEN l_orderkey % 10 < 7 THEN 'rework' ELSE 'pass' END AS action,
               {pick(star.DETECTION_POINTS, "l_suppkey % 4")} AS detection_point,
               CAST(10 + l_partkey % 80 AS INT) AS inspection_time_seconds,
               l_linenumber % 2 = 0 AS photo_taken
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'R'""",
    "inventory": """
        SELECT 'MAT_' || CAST(p_partkey AS VARCHAR) AS material_id, p_name AS material_name, p_type AS category,
               s_name AS supplier, 'C' || CAST(s_nationkey AS VARCHAR) AS country_origin,
               CAST(p_partkey * 37 % 5000 AS INT) AS current_stock, CAST(p_partkey * 53 % 1500 AS INT) AS reorder_point,
               CAST(2 + p_size AS INT) AS lead_time_days, p_retailprice AS unit_price_eur,
               CAST(p_partkey % 60 AS INT) AS consumption_rate_daily,
               CAST(640100 + p_partkey % 10 AS VARCHAR) AS hs_code
        FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""",
    "purchase_orders": """
        SELECT 'PO-' || CAST(o_orderkey AS VARCHAR) AS po_number, CAST(o_orderdate AS DATE) AS date,
               'S' || CAST(o_custkey % 20 AS VARCHAR) AS supplier, 'MAT_' || CAST(o_custkey AS VARCHAR) AS material_id,
               CAST(10 + o_orderkey % 300 AS INT) AS qty_ordered,
               CAST(CASE WHEN o_orderkey % 12 = 0 THEN floor((10 + o_orderkey % 300) * 0.75) ELSE 10 + o_orderkey % 300 END AS INT)
                   AS qty_received,
               o_totalprice AS total_eur,
               CAST(o_orderdate AS DATE) + CAST(20 + o_custkey % 30 AS INT) AS expected_delivery,
               CAST(o_orderdate AS DATE) + CAST(20 + o_custkey % 30 AS INT)
                   + CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 15 ELSE 0 END AS INT) AS actual_delivery,
               CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 15 ELSE 0 END AS INT) AS delay_days,
               CAST(1 + o_custkey % 5 AS INT) AS quality_score
        FROM orders""",
    "products_dpp": f"""
        SELECT 'PROD-' || CAST(p_partkey AS VARCHAR) AS product_id,
               p_name || ' ' || {pick(star.PRODUCT_LINES, "p_partkey % 6")} || ' v' || CAST(p_partkey % 9 + 1 AS VARCHAR) AS product_name,
               'Brand' || CAST(p_partkey % 3 + 1 AS VARCHAR) AS brand,
               {pick(star.PRODUCT_HS, "p_partkey % 4")} AS hs_code_6digit,
               {pick(star.PRODUCT_ORIGINS, "p_partkey % 7")} AS country_origin,
               {pick(star.COMPOSITIONS, "p_partkey % 5")} AS materials_composition,
               CAST(40 + p_size * 7 AS INT) AS weight_grams, p_retailprice / 200 AS carbon_footprint_kg,
               CAST(p_size * 2 AS INT) AS recyclability_score,
               {pick(star.HAZARDS, "p_partkey % 6")} AS hazardous_substances,
               'FAC-' || CAST(p_partkey % 20 AS VARCHAR) AS factory_id,
               DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT) AS production_date,
               'B' || strftime(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT), '%Y%m') || '-'
                   || CAST(1000 + p_partkey % 9000 AS VARCHAR) AS batch_number
        FROM part""",
    "shipments": f"""
        SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
               {pick(star.SHIPMENT_HS, "l_partkey % 5")} AS hs_code,
               {pick(star.SHIPMENT_DESTINATIONS, "l_suppkey % 8")} AS destination, l_extendedprice AS value_eur
        FROM lineitem""",
    "tariff_lines": f"""
        SELECT p_partkey AS line_no, p_name || ' ' || p_type AS product_description,
               {pick(star.TARIFF_HS, f"p_partkey % {len(star.TARIFF_HS)}")} AS correct_hs_code,
               {pick(star.TARIFF_COUNTRIES, f"p_partkey % {len(star.TARIFF_COUNTRIES)}")} AS country_destination
        FROM part""",
    "corpus": rf"""
        SELECT CAST(doc_id AS VARCHAR) AS file_name, text,
               CAST(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) AS INT) AS word_count
        FROM documents""",
    "questions": """
        SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, text AS question
        FROM conversations WHERE role = 'user'""",
    "inspections": """
        SELECT event_id AS inspection_id, ts, 'ST' || CAST(user_id % 6 AS VARCHAR) AS station,
               CASE WHEN event_type = 'error' THEN 'defect' ELSE 'ok' END AS prediction,
               CASE WHEN user_id % 5 = 0 THEN 'defect' ELSE 'ok' END AS actual_label,
               value AS processing_time_ms
        FROM events""",
    "query_log": """
        SELECT ts, 'DOC' || CAST(user_id % 10 AS VARCHAR) AS top_source,
               CAST(event_id % 101 AS DOUBLE) / 100.0 AS confidence, value AS response_time_ms,
               'topic' || CAST(user_id % 6 AS VARCHAR) AS topic
        FROM events""",
    "orders_to_plan": """
        SELECT o_orderkey AS order_id, 'Brand' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS brand,
               'Model' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS model, CAST(100 + o_orderkey % 400 AS INT) AS qty,
               CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS deadline
        FROM orders""",
}


class Once(str):
    """A view that is computed once, however many others read it."""


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it names (and the views those name)."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in known.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    ctes = [f"{name} AS {'MATERIALIZED ' if isinstance(known[name], Once) else ''}({known[name]})" for name in order]
    body = sql.strip()
    if not ctes:
        return body
    recursive = re.match(r"(?is)^with\s+recursive\s+(.*)$", body)
    plain = re.match(r"(?is)^with\s+(.*)$", body)
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + recursive.group(1)
    if plain:
        return "WITH " + ",\n".join(ctes) + ",\n" + plain.group(1)
    return "WITH " + ",\n".join(ctes) + "\n" + body
