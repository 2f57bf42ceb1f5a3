"""Queries on product passports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import round_to
from plantmetrics.functions.text import gtin, model_name, parse_materials, passport_id, product_line, share_containing
from plantmetrics.operators import passports
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import quoted, r, rx
from plantmetrics.plans.trade import LINE, VIEWS

ISSUED = dt.date(2026, 1, 1)
MAKER = {"name": "Plant", "address": "Plant road 1", "id": "PLANT-001"}
PRODUCT_COLUMNS = [
    "product_id", "product_name", "brand", "hs_code_6digit", "country_origin", "materials_composition", "weight_grams",
    "carbon_footprint_kg", "recyclability_score", "hazardous_substances", "factory_id", "production_date", "batch_number",
]

GTIN = "rpad('38' || substr(regexp_replace(md5(product_id), '[^0-9]', '', 'g'), 1, 10), 13, '0')"
TEMPLATE = (
    "CASE "
    + " ".join(f"WHEN contains(lower(product_name), '{k.lower()}') THEN '{k}'" for k in lookups.CARE_TEMPLATES)
    + f" ELSE '{lookups.FALLBACK_TEMPLATE}' END"
)
RECYCLED = "SELECT product_id, CAST(coalesce(sum(pct) FILTER (WHERE contains(lower(name), 'recycled')), 0) AS BIGINT) AS recycled FROM materials GROUP BY 1"
TEXTS = lookups.values_sql(
    [(k, v[0], v[1], v[2], ", ".join(v[3]), v[4]) for k, v in lookups.CARE_TEMPLATES.items()],
    "template, care, repair, disassembly, recyclable, disposal",
)


def documents(t):
    return passports.passport(t.products_dpp, ISSUED, MAKER)


@query("scan_products", f"SELECT {', '.join(PRODUCT_COLUMNS)} FROM products_dpp")
def scan_products(t):
    return t.products_dpp.select(*PRODUCT_COLUMNS)


@query("template_match", f"SELECT product_id, {TEMPLATE} AS template FROM products_dpp")
def template_match(t):
    return t.products_dpp.select("product_id", passports.template_name(F.col("product_name")).alias("template"))


@query(
    "str_product_line",
    f"SELECT product_id, {LINE} AS product_line, split_part(product_name, ' v', 1) AS model FROM products_dpp",
)
def str_product_line(t):
    name = F.col("product_name")
    return t.products_dpp.select(
        "product_id", product_line(name).alias("product_line"), model_name(name).alias("model")
    )


@query("str_gtin", f"SELECT product_id, {GTIN} AS gtin FROM products_dpp")
def str_gtin(t):
    return t.products_dpp.select("product_id", gtin(F.col("product_id")).alias("gtin"))


@query("str_dpp_id", "SELECT product_id, 'DPP-' || replace(product_id, 'PROD-', '') AS unique_id FROM products_dpp")
def str_dpp_id(t):
    return t.products_dpp.select("product_id", passport_id(F.col("product_id"), "DPP-").alias("unique_id"))


@query("map_sum_if", f"SELECT product_id, recycled AS recycled_pct FROM ({RECYCLED})", VIEWS)
def map_sum_if(t):
    share = share_containing(parse_materials(F.col("materials_composition")), "recycled")
    return t.products_dpp.select("product_id", share.cast("bigint").alias("recycled_pct"))


@query(
    "struct_dpp",
    f"""SELECT product_id, '1.0' AS dpp_version, 'DPP-' || replace(product_id, 'PROD-', '') AS unique_id,
               DATE '2026-01-01' AS issued_date, '{MAKER["name"]}' AS manufacturer, product_name AS name, brand,
               split_part(product_name, ' v', 1) AS model, {GTIN} AS gtin, hs_code_6digit AS hs_code, weight_grams,
               recycled AS recycled_content_pct, composition, hazardous_substances,
               {r("carbon_footprint_kg", 6)} AS carbon_footprint_kg,
               {rx("carbon_footprint_kg * CAST(2.8 AS DOUBLE)", 2)} AS energy_consumption_kwh,
               {rx("CAST(weight_grams AS DOUBLE) / 1000 * 45", 1)} AS water_consumption_liters, recyclability_score,
               disassembly AS disassembly_instructions, country_origin AS country, factory_id AS factory, production_date,
               batch_number AS batch, NOT contains(hazardous_substances, 'SVHC') AS oeko_tex,
               CASE WHEN contains(product_name, 'Carbon') THEN 3 ELSE 5 END AS expected_lifetime_years,
               care AS care_instructions, repair AS repair_info, recyclable AS recyclable_components,
               disposal AS disposal_instructions
        FROM products_dpp p JOIN ({RECYCLED}) USING (product_id)
        JOIN (SELECT product_id, string_agg(name || '=' || CAST(pct AS VARCHAR), ', ' ORDER BY name) AS composition
              FROM materials GROUP BY 1) USING (product_id)
        JOIN ({TEXTS}) x ON x.template = {TEMPLATE}""",
    VIEWS,
)
def struct_dpp(t):
    """The nested document, flattened for comparison."""
    parts = F.transform(
        F.array_sort(F.map_entries("dpp.materials.composition")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return documents(t).select(
        "product_id",
        "dpp.dpp_version",
        "dpp.unique_id",
        "dpp.issued_date",
        F.col("dpp.manufacturer.name").alias("manufacturer"),
        "dpp.product.*",
        F.col("dpp.materials.recycled_content_pct").cast("bigint").alias("recycled_content_pct"),
        F.array_join(parts, ", ").alias("composition"),
        "dpp.materials.hazardous_substances",
        round_to(F.col("dpp.sustainability.carbon_footprint_kg"), 6).alias("carbon_footprint_kg"),
        "dpp.sustainability.energy_consumption_kwh",
        "dpp.sustainability.water_consumption_liters",
        "dpp.sustainability.recyclability_score",
        "dpp.sustainability.disassembly_instructions",
        "dpp.origin.*",
        "dpp.compliance.oeko_tex",
        "dpp.durability.*",
        F.array_join("dpp.end_of_life.recyclable_components", ", ").alias("recyclable_components"),
        "dpp.end_of_life.disposal_instructions",
    )


VALIDATED = f"""
    SELECT product_id, brand, '' AS missing, true AS valid, 100.0 AS completeness_pct,
           concat_ws(' | ', CASE WHEN recycled = 0 THEN 'No recycled content declared — verify with supplier.' END,
                     CASE WHEN recyclability_score < 50 THEN 'Recyclability score below 50% — may not meet EU 2030 targets.' END,
                     CASE WHEN contains(hazardous_substances, 'SVHC') THEN 'OEKO-TEX certification missing — consider testing.' END) AS warnings
    FROM products_dpp JOIN ({RECYCLED}) USING (product_id)"""


@query(
    "struct_validate",
    f"""SELECT product_id, brand, missing, valid, CAST(completeness_pct AS DOUBLE) AS completeness_pct, warnings FROM ({VALIDATED})""",
    VIEWS,
)
def struct_validate(t):
    checked = passports.validate(documents(t))
    return checked.select(
        "product_id",
        "brand",
        F.array_join("missing_fields", ", ").alias("missing"),
        "valid",
        "completeness_pct",
        F.array_join("warnings", " | ").alias("warnings"),
    )


# Sections of a partial document, as far as a raw product row can fill them.
PRESENT = """list_filter([CASE WHEN recyclability_score >= 10 THEN 'sustainability' END,
                          CASE WHEN contains(lower(product_name), 'carbon') THEN NULL ELSE 'durability' END,
                          'product', 'materials', 'origin'], lambda s: s IS NOT NULL)"""


@query(
    "missing_sections",
    f"""SELECT product_id, list_aggregate(list_filter({quoted(lookups.PASSPORT_SECTIONS)}, lambda s: NOT list_contains(p, s)), 'string_agg', ',')
               AS missing, {rx(f"CAST(len(p) AS DOUBLE) / {len(lookups.PASSPORT_SECTIONS)} * 100", 1)} AS completeness_pct
        FROM (SELECT product_id, {PRESENT} AS p FROM products_dpp)""",
)
def missing_sections(t):
    """Required sections minus those a partial document holds."""
    from plantmetrics.functions import round_exact

    name = F.lower("product_name")
    present = F.array_compact(
        F.array(
            F.when(F.col("recyclability_score") >= 10, F.lit("sustainability")),
            F.when(~name.contains("carbon"), F.lit("durability")),
            F.lit("product"),
            F.lit("materials"),
            F.lit("origin"),
        )
    )
    frame = t.products_dpp.select("product_id", present.alias("p"))
    return frame.select(
        "product_id",
        F.array_join(passports.missing_sections(F.col("p")), ",").alias("missing"),
        round_exact(F.size("p") / len(lookups.PASSPORT_SECTIONS) * 100, 1).alias("completeness_pct"),
    )


@query("dpp_readiness", f"SELECT brand, {r('avg(completeness_pct)', 6)} AS completeness_pct FROM ({VALIDATED}) GROUP BY 1", VIEWS)
def dpp_readiness(t):
    frame = passports.readiness(passports.validate(documents(t)))
    return frame.withColumn("completeness_pct", round_to(F.col("completeness_pct"), 6))


@query(
    "dpp_batch_summary",
    f"""SELECT count(*) AS generated, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS with_issues
        FROM ({VALIDATED})""",
    VIEWS,
)
def dpp_batch_summary(t):
    return passports.batch_summary(passports.validate(documents(t)))
