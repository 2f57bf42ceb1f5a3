"""Queries on shipments, tariff lines and emissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import round_to
from plantmetrics.functions.text import parse_materials, zfill
from plantmetrics.operators import trade
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import r, rx
from plantmetrics.sources.readers import with_padded_code

KEYS = ["k1", "k2", "k3", "k4"]
BLOC = """CASE WHEN {0} IN ('%s') THEN 'EU' WHEN {0} IN ('%s') THEN 'CEFTA' WHEN {0} IN ('%s') THEN 'EFTA' ELSE {0} END""" % (
    "', '".join(lookups.EU),
    "', '".join(lookups.CEFTA),
    "', '".join(lookups.EFTA),
)
ZFILL = "CASE WHEN length({0}) < 6 THEN lpad({0}, 6, '0') ELSE {0} END"
VIEWS = {
    "duty_table": lookups.values_sql(lookups.duty_rows(), "code, rate_bloc, mfn_rate_pct"),
    "country_table": lookups.values_sql(lookups.country_rows(), "country, bloc, fta, multiplier, vat_rate_pct"),
    "schedule_table": lookups.values_sql(
        [(c, *v) for c, v in lookups.SCHEDULE_RATES.items()], "code, general_rate, us_rate"
    ),
    "term_table": lookups.values_sql([(g, *v) for g, v in lookups.SCHEDULE_TERMS.items()], "grp, agreement, needs"),
    "name_table": lookups.values_sql(list(lookups.HS_NAMES.items()), "code, description"),
    "factor_table": lookups.values_sql(list(lookups.EMISSION_FACTORS.items()), "material, factor"),
}
VIEWS["rated"] = f"""
    SELECT s.*, d.mfn_rate_pct, CASE WHEN hs NOT IN (SELECT code FROM duty_table) THEN 'unknown hs code'
           WHEN d.mfn_rate_pct IS NULL THEN 'no rate for destination' END AS error
    FROM (SELECT k1, k2, k3, k4, value_eur, {ZFILL.format("hs_code")} AS hs, upper(destination) AS dest FROM shipments) s
    LEFT JOIN duty_table d ON d.code = s.hs AND d.rate_bloc = {BLOC.format("s.dest")}"""
VIEWS["agreed"] = f"""
    SELECT r.*, coalesce(c.fta, '{lookups.NO_AGREEMENT}') AS fta, coalesce(c.multiplier, 1.0) AS multiplier,
           coalesce(c.vat_rate_pct, 0.0) AS vat_rate_pct
    FROM rated r LEFT JOIN country_table c ON c.country = r.dest"""
VIEWS["schedule"] = f"""
    SELECT line_no, product_description, correct_hs_code, country_destination, duty_rate_percent,
           CASE WHEN duty_rate_percent IS NOT NULL THEN CASE WHEN g IN ('EU', 'CEFTA', 'EFTA') THEN 0.0
                WHEN g = 'TR' THEN {rx("general_rate * CAST(0.5 AS DOUBLE)", 1)} ELSE duty_rate_percent END END AS preferential_rate,
           coalesce(agreement, 'None') AS fta_applicable, coalesce(needs, '') AS special_requirements
    FROM (SELECT *, CASE WHEN g = 'US' THEN us_rate WHEN g = 'CA' THEN {rx("general_rate * CAST(0.9 AS DOUBLE)", 1)} ELSE general_rate END
                 AS duty_rate_percent
          FROM (SELECT *, {BLOC.format("country_destination")} AS g FROM tariff_lines)
          LEFT JOIN schedule_table ON code = correct_hs_code) LEFT JOIN term_table ON grp = g"""
# products, one row per material in text order
PARSED = r"""
    SELECT product_id, clean, regexp_extract_all(clean, '(?i)([a-z ]+?)\s+(\d+)%', 1) AS names,
           regexp_extract_all(clean, '(?i)([a-z ]+?)\s+(\d+)%', 2) AS shares
    FROM (SELECT product_id, regexp_replace(trim(materials_composition), '^[a-z]+:\s*', '') AS clean FROM products_dpp)"""
VIEWS["materials"] = f"""
    SELECT product_id, part_no, name, pct FROM (
        SELECT product_id, CAST(unnest(generate_series(0, len(names) - 1)) AS INT) AS part_no, trim(unnest(names)) AS name,
               CAST(unnest(shares) AS INT) AS pct FROM ({PARSED}) WHERE len(names) > 0)
    QUALIFY row_number() OVER (PARTITION BY product_id, name ORDER BY part_no DESC) = 1
    UNION ALL SELECT product_id, 0, clean, 100 FROM ({PARSED}) WHERE len(names) = 0"""
VIEWS["weighed"] = """
    SELECT m.product_id, part_no, lower(name) AS material, CAST(weight_grams AS DOUBLE) / 1000 * pct / 100 AS weight_kg,
           coalesce(factor, 5.0) AS factor
    FROM materials m JOIN products_dpp p ON p.product_id = m.product_id LEFT JOIN factor_table f ON f.material = lower(name)"""
VIEWS["emitted"] = f"""
    SELECT p.*, {rx("greatest(carbon_footprint_kg, m) + CAST(weight_grams AS DOUBLE) / 1000000 * 15000 * CAST(0.016 AS DOUBLE)", 3)} AS emissions_kg
    FROM products_dpp p JOIN (SELECT product_id, list_reduce(list(weight_kg * factor ORDER BY part_no), lambda a, b: a + b) AS m
                              FROM weighed GROUP BY 1) w USING (product_id)"""
LINE = r"regexp_replace(product_name, '\s+v\d+$', '')"


@query("country_bloc", f"SELECT *, {BLOC.format('destination')} AS bloc FROM (SELECT k1, k2, k3, k4, destination FROM shipments)")
def country_bloc(t):
    return t.shipments.select(*KEYS, "destination", trade.country_bloc(F.col("destination")).alias("bloc"))


@query(
    "duty_lookup",
    "SELECT k1, k2, k3, k4, hs AS hs_code, dest AS destination, mfn_rate_pct, error FROM rated",
    VIEWS,
)
def duty_lookup(t):
    return trade.with_duty_rate(t.shipments).select(*KEYS, "hs_code", "destination", "mfn_rate_pct", "error")


@query(
    "fta_vat_default",
    "SELECT k1, k2, k3, k4, dest AS destination, fta, multiplier, vat_rate_pct FROM agreed",
    VIEWS,
)
def fta_vat_default(t):
    shipments = t.shipments.withColumn("destination", F.upper("destination"))
    return trade.with_agreement(shipments).select(*KEYS, "destination", "fta", "multiplier", "vat_rate_pct")


@query(
    "duty_batch",
    f"""WITH p AS (SELECT *, {rx("mfn_rate_pct * multiplier", 2)} AS pref FROM agreed),
        d AS (SELECT *, {rx("value_eur * pref / 100", 2)} AS duty FROM p),
        v AS (SELECT *, {rx("value_eur * mfn_rate_pct / 100 - duty", 2)} AS saving,
                     {rx("(value_eur + duty) * vat_rate_pct / 100", 2)} AS vat FROM d)
        SELECT k1, k2, k3, k4, hs AS hs_code, dest AS destination, value_eur, mfn_rate_pct, error, fta, vat_rate_pct,
               pref AS preferential_rate_pct, duty AS duty_eur, saving AS savings_vs_mfn_eur, vat AS vat_eur,
               {rx("value_eur + duty + vat", 2)} AS total_landed_cost_eur FROM v""",
    VIEWS,
)
def duty_batch(t):
    return trade.duty_batch(t.shipments)


@query("str_zfill", f"""SELECT DISTINCT correct_hs_code AS raw, {ZFILL.format("correct_hs_code")} AS code,
                        upper(country_destination) AS country FROM tariff_lines""")
def str_zfill(t):
    return t.tariff_lines.select(
        F.col("correct_hs_code").alias("raw"),
        zfill(F.col("correct_hs_code"), 6).alias("code"),
        F.upper("country_destination").alias("country"),
    ).distinct()


@query("preference_schedule", "SELECT * FROM schedule", VIEWS)
def preference_schedule(t):
    return trade.preference_schedule(t.tariff_lines)


@query(
    "scan_hs",
    f"""SELECT line_no, product_description, {ZFILL.format("correct_hs_code")} AS correct_hs_code, country_destination,
               duty_rate_percent, preferential_rate, fta_applicable, special_requirements FROM schedule""",
    VIEWS,
)
def scan_hs(t):
    return with_padded_code(trade.preference_schedule(t.tariff_lines), "correct_hs_code")


@query(
    "duty_saving_by_country",
    f"""SELECT country_destination, {r("mfn", 6)} AS mfn, {r("pref", 6)} AS pref, {r("saving", 6)} AS saving FROM (
            SELECT country_destination, avg(duty_rate_percent) AS mfn, avg(preferential_rate) AS pref,
                   avg(duty_rate_percent - preferential_rate) AS saving
            FROM schedule GROUP BY 1 ORDER BY round(saving, 6) DESC NULLS LAST, country_destination LIMIT 10)""",
    VIEWS,
)
def duty_saving_by_country(t):
    frame = trade.saving_by_country(trade.preference_schedule(t.tariff_lines))
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("mfn", "pref", "saving")})


@query(
    "hs_name_lookup",
    """SELECT line_no, correct_hs_code, coalesce(description, '') AS description
       FROM tariff_lines LEFT JOIN name_table ON code = correct_hs_code""",
    VIEWS,
)
def hs_name_lookup(t):
    return trade.with_hs_name(t.tariff_lines.select("line_no", "correct_hs_code"), "correct_hs_code")


@query("arr_parse_materials", "SELECT product_id, part_no, name, pct FROM materials", VIEWS)
def arr_parse_materials(t):
    parts = F.posexplode(parse_materials(F.col("materials_composition"))).alias("part_no", "m")
    return t.products_dpp.select("product_id", parts).select("product_id", "part_no", "m.name", "m.pct")


@query(
    "emission_lookup",
    f"""SELECT product_id, part_no, material, {r("weight_kg", 6)} AS weight_kg, factor FROM weighed""",
    VIEWS,
)
def emission_lookup(t):
    frame = trade.with_emission_factor(trade.material_weights(t.products_dpp))
    return frame.withColumn("weight_kg", round_to(F.col("weight_kg"), 6))


@query("embedded_emissions", "SELECT product_id, emissions_kg FROM emitted", VIEWS)
def embedded_emissions(t):
    return trade.embedded_emissions(t.products_dpp).select("product_id", "emissions_kg")


ROLLUP = f"""SELECT CASE WHEN country_origin IS NOT NULL THEN 'country' WHEN brand IS NOT NULL THEN 'brand' ELSE 'total' END AS level,
          coalesce(country_origin, brand, 'all') AS value, count(*) AS products, {r("sum(emissions_kg)", 3)} AS emissions_kg,
          {r("sum(emissions_kg) / 1000", 4)} AS emissions_tonnes, {r("avg(emissions_kg)", 6)} AS avg_kg,
          {r("sum(CAST(weight_grams AS DOUBLE) / 1000)", 3)} AS weight_kg
   FROM emitted GROUP BY GROUPING SETS ((country_origin), (brand), ())"""


def rollup(t):
    frame = trade.emission_rollup(trade.embedded_emissions(t.products_dpp))
    digits = {"emissions_kg": 3, "emissions_tonnes": 4, "avg_kg": 6, "weight_kg": 3}
    return frame.withColumns({c: round_to(F.col(c), d) for c, d in digits.items()})


@query("cbam_rollup", ROLLUP, VIEWS)
def cbam_rollup(t):
    return rollup(t)


@query(
    "cbam_cost",
    f"SELECT level, value, emissions_tonnes, {rx('emissions_tonnes * CAST(80.0 AS DOUBLE)', 2)} AS cost_eur FROM ({ROLLUP})",
    VIEWS,
)
def cbam_cost(t):
    from plantmetrics.functions import round_exact

    cost = round_exact(trade.certificate_cost(F.col("emissions_tonnes")), 2)
    return rollup(t).select("level", "value", "emissions_tonnes", cost.alias("cost_eur"))


@query(
    "carbon_by_line",
    f"""SELECT product_line, {r("m", 6)} AS mean_kg, {r("s", 4)} AS sum_kg, products,
               CASE WHEN m > 10 THEN 'high' WHEN m > 5 THEN 'medium' ELSE 'low' END AS band
        FROM (SELECT {LINE} AS product_line, avg(carbon_footprint_kg) AS m, sum(carbon_footprint_kg) AS s, count(*) AS products
              FROM products_dpp GROUP BY 1)""",
)
def carbon_by_line(t):
    frame = trade.carbon_by_line(t.products_dpp)
    return frame.withColumns({"mean_kg": round_to(F.col("mean_kg"), 6), "sum_kg": round_to(F.col("sum_kg"), 4)})


@query(
    "band_colour",
    """SELECT product_id, CASE WHEN carbon_footprint_kg > 10 THEN 'high' WHEN carbon_footprint_kg > 5 THEN 'medium' ELSE 'low' END
              AS carbon_band, CASE WHEN recyclability_score >= 90 THEN 'ready' WHEN recyclability_score >= 70 THEN 'partial' ELSE 'gap' END
              AS readiness_band FROM products_dpp""",
)
def band_colour(t):
    return t.products_dpp.select(
        "product_id",
        trade.carbon_band(F.col("carbon_footprint_kg")).alias("carbon_band"),
        trade.readiness_band(F.col("recyclability_score")).alias("readiness_band"),
    )


SCORES = ["hs_misclassification", "passport_gaps", "carbon_exposure", "substance_risk", "origin_complexity"]


@query(
    "risk_matrix",
    f"""SELECT {LINE} AS product_line,
               {r("least(count(DISTINCT hs_code_6digit) * 2.0, 10.0)", 6)} AS hs_misclassification,
               {r("greatest(10 - avg(recyclability_score) / 10, 0.0)", 6)} AS passport_gaps,
               {r("least(avg(carbon_footprint_kg) / 1.5, 10.0)", 6)} AS carbon_exposure,
               {r("avg(CASE WHEN regexp_matches(hazardous_substances, '(?i)traces|epoxy') THEN 1.0 ELSE 0.0 END) * 8", 6)} AS substance_risk,
               {r("least(count(DISTINCT country_origin) * 1.5, 10.0)", 6)} AS origin_complexity
        FROM products_dpp GROUP BY 1""",
)
def risk_matrix(t):
    return trade.risk_matrix(t.products_dpp).withColumns({c: round_to(F.col(c), 6) for c in SCORES})


@query(
    "contains_any",
    """SELECT product_id, coalesce(regexp_matches(hazardous_substances, '(?i)traces|epoxy'), false) AS risky,
              coalesce(regexp_matches(materials_composition, '(?i)recycled'), false) AS recycled FROM products_dpp""",
)
def contains_any(t):
    def flag(column, pattern):
        return F.coalesce(F.col(column).rlike(pattern), F.lit(False))

    return t.products_dpp.select(
        "product_id",
        flag("hazardous_substances", "(?i)traces|epoxy").alias("risky"),
        flag("materials_composition", "(?i)recycled").alias("recycled"),
    )
