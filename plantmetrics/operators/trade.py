"""Import duty, preference schedules and embedded emissions as batch joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import at_least, clip, round_exact
from plantmetrics.functions.text import parse_materials, product_line, zfill


def country_bloc(country: Column) -> Column:
    """EU, CEFTA or EFTA for their members, else the country itself."""
    return (
        F.when(country.isin(lookups.EU), "EU")
        .when(country.isin(lookups.CEFTA), "CEFTA")
        .when(country.isin(lookups.EFTA), "EFTA")
        .otherwise(country)
    )


def with_duty_rate(shipments: DataFrame) -> DataFrame:
    """Full rate by (code, country group); a code or group without one sets ``error`` instead of failing.

    The rate table has 70 rows and the country table 24, both fixed, so they are broadcast.
    """
    spark = shipments.sparkSession
    keyed = shipments.withColumns(
        {"hs_code": zfill(F.col("hs_code"), 6), "destination": F.upper("destination")}
    ).withColumn("bloc", country_bloc(F.col("destination")))
    rates = F.broadcast(lookups.duty_rates(spark))
    joined = keyed.join(rates, (F.col("hs_code") == F.col("code")) & (F.col("bloc") == F.col("rate_bloc")), "left")
    error = (
        F.when(~F.col("hs_code").isin(list(lookups.DUTY_RATES)), "unknown hs code")
        .when(F.col("mfn_rate_pct").isNull(), "no rate for destination")
    )
    return joined.withColumn("error", error).drop("code", "rate_bloc")


def with_agreement(shipments: DataFrame) -> DataFrame:
    """Agreement, multiplier and VAT of the destination; unknown countries pay the full rate and no VAT."""
    table = lookups.countries(shipments.sparkSession).drop("bloc")
    joined = shipments.join(F.broadcast(table), F.col("destination") == F.col("country"), "left").drop("country")
    return joined.withColumns(
        {
            "fta": F.coalesce("fta", F.lit(lookups.NO_AGREEMENT)),
            "multiplier": F.coalesce("multiplier", F.lit(1.0)),
            "vat_rate_pct": F.coalesce("vat_rate_pct", F.lit(0.0)),
        }
    )


def duty_batch(shipments: DataFrame) -> DataFrame:
    """Duty, VAT, landed cost and saving per shipment; rows with an error carry NULL amounts."""
    value = F.col("value_eur")
    frame = with_agreement(with_duty_rate(shipments))
    frame = frame.withColumn("preferential_rate_pct", round_exact(F.col("mfn_rate_pct") * F.col("multiplier"), 2))
    frame = frame.withColumn("duty_eur", round_exact(value * F.col("preferential_rate_pct") / 100, 2))
    frame = frame.withColumn(
        "savings_vs_mfn_eur", round_exact(value * F.col("mfn_rate_pct") / 100 - F.col("duty_eur"), 2)
    )
    frame = frame.withColumn("vat_eur", round_exact((value + F.col("duty_eur")) * F.col("vat_rate_pct") / 100, 2))
    return frame.withColumn(
        "total_landed_cost_eur", round_exact(value + F.col("duty_eur") + F.col("vat_eur"), 2)
    ).drop("multiplier", "bloc")


def preference_schedule(lines: DataFrame) -> DataFrame:
    """Duty, preferential rate, agreement and requirements per (code, country) line."""
    group = country_bloc(F.col("country_destination"))
    table = F.broadcast(lookups.schedule_rates(lines.sparkSession))
    general, us = F.col("general_rate"), F.col("us_rate")
    duty = F.when(F.col("_g") == "US", us).when(F.col("_g") == "CA", round_exact(general * 0.9, 1)).otherwise(general)
    pref = (
        F.when(F.col("_g").isin("EU", "CEFTA", "EFTA"), 0.0)
        .when(F.col("_g") == "TR", round_exact(general * 0.5, 1))
        .otherwise(F.col("duty_rate_percent"))
    )
    agreement, needs = F.lit("None"), F.lit("")
    for name, (text, requirements) in lookups.SCHEDULE_TERMS.items():
        agreement = F.when(F.col("_g") == name, text).otherwise(agreement)
        needs = F.when(F.col("_g") == name, requirements).otherwise(needs)
    return (
        lines.withColumn("_g", group)
        .join(table, F.col("correct_hs_code") == F.col("code"), "left")
        .withColumn("duty_rate_percent", duty)
        .withColumn("preferential_rate", F.when(F.col("duty_rate_percent").isNotNull(), pref))
        .withColumn("fta_applicable", agreement)
        .withColumn("special_requirements", needs)
        .drop("_g", "code", "general_rate", "us_rate")
    )


def saving_by_country(schedule: DataFrame, k: int = 10) -> DataFrame:
    """Mean full rate, preferential rate and saving per country; the k highest savings."""
    return (
        schedule.groupBy("country_destination")
        .agg(
            F.avg("duty_rate_percent").alias("mfn"),
            F.avg("preferential_rate").alias("pref"),
            F.avg(F.col("duty_rate_percent") - F.col("preferential_rate")).alias("saving"),
        )
        .orderBy(F.desc(F.round("saving", 6)), "country_destination")
        .limit(k)
    )


def with_hs_name(frame: DataFrame, code: str = "hs_code") -> DataFrame:
    names = F.broadcast(lookups.hs_names(frame.sparkSession).withColumnRenamed("hs_code", "_code"))
    return (
        frame.join(names, F.col(code) == F.col("_code"), "left")
        .withColumn("description", F.coalesce("description", F.lit("")))
        .drop("_code")
    )


def material_weights(products: DataFrame) -> DataFrame:
    """One row per product and material with its weight in kg; names in lower case."""
    lowered = F.transform(
        parse_materials(F.col("materials_composition")),
        lambda m: F.struct(F.lower(m["name"]).alias("name"), m["pct"].alias("pct")),
    )
    return products.select("product_id", "weight_grams", F.posexplode(lowered).alias("part_no", "m")).select(
        "product_id",
        "part_no",
        F.col("m.name").alias("material"),
        (F.col("weight_grams") / 1000 * F.col("m.pct") / 100).alias("weight_kg"),
    )


def with_emission_factor(materials: DataFrame) -> DataFrame:
    factors = F.broadcast(lookups.emission_factors(materials.sparkSession))
    default = F.lit(lookups.DEFAULT_EMISSION_FACTOR)
    return materials.join(factors, "material", "left").withColumn("factor", F.coalesce("factor", default))


def embedded_emissions(products: DataFrame) -> DataFrame:
    """Reported or material-based emissions, the larger one, plus sea transport, per product.

    The materials of a product are a short array in its own row, so they are summed there, without a shuffle.
    """
    factors = F.create_map(*[F.lit(x) for pair in lookups.EMISSION_FACTORS.items() for x in pair])
    kg = F.col("weight_grams") / 1000
    material = F.aggregate(
        parse_materials(F.col("materials_composition")),
        F.lit(0.0),
        lambda total, m: total
        + kg
        * m["pct"]
        / 100
        * F.coalesce(F.try_element_at(factors, F.lower(m["name"])), F.lit(lookups.DEFAULT_EMISSION_FACTOR)),
    )
    transport = F.col("weight_grams") / 1_000_000 * lookups.SEA_KM * lookups.SEA_KG_PER_TKM
    total = F.greatest(F.col("carbon_footprint_kg"), material) + transport
    return products.withColumn("emissions_kg", round_exact(total, 3))


def emission_rollup(emissions: DataFrame) -> DataFrame:
    """Products and emissions by country, by brand and in total, in one pass."""
    sets = emissions.groupingSets([["country_origin"], ["brand"], []], "country_origin", "brand").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("emissions_kg").alias("emissions_kg"),
        F.avg("emissions_kg").alias("avg_kg"),
        F.sum(F.col("weight_grams") / 1000).alias("weight_kg"),
    )
    level = F.when(F.col("country_origin").isNotNull(), "country").when(F.col("brand").isNotNull(), "brand")
    return sets.select(
        F.coalesce(level, F.lit("total")).alias("level"),
        F.coalesce("country_origin", "brand", F.lit("all")).alias("value"),
        "products",
        "emissions_kg",
        (F.col("emissions_kg") / 1000).alias("emissions_tonnes"),
        "avg_kg",
        "weight_kg",
    )


def certificate_cost(tonnes: Column, price_eur: float = 80.0) -> Column:
    return tonnes * price_eur


def carbon_by_line(products: DataFrame) -> DataFrame:
    """Mean, total and count of the footprint per product line, with a band for display."""
    per = products.groupBy(product_line(F.col("product_name")).alias("product_line")).agg(
        F.avg("carbon_footprint_kg").alias("mean_kg"),
        F.sum("carbon_footprint_kg").alias("sum_kg"),
        F.count(F.lit(1)).alias("products"),
    )
    return per.withColumn("band", carbon_band(F.col("mean_kg"))).orderBy(F.desc("mean_kg"), "product_line")


def carbon_band(value: Column) -> Column:
    return F.when(value > 10, "high").when(value > 5, "medium").otherwise("low")


def readiness_band(value: Column) -> Column:
    return F.when(value >= 90, "ready").when(value >= 70, "partial").otherwise("gap")


def risk_matrix(products: DataFrame) -> DataFrame:
    """Five scores from 0 to 10 per product line, from one aggregation."""
    risky = F.coalesce(F.col("hazardous_substances").rlike("(?i)traces|epoxy"), F.lit(False))
    per = products.groupBy(product_line(F.col("product_name")).alias("product_line")).agg(
        F.count_distinct("hs_code_6digit").alias("codes"),
        F.avg("recyclability_score").alias("recyclability"),
        F.avg("carbon_footprint_kg").alias("carbon"),
        F.avg(risky.cast("double")).alias("risky"),
        F.count_distinct("country_origin").alias("origins"),
    )
    return per.select(
        "product_line",
        clip(F.col("codes") * 2.0, high=10.0).alias("hs_misclassification"),
        at_least(10 - F.col("recyclability") / 10, 0.0).alias("passport_gaps"),
        clip(F.col("carbon") / 1.5, high=10.0).alias("carbon_exposure"),
        (F.col("risky") * 8).alias("substance_risk"),
        clip(F.col("origins") * 1.5, high=10.0).alias("origin_complexity"),
    )
