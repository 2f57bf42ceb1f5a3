"""Product passports: nested documents, validation and readiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions import round_exact
from plantmetrics.functions.text import gtin, model_name, parse_materials, passport_id, share_containing

TEMPLATE_FIELDS = ["care", "repair", "disassembly", "recyclable", "disposal"]


def template_name(product_name: Column, templates: dict = lookups.CARE_TEMPLATES) -> Column:
    """The first template whose key occurs in the name, whatever the case; else the fallback."""
    chosen = F.lit(lookups.FALLBACK_TEMPLATE)
    for key in reversed(list(templates)):
        chosen = F.when(F.lower(product_name).contains(key.lower()), key).otherwise(chosen)
    return chosen


def _template_struct(texts: tuple) -> Column:
    return F.struct(
        *[
            (F.array(*[F.lit(x) for x in text]) if isinstance(text, list) else F.lit(text)).alias(field)
            for field, text in zip(TEMPLATE_FIELDS, texts)
        ]
    )


def template(product_name: Column, templates: dict = lookups.CARE_TEMPLATES) -> Column:
    """Care texts of the matching template as a struct."""
    table = F.create_map(*[c for k, texts in templates.items() for c in (F.lit(k), _template_struct(texts))])
    return F.element_at(table, template_name(product_name, templates))


def passport(
    products: DataFrame,
    issued: dt.date,
    manufacturer: dict[str, str],
    id_prefix: str = "DPP-",
    templates: dict = lookups.CARE_TEMPLATES,
) -> DataFrame:
    """One row per product: its keys and the eleven-section document as a struct column ``dpp``."""
    materials = parse_materials(F.col("materials_composition"))
    carbon, kg = F.col("carbon_footprint_kg"), F.col("weight_grams") / 1000
    frame = products.withColumn("_t", template(F.col("product_name"), templates)).withColumn("_m", materials)
    document = F.struct(
        F.lit("1.0").alias("dpp_version"),
        passport_id(F.col("product_id"), id_prefix).alias("unique_id"),
        F.lit(issued).alias("issued_date"),
        F.struct(*[F.lit(v).alias(k) for k, v in manufacturer.items()]).alias("manufacturer"),
        F.struct(
            F.col("product_name").alias("name"),
            F.col("brand"),
            model_name(F.col("product_name")).alias("model"),
            gtin(F.col("product_id")).alias("gtin"),
            F.col("hs_code_6digit").alias("hs_code"),
            F.col("weight_grams"),
        ).alias("product"),
        F.struct(
            F.map_from_entries("_m").alias("composition"),
            share_containing(F.col("_m"), "recycled").alias("recycled_content_pct"),
            F.coalesce("hazardous_substances", F.lit("REACH compliant")).alias("hazardous_substances"),
            F.lit(True).alias("restricted_substances_tested"),
        ).alias("materials"),
        F.struct(
            F.col("carbon_footprint_kg"),
            F.lit("ISO 14067").alias("carbon_footprint_methodology"),
            round_exact(carbon * 2.8, 2).alias("energy_consumption_kwh"),
            round_exact(kg * 45, 1).alias("water_consumption_liters"),
            F.col("recyclability_score"),
            F.col("_t.disassembly").alias("disassembly_instructions"),
        ).alias("sustainability"),
        F.struct(
            F.col("country_origin").alias("country"),
            F.col("factory_id").alias("factory"),
            F.col("production_date"),
            F.col("batch_number").alias("batch"),
        ).alias("origin"),
        F.struct(
            F.lit(True).alias("ce_marking"),
            F.lit(True).alias("reach"),
            (~F.coalesce("hazardous_substances", F.lit("")).contains("SVHC")).alias("oeko_tex"),
        ).alias("compliance"),
        F.struct(
            F.when(F.col("product_name").contains("Carbon"), 3).otherwise(5).alias("expected_lifetime_years"),
            F.col("_t.care").alias("care_instructions"),
            F.col("_t.repair").alias("repair_info"),
        ).alias("durability"),
        F.struct(
            F.col("_t.recyclable").alias("recyclable_components"),
            F.col("_t.disposal").alias("disposal_instructions"),
        ).alias("end_of_life"),
    )
    return frame.select("product_id", "brand", document.alias("dpp"))


def _filled(section: str, present: Column) -> Column:
    return F.when(present, F.lit(section))


def missing_sections(present: Column) -> Column:
    """Required sections that are not in the array of present ones, in document order."""
    return F.array_except(F.array(*[F.lit(s) for s in lookups.PASSPORT_SECTIONS]), present)


def present_sections(passports: DataFrame) -> Column:
    """Names of the sections a document holds."""
    fields = {f.name for f in passports.schema["dpp"].dataType.fields}
    names = [_filled(s, F.col(f"dpp.{s}").isNotNull()) for s in lookups.PASSPORT_SECTIONS if s in fields]
    return F.array_compact(F.array(*names))


def validate(passports: DataFrame) -> DataFrame:
    """Validity, missing sections, warnings and completeness of each document."""
    present = present_sections(passports)
    warnings = F.array_compact(
        F.array(
            F.when(
                F.coalesce("dpp.materials.recycled_content_pct", F.lit(0)) == 0,
                "No recycled content declared — verify with supplier.",
            ),
            F.when(
                F.coalesce("dpp.sustainability.recyclability_score", F.lit(0)) < 50,
                "Recyclability score below 50% — may not meet EU 2030 targets.",
            ),
            F.when(
                ~F.coalesce("dpp.compliance.oeko_tex", F.lit(False)),
                "OEKO-TEX certification missing — consider testing.",
            ),
        )
    )
    total = len(lookups.PASSPORT_SECTIONS)
    return passports.select(
        "product_id",
        "brand",
        missing_sections(present).alias("missing_fields"),
        warnings.alias("warnings"),
        round_exact(F.size(present) / total * 100, 1).alias("completeness_pct"),
    ).withColumn("valid", F.size("missing_fields") == 0)


def readiness(validated: DataFrame) -> DataFrame:
    return validated.groupBy("brand").agg(F.avg("completeness_pct").alias("completeness_pct"))


def batch_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("with_issues"),
    )
