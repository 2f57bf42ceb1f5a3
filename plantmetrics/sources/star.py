"""The plant's tables as views over a star schema of orders, line items, parts and events.

Each view is a projection (and, where two tables are named, a join), so filters and column choices of
the operators reach the Parquet scans.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmetrics import lookups
from plantmetrics.functions.text import words

BRANDS = ["Brand1", "Brand2", "Brand3"]
DETECTION_POINTS = ["incoming", "inline", "final", "customer_return"]
# Samples: one per care template and one without, compositions and notes of every kind that the operators tell apart.
PRODUCT_LINES = ["Knit Upper", "Court Collar", "Garden Strap", "Trail Sole", "Race Carbon Plate", "Walker"]
PRODUCT_HS = ["640411", "640610", "640299", "640620"]
PRODUCT_ORIGINS = ["PT", "CN", "MA", "PL", "VN", "BR", "IN"]
COMPOSITIONS = [
    "upper: polyester 60% nylon 25% elastane 15%",
    "recycled polyester 80% elastane 20%",
    "croslite 100%",
    "sole: Rubber 75% EVA 25%",
    "felt",
]
HAZARDS = [
    "REACH compliant",
    "tested, SVHC below 0.1%",
    "chrome in the leather",
    "glue with epoxy",
    "not declared",
    "SVHC found",
]
SHIPMENT_HS = ["640411", "640610", "640299", "640110", "999999"]
SHIPMENT_DESTINATIONS = ["DE", "US", "RS", "CH", "TR", "CA", "de", "JP"]
# every code of the duty table, one that is too short and one that is too long; every country with a VAT rate and one without
TARIFF_HS = [*lookups.DUTY_RATES, "64011", "64041190"]
TARIFF_COUNTRIES = [*lookups.VAT_RATES, "JP"]


def pick(values: list[str], position: Column) -> Column:
    """The value at a 0-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def stored_between(df: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of [start, end); the bound sits on the stored column, so Parquet row groups are skipped."""
    low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (start, end))
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def _int(column: Column) -> Column:
    return column.cast("int")


class Star:
    """Lazy views; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.kept: dict[str, object] = {}  # frames that a query's parts share

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- production ---------------------------------------------------------------------------------
    @cached_property
    def production_log(self) -> DataFrame:
        return self._production(self.table("lineitem"))

    def production_between(self, start: dt.date, end: dt.date) -> DataFrame:
        return self._production(stored_between(self.table("lineitem"), "l_shipdate", start, end))

    def _production(self, items: DataFrame) -> DataFrame:
        q = items.withColumn("_actual", F.floor(F.col("l_quantity") * 10 * (1 - F.col("l_discount"))))
        return q.select(
            F.col("l_shipdate").cast("date").alias("date"),
            _int((F.col("l_linenumber") - 1) % 3 + 1).alias("shift"),
            F.concat(F.lit("L"), (F.col("l_suppkey") % 8 + 1).cast("string")).alias("line_id"),
            F.concat(F.lit("Brand"), (F.col("l_partkey") % 3 + 1).cast("string")).alias("brand"),
            F.concat(F.lit("Model"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("model_name"),
            _int(F.col("l_quantity") * 10).alias("planned_qty"),
            _int(F.col("_actual")).alias("actual_qty"),
            _int(F.floor(F.col("_actual") * F.col("l_tax"))).alias("defect_qty"),
            _int((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 240).alias("downtime_minutes"),
            _int(F.col("l_partkey") % 90).alias("changeover_minutes"),
            _int(4 + F.col("l_partkey") % 9).alias("operator_count"),
            F.concat(F.lit("M"), (F.col("l_suppkey") % 20).cast("string")).alias("machine_id"),
            ((1 - F.col("l_discount")) * (1 - F.col("l_tax"))).alias("oee_score"),
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").alias("k2"),
            F.col("l_partkey").alias("k3"),
            F.col("l_suppkey").alias("k4"),
        )

    # -- quality ------------------------------------------------------------------------------------
    @cached_property
    def defect_log(self) -> DataFrame:
        return self._defects(self.table("lineitem"))

    def defects_between(self, start: dt.date, end: dt.date) -> DataFrame:
        return self._defects(stored_between(self.table("lineitem"), "l_shipdate", start, end))

    def _defects(self, items: DataFrame) -> DataFrame:
        returned = items.where(F.col("l_returnflag") == "R")
        orders = self.table("orders").select("o_orderkey", "o_orderpriority")
        parts = self.table("part").select("p_partkey", "p_type")
        rows = returned.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            parts, F.col("l_partkey") == F.col("p_partkey")
        )
        priority = F.substring("o_orderpriority", 1, 1)
        return rows.select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.concat(F.lit("L"), (F.col("l_suppkey") % 8 + 1).cast("string")).alias("line_id"),
            F.concat(F.lit("Brand"), (F.col("l_partkey") % 3 + 1).cast("string")).alias("brand"),
            F.concat(F.lit("Model"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("model_name"),
            F.concat(F.lit("INS_"), F.lpad((F.col("l_suppkey") % 15 + 1).cast("string"), 2, "0")).alias(
                "inspector_id"
            ),
            F.col("p_type").alias("defect_type"),
            F.when(priority == "1", "critical")
            .when(priority.isin("2", "3"), "major")
            .otherwise("minor")
            .alias("severity"),
            F.when(F.col("l_orderkey") % 10 < 3, "scrap")
            .when(F.col("l_orderkey") % 10 < 7, "rework")
            .otherwise("pass")
            .alias("action"),
            pick(DETECTION_POINTS, F.col("l_suppkey") % 4).alias("detection_point"),
            _int(10 + F.col("l_partkey") % 80).alias("inspection_time_seconds"),
            (F.col("l_linenumber") % 2 == 0).alias("photo_taken"),
        )

    # -- supply chain -------------------------------------------------------------------------------
    @cached_property
    def inventory(self) -> DataFrame:
        # parts are dealt over all suppliers, whose keys are 0 to n - 1
        suppliers = self.table("supplier")
        count = suppliers.agg(F.count(F.lit(1))).scalar()
        parts = self.table("part").withColumn("_supplier", F.col("p_partkey") % count)
        rows = parts.join(suppliers, F.col("_supplier") == F.col("s_suppkey"))
        key = F.col("p_partkey")
        return rows.select(
            F.concat(F.lit("MAT_"), key.cast("string")).alias("material_id"),
            F.col("p_name").alias("material_name"),
            F.col("p_type").alias("category"),
            F.col("s_name").alias("supplier"),
            F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country_origin"),
            _int(key * 37 % 5000).alias("current_stock"),
            _int(key * 53 % 1500).alias("reorder_point"),
            _int(2 + F.col("p_size")).alias("lead_time_days"),
            F.col("p_retailprice").alias("unit_price_eur"),
            _int(key % 60).alias("consumption_rate_daily"),
            (640100 + key % 10).cast("string").alias("hs_code"),
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return self._purchases(self.table("orders"))

    def purchases_between(self, start: dt.date, end: dt.date) -> DataFrame:
        return self._purchases(stored_between(self.table("orders"), "o_orderdate", start, end))

    def _purchases(self, orders: DataFrame) -> DataFrame:
        order, cust = F.col("o_orderkey"), F.col("o_custkey")
        day = F.col("o_orderdate").cast("date")
        ordered = 10 + order % 300
        delay = F.when(order % 4 == 0, cust % 15).otherwise(0)
        expected = F.date_add(day, _int(20 + cust % 30))
        return orders.select(
            F.concat(F.lit("PO-"), order.cast("string")).alias("po_number"),
            day.alias("date"),
            F.concat(F.lit("S"), (cust % 20).cast("string")).alias("supplier"),
            F.concat(F.lit("MAT_"), cust.cast("string")).alias("material_id"),
            _int(ordered).alias("qty_ordered"),
            _int(F.when(order % 12 == 0, F.floor(ordered * 0.75)).otherwise(ordered)).alias("qty_received"),
            F.col("o_totalprice").alias("total_eur"),
            expected.alias("expected_delivery"),
            F.date_add(expected, _int(delay)).alias("actual_delivery"),
            _int(delay).alias("delay_days"),
            _int(1 + cust % 5).alias("quality_score"),
        )

    # -- products and trade -------------------------------------------------------------------------
    @cached_property
    def products_dpp(self) -> DataFrame:
        key = F.col("p_partkey")
        made = F.date_add(F.lit(dt.date(1995, 1, 1)), _int(key % 2400))
        return self.table("part").select(
            F.concat(F.lit("PROD-"), key.cast("string")).alias("product_id"),
            F.concat_ws(" ", "p_name", pick(PRODUCT_LINES, key % 6), F.concat(F.lit("v"), (key % 9 + 1).cast("string"))).alias(
                "product_name"
            ),
            F.concat(F.lit("Brand"), (key % 3 + 1).cast("string")).alias("brand"),
            pick(PRODUCT_HS, key % 4).alias("hs_code_6digit"),
            pick(PRODUCT_ORIGINS, key % 7).alias("country_origin"),
            pick(COMPOSITIONS, key % 5).alias("materials_composition"),
            _int(40 + F.col("p_size") * 7).alias("weight_grams"),
            (F.col("p_retailprice") / 200).alias("carbon_footprint_kg"),
            _int(F.col("p_size") * 2).alias("recyclability_score"),
            pick(HAZARDS, key % 6).alias("hazardous_substances"),
            F.concat(F.lit("FAC-"), (key % 20).cast("string")).alias("factory_id"),
            made.alias("production_date"),
            F.concat(F.lit("B"), F.date_format(made, "yyyyMM"), F.lit("-"), (1000 + key % 9000).cast("string")).alias(
                "batch_number"
            ),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").alias("k2"),
            F.col("l_partkey").alias("k3"),
            F.col("l_suppkey").alias("k4"),
            pick(SHIPMENT_HS, F.col("l_partkey") % 5).alias("hs_code"),
            pick(SHIPMENT_DESTINATIONS, F.col("l_suppkey") % 8).alias("destination"),
            F.col("l_extendedprice").alias("value_eur"),
        )

    @cached_property
    def tariff_lines(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("line_no"),
            F.concat_ws(" ", "p_name", "p_type").alias("product_description"),
            pick(TARIFF_HS, key % len(TARIFF_HS)).alias("correct_hs_code"),
            pick(TARIFF_COUNTRIES, key % len(TARIFF_COUNTRIES)).alias("country_destination"),
        )

    # -- text ---------------------------------------------------------------------------------------
    @cached_property
    def corpus(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("file_name"),
            "text",
            F.size(words(F.col("text"))).alias("word_count"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        return (
            self.table("conversations")
            .where(F.col("role") == "user")
            .select(
                F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
                F.col("text").alias("question"),
            )
        )

    # -- inspections and planning -------------------------------------------------------------------
    @cached_property
    def inspections(self) -> DataFrame:
        return inspections(self.table("events"))

    @cached_property
    def query_log(self) -> DataFrame:
        return query_log(self.table("events"))

    @cached_property
    def orders_to_plan(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.concat(F.lit("Brand"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("brand"),
            F.concat(F.lit("Model"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("model"),
            _int(100 + F.col("o_orderkey") % 400).alias("qty"),
            F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date")).alias("deadline"),
        )


def inspections(events: DataFrame) -> DataFrame:
    """Camera inspections from raw events; works on a stream as on a table."""
    return events.select(
        F.col("event_id").alias("inspection_id"),
        "ts",
        F.concat(F.lit("ST"), (F.col("user_id") % 6).cast("string")).alias("station"),
        F.when(F.col("event_type") == "error", "defect").otherwise("ok").alias("prediction"),
        F.when(F.col("user_id") % 5 == 0, "defect").otherwise("ok").alias("actual_label"),
        F.col("value").alias("processing_time_ms"),
    )


def query_log(events: DataFrame) -> DataFrame:
    """Question log from raw events; works on a stream as on a table."""
    return events.select(
        "ts",
        F.concat(F.lit("DOC"), (F.col("user_id") % 10).cast("string")).alias("top_source"),
        (F.col("event_id") % 101 / 100.0).alias("confidence"),
        F.col("value").alias("response_time_ms"),
        F.concat(F.lit("topic"), (F.col("user_id") % 6).cast("string")).alias("topic"),
    )
