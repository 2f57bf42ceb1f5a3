"""Queries that write to the shared folder and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import demand, index_store, retrieval
from plantmetrics.operators import inventory as inv
from plantmetrics.plans import demand as demand_plans
from plantmetrics.plans import inventory as inventory_plans
from plantmetrics.plans import reports as report_plans
from plantmetrics.plans import retrieval as retrieval_plans
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import big, r
from plantmetrics.plans.reports import all_reports
from plantmetrics.session import run_folder
from plantmetrics.sources import readers, sinks


def folder(t, name: str) -> str:
    return f"{run_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "sink_report_json",
    "SELECT brand, period, report_type, file_name, brand AS body_brand FROM every_report",
    report_plans.VIEWS,
)
def sink_report_json(t):
    path = folder(t, "reports")
    sinks.write_reports(all_reports(t), path)
    back = t.spark.read.schema("report_type string, file_name string, body string, brand string, period string").json(path)
    return back.select("brand", "period", "report_type", "file_name", F.get_json_object("body", "$.brand").alias("body_brand"))


@query(
    "scan_reports",
    "SELECT brand, period, count(*) AS reports, true AS filled FROM every_report GROUP BY 1, 2",
    report_plans.VIEWS,
)
def scan_reports(t):
    """The catalogue of the written reports by brand and period."""
    path = folder(t, "reports")
    sinks.write_json(all_reports(t).select("brand", "period", "body"), path)
    return (
        readers.read_reports(t.spark, path)
        .groupBy("brand", "period")
        .agg(F.count(F.lit(1)).alias("reports"), F.bool_and((F.col("size_bytes") > 0) & F.col("generated_at").isNotNull()).alias("filled"))
    )


RISK_SCHEMA = "material_id string, risk_level string, days_until_stockout double, estimated_cost double"


@query(
    "sink_result_json",
    "SELECT material_id, risk_level, days_until_stockout, estimated_cost FROM stock_risks",
    inventory_plans.VIEWS,
)
def sink_result_json(t):
    """Stock-out results written as JSON documents and read back."""
    path = folder(t, "risks")
    sinks.write_json(inv.stockout_risk(t.inventory), path)
    return sinks.read_documents(t.spark, path, RISK_SCHEMA)


@query(
    "json_roundtrip",
    f"""SELECT {big("sum(n)")} AS total, max(CASE WHEN status = 'critical' THEN n END) AS critical,
               {r("max(v)", 2)} AS largest_value
        FROM (SELECT status, count(*) AS n, sum(current_stock * unit_price_eur) AS v FROM optimised_stock GROUP BY 1)""",
    inventory_plans.VIEWS,
)
def json_roundtrip(t):
    """A result document per status goes to JSON text; single fields are picked out of it again."""
    per = (
        inv.optimise(t.inventory)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("current_stock") * F.col("unit_price_eur")).alias("v"))
    )
    text = per.select(F.to_json(F.struct("status", F.struct("n", "v").alias("summary"))).alias("doc"))
    parsed = text.select(
        F.get_json_object("doc", "$.status").alias("status"),
        F.from_json("doc", "summary struct<n: bigint, v: double>").alias("d"),
    )
    return parsed.agg(
        F.sum("d.summary.n").alias("total"),
        F.max(F.when(F.col("status") == "critical", F.col("d.summary.n"))).alias("critical"),
        round_to(F.max("d.summary.v"), 2).alias("largest_value"),
    )


@query("sink_chunks", "SELECT chunk_id, source_file, text, word_count, document_title FROM doc_chunks", retrieval_plans.VIEWS)
def sink_chunks(t):
    path = folder(t, "chunks")
    sinks.write_json(retrieval_plans.chunks(t), path)
    schema = "chunk_id string, source_file string, text string, word_count int, metadata struct<document_title: string>"
    return sinks.read_documents(t.spark, path, schema).select(
        "chunk_id", "source_file", "text", "word_count", "metadata.document_title"
    )


@query("sink_features_csv", "SELECT series, date, demand, lag_7, trend FROM (" + demand_plans.FEATURE_SQL + ")", demand_plans.VIEWS)
def sink_features_csv(t):
    path = folder(t, "features")
    features = demand.feature_matrix(demand_plans.both(t))
    sinks.write_csv(features, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.schema)
    return readers.read_table(t.spark, path, schema).select("series", "date", "demand", "lag_7", "trend")


@query(
    "sink_query_log",
    """SELECT question, CAST(length(answer) AS INT) AS answer_length, coalesce(split_part(sources, '|', 1), '') AS top_source, confidence,
              CAST(1.0 AS DOUBLE) AS response_time_ms FROM answered""",
    retrieval_plans.VIEWS,
)
def sink_query_log(t):
    """Answers of the question batch appended to a log and read back."""
    path = folder(t, "query-log")
    sinks.append_query_log(retrieval_plans.answers(t), path, 1.0)
    return readers.read_query_log(t.spark, path).drop("timestamp")


@query(
    "sink_index",
    f"SELECT chunk_id, term, {r('weight', 6)} AS weight FROM chunk_w",
    retrieval_plans.VIEWS,
)
def sink_index(t):
    path = folder(t, "index")
    index_store.refresh(t.corpus.select("file_name", "text"), path)
    saved = index_store.load(t.spark, path)
    return retrieval.postings(saved.vectors, saved.idf).select("chunk_id", "term", round_to(F.col("weight"), 6).alias("weight"))
