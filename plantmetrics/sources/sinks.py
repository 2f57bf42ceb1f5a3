"""Writers for reports, result documents, chunks, features, logs and the retrieval index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON reports in folders by brand and period."""
    reports.write.mode(mode).partitionBy("brand", "period").json(path)


def write_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested result documents, one JSON object per row."""
    results.write.mode(mode).json(path)


def write_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).option("header", True).csv(path)


def append_query_log(answers: DataFrame, path: str, response_time_ms: float) -> None:
    """One log row per answered question, appended; the time is that of the batch per question."""
    rows = query_log_rows(answers, response_time_ms)
    rows.write.mode("append").options(header=True, escape='"', quoteAll=True).csv(path)


def query_log_rows(answers: DataFrame, response_time_ms: float) -> DataFrame:
    first = F.get("sources", F.lit(0))["file"]
    return answers.select(
        F.date_trunc("second", F.current_timestamp()).alias("timestamp"),
        "question",
        F.length("answer").alias("answer_length"),
        F.coalesce(first, F.lit("")).alias("top_source"),
        "confidence",
        F.lit(response_time_ms).alias("response_time_ms"),
    )


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents read back with a fixed schema."""
    return spark.read.schema(schema).json(path)
