"""Readers for the plant's own files: CSV or Parquet tables, text corpus, images, reports, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmetrics import schemas
from plantmetrics.functions.text import words, zfill


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A table with a fixed schema; a CSV row that does not fit it fails the read."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, mode="FAILFAST")
    return reader.format(fmt).load(path)


def read_production(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.PRODUCTION_LOG, fmt)


def read_defects(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.DEFECT_LOG, fmt)


def read_inventory(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return with_demand_std(read_table(spark, path, schemas.INVENTORY, fmt))


def read_purchase_orders(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.PURCHASE_ORDERS, fmt)


def read_products(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.PRODUCTS_DPP, fmt)


def read_hs_classifications(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return with_padded_code(read_table(spark, path, schemas.HS_CLASSIFICATIONS, fmt), "correct_hs_code")


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; questions may hold line breaks and quotes."""
    reader = spark.read.schema(schemas.QUERY_LOG).options(header=True, mode="FAILFAST", multiLine=True, escape='"')
    return reader.csv(path)


def with_demand_std(inventory: DataFrame, share: float = 0.30) -> DataFrame:
    """Daily demand deviation as a fixed share of the consumption rate."""
    return inventory.withColumn("demand_std_daily", F.col("consumption_rate_daily") * share)


def with_padded_code(df: DataFrame, code: str, width: int = 6) -> DataFrame:
    return df.withColumn(code, zfill(F.col(code), width))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: file_name, text, word_count."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return corpus(files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")))


def corpus(texts: DataFrame) -> DataFrame:
    return texts.select("file_name", "text", F.size(words(F.col("text"))).alias("word_count"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG folder; files named ``defect_*`` carry label 1."""
    images = spark.read.format("image").option("pathGlobFilter", "*.png").load(path)
    name = F.element_at(F.split(F.col("image.origin"), "/"), -1)
    return images.select(
        name.alias("file_name"),
        name.startswith("defect_").cast("int").alias("label"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of written reports: file, brand, period, size and time of writing."""
    reports = spark.read.schema("brand string, period string").json(path, recursiveFileLookup=True, pathGlobFilter="*.json")
    return reports.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.coalesce("brand", F.lit("unknown")).alias("brand"),
        F.coalesce("period", F.lit("unknown")).alias("period"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("generated_at"),
    )


def query_log_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
    )
