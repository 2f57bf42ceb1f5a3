"""Structured Streaming jobs: score and log inspections, running counts, running question statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str) -> DataFrame:
    """Files of a folder as a stream, by name pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def scored(inspections: DataFrame) -> DataFrame:
    """One log row per inspection: prediction against the actual label."""
    return inspections.select(
        "inspection_id",
        "ts",
        "station",
        "prediction",
        "actual_label",
        "processing_time_ms",
        (F.col("prediction") == F.col("actual_label")).alias("correct"),
    )


def start_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet log; the checkpoint makes a restart add nothing twice."""
    writer = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def running_counts(inspections: DataFrame, *keys: str) -> DataFrame:
    """Counts, defect and correct percent so far, in total or per key; the state is one row per key."""
    defect = F.count_if(F.col("prediction") == "defect")
    correct = F.count_if(F.col("prediction") == F.col("actual_label"))
    n = F.count(F.lit(1))
    grouped = inspections.groupBy(*keys)
    return grouped.agg(
        n.alias("inspected"),
        defect.alias("defects"),
        (n - defect).alias("ok"),
        (defect / n * 100).alias("defect_pct"),
        (correct / n * 100).alias("correct_pct"),
        F.avg("processing_time_ms").alias("mean_ms"),
    )


def query_stats(log: DataFrame) -> DataFrame:
    """Number of questions, mean confidence and mean latency so far."""
    return log.groupBy().agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
    )


def start_table(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current totals as a small Parquet table, replaced as a whole after every batch; see replace_table."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        replace_table(batch, path, batch_id)

    writer = totals.writeStream.outputMode("complete").foreachBatch(replace).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def replace_table(batch: DataFrame, path: str, batch_id: int) -> None:
    """Make ``batch`` the table's content, once per batch id.

    The rows go to a folder of their own, then a pointer with the batch id is renamed into place, which is what readers follow.
    A job that dies before that leaves the old content in force, and the replayed batch writes a new folder; one that dies after
    it is replayed with an id that the pointer has reached, and only its state is computed. Folders of batches before the last are removed.
    """
    spark = batch.sparkSession
    if current_batch(spark, path) >= batch_id:
        batch.write.format("noop").mode("overwrite").save()  # a batch must be read, or its state is not committed
        return
    folder = f"{path}/batch={batch_id:012d}-{uuid.uuid4().hex}"
    batch.write.parquet(folder)
    switch_pointer(spark, path, batch_id, folder)
    files, hadoop_path = _files(spark, path)
    for status in files.globStatus(hadoop_path(f"{path}/batch=*")):
        if int(status.getPath().getName().removeprefix("batch=").split("-")[0]) < batch_id - 1:
            files.delete(status.getPath(), True)


def switch_pointer(spark: SparkSession, path: str, batch_id: int, folder: str) -> None:
    """A file named after the batch and its folder appears in one step."""
    files, hadoop_path = _files(spark, path)
    name = f"{batch_id:012d}@{folder.rsplit('/', 1)[1]}"
    draft = hadoop_path(f"{path}/_drafts/{uuid.uuid4().hex}")
    files.create(draft).close()
    files.mkdirs(hadoop_path(f"{path}/_pointers"))
    if not files.rename(draft, hadoop_path(f"{path}/_pointers/{name}")):
        raise RuntimeError(f"the pointer of batch {batch_id} could not be set in {path}")


def current_batch(spark: SparkSession, path: str) -> int:
    """The id of the batch that readers see, -1 if there is none."""
    return max((int(name.split("@")[0]) for name in _pointers(spark, path)), default=-1)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last complete batch left it."""
    names = _pointers(spark, path)
    if not names:
        raise FileNotFoundError(f"no batch was completed in {path}")
    return spark.read.parquet(f"{path}/{max(names).split('@')[1]}")


def _pointers(spark: SparkSession, path: str) -> list[str]:
    files, hadoop_path = _files(spark, path)
    found = files.globStatus(hadoop_path(f"{path}/_pointers/*")) or []
    return [status.getPath().getName() for status in found]


def _files(spark: SparkSession, path: str):
    """The file system of a path, and Hadoop's class of paths."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path
