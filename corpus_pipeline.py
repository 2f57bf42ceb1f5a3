"""From raw documents to training shards: quality, near copies, test items, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``. Near copies are judged here by five-word shingles and a similarity of
0.8 or more.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plantmetrics.llm import decontamination, mixing, near_dedup, quality, sharding  # noqa: E402
from plantmetrics.llm.common import in_fold  # noqa: E402
from plantmetrics.session import configure, run_folder  # noqa: E402

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are learned outside fold 2 of 4."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, ~in_fold(F.col("doc_id"), 4, 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id."""
    configure(spark)
    return near_dedup.keep_one(docs, repeats=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of test items."""
    items = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens follow tempered shares of source, language and topic."""
    configure(spark)
    return mixing.sample_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in one of 16 contiguous shards of nearly equal bytes."""
    configure(spark)
    placed = sharding.shard(docs, SHARDS, carry=tuple(docs.columns))
    return placed.select("document.*", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: A trained classifier and signatures have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
