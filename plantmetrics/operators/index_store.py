"""A stored search index with versions: changed documents are cut and split anew, all others are reused.

Folder of an index::

    deltas/<id>/chunks        chunks of the documents that were new or changed at one time, with their terms
    versions/<n>/documents    the live documents: name, mark, delta that holds their chunks, number
    versions/<n>/idf, segments, counts
    versions/<n>/manifest     written last; a version without it does not exist

Nothing is overwritten in place, so a reader keeps the version it has opened, and a writer that dies leaves only folders that
nobody refers to.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmetrics.operators import block_index, retrieval
from plantmetrics.session import materialise

MAX_DELTAS = 8  # more are merged into one
MAX_DEAD_SHARE = 0.5  # of the stored chunks may belong to documents that are gone or changed; then all are rewritten
COMPRESSION = "zstd"  # the index is a multiple of the texts, so it is packed well
DELTAS_SCHEMA = "delta string, chunks long"


class Index(NamedTuple):
    version: int
    chunks: DataFrame
    vectors: DataFrame
    idf: DataFrame
    segments: DataFrame


def marks(docs: DataFrame) -> DataFrame:
    """file_name and mark: what changes when a document changes.

    Documents that bring ``size`` and ``modified`` (as files do) are told by these, and their texts are not read; of others the
    length and the MD5 of the text count.
    """
    if {"size", "modified"} <= set(docs.columns):
        mark = F.concat_ws("-", F.col("size").cast("string"), F.col("modified").cast("timestamp").cast("double").cast("string"))
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        mark = F.concat_ws("-", F.octet_length(text).cast("string"), F.md5(text.cast("binary")))
    return docs.select("file_name", mark.alias("mark"))


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def _write(frame: DataFrame, place: str) -> None:
    frame.write.option("compression", COMPRESSION).parquet(place)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifest was written to the end."""
    return sorted(int(p.split("/")[-3]) for p in _paths(spark, f"{path}/versions/*/manifest/_SUCCESS"))


def _documents(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{version:08d}/documents")


def _deltas(spark: SparkSession, path: str, version: int) -> dict[str, int]:
    rows = spark.read.schema(DELTAS_SCHEMA).json(f"{path}/versions/{version:08d}/manifest").collect()
    return {row["delta"]: row["chunks"] for row in rows}


def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version, or the given one."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no index version {version or ''} in {path}")
    version = known[-1] if version is None else version
    place = f"{path}/versions/{version:08d}"
    chunks = _stored_chunks(spark, path, _documents(spark, path, version), list(_deltas(spark, path, version)))
    counts, idf, segments = (spark.read.parquet(f"{place}/{name}") for name in ("counts", "idf", "segments"))
    return Index(version, retrieval.named_chunks(chunks), retrieval.weigh(counts, idf, "chunk_id"), idf, segments)


def _stored_chunks(spark: SparkSession, path: str, owners: DataFrame, deltas: list[str]) -> DataFrame:
    """The stored chunks of the documents in ``owners`` (file_name, delta and more)."""
    stored = spark.read.parquet(*[f"{path}/deltas/{d}/chunks" for d in deltas])
    small = F.broadcast(owners) if owners.count() <= retrieval.SMALL_NAMES else owners
    return stored.join(small, ["file_name", "delta"])


def _write_delta(cut: DataFrame, path: str) -> tuple[str, int]:
    """Chunks with their terms in a new folder; its name and their number."""
    delta = uuid.uuid4().hex
    place = f"{path}/deltas/{delta}/chunks"
    _write(cut.withColumn("delta", F.lit(delta)), place)
    return delta, cut.sparkSession.read.parquet(place).count()


def _with_terms(cut: DataFrame) -> DataFrame:
    return cut.withColumn("t", retrieval.terms(F.col("text")))


def refresh(docs: DataFrame, path: str, max_terms: int = retrieval.MAX_TERMS) -> int:
    """Bring the index in ``path`` up to ``docs`` (file_name, text) and return its version; the same one if nothing changed.

    Only new and changed documents are cut and split into terms. Vocabulary, inverse frequencies and weights depend on all
    documents, and are computed from the stored terms. Names are expected once each. One writer at a time.
    """
    spark = docs.sparkSession
    known = versions(spark, path)
    now = marks(docs)
    if known:
        deltas = _deltas(spark, path, known[-1])
        before = _documents(spark, path, known[-1]).select("file_name", "mark", "delta")
        both = before.withColumnRenamed("mark", "_before").join(now, "file_name", "full")
        if both.where(~F.col("_before").eqNullSafe(F.col("mark"))).isEmpty():
            return known[-1]
        kept = materialise(before.join(now, ["file_name", "mark"], "left_semi"), "kept-documents")
        changed = docs.join(kept.select("file_name"), "file_name", "left_anti")
    else:
        deltas, kept, changed = {}, now.withColumn("delta", F.lit("")).where("false"), docs

    delta, deltas_size = _write_delta(_with_terms(retrieval.cut_documents(changed.select("file_name", "text"))), path)
    deltas[delta] = deltas_size
    fresh = now.join(kept.select("file_name"), "file_name", "left_anti").withColumn("delta", F.lit(delta))
    live = materialise(kept.select("file_name", "mark", "delta").unionByName(fresh), "live-documents")
    alive = {r["delta"]: r["count"] for r in _stored_chunks(spark, path, live, list(deltas)).groupBy("delta").count().collect()}
    deltas = {d: size for d, size in deltas.items() if d in alive or d == delta}  # what is dead as a whole is left out
    n_live, stored = sum(alive.values()), sum(deltas.values())
    if len(deltas) > MAX_DELTAS or stored - n_live > MAX_DEAD_SHARE * stored:
        merged, size = _write_delta(_stored_chunks(spark, path, live, list(deltas)).drop("mark"), path)
        live, deltas = live.withColumn("delta", F.lit(merged)), {merged: size}

    begun = [int(p.split("/")[-1]) for p in _paths(spark, f"{path}/versions/*")]
    version = max(begun, default=0) + 1
    place = f"{path}/versions/{version:08d}"
    retrieval.with_numbers(live, retrieval.document_numbers(live), "file_name").write.parquet(f"{place}/documents")
    chunks = _stored_chunks(spark, path, _documents(spark, path, version), list(deltas))
    _write_weights(retrieval.named_chunks(chunks, "t").select("chunk_id", "t"), place, max_terms)
    spark.createDataFrame(list(deltas.items()), DELTAS_SCHEMA).coalesce(1).write.json(f"{place}/manifest")
    return version


def _write_weights(termed: DataFrame, place: str, max_terms: int) -> None:
    """Term counts, inverse frequencies and segments from stored terms; no text is read.

    Weights are not stored a second time as vectors: they follow from the counts and the inverse frequencies.
    """
    spark = termed.sparkSession

    def keep(frame: DataFrame) -> DataFrame:
        return materialise(frame, "index")

    vocab = keep(retrieval.vocabulary(termed, max_terms, keep))
    _write(retrieval.term_vectors(termed, "chunk_id", vocab), f"{place}/counts")
    counted = spark.read.parquet(f"{place}/counts")
    _write(retrieval.inverse_frequencies(counted, vocab, termed), f"{place}/idf")
    weighed = retrieval.weigh_parts(counted, spark.read.parquet(f"{place}/idf"), "chunk_id")
    _write(block_index.build_segments(weighed), f"{place}/segments")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, and what no version refers to. Run it when no writer is at work."""
    known = versions(spark, path)[-keep:] if keep else []
    wanted = set().union(*[_deltas(spark, path, v) for v in known])
    for place in _paths(spark, f"{path}/versions/*"):
        if int(place.split("/")[-1]) not in known:
            _delete(spark, place)
    for place in _paths(spark, f"{path}/deltas/*"):
        if place.split("/")[-1] not in wanted:
            _delete(spark, place)
