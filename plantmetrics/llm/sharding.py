"""Contiguous shards of nearly equal size from global prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantmetrics.functions.ordered import in_order, part_of, place_of
from plantmetrics.functions.relational import attach_row


def shard(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut the documents, in the order of doc_id, into ``shards`` runs of nearly equal bytes.

    One range exchange puts the rows in order; it is the only time that texts move. Each partition's total is summed, the totals
    (one row per partition) are turned into offsets, and a window over places and sizes inside each partition adds its own
    running sum, so no task sees all rows. This tells the place at which each shard begins, which every row is compared with. A
    document goes to the shard in which its middle byte lies, so a shard misses the equal target by less than one document.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ``bytes``, shard, slot (from 0 in each shard) and grown_shard
    (null), and with ``carry`` those columns of the documents in the struct ``document``, whatever their names.

    Null texts have size 1 and the checksum of no bytes. Null ids come first. Rows that repeat an id are ordered by size and
    checksum and are each placed once; equal rows may swap slots. An empty table gives no rows. Very long texts are never
    split, so one may exceed the target.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ]
    if carry:
        columns.append(F.struct(*[F.col(c) for c in carry]).alias("document"))
    order = ["doc_id", "size", "text_crc32"]
    rows = in_order(docs.select(*columns), order).withColumn("part", part_of(F.col("_at")))

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = F.broadcast(  # one row per range partition
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("bytes_total"),
        )
    )
    position = F.col("rows_before") + place_of(F.col("_at"))
    inside = Window.partitionBy("part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        rows.select("part", "_at", "size")
        .join(totals, "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(inside))
        .withColumn("shard", F.expr(f"cast((2 * end - size) * {shards} div (2 * bytes_total) as int)"))
        .groupBy("shard")
        .agg(F.min("_at").alias("at"), F.min(position).alias("first"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "shard", "first"))).alias("all"))
    )
    # the shards' first places are compared with the rows where they are, so no text is exchanged again
    begun = attach_row(rows.join(totals, "part"), starts, "_starts").withColumn(
        "_own", F.element_at(F.filter("_starts.all", lambda s: s["at"] <= F.col("_at")), -1)
    )
    return begun.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_own.shard").alias("shard"),
        (position - F.col("_own.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["document"] if carry else []),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the carried documents as one folder of files per shard, in slot order."""
    (
        sharded.select("shard", "slot", "document.*")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
