"""Ranks without sorting the rows: the k-th value by histograms, the k rows of each group with the smallest hash by prefixes.

Only counts are exchanged. Rows are decided where they are, by comparing them with a cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions.ordered import small

BINS = 1024
FEW_VALUES = 5_000  # so many different values of one bin are listed with their counts
BUCKET_DIGITS = 4  # hexadecimal digits of a hash by which rows are counted before those of one bucket are ranked


def kth_values(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at 0-based ``ranks`` in the order of a numeric column, as a sort would give them.

    A histogram between the smallest and the largest value tells the bin of a rank; the next one covers only that bin, from its
    smallest to its largest value, until the bin holds one value or few enough to be listed. Equal values are counted, never
    moved. Nulls and NaN are left out. Each step reads the column once and exchanges at most BINS counts a task.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return [_kth_value(values, rank) for rank in ranks]


def _kth_value(values: DataFrame, rank: int) -> float:
    low = high = None
    below = 0  # values under the present range
    while True:
        inside = values if low is None else values.where(F.col("x").between(low, high))
        if low is None:
            span = inside.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).first()
            if not 0 <= rank < span["n"]:
                raise IndexError(f"rank {rank} of {span['n']} values")
            low, high, n = span["low"], span["high"], span["n"]
        if low == high:
            return low
        if n <= FEW_VALUES:
            counted = inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()
            for row in sorted(counted, key=lambda r: r["x"]):
                below += row["n"]
                if rank < below:
                    return row["x"]
        # halves, as the difference of two finite numbers may be infinite
        width = (high / 2 - low / 2) / BINS
        place = (F.col("x") / 2 - low / 2) / width if width > 0 and math.isfinite(width) else F.when(F.col("x") > low, BINS).otherwise(0)
        slot = F.when(F.col("x") >= high, BINS - 1).otherwise(F.least(F.floor(place), F.lit(BINS - 1))).cast("int")
        bins = (
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            .collect()
        )
        for row in sorted(bins, key=lambda r: r["slot"]):
            if rank < below + row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            below += row["n"]


def exact_quantile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row: the quantile of a column with linear interpolation, from the two values next to its place; null without values.

    ``df`` is read several times, so it should be a table.
    """
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
    place = (n - 1) * share
    low, high = kth_values(df, column, [math.floor(place), math.ceil(place)])
    value = low + (high - low) * (place - math.floor(place))
    return df.sparkSession.range(1).select(F.lit(float(value)).alias(name))


def hash_of(key: Sequence[str], seed: int) -> Column:
    """MD5 of the key's values and the seed, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))


def smallest_hashes(df: DataFrame, group: Sequence[str], key: Sequence[str], wanted: DataFrame, seed: int) -> DataFrame:
    """Per group the cut (struct ``cut`` of hash and key) up to which its ``_wanted`` smallest hashes reach.

    Rows are counted by the first digits of their hashes; only the rows of the one bucket in which the count passes ``_wanted``,
    about one in 65,536, are ranked. Groups that want nothing have no cut.
    """
    keyed = df.select(*group, *key).withColumn("_h", hash_of(key, seed))
    wanted = small(wanted.where(F.col("_wanted") > 0))
    prefix = F.substring("_h", 1, BUCKET_DIGITS).alias("_prefix")
    counts = _meet(keyed, wanted, group).groupBy(*group, prefix, "_wanted").count()
    upto = F.sum("count").over(W.partitionBy(*group).orderBy("_prefix"))
    open_ = small(
        counts.withColumn("_upto", upto)
        .where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("count") < F.col("_wanted")))
        .select(*group, "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("count")).alias("_wanted"))
    )
    order = W.partitionBy(*group).orderBy("_h", *key)
    last = _meet(keyed, open_, group).withColumn("_rank", F.row_number().over(order))
    return last.where(F.col("_rank") == F.col("_wanted")).select(*group, F.struct("_h", *key).alias("cut"))


def _meet(rows: DataFrame, table: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the row of their group, in the bucket that it names if it names one; null groups meet each other."""
    names = {c: f"_m_{c}" for c in group}
    table = table.withColumnsRenamed(names)
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    if "_prefix" in table.columns:
        same = same & F.startswith(F.col("_h"), F.col("_prefix"))
    if not group:
        table = F.broadcast(table)  # one row
    return rows.join(table, same).drop(*names.values(), "_prefix")


def mark_smallest(
    df: DataFrame, group: Sequence[str], key: Sequence[str], wanted: DataFrame, seed: int, name: str
) -> DataFrame:
    """The rows with a boolean ``name``: whether their hash is among the ``_wanted`` smallest of their group.

    Rows are only compared with their group's cut; none is exchanged unless there are very many groups. Rows with the same key
    are on the same side.
    """
    names = {c: f"_c_{c}" for c in group}
    cuts = smallest_hashes(df, group, key, wanted, seed).withColumnsRenamed(names)
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    cuts = small(cuts) if group else F.broadcast(cuts)
    own = F.struct(hash_of(key, seed).alias("_h"), *key)
    return df.join(cuts, same, "left").withColumn(name, F.coalesce(own <= F.col("cut"), F.lit(False))).drop("cut", *names.values())


def rows_at(df: DataFrame, key: Sequence[str], draws: DataFrame, position: str, seed: int) -> DataFrame:
    """The rows at the drawn positions (0-based) of the order of their hashes, joined to the draws.

    Buckets of equal first digits are counted, which tells the bucket of every draw; only rows of drawn buckets are ranked.
    Draws meet the buckets' ranges in bins, so neither is compared with all of the other.
    """
    keyed = df.withColumn("_h", hash_of(key, seed)).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = small(counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    step = counts.agg(F.greatest(F.max("_n"), F.lit(1))).scalar()
    reach = F.sequence(F.expr("_from div _step"), F.expr("(_from + _n - 1) div _step"))
    binned = buckets.withColumn("_step", step).withColumn("_bin", F.explode(reach)).drop("_step")
    placed = draws.withColumn("_step", step).withColumn("_bin", F.expr(f"`{position}` div _step")).drop("_step")
    found = small(
        placed.join(binned, "_bin")
        .where((F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_from") + F.col("_n")))
        .select(*draws.columns, "_bucket", (F.col(position) - F.col("_from")).alias("_at"))
    )
    order = W.partitionBy("_bucket").orderBy("_h", *key)
    drawn = keyed.join(found.select("_bucket").distinct(), "_bucket", "left_semi")
    ranked = drawn.withColumn("_at", F.row_number().over(order) - 1)
    return found.join(ranked, ["_bucket", "_at"]).drop("_bucket", "_at", "_h")
