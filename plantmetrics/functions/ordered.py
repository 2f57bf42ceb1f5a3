"""Scans over an ordered frame with one exchange: positions, running sums, trailing means and exponentially weighted means.

Rows go once to range partitions of the order, are sorted there, and what a scan can tell inside a partition is computed on the
way, before the rows are written. What must come from earlier partitions (a count, a sum, a few last rows, a decayed sum) is
worked out from one small row per partition or group and joined to the written rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.session import materialise

PLACE_BITS = 33  # the lower bits of Spark's increasing ids count the rows of a partition
PART_ROWS = 500_000  # rows of a range partition, about; a task sorts them and reads nothing else
SMALL_TABLE = 1_000_000  # rows of a table of groups and partitions that may be sent to every task

Scan = Callable[[pa.RecordBatch, "Runs"], dict[str, pa.Array]]


def part_of(at: Column) -> Column:
    return F.shiftright(at, PLACE_BITS)


def place_of(at: Column) -> Column:
    return at.bitwiseAND((1 << PLACE_BITS) - 1)


class Runs:
    """Runs of equal group values in the batches of one sorted partition."""

    def __init__(self, group: Sequence[str]) -> None:
        self.group = list(group)
        self.last: tuple | None = None  # group of the row before
        self.rows = 0  # rows of the partition before this batch
        self.first_run = True  # whether that row is still in the partition's first run
        self.state: dict = {}  # what a scan carries from batch to batch

    def enter(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        columns = [batch.column(c) for c in self.group]
        new = np.zeros(n, bool)
        for column in columns:
            before, here = column.slice(0, n - 1), column.slice(1)
            differs = pc.fill_null(pc.not_equal(before, here), False)
            nulls = pc.xor(pc.is_null(before), pc.is_null(here))
            new[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
        head = tuple(column[0].as_py() for column in columns)
        new[0] = self.last is None or head != self.last
        self.new = new
        # place of the row that begins the run; below 0: the run began in an earlier batch
        self.start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        later = np.cumsum(new & (np.arange(n) + self.rows > 0)) > 0
        self.open = self.first_run & ~later
        self.last = tuple(column[n - 1].as_py() for column in columns)

    def leave(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        self.first_run = bool(self.open[-1])


def in_order(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), scan: Scan | None = None, adds: str = ""
) -> DataFrame:
    """The frame written in ``order``, with ``_at``: partition and place, increasing along the order.

    The partitions are balanced by a sample of the order columns, whatever share of the rows one key or one day holds. There
    are as many as the session's shuffles have, or more where these would get over PART_ROWS rows, so that a task's share does
    not grow with the table. They are written, since a second computation could draw other bounds. ``scan`` adds the columns
    ``adds`` to each batch, in order.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-df.count() // PART_ROWS)
    # with a number of their own, partitions are not joined again, so few rows keep the session's
    ranged = df.repartitionByRange(wanted, *order) if wanted > usual else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    if scan is None:
        return materialise(placed, "ordered")
    added = T.StructType.fromDDL(adds)
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(group)
        for batch in batches:
            if batch.num_rows:
                runs.enter(batch)
                new = scan(batch, runs)
                runs.leave(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[new[c] for c in added.names]], [*names, *added.names])

    return materialise(placed.mapInArrow(run, T.StructType([*placed.schema, *added])), "ordered")


def small(table: DataFrame) -> DataFrame:
    """A written table, to be sent to every task if it is small; otherwise the optimizer decides how to join it."""
    table = materialise(table, "offsets")
    return F.broadcast(table) if table.count() <= SMALL_TABLE else table


def earlier_parts(placed: DataFrame, group: Sequence[str], measure: Column) -> DataFrame:
    """Per group and partition: ``_first`` (_at of its first row there) and ``_before``, the measure over earlier partitions.

    The rows of a group lie side by side, so there are no more rows here than groups and partitions together.
    """
    keys = [*group, part_of(F.col("_at")).alias("_part")]
    totals = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), measure.alias("_own"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*group, "_part", "_first", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))


def join_parts(placed: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group and partition; null groups meet each other."""
    renamed = parts.select(*[F.col(c).alias(f"_p_{c}") if c in group else F.col(c) for c in parts.columns])
    same = part_of(F.col("_at")) == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return placed.join(renamed, same).drop("_part", *[f"_p_{c}" for c in group])


def with_row_index(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """0-based position of each row in its group by ``order``; without group columns, in the whole frame."""
    placed = in_order(df, [*group, *order])
    parts = small(earlier_parts(placed, group, F.count(F.lit(1))))
    position = F.col("_before") + F.col("_at") - F.col("_first")
    return join_parts(placed, parts, group).withColumn(name, position).drop("_before", "_first", "_at")


def with_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Running total of ``value`` up to and including the row, by ``order``; null values count 0."""
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    kind, arrow = (np.int64, pa.int64()) if whole else (np.float64, pa.float64())

    def scan(batch: pa.RecordBatch, runs: Runs) -> dict[str, pa.Array]:
        values = pc.fill_null(batch.column(value).cast(arrow), 0).to_numpy(zero_copy_only=False).astype(kind)
        sums = np.cumsum(values)
        skipped = np.where(runs.start > 0, sums[np.maximum(runs.start, 1) - 1], 0)
        out = sums - skipped + np.where(runs.start < 0, runs.state.get("sum", 0), 0)
        runs.state["sum"] = out[-1]
        return {"_in": pa.array(out, arrow)}

    placed = in_order(df, [*group, *order], group, scan, f"_in {'long' if whole else 'double'}")
    parts = small(earlier_parts(placed, group, F.coalesce(F.sum(value), F.lit(0))))
    total = F.col("_before") + F.col("_in")
    return join_parts(placed, parts, group).withColumn(name, total).drop("_before", "_first", "_at", "_in")


def with_trailing(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, rows: int, name: str
) -> DataFrame:
    """Mean of ``value`` over the last ``rows`` rows of the group, the current one included; nulls are left out.

    Only the first rows of a partition reach into earlier ones. They get their means from the first and last rows of all
    partitions, which are few.
    """
    need = rows - 1

    def scan(batch: pa.RecordBatch, runs: Runs) -> dict[str, pa.Array]:
        held = runs.state.get("halo", (np.zeros(0), np.zeros(0, bool)))
        column = batch.column(value).cast(pa.float64())
        valid = np.r_[held[1], column.is_valid().to_numpy(zero_copy_only=False)]
        values = np.r_[held[0], pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)]
        here = np.arange(batch.num_rows) + len(held[0])
        first = np.where(runs.start < 0, here[0] - runs.state.get("length", 0), runs.start + len(held[0]))
        sums, counts = np.zeros(len(here)), np.zeros(len(here), np.int64)
        for back in range(min(rows, len(values))):
            at = here - back
            inside = (at >= np.maximum(first, 0)) & valid[np.maximum(at, 0)]
            sums += np.where(inside, values[np.maximum(at, 0)], 0.0)
            counts += inside
        runs.state["length"] = int(here[-1] - first[-1]) + 1
        runs.state["halo"] = (values[-need:], valid[-need:]) if need else (np.zeros(0), np.zeros(0, bool))
        return {
            "_mean": pa.array(np.divide(sums, counts, out=np.zeros(len(sums)), where=counts > 0), mask=counts == 0),
            "_open": pa.array(runs.open),
        }

    placed = in_order(df, [*group, *order], group, scan, "_mean double, _open boolean")
    sizes = placed.groupBy(part_of(F.col("_at")).alias("_part")).agg(F.max("_at").alias("_end"))
    head = F.col("_open") & (place_of(F.col("_at")) < need)
    edge = placed.withColumn("_part", part_of(F.col("_at"))).join(F.broadcast(sizes), "_part")  # one row per partition
    edge = edge.where(head | (F.col("_at") > F.col("_end") - need)).select(*group, "_at", head.alias("_head"), value)
    back = W.partitionBy(*group).orderBy("_at").rowsBetween(-need, 0)
    mended = edge.withColumn("_mended", F.avg(F.col(value).cast("double")).over(back)).where("_head").select("_at", "_mended")
    return (
        placed.join(small(mended), "_at", "left")
        .withColumn(name, F.when(F.col("_open") & (place_of(F.col("_at")) < need), F.col("_mended")).otherwise(F.col("_mean")))
        .drop("_mean", "_open", "_mended", "_at")
    )


def with_decayed_mean(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, keep: float, name: str, before: bool = False
) -> DataFrame:
    """Mean of all values so far with weights keep^age; ``before`` leaves the row itself out. Nulls are left out.

    Sums of values and of weights follow s -> keep * s + x, so each run is an affine map. Inside a batch the maps are composed
    by doubling, batches and partitions hand on the sums reached, and a row adds what came from earlier partitions, decayed by
    its place in the run.
    """

    def prefix(first: np.ndarray, x: np.ndarray, carried: float) -> np.ndarray:
        slope, sums = np.where(first, 0.0, keep), x.copy()
        sums[0] += slope[0] * carried
        step = 1
        while step < len(x):
            sums[step:] += slope[step:] * sums[:-step]
            slope[step:] *= slope[:-step].copy()
            step *= 2
        return sums

    def scan(batch: pa.RecordBatch, runs: Runs) -> dict[str, pa.Array]:
        column = batch.column(value).cast(pa.float64())
        out = {}
        for key, x in (
            ("_n", pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)),
            ("_d", column.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)),
        ):
            carried = runs.state.get(key, 0.0)
            reached = prefix(runs.new, x, carried)
            earlier = np.where(runs.new, 0.0, np.r_[carried, reached[:-1]])
            runs.state[key] = reached[-1]
            out[key], out[key + "_before"] = pa.array(reached), pa.array(earlier)
        return out

    placed = in_order(
        df, [*group, *order], group, scan, "_n double, _n_before double, _d double, _d_before double"
    )
    keys = [*group, part_of(F.col("_at")).alias("_part")]
    last = placed.groupBy(*keys).agg(
        F.min("_at").alias("_first"),
        F.count(F.lit(1)).alias("rows"),
        F.max_by(F.struct("_n", "_d"), "_at").alias("own"),
    )
    # one list per group, with one entry per partition that the group reaches into
    listed = last.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_part", "_first", "rows", "own"))).alias("parts"))
    nothing = F.array().cast("array<struct<_part: bigint, _first: bigint, n: double, d: double, n_after: double, d_after: double>>")

    def hand_on(done: Column, part: Column) -> Column:
        n = F.when(F.size(done) > 0, F.try_element_at(done, F.lit(-1))["n_after"]).otherwise(0.0)
        d = F.when(F.size(done) > 0, F.try_element_at(done, F.lit(-1))["d_after"]).otherwise(0.0)
        decay = F.pow(F.lit(float(keep)), part["rows"])
        entry = F.struct(
            part["_part"].alias("_part"),
            part["_first"].alias("_first"),
            n.alias("n"),
            d.alias("d"),
            (part["own"]["_n"] + decay * n).alias("n_after"),
            (part["own"]["_d"] + decay * d).alias("d_after"),
        )
        return F.concat(done, F.array(entry))

    carried = listed.select(*group, F.inline(F.aggregate("parts", nothing, hand_on))).select(
        *group, "_part", "_first", F.col("n").alias("_cn"), F.col("d").alias("_cd")
    )
    age = F.col("_at") - F.col("_first") + (0 if before else 1)
    decay = F.pow(F.lit(float(keep)), age)
    n, d = ("_n_before", "_d_before") if before else ("_n", "_d")
    weight = F.col(d) + decay * F.col("_cd")
    mean = F.when(weight > 0, (F.col(n) + decay * F.col("_cn")) / weight)
    return (
        join_parts(placed, small(carried), group)
        .withColumn(name, mean)
        .drop("_n", "_d", "_n_before", "_d_before", "_cn", "_cd", "_first", "_at")
    )
