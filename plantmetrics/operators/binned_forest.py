"""Random forest regression for large tables: rows are binned and packed once, and every level of all trees is one pass over them.

The trees are those of Spark ML's forest: rows drawn with replacement for each tree, features drawn for each node, splits of at most
``maxBins`` bins by the largest gain in variance. What differs is how rows are kept. Spark keeps a row as an object with its number
of draws for each tree; here rows are bytes in blocks, and the draws of a block and tree come from a seed of their own, so they
are the same in every pass and are never stored. Rows of a block with equal bins are added up before they go down a tree, after each
was drawn by itself. The result is a model of Spark ML.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmetrics.session import materialise, run_folder

WORD_FEATURES = 12  # features whose bins share a 64-bit word, with 5 bits each
MOST_BINS = 32
BLOCK_ROWS = 262_144  # rows that are packed together
PACK_ROWS = 1_000_000  # rows of a range partition
PASS_ROWS = 3_000_000  # rows that a task reads in a pass, for some of the trees
FILE_BYTES = 4 << 20  # of a row group, so that a large file is read by several tasks
DRAWS = 1 << 16  # the chances of being drawn 0, 1, 2, ... times are rounded to parts of this
BLOCK_SCHEMA = "block long, bins binary, starts binary, target binary"
SPLIT_SCHEMA = (
    "tree int, slot int, feature int, cut int, gain double, n double, s double, q double, left_n double, left_s double, left_q double"
)


# ---- rows --------------------------------------------------------------------------------------------------------------


def bin_rows(rows: DataFrame, features: Sequence[str], target: str, cuts: list[np.ndarray]) -> DataFrame:
    """Bins of each row as 64-bit words w0, w1, ..., and the target; a value equal to a cut lies below it, as in Spark's trees."""
    words = -(-len(features) // WORD_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if any(np.isnan(c).any() for c in columns):
                raise ValueError("features and target of a forest must not be null or NaN")
            out = np.zeros((words, batch.num_rows), np.int64)
            for i, (values, edges) in enumerate(zip(columns, cuts)):
                out[i // WORD_FEATURES] |= np.searchsorted(edges, values, "left").astype(np.int64) << (5 * (i % WORD_FEATURES))
            names = [*[f"w{i}" for i in range(words)], "target"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(columns[-1])], names=names)

    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])]
    return rows.select(*columns).mapInArrow(run, ", ".join([*[f"w{i} long" for i in range(words)], "target double"]))


def pack_rows(binned: DataFrame, features: int, rows: int) -> DataFrame:
    """Blocks of rows in the order of their bins: the bins of each different row, where its rows start, and all targets."""
    words = [c for c in binned.columns if c != "target"]

    def pack(block: int, held: list[pd.DataFrame]) -> dict:
        some = pd.concat(held, ignore_index=True)
        keys = some[words].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        bins = np.stack([keys[starts, i // WORD_FEATURES] >> (5 * (i % WORD_FEATURES)) & 31 for i in range(features)], axis=1)
        return {
            "block": block,
            "bins": bins.astype(np.uint8).tobytes(),
            "starts": starts.astype(np.int32).tobytes(),
            "target": some["target"].to_numpy(np.float64).tobytes(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield pd.DataFrame([pack(block, held)])
                block, held, size = block + 1, [], 0
        if size:
            yield pd.DataFrame([pack(block, held)])

    # ranges of bins and targets, so that a frequent row is no task's alone
    dealt = binned.repartitionByRange(rows // PACK_ROWS + 1, *words, "target").sortWithinPartitions(*words, "target")
    return dealt.mapInPandas(run, BLOCK_SCHEMA)


def chances(rate: float) -> list[int]:
    """For 1, 2, ... draws the part of DRAWS from which on a random number means at least as many: a Poisson distribution."""
    below, chance, out = 0.0, math.exp(-rate), []
    for n in range(1, 255):
        below += chance
        chance *= rate / n
        if round(below * DRAWS) >= DRAWS:
            break
        out.append(round(below * DRAWS))
    return out


def draw(source: np.random.Generator, rows: int, table: list[int]) -> np.ndarray:
    """How often each row is drawn."""
    picked, out = source.integers(0, DRAWS, rows, np.uint16), np.zeros(rows, np.uint8)
    for least in table:
        out += (picked >= least).view(np.uint8)
    return out.astype(np.float64)


# ---- a pass ------------------------------------------------------------------------------------------------------------


class Tree:
    """Nodes of a growing tree in the order in which they were made; a child's number is higher than its parent's."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left = np.array([-1]), np.array([0]), np.array([0])
        self.sums = np.zeros((1, 3))  # rows, sum and sum of squares of the target
        self.gain = np.array([-1.0])
        self.front = np.array([0])  # nodes that may be split in this pass

    def plain(self, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
        """What a task needs: feature, cut and left child of each node, its place in the front (-1 without one), drawn features."""
        slot = np.full(len(self.feature), -1)
        slot[self.front] = np.arange(len(self.front))
        return self.feature, self.cut, self.left, slot, drawn

    def split(self, found: pd.DataFrame, last: bool) -> None:
        """Take over the best splits of the front; the children are the next front unless they are at the greatest depth."""
        nodes = self.front[found["slot"]]
        self.sums[nodes] = found[["n", "s", "q"]]
        good = found[found["feature"] >= 0]
        nodes, first = self.front[good["slot"]], len(self.feature)
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = good["feature"], good["cut"], good["gain"]
        left = first + 2 * np.arange(len(good))
        self.left[nodes] = left
        ours = good[["left_n", "left_s", "left_q"]].to_numpy()
        children = np.stack([ours, good[["n", "s", "q"]].to_numpy() - ours], axis=1).reshape(-1, 3)
        none = np.full(2 * len(good), -1)
        self.feature, self.cut, self.left = np.r_[self.feature, none], np.r_[self.cut, none + 1], np.r_[self.left, none + 1]
        self.sums, self.gain = np.r_[self.sums, children], np.r_[self.gain, none.astype(float)]
        self.front = np.array([], np.int64) if last else np.arange(first, len(self.feature))


def walk(bins: np.ndarray, tree: tuple[np.ndarray, ...], level: int) -> np.ndarray:
    """The node that each row of bins has come to."""
    feature, cut, left = tree[:3]
    node, flat, at = np.zeros(len(bins), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    for _ in range(level):
        own = feature[node]
        further = left[node] + (flat[at + np.maximum(own, 0)] > cut[node])
        node = np.where(own >= 0, further, node)
    return node


def add_block(sums: np.ndarray, bins: np.ndarray, weights: np.ndarray, tree: tuple[np.ndarray, ...], level: int) -> None:
    """Add a block's rows to ``sums``: number, sum and square sum of the target by node of the front, drawn feature and bin."""
    slot = tree[3][walk(bins, tree, level)]
    held = np.flatnonzero((slot >= 0) & (weights[0] > 0))
    slot, weights, drawn = slot[held], weights[:, held], tree[4]
    flat, at, k = bins.ravel(), held * bins.shape[1], drawn.shape[1]
    for j in range(k):
        cell = (slot * k + j) * MOST_BINS + flat[at + drawn[slot, j]]
        for total, weight in zip(sums, weights):
            total += np.bincount(cell, weight, len(total))


def pass_level(blocks: DataFrame, trees: dict[int, tuple], features: int, level: int, rate: float | None, seed: int, turns: int, tasks: int):
    """One row per tree and task: the sums of add_block. Each task reads some blocks for the trees of one turn."""
    shared = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, table = shared.value, chances(rate or 1.0)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                bins = np.frombuffer(row.bins, np.uint8).reshape(-1, features)
                starts, target = np.frombuffer(row.starts, np.int32), np.frombuffer(row.target, np.float64)
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(target)]))
                for number, tree in trees.items():
                    if number % turns != row.turn:
                        continue
                    if number not in sums:
                        sums[number] = np.zeros((3, tree[4].size * MOST_BINS))
                    if rate is None:
                        drawn = np.ones(len(target))
                    else:
                        source = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, row.block, number]))
                        drawn = draw(source, len(target), table)
                    first = drawn * target
                    weights = np.stack([np.bincount(group, x, len(starts)) for x in (drawn, first, first * target)])
                    add_block(sums[number], bins, weights, tree, level)
        for number, total in sums.items():
            yield pd.DataFrame({"tree": [number], "sums": [total.tobytes()]})

    # a union of frames with a single partition each would be a single task
    read = blocks.coalesce(tasks) if tasks > 1 else blocks
    dealt = reduce(DataFrame.unionByName, [read.withColumn("turn", F.lit(i)) for i in range(turns)])
    return dealt.mapInPandas(run, "tree int, sums binary")


def best_splits(sums: np.ndarray, drawn: np.ndarray, least_rows: int, least_gain: float) -> pd.DataFrame:
    """The best split of each node of a front, feature -1 if there is none; ties go to the first drawn feature and lowest cut."""
    cells = sums.reshape(3, len(drawn), drawn.shape[1], MOST_BINS)
    n, s, q = cells[:, :, 0].sum(axis=2)
    left = np.cumsum(cells, axis=3)[..., :-1]
    left_n, left_s = left[0], left[1]
    right_n, right_s = n[:, None, None] - left_n, s[:, None, None] - left_s
    fits = (left_n >= max(least_rows, 1)) & (right_n >= max(least_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_square = np.where(n > 0, s * s / np.maximum(n, 1), 0)
        between = np.where(fits, left_s**2 / left_n + right_s**2 / right_n, -np.inf) - mean_square[:, None, None]
    between = between.reshape(len(drawn), -1)
    best = between.argmax(axis=1)
    node = np.arange(len(drawn))
    gain = between[node, best] / np.maximum(n, 1)
    j, cut = np.divmod(best, MOST_BINS - 1)
    # what adding in another order may leave of a gain of 0 is none
    good = (gain > 1e-12 * np.maximum(q / np.maximum(n, 1), 1e-300)) & (gain >= least_gain)
    out = {"slot": node, "feature": np.where(good, drawn[node, j], -1), "cut": cut, "gain": gain, "n": n, "s": s, "q": q}
    return pd.DataFrame(out | dict(zip(("left_n", "left_s", "left_q"), left[:, node, j, cut])))


def choose_splits(found: DataFrame, drawn: dict[int, np.ndarray], least_rows: int, least_gain: float) -> DataFrame:
    """The tasks' sums of each tree added up, and the best splits of its front."""
    shared = found.sparkSession.sparkContext.broadcast(drawn)

    def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in parts["sums"])
        return best_splits(total, shared.value[key[0]], least_rows, least_gain).assign(tree=key[0])

    return found.groupBy("tree").applyInPandas(choose, SPLIT_SCHEMA)


# ---- the forest --------------------------------------------------------------------------------------------------------


def grow(blocks: DataFrame, rows: int, features: int, forest: RandomForestRegressor) -> list[Tree]:
    """All trees level by level; the driver holds their nodes only."""
    spark = blocks.sparkSession
    seed, count, depth = forest.getSeed(), forest.getNumTrees(), forest.getMaxDepth()
    least_rows, least_gain = forest.getMinInstancesPerNode(), forest.getMinInfoGain()
    rate = forest.getSubsamplingRate() if forest.getBootstrap() else None
    if (rate is None and forest.getSubsamplingRate() != 1.0) or forest.getMinWeightFractionPerNode() != 0.0:
        raise ValueError("rows are drawn with replacement or all taken, and no weight fraction is asked of a node")
    k = {"all": features, "onethird": -(-features // 3), "auto": features if count == 1 else -(-features // 3)}[forest.getFeatureSubsetStrategy()]
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    trees = [Tree() for _ in range(count)]
    tasks = rows // PASS_ROWS + 1
    turns = min(count, max(1, -(-2 * spark.sparkContext.defaultParallelism // tasks)))
    for level in range(depth):
        open_ = {i: tree for i, tree in enumerate(trees) if len(tree.front)}
        if not open_:
            break
        drawn = {i: np.sort(np.argsort(rng.random((len(t.front), features)), axis=1)[:, :k], axis=1) for i, t in open_.items()}
        plain = {i: tree.plain(drawn[i]) for i, tree in open_.items()}
        found = pass_level(blocks, plain, features, level, rate, seed, turns, tasks)
        best = choose_splits(found, drawn, least_rows, least_gain).toArrow().to_pandas()
        for i, chosen in best.groupby("tree"):
            trees[i].split(chosen.sort_values("slot"), level == depth - 1)
    return trees


def as_model(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray], forest: RandomForestRegressor) -> RandomForestRegressionModel:
    """The trees in the form in which Spark ML stores a forest, loaded by it."""
    path = f"{run_folder(spark)}/forest-{uuid.uuid4().hex}"
    tables = []
    for i, tree in enumerate(trees):
        n, s, q = tree.sums.T
        some = np.maximum(n, 1)
        inner = tree.feature >= 0
        names = ["treeID", "id", "prediction", "impurity", "n", "s", "q", "gain", "leftChild", "rightChild", "featureIndex", "threshold"]
        mean = s / some
        at = [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        values = [np.full(len(n), i), np.arange(len(n)), mean, np.maximum(q / some - mean * mean, 0), n, s, q, tree.gain]
        values += [np.where(inner, tree.left, -1), np.where(inner, tree.left + 1, -1), tree.feature, np.array(at, float)]
        tables.append(pa.table([pa.array(v) for v in values], names=names))
    split = F.struct(
        F.col("featureIndex").cast("int").alias("featureIndex"),
        F.when(F.col("featureIndex") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        F.col("id").cast("int").alias("id"),
        "prediction",
        "impurity",
        F.array("n", "s", "q").alias("impurityStats"),
        F.col("n").cast("long").alias("rawCount"),
        "gain",
        F.col("leftChild").cast("int").alias("leftChild"),
        F.col("rightChild").cast("int").alias("rightChild"),
        split.alias("split"),
    )
    nodes = spark.createDataFrame(pa.concat_tables(tables))
    nodes.select(F.col("treeID").cast("int").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
    known = {p.name: v for p, v in forest.extractParamMap().items()}

    def described(kind: str, uid: str, skipped: Sequence[str] = (), **more) -> str:
        params = {k: v for k, v in known.items() if k not in skipped}
        made = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": {}}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", **made, **more})

    of_forest = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")
    single = [(i, described("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", of_forest), 1.0) for i in range(len(trees))]
    spark.createDataFrame(single, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = described("RandomForestRegressionModel", forest.uid, numFeatures=len(cuts), numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


def fit_forest(
    rows: DataFrame, features: Sequence[str], target: str, forest: RandomForestRegressor, edges: list[list[float]]
) -> RandomForestRegressionModel:
    """Fit ``forest`` on all rows; ``edges`` are the edges of at most 32 bins per feature, from -inf to inf."""
    cuts = [np.array(e[1:-1], float) for e in edges]
    if max(map(len, cuts)) >= MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins")
    binned = materialise(bin_rows(rows, features, target, cuts), "binned")
    count = binned.count()
    if not count:
        raise ValueError("a forest needs training rows")
    path = f"{run_folder(rows.sparkSession)}/packed-{uuid.uuid4().hex}"
    pack_rows(binned, len(features), count).write.option("parquet.block.size", FILE_BYTES).parquet(path)
    blocks = rows.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)
    return as_model(rows.sparkSession, grow(blocks, count, len(features), forest), cuts, forest)
