"""Isolation forest: small random trees built in parallel, rows scored where they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions.relational import attach_row
from plantmetrics.functions.selection import exact_quantile, hash_of

# Trees, rows per tree, share of anomalies.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
UNIT = 1_000_000  # path lengths are whole numbers of this part of a step, so their sums do not depend on the order
NODE_SCHEMA = "tree int, node int, feature int, cut double, units long"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def drawn(seed: int, tree: int, node: int, what: str, digits: int) -> int:
    """A number of so many hexadecimal digits from the MD5 of tree and node, which any engine can draw again."""
    return int(hashlib.md5(f"{seed}-{tree}-{node}-{what}".encode()).hexdigest()[:digits], 16)


def grow(rows: np.ndarray, tree: int, seed: int, limit: int) -> list[tuple]:
    """Nodes of one tree in heap numbering: (node, feature, cut, path length at a leaf in UNITs); feature -1 is a leaf.

    Feature and cut are drawn by hash: the feature among those with two values or more, the cut evenly between the smallest and
    the largest of them.
    """
    nodes, pending = [], [(0, rows, 0)]
    while pending:
        node, part, depth = pending.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        usable = np.flatnonzero(high > low) if len(part) > 1 else []
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, round((depth + float(average_path(len(part)))) * UNIT)))
            continue
        feature = int(usable[drawn(seed, tree, node, "feature", 8) % len(usable)])
        share = (drawn(seed, tree, node, "cut", 13) + 0.5) / 2**52
        cut = float(low[feature] + (high[feature] - low[feature]) * share)
        left = part[:, feature] < cut
        nodes.append((node, feature, cut, 0))
        pending += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]
    return nodes


def build_trees(
    df: DataFrame, features: Sequence[str], key: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """Tree nodes. At most trees * sample rows are drawn, by key hash; each tree takes its own ``sample`` of them, and rows go
    round where there are fewer."""
    limit = int(np.ceil(np.log2(sample)))
    names = list(features)
    values = [F.col(c).cast("double").alias(c) for c in names]
    first = df.select(*values, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], hash_of(key, seed).alias("_h"))
    order = ["_h", *[f"_k{i}" for i in range(len(key))]]
    # the draw has a fixed largest size, so numbering it in one window is safe
    numbered = first.orderBy(*order).limit(trees * sample).withColumn("_r", F.row_number().over(W.orderBy(*order)) - 1)
    size = F.count(F.lit(1)).over(W.partitionBy())
    slots = F.sequence(F.col("_r"), F.lit(trees * sample - 1), F.col("_n"))
    placed = numbered.withColumn("_n", size.cast("int")).withColumn("_slot", F.explode(slots))
    groups = placed.select(F.floor(F.col("_slot") / sample).cast("int").alias("tree"), *names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(pdf[names].to_numpy(dtype=float), tree, seed, limit)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "cut", "units"])
        return frame.assign(tree=np.int32(tree))[["tree", "node", "feature", "cut", "units"]]

    return groups.groupBy("tree").applyInPandas(fit, NODE_SCHEMA)


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Isolation score in (0, 1] per row; higher is more isolated.

    The forest holds at most trees * (2 * sample - 1) nodes, whatever the data, and travels to the tasks as
    one small array.
    """
    size = 2 ** (int(np.ceil(np.log2(sample))) + 1) - 1
    feature = np.full((trees, size), -1, dtype=np.int16)
    cut = np.zeros((trees, size))
    units = np.zeros((trees, size), dtype=np.int64)
    for row in nodes.toLocalIterator():
        feature[row.tree, row.node], cut[row.tree, row.node], units[row.tree, row.node] = row.feature, row.cut, row.units
    names = list(features)

    @F.pandas_udf("long")
    def path_units(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            everyone = np.arange(len(rows))
            total = np.zeros(len(rows), dtype=np.int64)
            for tree in range(trees):
                node = np.zeros(len(rows), dtype=np.int64)
                while True:
                    split = feature[tree, node]
                    inner = split >= 0
                    if not inner.any():
                        break
                    value = rows[everyone, np.maximum(split, 0)]
                    step = 2 * node + 1 + (value >= cut[tree, node])
                    node = np.where(inner, step, node)
                total += units[tree, node]
            yield pd.Series(total)

    paths = path_units(*[F.col(c).cast("double") for c in names])
    norm = float(trees * UNIT * average_path(sample))
    return df.withColumn("isolation", F.pow(F.lit(2.0), -paths / norm))


def label(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """anomaly_score below zero and label -1 for the most isolated share of rows, 1 for the rest.

    The threshold is the exact quantile, so without ties just that share of the rows is below zero. ``scored`` is read several
    times and should be a table.
    """
    threshold = exact_quantile(scored, "isolation", 1 - contamination, "t")
    return (
        attach_row(scored, threshold, "_t")
        .withColumn("anomaly_score", F.col("_t.t") - F.col("isolation"))
        .withColumn("anomaly", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
        .drop("_t", "isolation")
    )


def lowest(labelled: DataFrame, k: int = 5) -> DataFrame:
    return labelled.orderBy("anomaly_score", "k1", "k2", "k3", "k4").limit(k)


def split_by_label(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anomalies, normal rows)."""
    return labelled.where(F.col("anomaly") == -1), labelled.where(F.col("anomaly") == 1)
