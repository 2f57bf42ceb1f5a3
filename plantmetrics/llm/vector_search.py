"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics.session import materialise

K = 20
FIT_ROWS = 50_000  # the tree is fitted on a sample of about so many rows; every row is indexed
BRANCHES = 8
STEPS = 8
SEED = 5
LEAVES_PER_ROOT = 3.0  # leaves: so many times the square root of the number of rows, ...
FIT_PER_LEAF = 8  # ... but at least so many rows of the sample in each
CALIBRATION = 256  # queries that are searched exactly to find out how many leaves to visit
RECALL = 0.97
BLOCK = 4096
PARTS = 32


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows that take part.

    Rows without an id, with a null, zero or empty vector, or with a null or non-finite component take no part, and neither do
    vectors of another length than the most frequent one. Of rows that repeat an id the smallest vector counts.
    """
    vector = F.col("embedding").cast("array<double>")
    valid = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")
    )
    valid = valid.filter(F.forall("vector", is_finite) & F.exists("vector", lambda x: x != 0))
    rows = materialise(valid.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().sort(F.desc("count"), "size").first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- the tree ----------------------------------------------------------------------------------------------------------


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and assignments; fewer than k centres where points coincide."""
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(STEPS):
        nearest = closest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        used = counts > 0
        centres = sums[used] / counts[used, None]
    return centres, closest(points, centres)


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def fit_tree(points: np.ndarray, leaves: int) -> dict:
    """Nodes as arrays: centre, first child, number of children (0: a leaf) and leaf number. The fullest leaf is split next."""
    rng = np.random.default_rng(SEED)
    centres, first, children = [points.mean(0) if len(points) else np.zeros(0)], [0], [0]
    heap = [(-len(points), 0, points)]
    n_leaves = 1
    while heap and n_leaves < leaves:
        size, node, own = heapq.heappop(heap)
        if -size < 2:
            break
        found, nearest = kmeans(own, min(BRANCHES, leaves - n_leaves + 1), rng)
        if len(found) < 2:
            continue
        first[node], children[node] = len(centres), len(found)
        n_leaves += len(found) - 1
        for i, centre in enumerate(found):
            heapq.heappush(heap, (-int((nearest == i).sum()), len(centres), own[nearest == i]))
            centres.append(centre)
            first.append(0)
            children.append(0)
    children_ = np.array(children)
    leaf = np.full(len(children_), -1)
    leaf[children_ == 0] = np.arange(int((children_ == 0).sum()))
    return {"centre": np.array(centres), "first": np.array(first), "children": children_, "leaf": leaf}


def leaves_of(points: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf of every point, going down to the closest child."""
    at = np.zeros(len(points), np.int64)
    while True:
        inner = np.unique(at[tree["children"][at] > 0])
        if not len(inner):
            return tree["leaf"][at]
        for node in inner:
            rows = np.flatnonzero(at == node)
            first = tree["first"][node]
            at[rows] = first + closest(points[rows], tree["centre"][first : first + tree["children"][node]])


def leaves_in_order(query: np.ndarray, tree: dict):
    """Leaves by best bin first: a priority queue over all branches not yet taken, best inner product with the centre first."""
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        n = tree["children"][node]
        if n:
            first = tree["first"][node]
            for i, value in enumerate(tree["centre"][first : first + n] @ query):
                heapq.heappush(heap, (-value, first + i))
        else:
            yield int(tree["leaf"][node])


def visits(query: np.ndarray, tree: dict, counts: np.ndarray, least: int, k: int) -> list[int]:
    """The first ``least`` leaves, and more until they hold more than ``k`` rows."""
    chosen, rows = [], 0
    for leaf in leaves_in_order(query, tree):
        if len(chosen) >= least and rows > k:
            break
        chosen.append(leaf)
        rows += counts[leaf]
    return chosen


# ---- exact search of one block -----------------------------------------------------------------------------------------


def block_best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """For every query the ids and scores of its k best rows of the block, best first, ties to the smaller id.

    The matrix product only chooses candidates, with a margin; scores are sums over each row by itself, so equal vectors get
    equal scores.
    """
    product = queries @ vectors.T
    product[query_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, product.shape[1])
    bound = np.partition(product, product.shape[1] - n, axis=1)[:, product.shape[1] - n]
    margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
    for i in range(len(query_ids)):
        near = np.flatnonzero((product[i] >= bound[i] - margin[i]) & (product[i] > -np.inf))
        score = (vectors[near] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[near], -score))[:k]
        yield ids[near][order], score[order]


FOUND = "query_id long, part int, vec_ids array<long>, scores array<double>"


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all partial lists, merged in two levels, so that no query gathers its lists at once."""

    def level(frame: DataFrame, *keys: str) -> DataFrame:
        pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("less"), F.col("vec_ids").alias("vec_id"))
        lists = frame.select(*keys, pairs.alias("pairs"))
        best = F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k)
        return (
            lists.groupBy(*keys)
            .agg(best.alias("best"))
            .select(
                *keys,
                F.transform("best", lambda p: p["vec_id"]).alias("vec_ids"),
                F.transform("best", lambda p: -p["less"]).alias("scores"),
            )
        )

    return level(level(found, "query_id", "part"), "query_id")


def exact_best(vectors: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The true neighbours of a few queries, from one pass over all vectors."""
    ids, points = queries["vec_id"].to_numpy(), np.stack(queries["vector"].to_numpy())

    def run(batches):
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            lists = list(block_best(batch.column("vec_id").to_numpy(), matrix(batch.column("vector")), ids, points, k))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(np.full(len(ids), number % PARTS, np.int32)),
                    pa.array([x[0] for x in lists], pa.list_(pa.int64())),
                    pa.array([x[1] for x in lists], pa.list_(pa.float64())),
                ],
                ["query_id", "part", "vec_ids", "scores"],
            )

    return merge(vectors.mapInArrow(run, FOUND), k).toPandas()


def sample(vectors: DataFrame, rows: int, total: int, salt: int) -> pd.DataFrame:
    """About ``rows`` rows, chosen by a hash of the id."""
    share = min(1.0, rows / max(1, total))
    chosen = F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return vectors.filter(chosen).sort("vec_id").toPandas()


def with_leaves(vectors: DataFrame, tree: dict) -> DataFrame:
    """Every row with the number of its leaf, written."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            points = matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, 0))
            leaf = leaves_of(points, shared.value) if batch.num_rows else np.zeros(0)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(leaf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "leaf"])

    return materialise(vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, leaf int"), "tree-index")


def rows_per_leaf(index: DataFrame, leaves: int) -> np.ndarray:
    counts = np.zeros(leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():
        counts[leaf] = n
    return counts


def graft(tree: dict, subtrees: dict[int, dict]) -> dict:
    """The tree with leaves replaced by trees of their own; leaves are numbered anew."""
    centre, first, children = [tree["centre"]], tree["first"].copy(), tree["children"].copy()
    node_of = {leaf: node for node, leaf in enumerate(tree["leaf"].tolist()) if leaf >= 0}
    more_first, more_children, size = [], [], len(first)
    for leaf, sub in sorted(subtrees.items()):
        # the root of the subtree is the old leaf; its other nodes go to the end
        shift = size - 1
        first[node_of[leaf]], children[node_of[leaf]] = sub["first"][0] + shift, sub["children"][0]
        centre.append(sub["centre"][1:])
        more_first.append(np.where(sub["children"][1:] > 0, sub["first"][1:] + shift, 0))
        more_children.append(sub["children"][1:])
        size += len(sub["centre"]) - 1
    children = np.concatenate([children, *more_children])
    leaf = np.full(len(children), -1)
    leaf[children == 0] = np.arange(int((children == 0).sum()))
    return {"centre": np.concatenate(centre), "first": np.concatenate([first, *more_first]), "children": children, "leaf": leaf}


def grow(tree: dict, index: DataFrame, counts: np.ndarray, leaves: int) -> dict:
    """Split the leaves until there are about ``leaves`` in all, in proportion to their rows.

    Each leaf draws a sample of its own rows by hash and is split in a task of its own, so no task and not the driver sees more
    than FIT_PER_LEAF rows for each leaf that comes out of it; what is collected are the centres.
    """
    wanted = np.round(counts * (leaves / max(1, counts.sum()))).astype(int)
    shares = [
        (leaf, int(n), min(1.0, float(n * FIT_PER_LEAF) / rows))
        for leaf, (n, rows) in enumerate(zip(wanted.tolist(), counts.tolist(), strict=True))
        if n > 1
    ]
    if not shares:
        return tree
    # one row per leaf of the first tree, of which there are at most FIT_ROWS / FIT_PER_LEAF
    plan = F.broadcast(index.sparkSession.createDataFrame(shares, "leaf int, wanted int, share double"))
    drawn = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    points = index.join(plan, "leaf").filter(drawn).select("leaf", "wanted", "vec_id", "vector")

    def split(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id")
        sub = fit_tree(np.stack(own["vector"].to_numpy()), int(own["wanted"].iloc[0]))
        packed = {"leaf": [own["leaf"].iloc[0]], "centre": [sub["centre"].ravel()]}
        return pd.DataFrame(packed | {c: [sub[c]] for c in ("first", "children")})

    schema = "leaf int, centre array<double>, first array<long>, children array<long>"
    grown = points.groupBy("leaf").applyInPandas(split, schema).toPandas()
    subtrees = {
        int(row.leaf): {
            "centre": np.asarray(row.centre).reshape(len(row.first), -1),
            "first": np.asarray(row.first),
            "children": np.asarray(row.children),
        }
        for row in grown.itertuples()
        if len(row.first) > 1
    }
    return graft(tree, subtrees)


def build_index(vectors: DataFrame) -> tuple[dict, DataFrame, np.ndarray]:
    """The tree, every row with its leaf (written), and the rows per leaf.

    The number of leaves grows with the root of the number of rows. Where the sample is too small for so many, its leaves are
    split once more, each from rows of its own.
    """
    total = vectors.count()
    fitted = sample(vectors, FIT_ROWS, total, 1)
    points = np.stack(fitted["vector"].to_numpy()) if len(fitted) else np.zeros((0, 0))
    leaves = max(1, int(LEAVES_PER_ROOT * total**0.5))
    tree = fit_tree(points, max(1, min(leaves, len(points) // FIT_PER_LEAF)))
    index = with_leaves(vectors, tree)
    counts = rows_per_leaf(index, int(tree["leaf"].max()) + 1)
    if leaves > len(counts) and total > FIT_ROWS:
        tree = grow(tree, index, counts, leaves)
        index = with_leaves(index, tree)
        counts = rows_per_leaf(index, int(tree["leaf"].max()) + 1)
    return tree, index, counts


def calibrate(index: DataFrame, is_query: Column, tree: dict, counts: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaves to visit so that the mean recall of the calibration queries reaches ``recall``."""
    asked = index.filter(is_query)
    chosen = sample(asked, CALIBRATION, asked.count(), 2)
    if not len(chosen):
        return 1
    truth = exact_best(index.select("vec_id", "vector"), chosen, k).set_index("query_id")
    needed = index.join(
        index.sparkSession.createDataFrame(
            [(int(v),) for v in {v for ids in truth["vec_ids"] for v in ids}] or [(-1,)], "vec_id long"
        ),
        "vec_id",
    ).select("vec_id", "leaf")
    leaf_of = {row["vec_id"]: row["leaf"] for row in needed.collect()}
    depth = np.zeros(len(counts) + 1)  # share of true neighbours whose leaf comes at this place
    for query_id, vector in zip(chosen["vec_id"], chosen["vector"], strict=True):
        place = {leaf: i for i, leaf in enumerate(leaves_in_order(np.asarray(vector), tree))}
        for v in truth.loc[query_id, "vec_ids"]:
            depth[place[leaf_of[v]]] += 1
    reached = np.cumsum(depth) / max(1.0, depth.sum())
    return int(np.searchsorted(reached, recall)) + 1


def search(embeddings: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest rows by inner product of every row where ``is_query`` (a condition on vec_id) holds, but for itself.

    A tree is fitted on a sample and all rows are put into its leaves, which are split again where the table is large. A calibration set of the queries is searched exactly, and
    the number of leaf visits is widened until their mean recall reaches ``recall``. Queries then take their leaves from a
    priority queue. A leaf's rows and the queries that visit it are dealt into blocks, so a leaf with many equal vectors or
    many visitors is many tasks; a block gives each of its queries one list of k, and the lists are merged.

    Returns query_id, rank (from 1), vec_id and score (inner product in double precision), ties to the smaller vec_id. Which
    rows take part is told in ``clean_vectors``. With fewer than k other rows all are returned; a single row, or an empty
    table, gives no rows. Other columns are not read.
    """
    vectors = clean_vectors(embeddings)
    tree, index, counts = build_index(vectors)
    least = calibrate(index, is_query, tree, counts, k, recall)
    shared = embeddings.sparkSession.sparkContext.broadcast({"tree": tree, "counts": counts})

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vector"))
            chosen = [visits(p, shared.value["tree"], shared.value["counts"], least, k) for p in points]
            rows = np.repeat(np.arange(len(points)), [len(c) for c in chosen])
            leaf = pa.array(np.concatenate(chosen).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), leaf], ["query_id", "leaf"])

    asked = index.filter(is_query).select("vec_id", "vector")
    visited = materialise(asked.mapInArrow(visit, "query_id long, leaf int"), "leaf-visits")
    loads = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("row_blocks"))
    loads = loads.join(
        visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks")), "leaf"
    )
    loads = materialise(loads, "leaf-loads")

    def numbers(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    rows = (
        index.join(loads, "leaf")
        .withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int"))
        .withColumn("query_block", numbers("query_blocks"))
        .select("leaf", "row_block", "query_block", "vec_id", "vector")
    )
    questions = (
        visited.join(loads, "leaf")
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
        .withColumn("row_block", numbers("row_blocks"))
        .join(asked.withColumnRenamed("vec_id", "query_id"), "query_id")
        .select("leaf", "row_block", "query_block", "query_id", F.col("vector").alias("query"))
    )
    keys = ["leaf", "row_block", "query_block"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "part": [], "vec_ids": [], "scores": []})
        ids, query_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        lists = list(block_best(ids, np.stack(left["vector"]), query_ids, np.stack(right["query"]), k))
        part = int(left["leaf"].iloc[0] + left["row_block"].iloc[0]) % PARTS
        return pd.DataFrame(
            {"query_id": query_ids, "part": part, "vec_ids": [x[0] for x in lists], "scores": [x[1] for x in lists]}
        )

    found = rows.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(compare, FOUND)
    best = merge(found, k)
    return best.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )
