"""Inverted index of chunk vectors, cut into segments with the largest weight of each term, and its search.

A segment holds the postings of some hundred chunks, term by term; the postings of one term in one segment are a block. The
segments stay where they are, and questions come to them in rounds of bounded size. A task bounds from above what a question can
score in some segments, from the blocks' largest weights alone, and scores it only if this reaches the k-th best score that the
task has found for the question. Scores are first worked out in single precision, for terms that many questions share by a product
of matrices and for the others from the few rows that a question names; what may be among the k best is scored again in double
precision. No row is made for a pair of a question and a segment: a task gives k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.session import materialise

SEGMENT_CHUNKS = 256
TASK_QUESTIONS = 16_384  # questions of a round; their vectors, some megabytes, are sent to every task
BLOCK_QUESTIONS = 512  # of which so many are scored together
SHARED = 0.08  # of a block's questions have a term, and it is a column of their matrix
TASK_SEGMENTS = 16  # segments that a task unpacks at once,
TILE_CELLS = 8_000_000  # if their table has no more cells than that; a cell takes 12 bytes
EXACT_PAIRS = 100_000  # pairs of a question and a chunk that are scored again at once
TASKS_A_CORE, LEAST_TASKS = 2, 32  # tasks of a round; a task goes through any number of segments one after the other
MERGE_PARTS = 32  # hits of a question are merged in two levels if a round has more tasks than that
SLACK = 2e-6  # scores are rounded to six digits before they are ranked
SMALLEST = 1e-7  # what is lower is rounded to 0
SEGMENT_SCHEMA = (
    "segment long, chunk_ids array<string>, norms array<double>, terms array<int>, largest array<double>, starts array<int>,"
    " places binary, weights binary"
)


# ---- build -------------------------------------------------------------------------------------------------------------


def pack_segment(segment: int, rows: pd.DataFrame) -> dict:
    """The postings of some chunks by term: where each term's block starts, and place and weight of every posting.

    Weights are kept as they are before they are divided by their chunk's ``norm`` (1 without that column): a term has few
    different ones, so they take little room on disk.
    """
    sizes = rows["cols"].map(len).to_numpy()
    norms = rows["norm"].to_numpy() if "norm" in rows else np.ones(len(rows))
    place = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    term, weight = np.concatenate(rows["cols"].tolist()), np.concatenate(rows["vals"].tolist())
    order = np.argsort(term, kind="stable")
    term, weight = term[order], weight[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    return {
        "segment": segment,
        "chunk_ids": rows["chunk_id"].tolist(),
        "norms": norms.astype(np.float64),
        "terms": term[starts].astype(np.int32),
        "largest": np.maximum.reduceat(weight / norms[place[order]], starts),
        "starts": starts.astype(np.int32),
        "places": place[order].tobytes(),
        "weights": weight.astype(np.float64).tobytes(),
    }


def heaviest(row_cols: np.ndarray, row_vals: np.ndarray) -> int:
    return int(row_cols[np.argmax(row_vals)])


def build_segments(vectors: DataFrame, chunks: int = SEGMENT_CHUNKS) -> DataFrame:
    """One row per segment of ``vectors`` (chunk_id, cols, vals, and norm if vals are still to be divided by it); chunks are
    packed in the tasks where they are.

    Within what a task holds at once, chunks with the same most common and the same heaviest term lie side by side: the former
    tells languages apart, so that a segment has fewer terms, and for the latter its largest weights are high for few of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            batch = batch[batch["cols"].map(len) > 0]
            if batch.empty:
                continue
            lead = [heaviest(c, v) for c, v in zip(batch["cols"], batch["vals"], strict=True)]
            # columns are numbered from the most common term on
            common = [int(c[0]) for c in batch["cols"]]
            batch = batch.assign(common=common, lead=lead).sort_values(["common", "lead", "chunk_id"])
            rows = []
            for start in range(0, len(batch), chunks):
                rows.append(pack_segment(first + made, batch[start : start + chunks]))
                made += 1
            yield pd.DataFrame(rows)

    norm = [c for c in vectors.columns if c == "norm"]
    return vectors.select("chunk_id", "cols", "vals", *norm).mapInPandas(run, SEGMENT_SCHEMA)


# ---- search ------------------------------------------------------------------------------------------------------------


def term_limits(maxima: DataFrame, k: int) -> DataFrame:
    """Per term its largest weight, and the k-th largest of its blocks' largest weights (0 with fewer blocks).

    k blocks are k different chunks, so a question with this term has k chunks at or above the second figure times its weight.
    """
    order = W.partitionBy("term_no").orderBy(F.desc("largest"))
    best = maxima.select("term_no", "largest").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    sure = F.coalesce(F.max(F.when(F.col("r") == k, F.col("largest"))), F.lit(0.0))
    return best.groupBy("term_no").agg(F.max("largest").alias("top"), sure.alias("sure"))


def bound_segments(asked: DataFrame, maxima: DataFrame, k: int) -> DataFrame:
    """question_id, segment, bound and floor for the segments in which a question may find one of its k best chunks, as a table.

    It has a row for each such pair, so it is for looking at bounds; the search works them out inside its tasks.
    ``floor`` is a score that k chunks are known to reach. A question's terms are taken from the weakest on as long as all of
    them together stay below the floor: a chunk with only these cannot be a hit, so their blocks are not looked at, and their
    largest weights stand in for them. The other terms' blocks are summed by segment.
    """
    weighed = asked.select("question_id", F.inline(F.arrays_zip("cols", "vals"))).withColumnRenamed("cols", "term_no")
    limits = F.broadcast(term_limits(maxima, k))  # one row per term of the vocabulary, which has a largest size
    each = weighed.join(limits, "term_no").withColumn("most", F.col("vals") * F.col("top"))
    own = W.partitionBy("question_id")
    rising = own.orderBy("most", "term_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    split = each.withColumn("floor", F.max(F.col("vals") * F.col("sure")).over(own)).withColumn(
        "weak", F.sum("most").over(rising) < F.col("floor") - SLACK
    )
    rest = F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))).over(own), F.lit(0.0))
    strong = split.withColumn("rest", rest).where(~F.col("weak")).select("question_id", "term_no", "vals", "floor", "rest")
    return (
        strong.join(maxima, "term_no")
        .groupBy("question_id", "segment")
        .agg(
            (F.sum(F.col("vals") * F.col("largest")) + F.max("rest")).alias("bound"),
            F.max("floor").alias("floor"),
        )
        .where(F.col("bound") >= F.col("floor") - SLACK)
    )


class Block(NamedTuple):
    """Questions that are scored together: their ids, and their terms and weights one after the other.

    Terms that a good part of the block shares are columns of ``matrix``; the rest of each question's terms stay a list.
    """

    ids: np.ndarray
    starts: np.ndarray  # of each question's terms, and the end
    terms: np.ndarray
    weights: np.ndarray
    shared: np.ndarray
    matrix: np.ndarray  # questions x shared terms
    rest_starts: np.ndarray
    rest_terms: np.ndarray
    rest_weights: np.ndarray


def question_block(some: pd.DataFrame) -> Block:
    sizes = some["cols"].map(len).to_numpy()
    terms, weights = np.concatenate(some["cols"].tolist()).astype(np.int64), np.concatenate(some["vals"].tolist())
    row = np.repeat(np.arange(len(some)), sizes)
    known, place, uses = np.unique(terms, return_inverse=True, return_counts=True)
    common = uses >= SHARED * len(some)
    column = np.cumsum(common) - 1
    dense = common[place]
    matrix = np.zeros((len(some), int(common.sum())), np.float32)
    matrix[row[dense], column[place[dense]]] = weights[dense]
    rest_starts = np.r_[0, np.cumsum(np.bincount(row[~dense], minlength=len(some)))]
    rest = terms[~dense], weights[~dense].astype(np.float32)
    return Block(some["question_id"].to_numpy(), np.r_[0, np.cumsum(sizes)], terms, weights, known[common], matrix, rest_starts, *rest)


def question_blocks(asked: DataFrame, together: int = BLOCK_QUESTIONS) -> list[Block]:
    """The questions of a round in blocks; those with the same most common terms side by side, so that a block shares terms."""
    table = asked.select("question_id", "cols", "vals").toArrow().combine_chunks()
    rows = pd.DataFrame({name: table.column(name).to_numpy() for name in table.column_names})
    rows = rows[rows["cols"].map(len) > 0]
    for i in range(3):
        rows[i] = [int(c[i]) if len(c) > i else -1 for c in rows["cols"]]
    rows = rows.sort_values([0, 1, 2, "question_id"])
    return [question_block(rows[start : start + together]) for start in range(0, len(rows), together)]


class Segment(NamedTuple):
    chunk_ids: np.ndarray
    terms: np.ndarray
    largest: np.ndarray
    table: np.ndarray  # terms x chunks


def unpack_segment(row) -> Segment:
    terms, chunk_ids = np.asarray(row.terms), np.asarray(row.chunk_ids, dtype=object)
    place, weight = np.frombuffer(row.places, np.int32), np.frombuffer(row.weights, np.float64)
    block = np.repeat(np.arange(len(terms)), np.diff(np.r_[row.starts, len(place)]))
    table = np.zeros((len(terms), len(chunk_ids)))
    table[block, place] = weight / np.asarray(row.norms)[place]
    return Segment(chunk_ids, terms, np.asarray(row.largest), table)


class Tile(NamedTuple):
    """Segments that are scored together as one table; its last row is 0 and stands for all terms that it lacks."""

    chunk_ids: np.ndarray
    row: np.ndarray  # of each term by its number; the last entry is for all higher numbers
    largest: np.ndarray
    table: np.ndarray  # rows of terms x chunks
    rough: np.ndarray  # the same in single precision

    def rows(self, terms: np.ndarray) -> np.ndarray:
        return self.row[np.minimum(terms, len(self.row) - 1)]


def join_segments(segments: list[Segment]) -> Tile:
    terms = np.unique(np.concatenate([s.terms for s in segments]))
    row = np.full(int(terms[-1]) + 2, len(terms))
    row[terms] = np.arange(len(terms))
    table = np.zeros((len(terms) + 1, sum(len(s.chunk_ids) for s in segments)))
    largest, start = np.zeros(len(terms) + 1), 0
    for s in segments:
        own = row[s.terms]
        table[own, start : start + len(s.chunk_ids)] = s.table
        largest[own] = np.maximum(largest[own], s.largest)
        start += len(s.chunk_ids)
    return Tile(np.concatenate([s.chunk_ids for s in segments]), row, largest, table, table.astype(np.float32))


def tiles(batch: pd.DataFrame) -> Iterator[Tile]:
    """Neighbouring segments in tiles of at most TASK_SEGMENTS, and of TILE_CELLS cells if it is more than one."""
    some, terms, chunks = [], np.array([], np.int64), 0
    for row in batch.itertuples(index=False):
        both = np.union1d(terms, row.terms)
        if some and (len(some) == TASK_SEGMENTS or len(both) * (chunks + len(row.chunk_ids)) > TILE_CELLS):
            yield join_segments(some)
            some, both, chunks = [], np.asarray(row.terms), 0
        some.append(unpack_segment(row))
        terms, chunks = both, chunks + len(row.chunk_ids)
    if some:
        yield join_segments(some)


class Best:
    """The k best chunks that a task has found for each question of a block."""

    def __init__(self, block: Block, k: int) -> None:
        self.block, self.k = block, k
        self.top = np.zeros((len(block.ids), k))  # the k best scores
        self.floor = np.zeros(len(block.ids))  # the lowest of them, 0 as long as there are fewer
        self.found = [pd.DataFrame({"q": np.array([], np.int64), "score": np.array([], float), "chunk_id": np.array([], object)})]
        self.rows = 0

    def look(self, tile: Tile) -> None:
        """Score the questions whose bound in the tile reaches their floor: all chunks in single precision, and in double
        precision those that may then be among the k best."""
        bound = np.add.reduceat(self.block.weights * tile.largest[tile.rows(self.block.terms)], self.block.starts[:-1])
        asked = np.flatnonzero((bound > 0) & (bound >= self.floor - SLACK))
        if not len(asked):
            return
        rough = self._rough(tile, asked)
        # A sum of n products is off by n + 2 roundings of the sum of their sizes at most, which the bound is not below.
        slack = SLACK + (np.diff(self.block.starts)[asked] + 4) * np.finfo(np.float32).eps * bound[asked]
        least, new = self.floor[asked], np.flatnonzero(self.floor[asked] == 0)
        if len(new):
            keep = rough.shape[1] - min(self.k, rough.shape[1])
            least[new] = np.partition(rough[new], keep, axis=1)[:, keep] - slack[new]
        least = np.maximum(least - slack, SMALLEST).astype(np.float32)
        near = np.flatnonzero(rough.max(axis=1) >= least)
        q, c = np.divmod(np.flatnonzero(rough[near] >= least[near, None]), rough.shape[1])
        q = asked[near[q]]
        for start in range(0, len(q), EXACT_PAIRS):
            self._keep(tile, q[start : start + EXACT_PAIRS], c[start : start + EXACT_PAIRS])

    def _rough(self, tile: Tile, asked: np.ndarray) -> np.ndarray:
        block, none = self.block, len(tile.table) - 1
        shared = tile.rows(block.shared)
        held = shared < none
        out = block.matrix[np.ix_(asked, held)] @ tile.rough[shared[held]]
        rest = tile.rows(block.rest_terms)
        room = np.empty((int(np.diff(block.rest_starts).max()), out.shape[1]), np.float32)
        for line, i in zip(out, asked, strict=True):
            start, end = block.rest_starts[i], block.rest_starts[i + 1]
            if end > start:
                # the mode spares a second copy, as no index is out of range
                np.take(tile.rough, rest[start:end], axis=0, out=room[: end - start], mode="clip")
                line += block.rest_weights[start:end] @ room[: end - start]
        return out

    def _keep(self, tile: Tile, q: np.ndarray, c: np.ndarray) -> None:
        """Add pairs of a question and a chunk whose exact score reaches the floor, and raise the floors."""
        block = self.block
        sizes = (block.starts[1:] - block.starts[:-1])[q]
        firsts = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.repeat(block.starts[q] - firsts, sizes) + np.arange(sizes.sum())
        products = block.weights[at] * tile.table[tile.rows(block.terms[at]), np.repeat(c, sizes)]
        score = np.round(np.add.reduceat(products, firsts), 6)
        good = (score > 0) & (score >= self.floor[q])
        q, c, score = q[good], c[good], score[good]
        every, scores = np.r_[q, np.repeat(np.arange(len(block.ids)), self.k)], np.r_[score, self.top.ravel()]
        order = np.lexsort((-scores, every))
        counts = np.bincount(every, minlength=len(block.ids))
        self.top = scores[order][(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.floor = self.top[:, -1].copy()
        good = score >= self.floor[q]
        self.found.append(pd.DataFrame({"q": q[good], "score": score[good], "chunk_id": tile.chunk_ids[c[good]]}))
        self.rows += int(good.sum())
        if self.rows > 2 * self.top.size:
            self.prune()

    def prune(self) -> pd.DataFrame:
        """The k best of what was found, ties to the lower id; all else is forgotten."""
        if len(self.found) > 1:
            every = pd.concat(self.found)
            every = every[every["score"].to_numpy() >= self.floor[every["q"].to_numpy()]]
            every = every.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
            self.found = [every.groupby("q", sort=False).head(self.k)]
            self.rows = 0
        return self.found[0]


def search_tasks(segments: DataFrame) -> int:
    """Tasks of a round, at most: they give k rows a question each, so they follow the cores and not the number of segments."""
    return max(TASKS_A_CORE * segments.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS)


def score_segments(asked: DataFrame, segments: DataFrame, k: int, together: int = BLOCK_QUESTIONS) -> DataFrame:
    """The k best chunks of each question in each task's segments: question_id, chunk_id, score; scores above 0.

    The segments are read where they lie; ``asked`` is collected, so it is a round of at most about TASK_QUESTIONS questions.
    """
    shared = asked.sparkSession.sparkContext.broadcast(question_blocks(asked, together))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(block, k) for block in shared.value]
        for batch in batches:
            for tile in tiles(batch):
                for kept in best:
                    kept.look(tile)
        for kept in best:
            found = kept.prune()
            yield found.assign(question_id=kept.block.ids[found["q"].to_numpy()])[["question_id", "chunk_id", "score"]]

    columns = segments.select("chunk_ids", "norms", "terms", "largest", "starts", "places", "weights")
    return columns.coalesce(search_tasks(segments)).mapInPandas(run, "question_id string, chunk_id string, score double")


def search_segments(
    asked: DataFrame, segments: DataFrame, k: int, together: int = BLOCK_QUESTIONS, merge_parts: int = MERGE_PARTS
) -> DataFrame:
    """question_id, rank, chunk_id and score of the k best chunks of ``asked`` (question_id, cols, vals), scores above 0.

    Questions are dealt by a hash of their id into rounds, and each round passes all segments. Only a round's vectors are on the
    driver and in the tasks at a time, and only k rows a question and task are exchanged.
    """
    asked = materialise(asked, "asked")
    rounds = -(-asked.count() // TASK_QUESTIONS)
    if rounds > 1:
        turn = F.pmod(F.xxhash64("question_id"), F.lit(rounds))
        asked = materialise(asked.withColumn("round", turn).sortWithinPartitions("round"), "rounds")

    def best(frame: DataFrame, *keys: str) -> DataFrame:
        # Spark keeps the first k rows of each task before the exchange, as the rank has a limit.
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
        return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def ranked(questions: DataFrame) -> DataFrame:
        hits = score_segments(questions, segments, k, together)
        if search_tasks(segments) > merge_parts:
            parts = hits.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(merge_parts)))
            hits = best(parts, "question_id", "part").drop("rank", "part")
        merged = best(hits, "question_id")
        return materialise(merged.select("question_id", "rank", "chunk_id", "score"), "hits")

    if rounds <= 1:
        return ranked(asked)
    return reduce(DataFrame.unionByName, [ranked(asked.where(F.col("round") == i)) for i in range(rounds)])
