"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.llm.common import crc_of_id
from plantmetrics.session import materialise

STATISTICS = (
    "log_chars log_words word_length long_words upper digits marks symbols bars exclaims blanks beyond_ascii"
    " distinct_words top_word adjacent_repeats repeated_lines words_per_line sentence_ends"
).split()
FEATURES = 256
RIDGE = 0.01  # per training row
SEED = 11
FOLDS = 4
BINS = 3000
RAW_RANGE = (-1.0, 2.0)
THRESHOLD = 0.7
JUDGED_ROWS = 1000  # texts that are judged at once

UPPER_BYTES = bytes(range(65, 91))
DIGIT_BYTES = bytes(range(48, 58))
MARK_BYTES = b".,;:!?'\"()-"
SYMBOL_BYTES = b"#$%&*+<=>@[\\]^_`{}~/"
ASCII_BYTES = bytes(range(128))


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text, in the order of ``STATISTICS``; zeros for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    size, words, lines = len(raw), text.split(), text.split("\n")

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / size

    n = max(1, len(words))
    lengths = [len(w) for w in words]
    upper = share(UPPER_BYTES)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(sum(lengths) / n),
        sum(x > 20 for x in lengths) / n,
        upper**0.5,
        share(DIGIT_BYTES) ** 0.5,
        share(MARK_BYTES) ** 0.5,
        share(SYMBOL_BYTES) ** 0.5,
        share(b"|") ** 0.5,
        share(b"!") ** 0.5,
        share(b" \n\t") ** 0.5,
        share(ASCII_BYTES),
        len(set(words)) / n,
        (max(Counter(words).values()) / n if words else 0.0) ** 0.5,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
        (raw.count(b". ") + raw.count(b".\n")) / n,
    ]


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """The documents with an array of their statistics; one pass over the texts."""
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            values = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)


# ---- the model ---------------------------------------------------------------------------------------------------------


def matrix(column) -> np.ndarray:
    """A batch column of equally long arrays as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fourier(values: np.ndarray, model: dict) -> np.ndarray:
    """Cosine features whose inner products approximate a Gaussian kernel of the standardised statistics, and a constant."""
    scaled = np.clip((values - model["mean"]) / model["deviation"], -6, 6)
    waves = np.sqrt(2.0 / FEATURES) * np.cos(scaled @ model["waves"] + model["phases"])
    return np.hstack([waves, np.ones((len(values), 1))])


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: the blocks' mean positions and their never falling mean values."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame) -> dict:
    """Fit on all rows of ``labelled``: doc_id, statistics and y (0 or 1).

    Means and deviations, and then the normal equations, are summed per partition; what the driver gets is one number per
    statistic and one per pair of features and fold. The folds (by the id's checksum) give predictions for rows that the
    weights have not seen, and those are calibrated over ``BINS`` equal bins, so the driver never gets a row.
    """
    spark = labelled.sparkSession
    d = len(STATISTICS)
    moments = labelled.select(F.posexplode("statistics").alias("i", "v")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")
    )
    mean, deviation, n = np.zeros(d), np.ones(d), 0
    for row in moments.collect():
        mean[row["i"]], n = row["mean"], row["n"]
        deviation[row["i"]] = row["deviation"] if row["deviation"] > 1e-9 else 1.0
    rng = np.random.default_rng(SEED)
    model = {
        "mean": mean,
        "deviation": deviation,
        "waves": rng.normal(size=(d, FEATURES)) / np.sqrt(d),
        "phases": rng.uniform(0, 2 * np.pi, FEATURES),
    }
    if n == 0:
        return model | {"learned": False, "weights": np.zeros(FEATURES + 1), "x": np.array([0.0]), "y": np.array([0.0])}
    shared = spark.sparkContext.broadcast(model)
    width = FEATURES + 2  # the features, the constant and y

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = fourier(matrix(batch.column("statistics")), shared.value)
            both = np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False).reshape(-1, 1).astype(float)])
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                part = both[folds == fold]
                total[int(fold)] = total.get(int(fold), 0) + part.T @ part
        i, j = np.triu_indices(width)
        for fold, gram in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), fold, np.int32)),
                    pa.array(i.astype(np.int32)),
                    pa.array(j.astype(np.int32)),
                    pa.array(gram[i, j]),
                ],
                ["fold", "i", "j", "v"],
            )

    rows = labelled.select("statistics", "y", F.pmod(F.shiftright(crc_of_id(F.col("doc_id")), 8), F.lit(FOLDS)).cast("int").alias("fold"))
    added = rows.mapInArrow(sums, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    fold, i, j, v = (added.column(c).to_numpy() for c in ("fold", "i", "j", "v"))
    grams = np.zeros((FOLDS, width, width))
    grams[fold, i, j] = v
    grams[fold, j, i] = v

    def solve(gram: np.ndarray) -> np.ndarray:
        count = gram[width - 2, width - 2]
        penalty = np.full(width - 1, RIDGE * max(1.0, count) / FEATURES + 1e-6)
        penalty[-1] = 1e-6  # the constant is free
        return np.linalg.solve(gram[:-1, :-1] + np.diag(penalty), gram[:-1, -1])

    whole = grams.sum(0)
    left_out = np.array([solve(whole - g) for g in grams])
    tuned = spark.sparkContext.broadcast(model | {"left_out": left_out})
    low, high = RAW_RANGE

    def bins(batches):
        count, ones = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            z = fourier(matrix(batch.column("statistics")), tuned.value)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", z, tuned.value["left_out"][folds])
            place = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
            count += np.bincount(place, minlength=BINS)
            ones += np.bincount(place, batch.column("y").to_numpy(zero_copy_only=False).astype(float), BINS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(ones[used])], ["bin", "n", "ones"]
        )

    binned = rows.mapInArrow(bins, "bin int, n long, ones double").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones")
    )
    table = binned.sort("bin").toArrow()
    count = table.column("n").to_numpy().astype(float)
    centres = low + (table.column("bin").to_numpy() + 0.5) * (high - low) / BINS
    x, y = pool_adjacent(centres, table.column("ones").to_numpy() / count, count)
    return model | {"learned": True, "weights": solve(whole), "x": x, "y": y}


def scores(values: np.ndarray, model: dict) -> np.ndarray:
    raw = fourier(values, model) @ model["weights"]
    return np.clip(np.interp(raw, model["x"], model["y"]), 0.0, 1.0)


def with_score(rows: DataFrame, model: dict, column: str = "statistics") -> DataFrame:
    """Rows that hold statistics, with their score instead."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c not in (column, "score")]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            score = scores(matrix(batch.column(column)), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score)], [*names, "score"])

    return rows.select(*names, column).mapInArrow(run, schema)


def label_rows(statistics: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """Statistics of the training rows with y. An id with several labels counts with the largest."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    return statistics.filter(train).join(known, "doc_id").select("doc_id", "statistics", "y")


def score_documents(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id, score and predicted of every document; labels are learned from the rows where ``train`` holds.

    The statistics are written once and serve fitting and scoring, so the texts are read once. Null and empty texts have
    statistics of zero and the score that follows from them. Without any label every score is 0. Rows that repeat are scored
    each; documents without an id are scored but never learned from; other columns are not read.
    """
    stats = materialise(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = fit(label_rows(stats, labels, train))
    return with_score(stats, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they were.

    The texts are read a second time instead of joining the scores back, so no text is shuffled. One pass computes statistics
    and scores and lets accepted rows through, so a text goes to one worker, once. Where no training row has a label, there is
    nothing to judge by, and that is an error; only an empty table needs no labels.
    """
    stats = materialise(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = fit(label_rows(stats, labels, train))
    if not model["learned"]:
        if stats.isEmpty():
            return docs
        raise ValueError("no training document has a quality label, so no document can be judged")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, JUDGED_ROWS):
                some = batch.slice(start, JUDGED_ROWS)
                values = np.array([statistics(t) for t in some.column("text").to_pylist()], float)
                yield some.filter(pa.array(scores(values, shared.value) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
