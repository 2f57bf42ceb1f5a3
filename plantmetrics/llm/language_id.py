"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.session import materialise

BUCKET_BITS = 15
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
PIECE = 1 << 20  # characters counted at a time
MAX_LANGUAGES = 1024  # the matrix is broadcast: 2^15 buckets x 4 bytes x 1024 languages are 128 MB
UNDETERMINED = "und"


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def gram_counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Counts of the text's n-grams by hash bucket; None if it has no letter.

    The text is put in lower case, each run of other characters than letters is one space, and a space is put before and
    after. Texts longer than ``PIECE`` are counted piece by piece, as if a space stood at the cut.
    """
    total = None
    for start in range(0, len(text or ""), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        if not is_letter.any():
            continue
        spaced = np.concatenate([[0], np.where(is_letter, codes, 0), [0]]).astype(np.uint32)
        spaced = spaced[np.concatenate([[True], (spaced[1:] != 0) | (spaced[:-1] != 0)])]
        hashes, state = [], np.zeros(len(spaced), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if n > len(spaced):
                break
            state = (state[: len(spaced) - n + 1] + spaced[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            state ^= state >> np.uint32(15)
            if n in GRAMS:
                hashes.append((state * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
        counts = np.bincount(np.concatenate(hashes), minlength=1 << BUCKET_BITS)
        total = counts if total is None else total + counts
    return total


def fit(labelled: DataFrame) -> dict:
    """Log-probabilities per language and bucket from all rows of ``labelled`` (text, lang); rows with null lang are left out.

    Every task sums its rows to one count per language and bucket; those are summed in one exchange. Only the matrix, of a
    size that ``MAX_LANGUAGES`` bounds, comes to the driver. Bucket -1 counts the documents.
    """
    spark = labelled.sparkSession
    letters = spark.sparkContext.broadcast(letter_table())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts = gram_counts(text, letters.value)
                if counts is not None:
                    if lang in sums:
                        sums[lang] += counts
                    else:
                        sums[lang] = counts
                    n_docs[lang] = n_docs.get(lang, 0) + 1
        for lang, counts in sums.items():
            buckets = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(buckets) + 1), pa.string()),
                    pa.array(np.append(buckets, -1).astype(np.int32)),
                    pa.array(np.append(counts[buckets], n_docs[lang]).astype(np.int64)),
                ],
                ["lang", "bucket", "n"],
            )

    rows = labelled.filter(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "gram-counts")
    langs = [r[0] for r in counted.filter("bucket = -1").select("lang").sort("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = counted.toArrow()
    index = {lang: i for i, lang in enumerate(langs)}
    place = np.array([index[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy().astype(float)
    counts, docs = np.zeros((len(langs), 1 << BUCKET_BITS)), np.zeros(len(langs))
    grams = bucket >= 0
    counts[place[grams], bucket[grams]] = n[grams]
    docs[place[~grams]] = n[~grams]
    smooth = counts + SMOOTHING
    return {
        "langs": langs,
        "log_prob": np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32) if langs else None,
        "log_prior": np.log(docs / docs.sum()) if langs else None,
        "letters": letters.value,
    }


def predict_text(text: str | None, model: dict) -> tuple[str, float]:
    counts = gram_counts(text, model["letters"])
    if counts is None or not model["langs"]:
        return UNDETERMINED, 0.0
    present = np.flatnonzero(counts)  # the document's sparse row
    logs = counts[present].astype(np.float32) @ model["log_prob"][present] + model["log_prior"]
    best = int(np.argmax(logs))
    return model["langs"][best], float(1.0 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with lang_pred and score (the posterior probability of that language), in place, without a shuffle.

    Null texts, empty texts and texts without a letter are ``und`` with score 0, as is everything if no row had a language.
    Ties go to the language that sorts first. Texts are read whole, and rows that repeat are scored each. Columns of the
    documents that are called lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = [docs.schema[c] for c in names]
    schema = T.StructType(
        [*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            found = [predict_text(text, shared.value) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return docs.select(*names).mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Fit on the rows that are not held out and predict every row."""
    return predict(docs, fit(docs.filter(~held_out)))
