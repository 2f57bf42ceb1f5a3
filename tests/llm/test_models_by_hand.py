"""The three learned queries against plain versions over collected rows: no hashing into matrices, no sums per task, no batches."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmetrics.llm import language_id, quality, toxicity
from plantmetrics.llm.common import in_fold
from plantmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# ---- language ------------------------------------------------------------------------------------------------------------


def grams(text):
    """Buckets of the 1- to 3-grams of letters and single spaces, one by one."""
    letters = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in (text or "").lower()]
    spaced = [0]
    for c in [*letters, 0]:
        if c or spaced[-1]:
            spaced.append(c)
    found = Counter()
    for i in range(len(spaced)):
        state = 0
        for n, code in enumerate(spaced[i : i + max(language_id.GRAMS)], 1):
            state = (state + code + n) * 0x9E3779B1 % 2**32
            state ^= state >> 15
            found[(state * 0x85EBCA6B % 2**32) >> (32 - language_id.BUCKET_BITS)] += 1
    return found if any(letters) else None


def test_language_equals_a_dictionary_of_counts(spark, rows):
    counted = {r.doc_id: grams(r.text) for r in rows}
    counts, docs = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and crc(r.doc_id) % 3 != 1 and counted[r.doc_id]:
            counts[r.lang] += counted[r.doc_id]
            docs[r.lang] += 1
    langs, size = sorted(counts), 1 << language_id.BUCKET_BITS
    below = {lang: sum(counts[lang].values()) + language_id.SMOOTHING * size for lang in langs}
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = counted[r.doc_id]
        logs = {
            lang: math.log(docs[lang] / sum(docs.values()))
            + sum(n * math.log((counts[lang][b] + language_id.SMOOTHING) / below[lang]) for b, n in own.items())
            for lang in langs
        }
        best = max(langs, key=lambda x: (logs[x], -langs.index(x)))
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)
        assert got[r.doc_id].held_out == (crc(r.doc_id) % 3 == 1)


# ---- quality -------------------------------------------------------------------------------------------------------------


def isotonic(y, weight):
    """The largest over starts of the smallest over ends of the mean in between."""
    sums, weights = np.r_[0, np.cumsum(y * weight)], np.r_[0, np.cumsum(weight)]
    n = len(y)
    means = [[(sums[k + 1] - sums[j]) / (weights[k + 1] - weights[j]) if k >= j else np.inf for k in range(n)] for j in range(n)]
    return np.array([max(min(means[j][i:]) for j in range(i + 1)) for i in range(n)])


def test_quality_equals_a_direct_fit(spark, rows, labels):
    known = defaultdict(list)
    for r in labels:
        if r.quality is not None:
            known[r.doc_id].append(float(r.quality))
    stats = {r.doc_id: np.array(quality.statistics(r.text)) for r in rows}
    train = [r.doc_id for r in rows if r.doc_id in known and crc(r.doc_id) % 4 != 2]
    x, y = np.array([stats[i] for i in train]), np.array([max(known[i]) for i in train])
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    rng = np.random.default_rng(quality.SEED)
    waves = rng.normal(size=(len(quality.STATISTICS), quality.FEATURES)) / np.sqrt(len(quality.STATISTICS))
    phases = rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(v):
        z = np.clip((v - mean) / deviation, -6, 6)
        return np.append([math.sqrt(2 / quality.FEATURES) * math.cos(z @ waves[:, j] + phases[j]) for j in range(quality.FEATURES)], 1.0)

    def ridge(z, target):
        penalty = np.append(np.full(quality.FEATURES, quality.RIDGE * len(z) / quality.FEATURES + 1e-6), 1e-6)
        # rows of the penalty under the data: an ordinary least squares problem
        return np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(penalty))]), np.append(target, np.zeros(len(penalty))), rcond=None)[0]

    z = np.array([features(v) for v in x])
    folds = np.array([(crc(i) >> 8) % quality.FOLDS for i in train])
    bins = defaultdict(list)
    low, high = quality.RAW_RANGE
    for fold in range(quality.FOLDS):
        weights = ridge(z[folds != fold], y[folds != fold])
        for own, target in zip(z[folds == fold] @ weights, y[folds == fold]):
            bins[min(max(int((own - low) / (high - low) * quality.BINS), 0), quality.BINS - 1)].append(target)
    places = sorted(bins)
    weight = np.array([len(bins[b]) for b in places], float)
    centres = low + (np.array(places) + 0.5) * (high - low) / quality.BINS
    fitted = isotonic(np.array([np.mean(bins[b]) for b in places]), weight)
    levels = np.unique(np.round(fitted, 12))
    groups = [np.isclose(fitted, v, atol=1e-11) for v in levels]
    at = [np.average(centres[g], weights=weight[g]) for g in groups]
    last = ridge(z, y)
    want = {i: float(np.clip(np.interp(features(v) @ last, at, levels), 0, 1)) for i, v in stats.items()}
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    assert set(got) == set(want)
    assert [got[i].score for i in want] == pytest.approx(list(want.values()), abs=1e-6)
    assert all(got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (crc(i) % 4 == 2) for i in want)


# ---- toxicity ------------------------------------------------------------------------------------------------------------


def one_window(words, model, inputs):
    """The logit of one window, word by word in both directions."""
    net, h = model["net"], toxicity.HIDDEN
    states = np.zeros((len(words), 2 * h))
    for at, side in enumerate("fb"):
        state = np.zeros(h)
        for t in range(len(words)) if side == "f" else reversed(range(len(words))):
            x = inputs[words[t]] @ net[f"W{side}"] + net[f"c{side}"]
            pushed = state @ net[f"U{side}"]
            update = 1 / (1 + np.exp(-(x[:h] + pushed[:h])))
            reset = 1 / (1 + np.exp(-(x[h : 2 * h] + pushed[h : 2 * h])))
            new = np.tanh(x[2 * h :] + reset * pushed[2 * h :])
            state = update * state + (1 - update) * new
            states[t, at * h : (at + 1) * h] = state
    attention = np.exp(states @ net["attend"] - (states @ net["attend"]).max())
    return (attention / attention.sum()) @ states @ net["out"] + net["bias"][0]


def test_toxicity_equals_one_window_at_a_time(spark, rows):
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(*toxicity.fitting_sample(docs, labelled, ~in_fold(F.col("doc_id"), 5, 0)))
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    inputs = {}
    for r in rows:
        words = toxicity.words_of(r.text)
        for w in words:
            if w not in inputs:
                inputs[w] = toxicity.inputs_of([w], model["tables"])[0]
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else []
        logits = [one_window(words[s : s + toxicity.WINDOW], model, inputs) for s in starts]
        want = 1 / (1 + math.exp(-(model["slope"] * max(logits) + model["shift"]))) if logits else 0.0
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-4), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (crc(r.doc_id) % 5 == 0)
