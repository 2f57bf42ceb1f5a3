"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

A word's inputs are read from its characters (hashed 3- to 5-grams of its bytes) and from the word itself (its hash). Both
have, per bucket, the log-odds of toxic against other documents in the fitting sample, and a few random numbers by which words
differ; the network's weights are trained by back-propagation, all in numpy. A document's score is that of its most toxic
window; windows of ``WINDOW`` words start every ``STRIDE`` words, so each word is seen with context on both sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmetrics.llm.common import WORD_BYTES, mix

WINDOW, STRIDE = 32, 16
HIDDEN = 12
CHAR_BITS, WORD_BITS = 18, 17
CHAR_RANDOM, WORD_RANDOM = 4, 4
INPUTS = 2 + CHAR_RANDOM + 1 + WORD_RANDOM
GRAMS = (3, 4, 5)
SHRINK = 4.0

# Bounds of the fitting sample, and of the training.
FIT_TOXIC, FIT_CLEAN = 1200, 1800  # documents
FIT_BYTES = 200_000  # longer documents are scored, but not learned from
ROUNDS, STEPS, BATCH = 3, 110, 128
RATE = 0.02
SEED = 7

BLOCK_WORDS = 120_000
CACHE_WORDS = 200_000
PAD_GATE = 30.0  # the update gate of padding: the state stays
THRESHOLD = 0.5


# ---- words and their inputs --------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words, in word order, and where each word's begin.

    Words stand between < and >; every word has one 3-gram at least.
    """
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(data))  # bytes to the word's end
    found, place = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = value << np.uint64(8) | data[at + i]
        found.append((mix(value) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        place.append(at)
    order = np.argsort(np.concatenate(place), kind="stable")
    places = np.concatenate(place)[order]
    return np.concatenate(found)[order], np.searchsorted(places, start)


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Polynomial hashes of the words' bytes."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    inside = np.arange(len(data)) - np.repeat(start, length)
    value = mix(data + (inside.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return (mix(np.add.reduceat(value, start)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def inputs_of(words: list[bytes], tables: dict) -> np.ndarray:
    """The input vectors of distinct words."""
    if not words:
        return np.zeros((0, INPUTS), np.float32)
    grams, first = gram_buckets(words)
    counts = np.diff(np.append(first, len(grams)))[:, None]
    chars, own = tables["chars"][grams], tables["words"][word_buckets(words)]
    sums = np.add.reduceat(chars, first, axis=0)
    highest = np.maximum.reduceat(chars[:, 0], first)[:, None]
    return np.hstack([highest, sums[:, :1] / counts, sums[:, 1:] / np.sqrt(counts), own]).astype(np.float32)


# ---- the network -------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    net = {}
    for side in ("f", "b"):
        net[f"W{side}"] = rng.normal(size=(INPUTS, 3 * h)) / np.sqrt(INPUTS)
        net[f"U{side}"] = rng.normal(size=(h, 3 * h)) / np.sqrt(h)
        net[f"c{side}"] = np.zeros(3 * h)
    net["attend"] = rng.normal(size=2 * h) * 0.1
    net["out"] = rng.normal(size=2 * h) * 0.1
    net["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def step(x: np.ndarray, state: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a gated recurrent unit from the projected input x (update, reset, new)."""
    h = HIDDEN
    pushed = state @ inner
    gates = 1.0 / (1.0 + np.exp(-(x[:, : 2 * h] + pushed[:, : 2 * h])))
    update, reset = gates[:, :h], gates[:, h:]
    new = np.tanh(x[:, 2 * h :] + reset * pushed[:, 2 * h :])
    return new + update * (state - new), update, reset, new, pushed[:, 2 * h :]


def pooled_logits(states: np.ndarray, padded: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention and pooled states from states (time, row, 2 * HIDDEN)."""
    weight = np.where(padded, -1e9, states @ net["attend"])
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tr,trh->rh", weight, states)
    return pooled @ net["out"] + net["bias"][0], weight, pooled


def logits_of(projected: np.ndarray, windows: np.ndarray, net: dict) -> np.ndarray:
    """Logits of windows given as rows (time, row) of projected inputs; row 0 is padding."""
    time, rows = windows.shape
    states = np.empty((time, rows, 2 * HIDDEN), np.float32)
    for side, order, at in (("f", range(time), 0), ("b", range(time - 1, -1, -1), 1)):
        state = np.zeros((rows, HIDDEN), np.float32)
        inner, own = net[f"U{side}"], projected[at]
        for t in order:
            state = step(own[windows[t]], state, inner)[0]
            states[t, :, at * HIDDEN : (at + 1) * HIDDEN] = state
    return pooled_logits(states, windows == 0, net)[0]


def project(inputs: np.ndarray, net: dict) -> list[np.ndarray]:
    """Projected inputs of both directions."""
    return [inputs @ net[f"W{side}"] + net[f"c{side}"] for side in ("f", "b")]


def padding() -> np.ndarray:
    row = np.zeros((1, 3 * HIDDEN), np.float32)
    row[0, :HIDDEN] = PAD_GATE
    return row


def gradients(x: np.ndarray, padded: np.ndarray, y: np.ndarray, weight: np.ndarray, net: dict) -> tuple[float, dict]:
    """Loss and gradients for inputs x (time, row, INPUTS), by back-propagation through time."""
    time, rows, _ = x.shape
    h = HIDDEN
    states = np.zeros((time, rows, 2 * h), np.float32)
    tape: dict[str, list] = {"f": [], "b": []}
    orders = {"f": list(range(time)), "b": list(range(time - 1, -1, -1))}
    for at, side in enumerate(("f", "b")):
        state = np.zeros((rows, h), np.float32)
        for t in orders[side]:
            p = np.where(padded[t][:, None], padding(), x[t] @ net[f"W{side}"] + net[f"c{side}"])
            after, *parts = step(p, state, net[f"U{side}"])
            tape[side].append((t, state, *parts))
            state = after
            states[t, :, at * h : (at + 1) * h] = state
    logits, attention, pooled = pooled_logits(states, padded, net)
    p = sigmoid(logits)
    loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weight.sum())
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    d_logit = weight * (p - y) / weight.sum()
    grad["out"] = pooled.T @ d_logit
    grad["bias"] = np.array([d_logit.sum()])
    d_pooled = d_logit[:, None] * net["out"]
    d_weight = np.einsum("rh,trh->tr", d_pooled, states)
    d_score = attention * (d_weight - (attention * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tr,trh->h", d_score, states)
    d_states = attention[:, :, None] * d_pooled + d_score[:, :, None] * net["attend"]
    for at, side in enumerate(("f", "b")):
        carry = np.zeros((rows, h), np.float32)
        inner = net[f"U{side}"]
        for t, before, update, reset, new, pushed in reversed(tape[side]):
            d = d_states[t, :, at * h : (at + 1) * h] + carry
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * pushed * reset * (1 - reset)
            d_pushed = np.hstack([d_update, d_reset, d_new * reset])
            d_x = np.hstack([d_update, d_reset, d_new]) * ~padded[t][:, None]
            grad[f"U{side}"] += before.T @ d_pushed
            grad[f"W{side}"] += x[t].T @ d_x
            grad[f"c{side}"] += d_x.sum(axis=0)
            carry = d * update + d_pushed @ inner.T
    return loss, grad


def train(x: np.ndarray, padded: np.ndarray, y: np.ndarray, net: dict, moments: dict, rng: np.random.Generator) -> float:
    """``STEPS`` steps of Adam over random batches; half of each batch is toxic. Returns the last loss."""
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    loss = 0.0
    for _ in range(STEPS if len(toxic) and len(clean) else 0):
        chosen = np.concatenate([rng.choice(toxic, BATCH // 2), rng.choice(clean, BATCH // 2)])
        loss, grad = gradients(x[:, chosen], padded[:, chosen], y[chosen], np.ones(len(chosen), np.float32), net)
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        moments["n"] = moments.get("n", 0) + 1
        n = moments["n"]
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m, v = moments.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            moments[k] = (m, v)
            change = RATE * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
            net[k] = (net[k] - change).astype(np.float32)
    return loss


# ---- fitting -----------------------------------------------------------------------------------------------------------


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(1 + max(0, -(-(n - WINDOW) // STRIDE))) * STRIDE if n else np.zeros(0, np.int64)


def windows_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows (time, row) of documents given as arrays of row numbers, padded with 0, and each window's document."""
    starts = [window_starts(len(r)) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
    flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)]).astype(np.int64)
    base = np.cumsum([0, *[len(r) for r in rows]])
    at = np.concatenate([np.zeros(0, np.int64), *starts])
    place = base[owner] + at
    time = np.arange(WINDOW)[:, None]
    inside = time + at < (base[owner + 1] - base[owner])
    return np.where(inside, flat[np.where(inside, place + time, 0)], 0), owner


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds from document counts, drawn to zero where a bucket is rare."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds * (toxic + clean) / (toxic + clean + SHRINK)


def fit(sample: pd.DataFrame, toxic_share: float) -> dict:
    """Train on the sample (text, y). Windows of toxic documents are not labelled, so in each round the highest window of a
    toxic document counts as toxic, and the highest ones of the others, with some random ones, as clean. At last the highest
    logits of the sample's documents are turned into probabilities by a logistic fit at the labels' own share of toxic ones."""
    rng = np.random.default_rng(SEED)
    split = [words_of(t) for t in sample["text"]]
    y = sample["y"].to_numpy(float)
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    vocabulary = list(known)
    rows = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]
    tables = {
        "chars": np.zeros((1 << CHAR_BITS, 1 + CHAR_RANDOM), np.float32),
        "words": np.zeros((1 << WORD_BITS, 1 + WORD_RANDOM), np.float32),
    }
    model = {"tables": tables, "net": new_network(rng), "slope": 0.0, "shift": -30.0}
    if not vocabulary or len(set(y)) < 2:
        return model
    grams, first = gram_buckets(vocabulary)
    ends, buckets = np.append(first[1:], len(grams)), word_buckets(vocabulary)
    counts = {k: np.zeros((2, 1 << bits)) for k, bits in (("chars", CHAR_BITS), ("words", WORD_BITS))}
    for own, label in zip(rows, y, strict=True):
        distinct = np.unique(own)
        counts["words"][int(label), np.unique(buckets[distinct])] += 1
        spans = [grams[first[w] : ends[w]] for w in distinct]
        if spans:
            counts["chars"][int(label), np.unique(np.concatenate(spans))] += 1
    for k, random in (("chars", CHAR_RANDOM), ("words", WORD_RANDOM)):
        tables[k][:, 0] = log_odds(counts[k][1], counts[k][0], int((y == 1).sum()), int((y == 0).sum()))
        tables[k][:, 1:] = rng.normal(size=(len(tables[k]), random)) * 0.1
    inputs = np.vstack([np.zeros((1, INPUTS), np.float32), inputs_of(vocabulary, tables)])
    windows, owner = windows_of([r + 1 for r in rows])
    value = inputs[:, 0][windows].max(axis=0)  # at first the highest log-odds of a window chooses
    net, moments = model["net"], {}
    for _ in range(ROUNDS):
        order = np.lexsort((-value, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = y[owner[order]] == 1
        chosen = order[(toxic & (rank == 0)) | (~toxic & (rank < 2))]
        clean = np.flatnonzero(y[owner] == 0)
        chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), 2 * len(chosen)), replace=False)])
        own = windows[:, chosen]
        train(inputs[own], own == 0, y[owner[chosen]], net, moments, rng)
        projected = [np.vstack([padding(), p[1:]]) for p in project(inputs, net)]
        value = np.concatenate(
            [logits_of(projected, windows[:, a : a + 8192], net) for a in range(0, windows.shape[1], 8192)]
        )
    highest = np.full(len(y), -30.0)
    np.maximum.at(highest, owner, value)
    weight = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum())) * len(y)
    model["slope"], model["shift"] = logistic(highest, y, weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a small penalty on the slope."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * x + shift)
        g = np.array([(weight * (p - y) * x).sum() + 0.5 * (slope - 1), (weight * (p - y)).sum()])
        w = weight * p * (1 - p)
        matrix = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        change = np.clip(np.linalg.solve(matrix, g), -1, 1)
        slope, shift = slope - change[0], shift - change[1]
    return max(float(slope), 0.05), float(shift)


# ---- scoring -----------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores texts; keeps the projected inputs of words met before, up to ``CACHE_WORDS``."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.projected = [padding().repeat(1 << 14, axis=0) for _ in range(2)]

    def learn(self, words: list[bytes]) -> None:
        fresh = list(set(words).difference(self.known))
        size = len(self.known) + 1
        while size + len(fresh) > len(self.projected[0]):
            self.projected = [np.vstack([p, np.empty_like(p)]) for p in self.projected]
        for i, word in enumerate(fresh):
            self.known[word] = size + i
        for own, new in zip(self.projected, project(inputs_of(fresh, self.model["tables"]), self.model["net"]), strict=True):
            own[size : size + len(fresh)] = new

    def highest(self, split: list[list[bytes]]) -> np.ndarray:
        """The highest logit of every document's windows."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        self.learn([w for words in split for w in words])
        rows = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in split]
        windows, owner = windows_of(rows)
        found = np.full(len(split), -np.inf)
        if windows.shape[1]:
            np.maximum.at(found, owner, logits_of(self.projected, windows, self.model["net"]))
        return found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, in blocks of about ``BLOCK_WORDS`` words; longer texts are cut into overlapping pieces."""
        found = np.full(len(texts), -np.inf)
        block: list[list[bytes]] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, max(1, len(words) - WINDOW + STRIDE), BLOCK_WORDS):
                piece = words[start : start + BLOCK_WORDS + WINDOW - STRIDE]
                if not piece:
                    continue
                block.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= BLOCK_WORDS:
                    np.maximum.at(found, owners, self.highest(block))
                    block, owners, size = [], [], 0
        if block:
            np.maximum.at(found, owners, self.highest(block))
        known = np.isfinite(found)
        return np.where(known, sigmoid(self.model["slope"] * np.where(known, found, 0.0) + self.model["shift"]), 0.0)


def fitting_sample(docs: DataFrame, labels: DataFrame, train_fold: Column) -> tuple[pd.DataFrame, float]:
    """Texts and labels of at most ``FIT_TOXIC`` and ``FIT_CLEAN`` documents, chosen by a hash of the id, and the labels'
    share of toxic documents. The ids are chosen first, so only the sample's texts are moved."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(train_fold)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("y"))
    )
    counts = {row["y"]: row["count"] for row in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    place = F.xxhash64(F.lit(SEED), "doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(place, "doc_id").limit(n) for y, n in ((1.0, FIT_TOXIC), (0.0, FIT_CLEAN))]
    chosen = parts[0].unionByName(parts[1])  # at most FIT_TOXIC + FIT_CLEAN ids: the bound of the broadcast
    rows = (
        docs.filter(F.octet_length("text") <= FIT_BYTES)
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(place, "doc_id", F.xxhash64("text"))
        .limit(FIT_TOXIC + FIT_CLEAN)
    )
    return rows.select("text", "y").toPandas(), counts.get(1.0, 0) / max(1, total)


def score_documents(docs: DataFrame, labels: DataFrame, train_fold: Column) -> DataFrame:
    """The documents with score and predicted, in place; labels are learned where ``train_fold`` (on doc_id) holds.

    The network is trained on a bounded sample on the driver and broadcast; every window of every text is scored, without a
    shuffle. Null and empty texts, and texts without a word, have score 0. Without labels of both kinds every score is about
    0. Rows that repeat are scored each; an id with several labels counts with the largest; labels without an id or a value
    are not used. Columns of the documents called score or predicted are replaced.
    """
    model = fit(*fitting_sample(docs, labels, train_fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def run(batches):
        kept = shared.value
        scorer = kept.get("scorer")
        if scorer is None:
            scorer = kept["scorer"] = Scorer(kept)
        for batch in batches:
            score = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    return docs.select(*names).mapInArrow(run, schema)
