"""The building blocks for large groups against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmetrics.functions.relational import exact_quantile, in_ranges, with_row_index, with_running_sum, with_trailing
from plantmetrics.operators import planning, quality, retrieval


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice("ab")
        rows.append((key, rng.randint(0, 12), i, rng.randint(0, 99)))
    rows.append(("single", 5, 1000, 7))
    return rows


SCHEMA = "g string, b int, i int, v int"


def by_group(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_row_index(spark, skewed):
    frame = with_row_index(spark.createDataFrame(skewed, SCHEMA), ["g"], ["b", "i"])
    got = {(r.g, r.i): r.row_idx for r in frame.collect()}
    assert got == {(g, r[2]): n for g, rows in by_group(skewed).items() for n, r in enumerate(rows)}


def test_running_sum(spark, skewed):
    frame = with_running_sum(spark.createDataFrame(skewed, SCHEMA), ["g"], ["b", "i"], "v", "s")
    got = {(r.g, r.i): r.s for r in frame.collect()}
    want = {(g, r[2]): s for g, rows in by_group(skewed).items() for r, s in zip(rows, np.cumsum([x[3] for x in rows]))}
    assert got == want


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, skewed, share):
    frame = exact_quantile(spark.createDataFrame(skewed, SCHEMA), "v", share, "q")
    assert frame.first().q == pytest.approx(np.quantile([r[3] for r in skewed], share))


def test_one_hot_day_is_split(spark):
    """One line and day hold all rows; their order columns still spread them over the tasks."""
    rows = [("hot", 1, i, i % 7) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frame = in_ranges(spark.createDataFrame(rows, SCHEMA), ["g", "b", "i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in frame.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000 / 2


@pytest.mark.parametrize("rows_back", [2, 7, 40])
def test_trailing_mean_reaches_over_sparse_buckets(spark, skewed, rows_back):
    frame = with_trailing(spark.createDataFrame(skewed, SCHEMA), ["g"], ["b", "i"], "v", rows_back, "m")
    got = {(r.g, r.i): r.m for r in frame.collect()}
    for g, rows in by_group(skewed).items():
        values = [r[3] for r in rows]
        for n, row in enumerate(rows):
            assert got[(g, row[2])] == pytest.approx(np.mean(values[max(0, n - rows_back + 1) : n + 1]))


def test_samples_have_the_asked_size(spark, skewed):
    frame = spark.createDataFrame(skewed, SCHEMA)
    once = quality.fixed_sample(frame, 50, ["g", "i"])
    again = quality.fixed_sample(frame, 900, ["g", "i"], replace=True)
    assert once.count() == once.distinct().count() == 50
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, quality.fixed_sample(frame, 50, ["g", "i"]).collect()))
    assert again.count() == 900 and again.select("g", "i").distinct().count() < 601


def brute_search(chunks, questions, k, max_terms):
    """Scores straight from the definition."""
    import math
    import re
    from collections import Counter

    def grams(text):
        t = re.findall(r"\w{2,}", text.lower())
        return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])

    bags = {c: grams(text) for c, text in chunks}
    corpus = sum(bags.values(), Counter())
    vocab = [t for t, _ in sorted(corpus.items(), key=lambda x: (-x[1], x[0]))[:max_terms]]
    idf = {t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags.values()))) + 1 for t in vocab}

    def vector(bag):
        w = {t: (1 + math.log(bag[t])) * idf[t] for t in vocab if bag[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {c: vector(b) for c, b in bags.items()}
    out = {}
    for q, text in questions:
        qv = vector(grams(text))
        scored = [(round(sum(x * v.get(t, 0) for t, x in qv.items()), 6), c) for c, v in vectors.items()]
        best = sorted(((s, c) for s, c in scored if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        out[q] = [(c, s) for s, c in best]
    return out


@pytest.mark.parametrize("max_terms", [80, 20, 500])
def test_search_equals_brute_force(spark, monkeypatch, max_terms):
    """Many small tiles and blocks, a word in every chunk, equal chunks (ties) and an unknown question."""
    monkeypatch.setattr(retrieval, "TILE_CHUNKS", 7)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 3)
    monkeypatch.setattr(retrieval, "MERGE_PARTS", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = ["common " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) for _ in range(60)]
    texts += [texts[0]] * 6
    chunks = [(f"C{i:03d}", x) for i, x in enumerate(texts)]
    questions = [(f"Q{i}", " ".join(rng.choice(words) for _ in range(4))) for i in range(9)] + [("QC", "common"), ("QX", "zzz yyy")]
    c = spark.createDataFrame(chunks, "chunk_id string, text string")
    q = spark.createDataFrame(questions, "question_id string, question string")
    vectors, idf = retrieval.build_index(c, max_terms=max_terms)
    hits = retrieval.search(q, vectors, idf, k=5, max_terms=max_terms).collect()
    want = brute_search(chunks, questions, 5, max_terms)
    got = {}
    for r in sorted(hits, key=lambda r: (r.question_id, r["rank"])):
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    assert got.pop("QX") == [(None, 0.0)] and want.pop("QX") == []
    assert set(got) == set(want)
    for key in want:
        assert [x for x, _ in got[key]] == [x for x, _ in want[key]]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in want[key]], abs=2e-6)


@pytest.mark.parametrize("days", [1, 5])
def test_plan_conserves_quantity(spark, days):
    import datetime as dt

    rng = random.Random(11)
    log = [
        (dt.date(2025, 1, 1 + i % 20), 1 + i % 3, f"L{i % 4}", f"B{i % 2}", 100, 80 + i % 20, i % 5, i % 60, i % 20, 0.8)
        for i in range(240)
    ]
    log = spark.createDataFrame(
        log,
        "date date, shift int, line_id string, brand string, planned_qty int, actual_qty int, defect_qty int,"
        " downtime_minutes int, changeover_minutes int, oee_score double",
    )
    orders = [
        (i, f"B{0 if rng.random() < 0.8 else 1}", "M", rng.choice([40, 200, 900]), None if i % 3 == 0 else dt.date(2025, 2, 1 + i % 5))
        for i in range(60)
    ]
    orders = spark.createDataFrame(orders, "order_id bigint, brand string, model string, qty int, deadline date")
    slots = planning.slot_grid(log, days)
    plan = planning.capacity_fill(orders, slots, log).cache()
    rest = planning.unplaced(orders, plan)
    assert rest.where((F.col("remaining") < 0) | (F.col("placed") + F.col("remaining") != F.col("qty"))).count() == 0
    used = plan.groupBy("day", "line_id", "shift").agg(F.sum("qty").alias("used"))
    assert used.join(slots, ["day", "line_id", "shift"]).where("used > capacity").count() == 0
    lanes = planning.lanes(slots, orders.select("brand").distinct(), log).groupBy("brand").agg(F.sum("capacity").alias("room"))
    asked = orders.groupBy("brand").agg(F.sum("qty").alias("asked"))
    made = plan.groupBy("brand").agg(F.sum("qty").alias("made"))
    full = asked.join(lanes, "brand", "left").join(made, "brand", "left").na.fill(0)
    assert full.where(F.col("made") != F.least("asked", "room")).count() == 0
