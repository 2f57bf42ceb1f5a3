"""Ordered scans and ranks without sorting: brute force over many partitions, hot groups and values, and the shape of plans."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmetrics import session
from plantmetrics.functions import ordered, selection
from plantmetrics.operators import learning, quality

SCHEMA = "g string, b int, i int, v double, x int"


@pytest.fixture(scope="module")
def parts(spark):
    """The number of range partitions, empty ones among them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(500):
        g = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, *[f"small{j}" for j in range(30)]])
        out.append((g, rng.randint(0, 9), i, rng.random() if rng.random() < 0.9 else None, rng.randint(-5, 50)))
    return out


def by_group(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_positions_and_sums(spark, rows, parts):
    frame = spark.createDataFrame(rows, SCHEMA)
    placed = {r.i: r.p for r in ordered.with_row_index(frame, ["g"], ["b", "i"], "p").collect()}
    whole = {r.i: r.s for r in ordered.with_running_sum(frame, ["g"], ["b", "i"], "x", "s").collect()}
    double = {r.i: r.s for r in ordered.with_running_sum(frame, ["g"], ["b", "i"], "v", "s").collect()}
    for own in by_group(rows).values():
        assert [placed[r[2]] for r in own] == list(range(len(own)))
        assert [whole[r[2]] for r in own] == np.cumsum([r[4] for r in own]).tolist()
        assert [double[r[2]] for r in own] == pytest.approx(np.cumsum([r[3] or 0 for r in own]))
    everyone = {r.i: r.p for r in ordered.with_row_index(frame, [], ["b", "i"], "p").collect()}
    assert [everyone[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(len(rows)))


@pytest.mark.parametrize("back", [1, 7, 60])
def test_trailing_means(spark, rows, parts, back):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.i: r.m for r in ordered.with_trailing(frame, ["g"], ["b", "i"], "v", back, "m").collect()}
    assert len(got) == len(rows)
    for own in by_group(rows).values():
        for n, row in enumerate(own):
            values = [r[3] for r in own[max(0, n - back + 1) : n + 1] if r[3] is not None]
            assert got[row[2]] == (pytest.approx(np.mean(values)) if values else None)


@pytest.mark.parametrize("keep, before", [(0.5, False), (0.99, True), (0.0, True)])
def test_decayed_means(spark, rows, parts, keep, before):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.i: r.m for r in ordered.with_decayed_mean(frame, ["g"], ["b", "i"], "v", keep, "m", before).collect()}
    assert len(got) == len(rows)
    for own in by_group(rows).values():
        n = d = 0.0
        for row in own:
            was = (n, d)
            n, d = n * keep + (row[3] or 0), d * keep + (row[3] is not None)
            a, b = was if before else (n, d)
            assert got[row[2]] == (pytest.approx(a / b, rel=1e-9) if b > 0 else None)


def test_empty_frames(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.with_row_index(none, ["g"], ["i"]).count() == 0
    assert ordered.with_running_sum(none, ["g"], ["i"], "x", "s").count() == 0
    assert ordered.with_trailing(none, ["g"], ["i"], "v", 3, "m").count() == 0
    assert ordered.with_decayed_mean(none, ["g"], ["i"], "v", 0.5, "m").count() == 0
    assert selection.exact_quantile(none, "v", 0.5, "q").first().q is None


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scan", ["index", "sum", "trailing", "decayed"])
def test_rows_are_exchanged_once(spark, rows, monkeypatch, scan):
    """Exchanges of whole rows, over all that is written and the frame itself: the one by range."""
    seen = []

    def watched(frame, name):
        seen.append((name, plan(frame)))
        return session.materialise(frame, name)

    monkeypatch.setattr(ordered, "materialise", watched)
    frame = spark.createDataFrame(rows, SCHEMA)
    call = {
        "index": lambda: ordered.with_row_index(frame, ["g"], ["b", "i"]),
        "sum": lambda: ordered.with_running_sum(frame, ["g"], ["b", "i"], "x", "s"),
        "trailing": lambda: ordered.with_trailing(frame, ["g"], ["b", "i"], "v", 7, "m"),
        "decayed": lambda: ordered.with_decayed_mean(frame, ["g"], ["b", "i"], "v", 0.5, "m"),
    }[scan]
    last = plan(call())
    whole = [p for name, p in seen if name == "ordered"]
    assert len(whole) == 1 and whole[0].count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in whole[0]
    assert "hashpartitioning" not in last and "Window" not in last


# ---- ranks ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["spread", "half equal", "all equal", "huge", "close"])
def test_values_at_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "FEW_VALUES", 10)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = np.random.default_rng(5)
    values = {
        "spread": rng.normal(0, 1, 2000),
        "half equal": np.r_[np.full(1500, 0.25), rng.random(1500)],
        "all equal": np.full(900, -3.5),
        "huge": np.r_[-1.7e308, 1.7e308, rng.normal(0, 1e-300, 700), rng.normal(0, 1e300, 700)],
        "close": 1.0 + np.arange(600) * 2.0**-52,
    }[kind]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1]
    assert selection.kth_values(frame, "v", ranks) == np.sort(values)[ranks].tolist()
    with pytest.raises(IndexError):
        selection.kth_values(frame, "v", [len(values)])


def test_no_value_is_moved(spark, monkeypatch):
    """A value in half of the rows meets no task: only counts per bin or value are exchanged."""
    frame = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.rand(1)).alias("v"))
    frame = session.materialise(frame, "values")
    assert selection.exact_quantile(frame, "v", 0.5, "q").first().q == pytest.approx(0.5)
    inside = frame.groupBy((F.col("v") * 8).cast("int")).agg(F.count(F.lit(1)))
    assert "partial_count" in plan(inside)


def by_hand(rows, seed, ratio):
    groups = {}
    for label, key in rows:
        groups.setdefault(label, []).append((hashlib.md5(f"{key}-{seed}".encode()).hexdigest(), key))
    return {k for own in groups.values() for _, k in sorted(own)[: int(len(own) * ratio)]}


@pytest.mark.parametrize("ratio", [0.0, 0.8])
def test_split_of_a_hot_class(spark, ratio):
    rows = [("hot" if i % 10 < 7 else f"c{i % 10}" if i % 10 < 9 else None, i) for i in range(3000)] + [("single", 9999)]
    frame = spark.createDataFrame(rows, "label string, key int").withColumn("text", F.lit("long"))
    got = learning.stratified_split(frame, "label", "key", ratio)
    assert got.columns == ["label", "key", "text", "is_train"]
    assert "Exchange hashpartitioning" not in plan(got) and "Sort" not in plan(got)
    taken = got.collect()
    assert len(taken) == len(rows)
    assert {r["key"] for r in taken if r["is_train"]} == by_hand(rows, learning.SEED, ratio)


def test_rows_with_one_key_stay_together(spark):
    frame = spark.createDataFrame([("a", i // 4) for i in range(400)], "label string, key int")
    sides = learning.stratified_split(frame, "label", "key", 0.5).groupBy("key").agg(F.count_distinct("is_train").alias("n"))
    assert sides.where("n > 1").count() == 0


def test_draws_with_replacement(spark):
    rows = [(i, f"r{i}") for i in range(700)]
    frame = spark.createDataFrame(rows, "k int, name string")
    got = quality.fixed_sample(frame, 300, ["k"], seed=42, replace=True).collect()
    order = [k for _, k in sorted((hashlib.md5(f"{k}-42".encode()).hexdigest(), k) for k, _ in rows)]
    want = {d: order[int(hashlib.md5(f"{d}-42".encode()).hexdigest()[:15], 16) % 700] for d in range(300)}
    assert {r["draw"]: r["k"] for r in got} == want and len(got) == 300


def test_parts_do_not_grow_with_the_table(spark, monkeypatch):
    """A table of more rows gets more range partitions, not larger ones."""
    monkeypatch.setattr(ordered, "PART_ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).alias("v"))
    placed = ordered.in_order(rows, ["g", "id"])
    sizes = [r["count"] for r in placed.groupBy(ordered.part_of(F.col("_at"))).count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 300
    summed = ordered.with_running_sum(rows, ["g"], ["id"], "v", "s")
    assert summed.where(F.col("s") != F.floor(F.col("id") / 2) + 1).count() == 0
