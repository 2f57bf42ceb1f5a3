"""The kernel machine against the exact kernel, joint smoothing against the search it replaces, exclusive slots against a greedy run."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantmetrics.operators import binned_forest, forecasting, kernel_svm, learning, planning


def rings(n=200, seed=1):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    radius = np.where(label == 1, 1.0, 2.4) + rng.normal(0, 0.35, n)
    angle = rng.uniform(0, 2 * np.pi, n)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), label


def exact_machine(x, y, gamma, penalty, rounds=20_000):
    """The dual of the machine with the full kernel, by pairs of multipliers; returns its margins."""
    kernel = kernel_svm.gaussian(x, x, gamma)
    sign = np.where(y == 1, 1.0, -1.0)
    a, gradient = np.zeros(len(x)), -np.ones(len(x))
    for _ in range(rounds):
        up = ((sign > 0) & (a < penalty)) | ((sign < 0) & (a > 0))
        down = ((sign < 0) & (a < penalty)) | ((sign > 0) & (a > 0))
        slope = -sign * gradient
        i, j = np.where(up, slope, -np.inf).argmax(), np.where(down, slope, np.inf).argmin()
        if slope[i] - slope[j] < 1e-6:
            break
        move = (slope[i] - slope[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        move = min(move, penalty - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else penalty - a[j])
        a[i] += sign[i] * move
        a[j] -= sign[j] * move
        gradient += sign * move * (kernel[:, i] - kernel[:, j])
    return kernel @ (a * sign) + (slope[i] + slope[j]) / 2


def labelled(spark, x, y):
    frame = spark.createDataFrame([(int(i), [float(v) for v in row], float(c)) for i, (row, c) in enumerate(zip(x, y))], "id int, a array<double>, label double")
    return frame.withColumn("features", array_to_vector("a"))


@pytest.fixture(scope="module")
def machine(spark):
    x, y = rings()
    return x, y, kernel_svm.KernelSVM(landmarks=200).fit(labelled(spark, x, y))


def test_all_landmarks_give_the_exact_kernel(spark, machine):
    x, y, model = machine
    frame = labelled(spark, x, y)
    gamma = kernel_svm.scale_gamma(frame, "features")
    assert gamma == pytest.approx(1 / (2 * x.var()))
    margins = np.array([r["m"] for r in model.transform(frame).sort("id").select(learning.vector_to_array("margin")[1].alias("m")).collect()])
    exact = exact_machine(x, y, gamma, kernel_svm.PENALTY)
    assert np.mean((margins > 0) == (exact > 0)) >= 0.99
    assert np.corrcoef(margins, exact)[0, 1] > 0.99


def test_few_landmarks_come_near(spark):
    x, y = rings()
    model = kernel_svm.KernelSVM(landmarks=40).fit(labelled(spark, x, y))
    other, truth = rings(200, seed=9)
    scored = model.transform(labelled(spark, other, truth)).sort("id").collect()
    exact = exact_machine(x, y, 1 / (2 * x.var()), kernel_svm.PENALTY)
    assert np.mean((exact > 0) == (y == 1)) > 0.9
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.9
    assert all(0.0 <= p <= 1.0 for r in scored for p in r["probability"])


def test_the_machine_is_saved_and_loaded(spark, machine, tmp_path):
    x, y, model = machine
    frame = labelled(spark, x, y)
    third, _ = learning.fit_packed(frame, ["a", "b", "c"], "y", forest.setFeatureSubsetStrategy("auto"))
    assert {t._call_java("rootNode").split().featureIndex() for t in third.stages[-1].trees} == {0, 1, 2}
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    before, after = (sorted((r["id"], r["prediction"]) for r in m.transform(frame).collect()) for m in (model, again))
    assert before == after


def test_repeated_vectors_are_one_landmark(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 1.0], [3.0, 0.0]], 50, axis=0)
    frame = labelled(spark, x, (x[:, 0] > 0.5).astype(int))
    assert len(kernel_svm.choose_landmarks(frame, "features", 10)) == 3
    predicted = kernel_svm.KernelSVM().fit(frame).transform(frame)
    assert predicted.where("prediction <> label").count() == 0


def test_three_classifiers_and_scoring_in_one_session(spark, monkeypatch):
    """Scoring works after other models were fitted in the session."""
    real = learning.defect_classifiers
    monkeypatch.setattr(learning, "defect_classifiers", lambda *_: real(5, 5))
    queries = entry.queries()
    metrics = queries["defect_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert {r["model"] for r in metrics} == {"random_forest", "gradient_boosting", "kernel_svm"}
    scored = queries["defect_scoring"](spark, "/root/testdata/sf0.01").collect()
    assert len(scored) == 500
    assert {r["label"] for r in scored} <= {"ok", "defect"} and all(0.5 <= r["confidence"] <= 1.0 for r in scored)


# ---- smoothing -----------------------------------------------------------------------------------------------------------


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    season = np.array([12.0, -7.0, 3.0, -8.0])[t % 4]
    return {
        "walk": 100 + rng.normal(0, 4, n).cumsum() + season + rng.normal(0, 3, n),
        "flat": np.full(n, 7.0),
        "jump": np.where(t < n // 2, 50.0, 90.0) + season,
        "first": np.r_[900.0, 40 + season[1:] + rng.normal(0, 1, n - 1)],
    }[kind]


@pytest.mark.parametrize("n", [9, 30, 120])
def test_joint_fit_is_never_worse(n):
    values = np.stack([series(k, n, i) for i, k in enumerate(["walk", "walk", "flat", "jump", "first"])])
    period = forecasting.season_length(n)
    weights, states, error = forecasting.fit_many(values, period)
    given = forecasting.usual_states(values, period)[:, None, :, None]

    def usual(w):
        return forecasting.follow(values, period, w, given)[0][..., 0, 0]

    grid = np.broadcast_to(np.array([(a, b, c) for a in forecasting.GRID for b in forecasting.GRID for c in forecasting.GRID]), (5, 343, 3))
    _, before = forecasting.refine(values, grid[np.arange(5), usual(grid).argmin(axis=1)], usual)
    assert (error <= before + 1e-9).all() and error[4] < before[4]
    again = forecasting.follow(values, period, weights[:, None], states[:, None, :, None])[0][:, 0, 0, 0]
    assert again == pytest.approx(error)
    alone = [forecasting.fit_many(v[None], period)[2][0] for v in values]
    assert alone == pytest.approx(error)


def test_series_of_a_task_are_fitted_together(spark, monkeypatch):
    monkeypatch.setattr(forecasting, "BATCH_SERIES", 2)
    rows, want = [], {}
    for i in range(7):
        values = series("walk", 20 + i % 2, i)
        want[f"s{i}"] = forecasting.smooth(values, 4, 3)
        rows += [(f"s{i}", dt.date(2025, 1, 1) + dt.timedelta(weeks=w), float(v)) for w, v in enumerate(values)]
    random.Random(0).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    got = forecasting.holt_winters(spark.createDataFrame(rows, "series string, date date, demand double"), 3).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.series, r.step): r.forecast for r in got} == {
        (name, step): pytest.approx(v[step - 1]) for name, v in want.items() for step in (1, 2, 3)
    }


# ---- planning ------------------------------------------------------------------------------------------------------------


def greedy(orders, slots, affinity, brands):
    """One order after the other takes whole slots of its brand's lines."""
    best = {}
    for line in {s[1] for s in slots}:
        best[line] = min((-affinity.get((line, b), 0.5), b) for b in brands)
    free = {b: sorted((best[line][0], day, shift, line, cap) for day, line, shift, cap in slots if best[line][1] == b and cap > 0) for b in brands}
    plan = []
    for due, neg, order_id, brand in sorted((d or dt.date(9999, 12, 31), -q, i, b) for i, b, q, d in orders):
        rest = -neg
        while rest > 0 and free[brand]:
            _, day, shift, line, cap = free[brand].pop(0)
            plan.append((day, line, shift, brand, order_id, min(cap, rest)))
            rest -= cap
    return sorted(plan)


@pytest.mark.parametrize("days", [2, 40])
def test_a_slot_serves_one_order(spark, days):
    rng = random.Random(days)
    log = [
        (dt.date(2025, 1, 1 + i % 20), 1 + i % 3, f"L{i % 9}", f"B{(i * i) % 4}", 100, 60 + (i * 7) % 40, i % 5, i % 60, i % 20, 0.8)
        for i in range(700)
    ]
    schema = (
        "date date, shift int, line_id string, brand string, planned_qty int, actual_qty int, defect_qty int,"
        " downtime_minutes int, changeover_minutes int, oee_score double"
    )
    log = spark.createDataFrame(log, schema)
    rows = [
        (i, "B0" if rng.random() < 0.6 else rng.choice(["B1", "B2", "B9"]), rng.choice([0, 40, 200, 900]), None if i % 3 == 0 else dt.date(2025, 2, 1 + i % 20))
        for i in range(1000)
    ]
    orders = spark.createDataFrame([(i, b, "M", q, d) for i, b, q, d in rows], "order_id bigint, brand string, model string, qty int, deadline date")
    slots = planning.slot_grid(log, days)
    plan = planning.exclusive_fill(orders, slots, log).collect()
    affinity = {(r.line_id, r.brand): round(r.affinity, 9) for r in planning.affinity(log).collect()}
    want = greedy(rows, [tuple(s) for s in slots.select("day", "line_id", "shift", "capacity").collect()], affinity, {b for _, b, _, _ in rows})
    assert sorted((r.day, r.line_id, r.shift, r.brand, r.order_id, r.qty) for r in plan) == want
    used = [(r.day, r.line_id, r.shift) for r in plan]
    assert len(used) == len(set(used)) > 0
    assert all((r.start_hour, r.end_hour) == (8 * r.shift - 8, 8 * r.shift) for r in plan)


def test_lines_go_to_the_brand_of_the_full_grid(spark):
    """Without a row for every slot and brand, the choice is that of the grid."""
    log = entry.queries()["scan_production"](spark, "/root/testdata/sf0.001")
    orders = spark.createDataFrame([(i, f"Brand{i}") for i in range(6)], "order_id int, brand string")
    slots = planning.slot_grid(log, 1)
    lanes = planning.lanes(slots, orders.select("brand"), log).select("line_id", "brand").distinct()
    assert sorted(map(tuple, planning.line_brands(slots, orders, log).select("line_id", "brand").collect())) == sorted(map(tuple, lanes.collect()))


# ---- boosted trees on binned rows ----------------------------------------------------------------------------------------


def test_rows_with_equal_bins_are_fitted_as_one(spark, monkeypatch):
    """The same predictions as from all rows with their bins, from as many rows as there are different bins."""
    rng = np.random.default_rng(4)
    n = 3000
    x = np.column_stack([rng.integers(0, 4, n), rng.integers(0, 200, n), rng.integers(0, 3, n)]).astype(float)
    y = x[:, 0] * 2 + np.sin(x[:, 1] / 20) + rng.normal(0, 0.3, n)
    rows = [(i, *map(float, r), float(v), i % 5 > 0) for i, (r, v) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, is_train boolean").cache()
    edges = learning.bin_edges(frame.where("is_train"), "abc")
    assert [len(e) - 1 for e in edges] == [4, 32, 3] and edges[0][1:-1] == [0.5, 1.5, 2.5]
    fitted = []
    real = learning.materialise
    monkeypatch.setattr(learning, "materialise", lambda f, name: fitted.append(real(f, name)) or fitted[-1])
    model, predicted = learning.fit_binned(frame, "abc", "y", learning.boosted_regressor("abc", "y", 5).getStages()[-1])
    assert fitted[0].count() <= 4 * 32 * 3 and fitted[0].agg(F.sum("_rows")).first()[0] == frame.where("is_train").count()
    binned = PipelineModel(stages=model.stages[:2]).transform(frame)
    plain = learning.boosted_regressor("abc", "y", 5).getStages()[-1].setFeaturesCol("features").fit(binned.where("is_train"))
    want = {r.id: r.prediction for r in plain.transform(binned.where("not is_train")).collect()}
    got = {r.id: r.prediction for r in predicted.collect()}
    assert got == {i: pytest.approx(v) for i, v in want.items()}
    assert np.mean([(got[i] - y[i]) ** 2 for i in got]) < 0.5 * y.var()


def test_the_machine_learns_from_a_plain_table(spark, monkeypatch):
    """What is handed to the learners is a scan, without task functions or cached relations of the session."""
    plans = []
    real = kernel_svm.Pipeline.fit
    monkeypatch.setattr(kernel_svm.Pipeline, "fit", lambda self, frame: plans.append(frame._jdf.queryExecution().toString()) or real(self, frame))
    x, y = rings(60)
    kernel_svm.KernelSVM(landmarks=20).fit(labelled(spark, x, y))
    assert len(plans) == 1 and "parquet" in plans[0] and not any(n in plans[0] for n in ("InMemoryRelation", "InMemoryTableScan", "ArrowEvalPython", "UDF("))


def packed_rows(spark, n=4000, seed=4):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, n), rng.integers(0, 30, n) / 4, rng.integers(0, 3, n)
    y = 5.0 * (a > 4) + b * (c == 1) + a * b / 9 + rng.integers(0, 3, n)
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "i int, a double, b double, c double, y double")


def test_a_packed_tree_is_sparks_tree(spark, monkeypatch):
    """With all rows and features the same splits and predictions, though rows lie in several blocks, files and tasks."""
    for name, value in (("BLOCK_ROWS", 300), ("PACK_ROWS", 1500), ("PASS_ROWS", 2000), ("FILE_BYTES", 4096)):
        monkeypatch.setattr(binned_forest, name, value)
    frame = packed_rows(spark).withColumn("is_train", F.col("i") % 5 != 0).cache()
    own = RandomForestRegressor(labelCol="y", numTrees=1, maxDepth=6, bootstrap=False, featureSubsetStrategy="all", seed=3)
    model, predicted = learning.fit_packed(frame, ["a", "b", "c"], "y", own)
    theirs, wanted = learning.fit_and_predict(frame, learning._regression(["a", "b", "c"], own.copy()))
    got = {r.i: r.prediction for r in predicted.collect()}
    assert got == pytest.approx({r.i: r.prediction for r in wanted.collect()}) and len(got) == 800
    assert model.stages[-1].toDebugString.splitlines()[2:5] == theirs.stages[-1].toDebugString.splitlines()[2:5]
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(theirs.stages[-1].featureImportances.toArray())


def test_a_packed_forest_draws_rows_and_features(spark, tmp_path):
    """Every row is drawn by itself, as often as a Poisson number; the forest is as good as Spark's, and is saved and loaded."""
    drawn = binned_forest.draw(np.random.default_rng(1), 2_000_000, binned_forest.chances(1.0))
    counts = np.bincount(drawn.astype(int), minlength=9)[:9] / len(drawn)
    assert counts == pytest.approx([math.exp(-1) / math.factorial(i) for i in range(9)], abs=1e-3) and counts[7] > 0
    frame = packed_rows(spark).withColumn("is_train", F.col("i") % 5 != 0).cache()
    forest = RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=6, featureSubsetStrategy="all", seed=3)
    model, predicted = learning.fit_packed(frame, ["a", "b", "c"], "y", forest)
    _, wanted = learning.fit_and_predict(frame, learning._regression(["a", "b", "c"], forest.copy()))
    errors = [learning.regression_metrics(x, "y", "prediction").first() for x in (predicted, wanted)]
    assert errors[0].rmse == pytest.approx(errors[1].rmse, rel=0.03)
    trees = model.stages[-1].trees
    rows = [t._call_java("rootNode").impurityStats().stats() for t in trees]
    assert len(trees) == 20 and len({tuple(r) for r in rows}) == 20
    assert np.mean([r[0] for r in rows]) == pytest.approx(3200, rel=0.02)
    third, _ = learning.fit_packed(frame, ["a", "b", "c"], "y", forest.setFeatureSubsetStrategy("auto"))
    assert {t._call_java("rootNode").split().featureIndex() for t in third.stages[-1].trees} == {0, 1, 2}
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(frame.where("not is_train"))
    assert sorted(map(tuple, again.select("i", "prediction").collect())) == sorted(map(tuple, predicted.select("i", "prediction").collect()))


def test_trees_of_few_rows_grow_in_several_tasks(spark):
    """One file with a single block would be one task; each tree's sums come from one of them."""
    binned = spark.createDataFrame([(i % 7, float(i % 5)) for i in range(3000)], "w0 long, target double").coalesce(1)
    blocks = binned_forest.materialise(binned_forest.pack_rows(binned, 1, 3000), "packed")
    trees = {i: binned_forest.Tree().plain(np.array([[0]])) for i in range(20)}
    passed = binned_forest.pass_level(blocks, trees, 1, 0, None, 1, 4, 1)
    assert blocks.count() == 1 and passed.rdd.getNumPartitions() >= 4
    rows = passed.collect()
    sums = [np.frombuffer(r.sums).reshape(3, 32) for r in rows]
    assert len(rows) == 20 and all(x[0, :7].tolist() == [429, 429, 429, 429, 428, 428, 428] and x[1].sum() == 6000 for x in sums)
