"""Edge rows: single periods, zero denominators, ties, missing sides, odd counts, empty periods."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantmetrics.operators import inventory as inv
from plantmetrics.operators import kpi, learning, oee, planning, quality, reports, retrieval

LOG = (
    "date date, shift int, line_id string, brand string, model_name string, planned_qty int, actual_qty int,"
    " defect_qty int, downtime_minutes int, changeover_minutes int, operator_count int, machine_id string,"
    " oee_score double, k1 bigint, k2 int, k3 bigint, k4 bigint"
)


def log(spark, rows):
    """rows of (date, line, brand, planned, actual, defects, down, change, score)."""
    full = [
        (dt.date.fromisoformat(d), 1, line, brand, "M", p, a, q, down, change, 5, "X", score, i, 1, 1, 1)
        for i, (d, line, brand, p, a, q, down, change, score) in enumerate(rows)
    ]
    return spark.createDataFrame(full, LOG)


def test_ratios_are_clipped_and_guarded(spark):
    frame = log(
        spark,
        [
            ("2025-01-01", "L1", "A", 100, 120, 10, 400, 200, 0.5),  # lost more than the shift, made more than planned
            ("2025-01-01", "L2", "A", 0, 0, 0, 0, 0, 0.5),
        ],
    )
    rows = {r.line_id: r for r in oee.oee_line_period(frame).collect()}
    assert (rows["L1"].availability, rows["L1"].performance) == (0.0, 1.0)
    assert (rows["L2"].performance, rows["L2"].quality, rows["L2"].oee) == (0.0, 0.0, 0.0)


def test_single_period_compares_with_itself(spark):
    frame = log(spark, [("2025-01-01", "L1", "A", 100, 90, 0, 0, 0, 0.9)])
    row = oee.current_oee(oee.oee_line_period(frame)).first()
    assert row.trend == "stable" and row.previous_oee == row.oee


def test_weeks_are_labelled_by_sunday_and_skip_gaps(spark):
    frame = log(spark, [("2025-01-06", "L1", "A", 10, 9, 0, 0, 0, 1.0), ("2025-01-26", "L1", "A", 10, 9, 0, 0, 0, 1.0)])
    periods = sorted(r.period for r in oee.oee_line_period(frame, "weekly").collect())
    assert periods == [dt.date(2025, 1, 12), dt.date(2025, 1, 26)]


def test_best_metric_ties_go_to_the_first(spark):
    frame = log(spark, [("2025-01-01", "L1", "A", 100, 100, 0, 0, 0, 1.0), ("2025-01-01", "L2", "A", 100, 100, 0, 0, 0, 1.0)])
    rows = oee.benchmark(frame).orderBy("rank").collect()
    assert [(r.line_id, r.best_metric, r.worst_metric) for r in rows] == [
        ("L1", "availability", "availability"),
        ("L2", "availability", "availability"),
    ]
    assert oee.best_worst(oee.benchmark(frame)).first()[:1] == ("L1",)


def test_rates_need_both_sides(spark):
    produced = log(spark, [("2025-01-01", "L1", "A", 10, 10, 0, 0, 0, 1.0), ("2025-02-01", "L1", "B", 10, 10, 0, 0, 0, 1.0)])
    defects = spark.createDataFrame([(dt.date(2025, 1, 5), "A"), (dt.date(2025, 3, 5), "B")], "date date, brand string")
    rows = {(r.month, r.brand): r.defect_rate_pct for r in quality.defect_rate_trend(defects, produced).collect()}
    assert rows == {("2025-01", "A"): 10.0, ("2025-01", "Overall"): 10.0}


def test_pareto_ties_by_name(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "defect_type string")
    rows = quality.pareto(frame).orderBy("rank").collect()
    assert [(r.defect_type, r.cumulative_pct) for r in rows] == [("c", 50.0), ("a", 75.0), ("b", 100.0)]


def test_unknown_label_has_no_ordinal(spark):
    frame = spark.createDataFrame([("minor",), ("odd",)], "s string")
    got = {r.s: r.o for r in frame.withColumn("o", quality.ordinal(F.col("s"), quality.SEVERITY_WEIGHT)).collect()}
    assert got == {"minor": 1, "odd": None}


def test_expand_skips_zero(spark):
    frame = spark.createDataFrame([("a", 3), ("b", 0)], "k string, n int")
    assert sorted(map(tuple, quality.expand_by_count(frame, "n").collect())) == [("a", 1), ("a", 2), ("a", 3)]


STOCK = "material_id string, material_name string, current_stock int, reorder_point int, lead_time_days int, unit_price_eur double, consumption_rate_daily int"


def test_stock_without_demand_or_price(spark):
    frame = spark.createDataFrame([("a", "A", 10, 5, 7, 2.0, 0), ("b", "B", 45, 5, 2, 0.0, 20)], STOCK)
    rows = {r.material_id: r for r in inv.optimise(frame).collect()}
    assert rows["a"].days_of_stock == 999.0 and rows["a"].status == "overstocked"
    assert rows["b"].days_of_stock == 2.2  # 2.25, tie to even
    assert rows["b"].eoq == round((2 * 20 * 365 * 50 / 0.01) ** 0.5)
    assert [r.material_id for r in inv.stockout_risk(frame).collect()] == ["b"]


def test_other_service_levels_use_the_normal_quantile():
    assert inv.service_factor(0.95) == 1.645
    assert abs(inv.service_factor(0.99) - 2.3263) < 1e-4


def test_no_orders_fall_back_to_defaults(spark):
    empty = spark.createDataFrame([], "date date, expected_delivery date, actual_delivery date, delay_days int")
    assert tuple(reports.on_time(empty).first()) == (95.0, 30.0, 30.0)


def test_halves_of_odd_and_single_rows(spark):
    rows = [(f"2025-01-0{i + 1}", "L1", "A", 1, 1, 0, 0, 0, s) for i, s in enumerate([0.2, 0.4, 0.9])]
    row = reports.half_means(log(spark, rows + [("2025-01-01", "L1", "B", 1, 1, 0, 0, 0, 0.5)])).orderBy("brand").collect()
    assert (row[0].half, row[0].first_mean) == (1, 0.2) and abs(row[0].second_mean - 0.65) < 1e-12
    assert (row[1].half, row[1].first_mean, row[1].second_mean) == (0, None, 0.5)


def test_zero_is_best_branch(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (5.0,)], "v double")
    light = kpi.status(F.col("v"), F.lit(0.0), F.lit(3.0), F.lit("zero_is_best"))
    assert [r[0] for r in frame.select(light).collect()] == ["green", "yellow", "red"]


def test_alert_order(spark):
    rows = [("a", "Zeta", 1.0, 1.0, "red", "up"), ("b", "Beta", 1.0, 1.0, "yellow", "up"), ("c", "Alpha", 1.0, 1.0, "red", "up"), ("d", "G", 1.0, 1.0, "green", "up")]
    frame = spark.createDataFrame(rows, "kpi_id string, name string, value double, target double, status string, trend string")
    assert [r.kpi_id for r in kpi.alerts(frame).collect()] == ["c", "a", "b"]


def test_missing_line_changes_nothing_in_scenario(spark):
    frame = log(spark, [("2025-01-01", "L1", "A", 10, 10, 0, 0, 0, 0.5)])
    rows = {r.scenario: r for r in planning.what_if(frame, "L9").collect()}
    assert rows["remove_line_L9"].change_pct == 0.0
    assert rows["add_shift_3"].projected_daily_output == 13.0
    assert rows["increase_capacity_10pct"].change_pct == 10.0


def test_constant_values_fill_one_bin(spark):
    rows = retrieval.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()
    assert len(rows) == 20 and sum(r["count"] for r in rows) == 2


def test_metrics_with_empty_denominators(spark):
    frame = spark.createDataFrame([("ok", "ok"), ("ok", "ok")], "y string, p string")
    row = learning.classification_metrics(frame, "y", "p", "defect").first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.tn) == (1.0, 0.0, 0.0, 0.0, 2)
    zeros = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    row = learning.regression_metrics(zeros, "y", "p").first()
    assert (row.mae, row.mape, row.r2) == (1.0, 0.0, None)


def test_answers_below_the_threshold_say_so(spark):
    q = spark.createDataFrame([("1", "why"), ("2", "belt speed limit")], "question_id string, question string")
    text = "The belt speed has a limit of two metres per second, and the guard has to be closed before the belt starts."
    hit = spark.createDataFrame(
        [("2", 1, "C1", "a.txt", text, 0.4), ("2", 2, "C2", "b.txt", "other words", 0.03)],
        "question_id string, rank int, chunk_id string, source_file string, text string, similarity_score double",
    )
    rows = {r.question_id: r for r in retrieval.answer_questions(q, hit).collect()}
    assert rows["1"].answer == retrieval.NO_ANSWER and rows["1"].confidence == 0.0 and rows["1"].sources == []
    assert rows["2"].answer == f"Na osnovu dokumenta [a.txt]: {text} (Izvori: a.txt, b.txt)"
    assert rows["2"].confidence == 1.0 and rows["2"].sources[0].excerpt == text[:100] + "..."


def test_section_choice_prefers_overlap_then_first(spark):
    a = "The press needs oil every week and the filter needs a change each month, says the maintenance plan."
    b = "The oven needs nothing at all for a long time, and nobody has to look at it before the end of the year."
    frame = spark.createDataFrame([("when does the press need oil", f"{b} === {a}")], "q string, t string")
    assert frame.select(retrieval.best_section(F.col("q"), F.col("t"))).first()[0] == a


def test_an_unset_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from plantmetrics.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
