"""Plan checks: what runs in the JVM, what reaches the scan, what is broadcast."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PYTHON = ["PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]
# queries whose frame is the result of an earlier Python step or whose search runs in Arrow batches
IN_PYTHON = {"similarity_search", "topk_per_query", "ordered_distinct", "answer_questions"}
EAGER = {"sink_result_json", "sink_chunks", "sink_features_csv", "sink_index", "tfidf_weights", "vocab_topn"}


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name",
    sorted(n for n in entry.oracle_sql() if n not in IN_PYTHON | EAGER and not re.match("stream_|op[0-9]+_|pipeline", n)),
)
def test_checked_queries_stay_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not any(node in text for node in PYTHON)


def test_quarter_reaches_the_scan(spark):
    text = plan(entry.queries()["filter_quarter"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["weekly_demand"](spark, SF))
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]
    assert "l_orderkey" not in text.split("== Physical Plan ==")[1]


def test_effectiveness_needs_one_shuffle(spark):
    physical = plan(entry.queries()["oee_line_period"](spark, SF)).split("== Physical Plan ==")[1]
    assert physical.count("Exchange") == 1


def test_nothing_is_a_cross_join(spark):
    for name in ("stockout_heatmap", "kpi_board", "affinity_rank", "capacity_fill", "brand_alloc", "weekly_demand_brand"):
        physical = plan(entry.queries()[name](spark, SF)).split("== Physical Plan ==")[1]
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


@pytest.mark.parametrize("name", ["smsi_scorecard", "performance_report", "kpi_board", "dashboard_doc"])
def test_reports_scan_the_lines_at_most_twice(spark, name, monkeypatch):
    """Once for production and once for defects, whether directly or into a written table; the indicators add the whole log."""
    from plantmetrics import session
    from plantmetrics.plans import reports

    scans = []

    def counted(frame, label):
        scans.append(plan(frame).split("== Physical Plan ==")[1].count("lineitem.parquet"))
        return session.materialise(frame, label)

    monkeypatch.setattr(reports, "materialise", counted)
    last = plan(entry.queries()[name](spark, SF)).split("== Physical Plan ==")[1].count("lineitem.parquet")
    assert sum(scans) + last <= (2 if name in ("smsi_scorecard", "performance_report") else 4)
