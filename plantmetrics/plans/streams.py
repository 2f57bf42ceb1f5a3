"""Queries that run as streams over the event files until they are read to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import r
from plantmetrics.session import run_folder
from plantmetrics.sources import star
from plantmetrics.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
COUNTS = f"""count(*) AS inspected, count(*) FILTER (WHERE prediction = 'defect') AS defects,
    count(*) FILTER (WHERE prediction <> 'defect') AS ok,
    {r("CAST(count(*) FILTER (WHERE prediction = 'defect') AS DOUBLE) / count(*) * 100", 6)} AS defect_pct,
    {r("CAST(count(*) FILTER (WHERE prediction = actual_label) AS DOUBLE) / count(*) * 100", 6)} AS correct_pct,
    {r("avg(processing_time_ms)", 6)} AS mean_ms"""
RATES = ["defect_pct", "correct_pct", "mean_ms"]


def events(t):
    return jobs.read_stream(t.spark, t.folder, EVENTS, "events.parquet")


def totals(t, frame, name):
    """Run a totals stream to the end and read its table."""
    base = f"{run_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    jobs.start_table(frame, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return jobs.read_current(t.spark, f"{base}/table")


def rounded(frame, columns):
    return frame.withColumns({c: round_to(F.col(c), 6) for c in columns})


@query("stream_running_counts", f"SELECT station, {COUNTS} FROM inspections GROUP BY station")
def stream_running_counts(t):
    frame = jobs.running_counts(star.inspections(events(t)), "station")
    return rounded(totals(t, frame, "station-counts"), RATES)


@query("stream_running_counts_global", f"SELECT {COUNTS} FROM inspections")
def stream_running_counts_global(t):
    return rounded(totals(t, jobs.running_counts(star.inspections(events(t))), "counts"), RATES)


@query(
    "stream_query_stats",
    f"""SELECT count(*) AS total_queries, {r("avg(confidence)", 6)} AS avg_confidence, {r("avg(response_time_ms)", 6)} AS avg_response_time_ms
        FROM query_log""",
)
def stream_query_stats(t):
    frame = totals(t, jobs.query_stats(star.query_log(events(t))), "question-stats")
    return rounded(frame, ["avg_confidence", "avg_response_time_ms"])


@query(
    "stream_score_log",
    """SELECT inspection_id, station, prediction, actual_label, processing_time_ms, prediction = actual_label AS correct FROM inspections""",
)
def stream_score_log(t):
    base = f"{run_folder(t.spark)}/inspection-log-{uuid.uuid4().hex}"
    rows = jobs.scored(star.inspections(events(t)))
    jobs.start_log(rows, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/log").drop("ts")
