"""The table of running totals: replays, a job that dies before or after the switch, and readers in between."""

import pytest
from pyspark.sql import functions as F

from plantmetrics.sources import star
from plantmetrics.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def totals_of(frame):
    columns = ["station", "inspected", "defects", "ok", F.round("mean_ms", 9).alias("m")]
    return sorted(map(tuple, frame.select(columns).collect()))


def test_each_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        jobs.read_current(spark, path)
    for batch_id in range(3):
        jobs.replace_table(spark.range(batch_id + 1), path, batch_id)
        assert jobs.current_batch(spark, path) == batch_id
        jobs.replace_table(spark.range(99), path, batch_id)  # a replay changes nothing
        jobs.replace_table(spark.range(99), path, 0)
        assert jobs.read_current(spark, path).count() == batch_id + 1
    assert len(list((tmp_path / "table").glob("batch=*"))) == 2  # the last one and the one that readers may still have open


@pytest.mark.parametrize("dies", ["before the switch", "after the switch"])
def test_a_killed_job_goes_on(spark, tmp_path, monkeypatch, dies):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    events.where("event_id % 3 = 0").write.parquet(source)

    def run():
        stream = jobs.read_stream(spark, source, EVENTS, "*.parquet")
        jobs.start_table(jobs.running_counts(star.inspections(stream), "station"), table, check).awaitTermination()

    def batch():
        return totals_of(jobs.running_counts(star.inspections(spark.read.parquet(source)), "station"))

    run()
    first = batch()
    assert totals_of(jobs.read_current(spark, table)) == first
    events.where("event_id % 3 = 1").write.mode("append").parquet(source)
    switch = jobs.switch_pointer

    def killed(*given):
        if dies == "after the switch":
            switch(*given)
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "switch_pointer", killed)
        with pytest.raises(Exception, match="killed"):
            run()
    seen = totals_of(jobs.read_current(spark, table))
    assert seen == (first if dies == "before the switch" else batch())
    run()  # the checkpoint replays the batch
    assert totals_of(jobs.read_current(spark, table)) == batch() != first
