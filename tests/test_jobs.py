"""Streams, sinks, images and models."""

import base64
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmetrics.operators import anomaly, forecasting, images, learning, retrieval
from plantmetrics.sources import readers, sinks, star
from plantmetrics.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def test_stream_log_restart_adds_nothing_twice(spark, tmp_path):
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.limit(100).write.parquet(source)

    def run():
        stream = jobs.read_stream(spark, source, EVENTS, "*.parquet")
        jobs.start_log(jobs.scored(star.inspections(stream)), log, check).awaitTermination()
        return spark.read.parquet(log).count()

    assert run() == 100
    assert run() == 100
    events.limit(30).write.mode("append").parquet(source)
    assert run() == 130


def test_stream_totals_equal_the_batch(spark, tmp_path):
    stream = jobs.read_stream(spark, SF, EVENTS, "events.parquet")
    totals = jobs.running_counts(star.inspections(stream), "station")
    jobs.start_table(totals, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    batch = jobs.running_counts(star.inspections(spark.read.parquet(f"{SF}/events.parquet")), "station")
    columns = ["station", "inspected", "defects", "ok", F.round("mean_ms", 9).alias("m")]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select(columns).collect()))
    assert got == sorted(map(tuple, batch.select(columns).collect()))


def test_table_csv_keeps_codes_and_fails_on_bad_rows(spark, tmp_path):
    path = tmp_path / "hs.csv"
    header = "product_description,correct_hs_code,country_destination,duty_rate_percent,preferential_rate,fta_applicable,special_requirements\n"
    path.write_text(header + "boot,64011,DE,1.5,0.0,x,y\n")
    assert readers.read_hs_classifications(spark, str(path)).first().correct_hs_code == "064011"
    path.write_text(header + "boot,64011,DE,notanumber,0.0,x,y\n")
    with pytest.raises(Exception):
        readers.read_hs_classifications(spark, str(path)).collect()


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two words", encoding="utf-8")
    (tmp_path / "a.txt").write_text("Title: A\nline", encoding="utf-8")
    (tmp_path / "c.md").write_text("ignored")
    rows = readers.read_corpus(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(r.file_name, r.word_count) for r in rows] == [("a.txt", 3), ("b.txt", 2)]
    chunk = retrieval.chunk_documents(readers.read_corpus(spark, str(tmp_path))).orderBy("chunk_id").first()
    assert chunk.metadata.document_title == "A"


def test_reports_are_partitioned_and_listed(spark, tmp_path):
    frame = spark.createDataFrame([("A", "2025-Q4", "x"), ("B", "2025-Q4", "y")], "brand string, period string, body string")
    sinks.write_reports(frame, str(tmp_path / "r"))
    assert sorted(os.listdir(tmp_path / "r"))[-2:] == ["brand=A", "brand=B"]
    sinks.write_json(frame, str(tmp_path / "j"))
    rows = readers.read_reports(spark, str(tmp_path / "j")).collect()
    assert {r.brand for r in rows} <= {"A", "B"} and all(r.size_bytes > 0 for r in rows)


def test_query_log_round_trip_with_line_breaks(spark, tmp_path):
    answers = spark.createDataFrame(
        [('say "what"\nnow', "answer", [("a.txt", "C1", 0.5, "e")], 0.5)],
        "question string, answer string, sources array<struct<file:string,chunk_id:string,relevance:double,excerpt:string>>, confidence double",
    )
    for _ in range(2):
        sinks.append_query_log(answers, str(tmp_path / "log"), 1.5)
    rows = readers.read_query_log(spark, str(tmp_path / "log")).collect()
    assert [(r.question, r.top_source, r.answer_length) for r in rows] == [('say "what"\nnow', "a.txt", 6)] * 2


PNGS = {  # 6 by 4 grey pixels: 0 to 23, and 200 throughout
    "defect_1.png": "iVBORw0KGgoAAAANSUhEUgAAAAYAAAAECAAAAACIbxGfAAAAJElEQVR4nGNgYGRiZmFlYGPn4OTiZuDh5eMXEGQQEhYRFRMHAAoCARX6FQ+xAAAAAElFTkSuQmCC",
    "ok_1.png": "iVBORw0KGgoAAAANSUhEUgAAAAYAAAAECAAAAACIbxGfAAAADklEQVR4nGM4AQYM2CgABqsSwcnZIg8AAAAASUVORK5CYII=",
}


def test_png_folder(spark, tmp_path):
    (tmp_path / "png").mkdir()
    for name, data in PNGS.items():
        (tmp_path / "png" / name).write_bytes(base64.b64decode(data))
    read = readers.read_images(spark, str(tmp_path / "png"))
    rows = {r.file_name: r for r in images.image_features(read).collect()}
    assert {k: r.label for k, r in rows.items()} == {"defect_1.png": 1, "ok_1.png": 0}
    flat = np.array(rows["ok_1.png"].features)
    assert len(flat) == 62 and flat[0] == 200.0 and flat[1] == 0.0
    assert flat[6:54].sum() == pytest.approx(3.0) and flat[58] == 200.0 and not flat[59:].any()


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), 1, 1, 1) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(400, 40.0, -40.0, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "k1 bigint, x double, y double, k2 int, k3 int, k4 int")
    nodes = anomaly.build_trees(frame, ["x", "y"], ["k1"], trees=30, sample=64)
    labelled = anomaly.label(anomaly.score(frame, nodes, ["x", "y"], trees=30, sample=64))
    assert anomaly.lowest(labelled, 1).first().k1 == 400
    bad, good = anomaly.split_by_label(labelled)
    assert abs(bad.count() / 401 - 0.05) < 0.02 and bad.count() + good.count() == 401


def test_smoothing_follows_trend_and_season():
    season = np.array([10.0, -5.0, 0.0, -5.0])
    values = np.array([100 + 2 * i + season[i % 4] for i in range(40)])
    want = np.array([100 + 2 * i + season[i % 4] for i in range(40, 48)])
    assert np.abs(forecasting.smooth(values, 4, 8) - want).max() < 3.0


def test_splits_and_weights(spark):
    rows = [(i, "hot" if i % 10 else "rare") for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, c string")
    shares = learning.stratified_split(frame, "c", "id").groupBy("c").agg(F.count_if("is_train").alias("n")).collect()
    assert {r.c: r.n for r in shares} == {"hot": 144, "rare": 16}
    weights = {r.c: r.weight for r in learning.class_weights(frame, "c").collect()}
    assert weights == {"hot": 200 / (2 * 180), "rare": 200 / (2 * 20)}


def test_topk_classes(spark):
    from pyspark.ml.functions import array_to_vector

    frame = spark.createDataFrame([(1, [0.005, 0.6, 0.395])], "id int, p array<double>")
    row = learning.top_classes(frame.withColumn("probability", array_to_vector("p")), "id", ["a", "b", "c"]).first()
    assert (row.best, row.confidence) == ("b", 0.6)
    assert [(a.code, a.confidence) for a in row.alternatives] == [("c", 0.395)]


def test_training_texts_are_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    """One small file is one task of each pass otherwise; the rows stay the same."""
    rows = [(i, f"{'steel' if i % 2 else 'wood'} part{i % 5}", "ab"[i % 2], 1.0) for i in range(120)]
    schema = "line_no long, words string, code string, weight double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "texts"))
    frame = spark.read.parquet(str(tmp_path / "texts"))
    dealt = learning.deal_rows(frame, "line_no")
    parts = dealt.rdd.glom().map(len).collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts) < 60
    assert sorted(map(tuple, dealt.collect())) == rows
    monkeypatch.setattr(learning, "ROWS_PER_TASK", 5)
    assert learning.deal_rows(frame, "line_no").rdd.getNumPartitions() == 25
    model = learning.text_classifier("words", "code", trees=3).fit(dealt)
    assert model.transform(frame).where("label_no = prediction").count() == 120
    assert model.stages[-1].getCacheNodeIds()
