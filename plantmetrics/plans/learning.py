"""Queries on features, splits, metrics and models, with the operators' own settings.

Models are fitted when a query's frame is made, so calling a model query starts jobs before any action on its frame.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plantmetrics.functions import round_to
from plantmetrics.operators import anomaly, demand, forecasting, learning
from plantmetrics.plans import demand as demand_plans
from plantmetrics.plans.catalog import query
from plantmetrics.plans.oracle import Once, div, r
from plantmetrics.plans.sinks import folder
from plantmetrics.session import materialise

KEYS = ["k1", "k2", "k3", "k4"]


# -- preparation and metrics --------------------------------------------------------------------------
@query(
    "label_encode",
    """SELECT line_id, CAST(dense_rank() OVER (ORDER BY line_id) - 1 AS INT) AS line_enc, count(*) AS n FROM production_log GROUP BY line_id""",
)
def label_encode(t):
    encoded = learning.label_encode(t.production_log.select("line_id"), "line_id", "line_enc")
    return encoded.groupBy("line_id", "line_enc").agg(F.count(F.lit(1)).alias("n"))


@query(
    "win_split_80_global",
    """SELECT k1, k2, k3, k4, date, row_number() OVER (ORDER BY line_id, date, shift, k1, k2, k3, k4) - 1 AS position,
              row_number() OVER (ORDER BY line_id, date, shift, k1, k2, k3, k4) <= floor(0.8 * count(*) OVER ()) AS is_train FROM production_log""",
)
def win_split_80_global(t):
    log = t.production_log.select(*KEYS, "line_id", "date", "shift")
    return learning.split_rows(log).select(*KEYS, "date", "position", "is_train")


@query(
    "win_split_80_by_time",
    """SELECT k1, k2, k3, k4, date, row_number() OVER (ORDER BY date, line_id, shift, k1, k2, k3, k4) - 1 AS position,
              row_number() OVER (ORDER BY date, line_id, shift, k1, k2, k3, k4) <= floor(0.8 * count(*) OVER ()) AS is_train FROM production_log""",
)
def win_split_80_by_time(t):
    log = t.production_log.select(*KEYS, "line_id", "date", "shift")
    return learning.split_rows(log, by_time=True).select(*KEYS, "date", "position", "is_train")


SPLIT = """SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id)
           <= floor(0.8 * count(*) OVER (PARTITION BY label)) AS is_train FROM embeddings"""


@query("stratified_split", SPLIT)
def stratified_split(t):
    return learning.stratified_split(t.table("embeddings").select("vec_id", "label"), "label", "vec_id")


@query(
    "class_weights",
    """SELECT label, rows, CAST(sum(rows) OVER () AS DOUBLE) / (count(*) OVER () * rows) AS weight
       FROM (SELECT label, count(*) AS rows FROM embeddings GROUP BY 1)""",
)
def class_weights(t):
    return learning.class_weights(t.table("embeddings"), "label")


CONFUSION = """SELECT count(*) FILTER (WHERE prediction = actual_label) AS correct, count(*) AS total,
    count(*) FILTER (WHERE prediction = 'defect' AND actual_label = 'defect') AS tp,
    count(*) FILTER (WHERE prediction = 'defect' AND actual_label <> 'defect') AS fp,
    count(*) FILTER (WHERE prediction <> 'defect' AND actual_label = 'defect') AS fn,
    count(*) FILTER (WHERE prediction <> 'defect' AND actual_label <> 'defect') AS tn FROM inspections"""


@query(
    "clf_metrics",
    f"""SELECT {r("a", 6)} AS accuracy, {r("p", 6)} AS precision, {r("q", 6)} AS recall, {r(div("2 * p * q", "p + q"), 6)} AS f1, tp, fp, fn, tn
        FROM (SELECT *, {div("correct", "total")} AS a, {div("tp", "tp + fp")} AS p, {div("tp", "tp + fn")} AS q FROM ({CONFUSION}))""",
)
def clf_metrics(t):
    frame = learning.classification_metrics(t.inspections, "actual_label", "prediction", "defect")
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("accuracy", "precision", "recall", "f1")})


@query("confusion_matrix", "SELECT actual_label, prediction, count(*) AS n FROM inspections GROUP BY 1, 2")
def confusion_matrix(t):
    return learning.confusion(t.inspections, "actual_label", "prediction")


@query(
    "topk_accuracy",
    f"""SELECT {r("avg(CASE WHEN len(list_filter(p, lambda s: s > p[label + 1])) < 3 THEN 1.0 ELSE 0.0 END)", 6)} AS topk_accuracy, count(*) AS rows
        FROM (SELECT label, embedding AS p FROM embeddings)""",
)
def topk_accuracy(t):
    """All numbers of a vector read as the scores of as many classes, of which labels name the first ones."""
    scored = t.table("embeddings").select("label", F.col("embedding").alias("p"))
    frame = learning.topk_accuracy(scored, "label", "p")
    return frame.withColumn("topk_accuracy", round_to(F.col("topk_accuracy"), 6))


NAIVE = """
    SELECT series, model, demand, forecast FROM (
        SELECT w.series, w.demand, unnest(['last', 'mean']) AS model, unnest([CAST(l AS DOUBLE), m]) AS forecast
        FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) <= floor(0.8 * count(*) OVER (PARTITION BY series)) AS is_train
              FROM weekly_both) w
        JOIN (SELECT series, avg(demand) AS m, arg_max(demand, date) AS l FROM training_weeks GROUP BY 1) b ON b.series = w.series
        WHERE NOT is_train)"""
REG = f"""SELECT series, model, {r("avg(abs(demand - forecast))", 6)} AS mae, {r("sqrt(avg((demand - forecast) * (demand - forecast)))", 6)} AS rmse,
          {r("coalesce(avg(CASE WHEN demand <> 0 THEN abs((demand - forecast) / demand) END) * 100, 0.0)", 6)} AS mape,
          {r("1 - sum((demand - forecast) * (demand - forecast)) / (var_pop(demand) * count(*))", 6)} AS r2 FROM ({NAIVE}) GROUP BY 1, 2"""


def naive_forecasts(t):
    """Test weeks with two forecasts of the training weeks: their mean and their last value."""
    split = demand.split_time(demand_plans.both(t))
    base = split.where("is_train").groupBy("series").agg(
        F.avg("demand").alias("mean"), F.max_by("demand", "date").cast("double").alias("last")
    )
    test = split.where(~F.col("is_train")).join(base, "series")
    return test.unpivot(["series", "date", "demand"], ["last", "mean"], "model", "forecast")


def naive_metrics(t):
    frame = learning.regression_metrics(naive_forecasts(t), "demand", "forecast", "series", "model")
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("mae", "rmse", "mape", "r2")})


@query("reg_metrics", REG, demand_plans.VIEWS)
def reg_metrics(t):
    return naive_metrics(t)


@query(
    "best_model",
    f"SELECT model AS best_model FROM ({REG}) WHERE series = 'all' ORDER BY rmse, model LIMIT 1",
    demand_plans.VIEWS,
)
def best_model(t):
    return learning.best_model(naive_metrics(t).where(F.col("series") == "all"), "rmse")


# -- classifiers --------------------------------------------------------------------------------------
def labelled_vectors(t):
    """Feature vectors with a binary label and a split per class."""
    rows = t.table("embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("label"))
    split = learning.stratified_split(rows, "label", "vec_id").withColumn("label", F.col("label").cast("double"))
    return learning.vectors(split, "embedding").drop("embedding")


@query(
    "scale_features",
    f"""WITH s AS (SELECT vec_id, row_number() OVER (PARTITION BY label % 2 ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id)
                             <= floor(0.8 * count(*) OVER (PARTITION BY label % 2)) AS is_train, embedding FROM embeddings),
             u AS (SELECT vec_id, is_train, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM s),
             m AS (SELECT i, avg(x) AS mean, stddev_samp(x) AS deviation FROM u WHERE is_train GROUP BY i)
        SELECT vec_id, is_train, CAST(i AS INT) AS i, round((x - mean) / deviation, 6) + 0.0 AS scaled FROM u JOIN m USING (i)""",
)
def scale_features(t):
    """Standardised numbers, one row per vector and place."""
    from pyspark.ml.functions import vector_to_array

    scaled = learning.scale(labelled_vectors(t), "features")
    rows = scaled.select("vec_id", "is_train", F.posexplode(vector_to_array("scaled")).alias("i", "x"))
    return rows.select("vec_id", "is_train", "i", (F.round("x", 6) + F.lit(0.0)).alias("scaled"))


def scaled_vectors(t):
    scaled = learning.scale(labelled_vectors(t), "features").drop("features")
    return materialise(scaled.withColumnRenamed("scaled", "features"), "vectors")


@query("defect_classifier")
def defect_classifier(t):
    frame = scaled_vectors(t)
    _, metrics = learning.train_defect_classifiers(frame)
    return metrics


@query("defect_scoring")
def defect_scoring(t):
    frame = scaled_vectors(t)
    models, metrics = learning.train_defect_classifiers(frame)
    best = models[learning.best_model(metrics, "f1", lowest=False).first()[0]]
    path = folder(t, "defect-model")
    best.write().overwrite().save(path)
    # the loaded model has trees only, not the session's summary of its training
    return learning.score_defects(type(best).load(path), frame, "vec_id")


@query(
    "tariff_rows",
    """WITH s AS (SELECT line_no, correct_hs_code, row_number() OVER (PARTITION BY correct_hs_code
                       ORDER BY md5(CAST(line_no AS VARCHAR) || '-42'), line_no) <= floor(0.8 * count(*) OVER (PARTITION BY correct_hs_code))
                       AS is_train, count(*) OVER (PARTITION BY correct_hs_code) AS own FROM tariff_lines)
       SELECT line_no, correct_hs_code, is_train,
              CAST((SELECT count(*) FROM s) AS DOUBLE) / ((SELECT count(DISTINCT correct_hs_code) FROM s) * own) AS weight FROM s""",
)
def tariff_rows(t):
    """What the code classifier is fitted on: label, split and class weight of every line."""
    lines = t.tariff_lines.select("line_no", "correct_hs_code")
    split = learning.stratified_split(lines, "correct_hs_code", "line_no")
    return learning.with_class_weight(split, "correct_hs_code")


def classified_texts(t):
    lines = t.tariff_lines.select("line_no", "product_description", "correct_hs_code")
    split = learning.stratified_split(lines, "correct_hs_code", "line_no")
    frame = materialise(learning.with_class_weight(split, "correct_hs_code"), "texts")
    training = learning.deal_rows(frame.where("is_train"), "line_no")
    model = learning.text_classifier("product_description", "correct_hs_code").fit(training)
    return model, model.transform(frame.where(~F.col("is_train")))


@query("hs_classifier")
def hs_classifier(t):
    from pyspark.ml.functions import vector_to_array

    _, predicted = classified_texts(t)
    scored = predicted.select(F.col("label_no").cast("int").alias("label_no"), "prediction", vector_to_array("probability").alias("p"))
    top3 = learning.topk_accuracy(scored, "label_no", "p", 3)
    return scored.agg(F.avg((F.col("label_no") == F.col("prediction")).cast("double")).alias("accuracy")).withColumn(
        "top3_accuracy", top3.select("topk_accuracy").scalar()
    )


@query("topk_classes")
def topk_classes(t):
    model, predicted = classified_texts(t)
    return learning.top_classes(predicted, "line_no", model.stages[0].labels).withColumn(
        "alternatives", F.to_json("alternatives")
    )


# -- regression and forecasts -------------------------------------------------------------------------
def prepared_log(t):
    return materialise(learning.split_rows(learning.prepare_log(t.production_log)), "prepared-log")


@query(
    "regression_rows",
    f"""SELECT k1, k2, k3, k4, CAST(dense_rank() OVER (ORDER BY line_id) - 1 AS INT) AS line_enc,
               CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INT) AS brand_enc, shift, CAST(isodow(date) - 1 AS INT) AS day_of_week,
               CAST(month(date) AS INT) AS month, operator_count, downtime_minutes, changeover_minutes,
               {r('''avg(downtime_minutes) OVER (PARTITION BY line_id ORDER BY date, shift, k1, k2, k3, k4
                     ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)''', 6)} AS rolling_avg_downtime_7d,
               {r(div("defect_qty", "actual_qty"), 6)} AS defect_rate,
               row_number() OVER (ORDER BY line_id, date, shift, k1, k2, k3, k4) <= floor(0.8 * count(*) OVER ()) AS is_train
        FROM production_log""",
)
def regression_rows(t):
    """What the downtime and defect rate models are fitted on: features, targets and split of every row."""
    names = list(dict.fromkeys([*learning.DOWNTIME_FEATURES, *learning.DEFECT_FEATURES]))
    frame = prepared_log(t).select(*KEYS, *names, "defect_rate", "is_train")
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("rolling_avg_downtime_7d", "defect_rate")})


def downtime(t):
    return fitted_downtime(prepared_log(t))


def fitted_downtime(frame):
    forest = learning.forest_regressor(learning.DOWNTIME_FEATURES, "downtime_minutes").getStages()[-1]
    return learning.fit_packed(frame, learning.DOWNTIME_FEATURES, "downtime_minutes", forest)


@query("downtime_model")
def downtime_model(t):
    _, predicted = downtime(t)
    return learning.regression_metrics(predicted, "downtime_minutes", "prediction")


@query("actual_vs_predicted")
def actual_vs_predicted(t):
    _, predicted = downtime(t)
    pairs = predicted.select(*KEYS, F.col("downtime_minutes").alias("actual"), F.col("prediction").alias("predicted"))
    return learning.actual_vs_predicted(pairs, "actual", "predicted")


@query("importance_sorted")
def importance_sorted(t):
    model, predicted = downtime(t)
    return learning.importance(model, learning.DOWNTIME_FEATURES, predicted)


@query("defect_rate_model")
def defect_rate_model(t):
    boosted = learning.boosted_regressor(learning.DEFECT_FEATURES, "defect_rate").getStages()[-1]
    _, predicted = learning.fit_binned(prepared_log(t), learning.DEFECT_FEATURES, "defect_rate", boosted)
    return learning.regression_metrics(predicted, "defect_rate", "prediction")


@query("sink_models")
def sink_models(t):
    """A fitted pipeline is saved, loaded again and used."""
    frame = prepared_log(t)
    model, _ = fitted_downtime(frame)
    path = folder(t, "models")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path).transform(frame.where(~F.col("is_train")))
    return loaded.select(*KEYS, "prediction")


def split_features(t):
    return materialise(demand.split_time(demand.feature_matrix(demand_plans.both(t))), "features")


@query(
    "forecast_rows",
    f"""SELECT f.*, f.trend < floor(0.8 * count(*) OVER (PARTITION BY f.series)) AS is_train
        FROM (SELECT series, date, demand, month, rolling_mean_14, rolling_std_14, lag_30, trend FROM ({demand_plans.FEATURE_SQL})) f""",
    demand_plans.VIEWS,
)
def forecast_rows(t):
    """What the demand models are fitted on, and which weeks they are tested on."""
    frame = split_features(t).select(
        "series", "date", "demand", "month", "rolling_mean_14", "rolling_std_14", "lag_30", "trend", "is_train"
    )
    return frame.withColumns({c: round_to(F.col(c), 6) for c in ("rolling_mean_14", "rolling_std_14")})


def tree_predictions(t, frame):
    """Test rows with the prediction of each model."""
    forest = learning.forest_regressor(demand.FEATURES, "demand")
    boosted = learning.boosted_regressor(demand.FEATURES, "demand")
    rows, models = None, {}
    for name, pipeline in (("random_forest", forest), ("gradient_boosting", boosted)):
        models[name], predicted = learning.fit_and_predict(frame, pipeline)
        part = predicted.select("series", "date", "demand", F.lit(name).alias("model"), F.col("prediction").alias("forecast"))
        rows = part if rows is None else rows.unionByName(part)
    return models, rows


def smoothed(frame):
    test = frame.where(~F.col("is_train"))
    horizon = test.groupBy("series").count().agg(F.max("count")).first()[0]
    forecast = forecasting.holt_winters(frame.where("is_train"), horizon)
    return forecasting.against_actual(forecast, test).drop("step").withColumn("model", F.lit("holt_winters"))


@query("holt_winters")
def holt_winters(t):
    return smoothed(materialise(demand.split_time(demand_plans.both(t)), "weeks"))


@query("demand_models")
def demand_models(t):
    """Three models compared per series; the lowest RMSE wins."""
    frame = split_features(t)
    _, rows = tree_predictions(t, frame)
    every = rows.unionByName(smoothed(frame).select("series", "date", "demand", "model", "forecast"))
    return learning.regression_metrics(every, "demand", "forecast", "series", "model")


@query("forecast_vs_actual")
def forecast_vs_actual(t):
    frame = split_features(t)
    _, rows = tree_predictions(t, frame)
    training = frame.where("is_train").select("series", "demand")
    return demand.with_band(rows.where(F.col("model") == "random_forest"), training)


@query("demand_forecast")
def demand_forecast(t):
    frame = split_features(t)
    models, _ = tree_predictions(t, frame)
    future = demand.future_features(frame, 30)
    predicted = models["random_forest"].transform(future).select("series", "date", F.col("prediction").alias("forecast"))
    return demand.with_band(predicted, frame.where("is_train").select("series", "demand"))


# -- anomalies -----------------------------------------------------------------------------
ANOMALY_FEATURES = ["oee_score", "downtime_minutes", "defect_qty", "actual_qty"]


def labelled_log(t):
    log = t.production_log.select(*KEYS, "date", "line_id", "brand", "shift", *ANOMALY_FEATURES)
    nodes = anomaly.build_trees(log, ANOMALY_FEATURES, [*KEYS, "date"])
    scored = materialise(anomaly.score(log, nodes, ANOMALY_FEATURES), "scored")
    return anomaly.label(scored)


def forest_views() -> dict[str, str]:
    """The same forest in SQL: one step of common table expressions per level, first for the drawn rows, then for all."""
    trees, sample, unit, seed = anomaly.TREES, anomaly.SAMPLE, anomaly.UNIT, anomaly.SEED
    limit = sample.bit_length() - 1
    width = range(len(ANOMALY_FEATURES))
    values = ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(ANOMALY_FEATURES))
    fs = ", ".join(f"f{i}" for i in width)
    keys = "k1, k2, k3, k4, date"
    draw = "('0x' || substr(md5(concat_ws('-', {}, tree, node, '{}')), 1, {}))::BIGINT"
    path = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n WHEN n = 2 THEN 1.0 ELSE 0.0 END"
    usable = "list_filter([" + ", ".join(f"CASE WHEN hi[{i + 1}] > lo[{i + 1}] THEN {i} END" for i in width) + "], lambda x: x IS NOT NULL)"
    step = "2 * node + 1 + CASE WHEN [" + fs + "][feature + 1] >= cut THEN 1 ELSE 0 END"
    views = {
        "log_rows": f"SELECT row_number() OVER () AS row_id, {keys}, line_id, brand, shift, {', '.join(ANOMALY_FEATURES)}, {values} FROM production_log",
        "drawn_rows": f"""SELECT {fs}, row_number() OVER (ORDER BY md5(concat_ws('-', {keys}, {seed})), {keys}) - 1 AS r, count(*) OVER () AS total
                          FROM log_rows QUALIFY r < {trees * sample}""",
        "level_0": f"""SELECT CAST(slot // {sample} AS INT) AS tree, 0 AS node, {fs}
                       FROM (SELECT {fs}, unnest(range(r, {trees * sample}, least(total, {trees * sample}))) AS slot FROM drawn_rows)""",
    }
    for depth in range(limit + 1):
        views[f"split_{depth}"] = f"""
            SELECT tree, node, feature, lo[feature + 1] + (hi[feature + 1] - lo[feature + 1])
                       * (({draw.format(seed, "cut", 13)} + 0.5) / {2**52}.0) AS cut,
                   CASE WHEN feature IS NULL THEN CAST(round(({depth} + {path}) * {unit}) AS BIGINT) END AS units
            FROM (SELECT *, CASE WHEN {depth} < {limit} AND len(usable) > 0
                            THEN usable[CAST({draw.format(seed, "feature", 8)} % len(usable) AS INT) + 1] END AS feature
                  FROM (SELECT *, {usable} AS usable
                        FROM (SELECT tree, node, count(*) AS n, [{', '.join(f'min(f{i})' for i in width)}] AS lo,
                                     [{', '.join(f'max(f{i})' for i in width)}] AS hi FROM level_{depth} GROUP BY tree, node)))"""
        if depth < limit:
            views[f"level_{depth + 1}"] = f"""
                SELECT l.tree, {step.replace("node", "l.node", 1)} AS node, {fs}
                FROM level_{depth} l JOIN split_{depth} s ON s.tree = l.tree AND s.node = l.node WHERE feature IS NOT NULL"""
    reached = f"SELECT row_id, {fs}, CAST(unnest(range({trees})) AS INT) AS tree, 0 AS node FROM log_rows"
    for depth in range(limit + 1):
        views[f"passed_{depth}"] = f"""
            SELECT p.row_id, {fs}, p.tree, {step.replace("node", "p.node", 1)} AS node,
                   CASE WHEN feature IS NULL THEN coalesce(s.units, {depth} * {unit}) END AS units
            FROM ({reached}) p LEFT JOIN split_{depth} s ON s.tree = p.tree AND s.node = p.node"""
        reached = f"SELECT row_id, {fs}, tree, node FROM passed_{depth} WHERE units IS NULL"
    norm = float(trees * unit * anomaly.average_path(sample))
    ends = " UNION ALL ".join(f"SELECT row_id, units FROM passed_{d} WHERE units IS NOT NULL" for d in range(limit + 1))
    views["isolated"] = f"""SELECT row_id, pow(CAST(2.0 AS DOUBLE), -CAST(sum(units) AS DOUBLE) / CAST({norm!r} AS DOUBLE)) AS isolation
                            FROM ({ends}) GROUP BY row_id"""
    views["labelled_rows"] = f"""SELECT *, t - isolation AS anomaly_score, CASE WHEN t - isolation < 0 THEN -1 ELSE 1 END AS anomaly
        FROM log_rows JOIN isolated USING (row_id), (SELECT quantile_cont(isolation, {1 - anomaly.CONTAMINATION!r}) AS t FROM isolated)"""
    return {name: Once(body) for name, body in views.items()}


FOREST = forest_views()


@query(
    "anomaly_forest",
    f"SELECT k1, k2, k3, k4, date, anomaly, {r('anomaly_score', 6)} AS anomaly_score FROM labelled_rows",
    FOREST,
)
def anomaly_forest(t):
    found = labelled_log(t).select(*KEYS, "date", "anomaly", "anomaly_score")
    return found.withColumn("anomaly_score", round_to(F.col("anomaly_score"), 6))


@query(
    "topk_lowest_score",
    f"""SELECT k1, k2, k3, k4, date, line_id, brand, shift, {', '.join(ANOMALY_FEATURES[1:])}, {r('oee_score', 6)} AS oee_score, anomaly,
               {r('anomaly_score', 6)} AS anomaly_score
        FROM labelled_rows ORDER BY labelled_rows.anomaly_score, k1, k2, k3, k4 LIMIT 5""",
    FOREST,
)
def topk_lowest_score(t):
    lowest = anomaly.lowest(labelled_log(t))
    return lowest.withColumns({c: round_to(F.col(c), 6) for c in ("oee_score", "anomaly_score")})


@query(
    "split_by_label",
    f"""SELECT CASE WHEN anomaly = -1 THEN 'anomaly' ELSE 'normal' END AS part, count(*) AS rows,
               {', '.join(f"{r(f'avg({c})', 6)} AS mean_{c}" for c in ANOMALY_FEATURES)}
        FROM labelled_rows GROUP BY 1""",
    FOREST,
)
def split_by_label(t):
    """Means of the normal and the anomalous rows side by side."""
    parts = anomaly.split_by_label(labelled_log(t))
    means = [F.count(F.lit(1)).alias("rows"), *[round_to(F.avg(c), 6).alias(f"mean_{c}") for c in ANOMALY_FEATURES]]
    named = [part.agg(*means).withColumn("part", F.lit(name)) for part, name in zip(parts, ("anomaly", "normal"))]
    return named[0].unionByName(named[1])
