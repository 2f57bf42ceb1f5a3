"""Feature preparation, splits, metrics and Spark ML models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    Bucketizer,
    CountVectorizer,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantmetrics.functions import safe_div, weekday0
from plantmetrics.functions.relational import attach_row, with_row_index, with_trailing
from plantmetrics.functions.selection import mark_smallest
from plantmetrics.functions.text import TERM
from plantmetrics.operators.binned_forest import fit_forest
from plantmetrics.operators.kernel_svm import KernelSVM
from plantmetrics.session import materialise

# Model settings and feature lists.
SEED = 42
TREES, DEPTH = 100, 10
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 200, 5, 0.1
MAX_BINS = 32  # Spark's own number
QUANTILE_ERROR = 0.001
ROWS_PER_TASK = 100_000  # rows that one task sums in each step of a fit
CLASS_TREES, CLASS_BOOST_DEPTH = 200, 4
TEXT_DEPTH, TEXT_LEAF = 30, 2  # Spark's deepest tree; a split of three rows leaves two on one side
DOWNTIME_FEATURES = [
    "line_enc", "brand_enc", "shift", "day_of_week", "month", "operator_count", "rolling_avg_downtime_7d",
]
DEFECT_FEATURES = [
    "line_enc", "brand_enc", "shift", "operator_count", "downtime_minutes", "changeover_minutes", "month",
]
ROW_KEYS = ["shift", "k1", "k2", "k3", "k4"]


# -- preparation --------------------------------------------------------------------------------------
def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based number of each label in alphabetical order."""
    labels = df.select(column).distinct().withColumn(out, F.row_number().over(W.orderBy(column)) - 1)
    return df.join(labels, column, "left")


def prepare_log(log: DataFrame) -> DataFrame:
    """Production rows with calendar, encoded names, trailing downtime and defect rate."""
    rolled = with_trailing(
        log, ["line_id"], ["date", *ROW_KEYS], "downtime_minutes", 7, "rolling_avg_downtime_7d"
    )
    encoded = label_encode(label_encode(rolled, "line_id", "line_enc"), "brand", "brand_enc")
    return encoded.withColumns(
        {
            "day_of_week": weekday0(F.col("date")),
            "month": F.month("date"),
            "defect_rate": safe_div(F.col("defect_qty"), F.col("actual_qty")),
        }
    )


def split_rows(log: DataFrame, ratio: float = 0.80, by_time: bool = False) -> DataFrame:
    """Mark the first int(ratio * n) rows as training rows.

    By default rows count line by line, so the last lines are the test set; ``by_time=True`` counts them by
    date over all lines, so the latest dates are.
    """
    total = log.agg(F.count(F.lit(1)).alias("n"))
    order = ["date", "line_id", *ROW_KEYS] if by_time else ["line_id", "date", *ROW_KEYS]
    placed = with_row_index(log, [], order, "position")
    limit = F.floor(F.col("_t.n") * ratio)
    return attach_row(placed, total, "_t").withColumn("is_train", F.col("position") < limit).drop("_t")


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.80, seed: int = SEED) -> DataFrame:
    """floor(ratio * n) training rows per class, those with the smallest hashes of the key.

    The hash up to which a class's rows are taken comes from counts of hash prefixes, so rows are compared with it where they
    are, and a class may be of any size. Rows that share a key go to the same side.
    """
    wanted = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * ratio).alias("_wanted"))
    return mark_smallest(df, [label], [key], wanted, seed, "is_train")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (number of classes * rows of the class) per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    every = W.partitionBy()
    weight = F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows"))
    return sizes.withColumn("weight", weight)


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    return df.join(class_weights(df, label).drop("rows"), label)


def scale(df: DataFrame, features: str, out: str = "scaled") -> DataFrame:
    """Standardised vectors; mean and deviation come from the training rows only."""
    scaler = StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df.where("is_train")).transform(df)


# -- metrics ------------------------------------------------------------------------------------------
def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive) -> DataFrame:
    """Accuracy, precision, recall and F1 from the confusion counts; 0 where a denominator is 0."""
    cells = confusion(df, actual, predicted)
    yes, said = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)

    def total(condition) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = cells.agg(
        total(F.col(actual) == F.col(predicted)).alias("correct"),
        F.sum("n").alias("total"),
        total(yes & said).alias("tp"),
        total(~yes & said).alias("fp"),
        total(yes & ~said).alias("fn"),
        total(~yes & ~said).alias("tn"),
    )
    precision = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        safe_div(F.col("correct"), F.col("total")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_div(2 * precision * recall, precision + recall).alias("f1"),
        "tp",
        "fp",
        "fn",
        "tn",
    )


def topk_accuracy(df: DataFrame, label: str, scores: str, k: int = 3) -> DataFrame:
    """Share of rows whose true class is among the k highest scores."""
    own = F.element_at(scores, F.col(label) + 1)
    better = F.size(F.filter(scores, lambda s: s > own))
    return df.agg(F.avg((better < k).cast("double")).alias("topk_accuracy"), F.count(F.lit(1)).alias("rows"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """MAE, RMSE, MAPE over nonzero actuals and R2, in one aggregation."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    squares = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.coalesce(F.avg(F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0))))) * 100, F.lit(0.0)).alias("mape"),
        F.when(spread > 0, 1 - squares / spread).alias("r2"),
    )


def best_model(metrics: DataFrame, by: str, lowest: bool = True, name: str = "model") -> DataFrame:
    """The model with the lowest (or highest) metric; ties go to the first name."""
    order = F.col(by) if lowest else -F.col(by)
    pick = F.min(F.struct(order.alias("v"), F.col(name).alias("m")))
    return metrics.agg(pick.alias("p")).select(F.col("p.m").alias("best_model"))


def actual_vs_predicted(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Pairs with one common axis limit: the largest value times 1.1."""
    limit = df.agg((F.greatest(F.max(actual), F.max(predicted)) * 1.1).alias("axis_limit"))
    return attach_row(df, limit, "_l").withColumn("axis_limit", F.col("_l.axis_limit")).drop("_l")


def importance(model: PipelineModel, features: Sequence[str], reference: DataFrame) -> DataFrame:
    """Features by importance, highest first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    frame = reference.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


# -- models -------------------------------------------------------------------------------------------
def _regression(features: Sequence[str], estimator) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator.setFeaturesCol("features")])


def forest_regressor(features: Sequence[str], target: str, trees: int = TREES, depth: int = DEPTH) -> Pipeline:
    return _regression(
        features, RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=SEED)
    )


def boosted_regressor(features: Sequence[str], target: str, rounds: int = BOOST_ROUNDS) -> Pipeline:
    return _regression(
        features,
        GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=SEED),
    )


def fit_and_predict(frame: DataFrame, pipeline: Pipeline) -> tuple[PipelineModel, DataFrame]:
    """Fit on training rows, predict test rows."""
    model = pipeline.fit(frame.where("is_train"))
    return model, model.transform(frame.where(~F.col("is_train")))


def fit_packed(frame: DataFrame, features: Sequence[str], target: str, forest: RandomForestRegressor) -> tuple[PipelineModel, DataFrame]:
    """Fit a forest on training rows and predict test rows; the rows are binned and packed once for all its passes.

    Test rows may lie in few files, as those of the last lines do, so they are dealt over all cores before they go down the trees.
    """
    training = frame.where("is_train")
    learned = fit_forest(training, features, target, forest.setMaxBins(MAX_BINS), bin_edges(training, features))
    model = PipelineModel(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learned])
    tasks = max(frame.sparkSession.sparkContext.defaultParallelism, frame.count() // ROWS_PER_TASK + 1)
    return model, model.transform(frame.where(~F.col("is_train")).repartition(tasks))


def fit_binned(frame: DataFrame, features: Sequence[str], target: str, estimator) -> tuple[PipelineModel, DataFrame]:
    """Fit a boosted regressor on training rows and predict test rows; rows with equal bins are fitted as one weighted row.

    The trees see a feature only by the bin it falls into, of which there are MAX_BINS at most. So each feature becomes the number
    of its bin first, and rows with the same bins count as one row with their number as weight and their mean as target. For
    squared errors this gives every split the same gain and every leaf the same value: what differs is the spread inside such a
    group, which no split can change. The rounds then pass over the different rows, however often each occurs.
    """
    training = frame.where("is_train")
    binned = [f"{c}_bin" for c in features]
    bins = Bucketizer(inputCols=list(features), outputCols=binned, splitsArray=bin_edges(training, features), handleInvalid="error")
    grouped = bins.transform(training.select(*features, target)).groupBy(*binned).agg(
        F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias("_rows")
    )
    assembler = VectorAssembler(inputCols=binned, outputCol="features")
    grouped = materialise(grouped, "binned-rows")
    # a round is some short jobs, so few rows go to few tasks
    grouped = grouped.coalesce(grouped.count() // ROWS_PER_TASK + 1)
    learned = estimator.setFeaturesCol("features").setWeightCol("_rows").setMaxBins(MAX_BINS).fit(assembler.transform(grouped))
    model = PipelineModel(stages=[bins, assembler, learned])
    return model, model.transform(frame.where(~F.col("is_train")))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Edges of at most ``bins`` bins per feature: one bin per value where these are few, else quantiles of nearly equal counts."""
    edges = []
    for c in features:
        values = [r[0] for r in rows.select(F.col(c).cast("double")).distinct().limit(bins + 1).collect()]
        if len(values) <= bins:
            values = sorted(values)
            cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        else:
            cuts = rows.stat.approxQuantile(c, [i / bins for i in range(1, bins)], QUANTILE_ERROR)
        edges.append([-math.inf, *sorted(set(cuts)), math.inf])
    return edges


def defect_classifiers(trees: int = CLASS_TREES, rounds: int = BOOST_ROUNDS) -> dict[str, object]:
    return {
        "random_forest": RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=DEPTH, seed=SEED),
        "gradient_boosting": GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=CLASS_BOOST_DEPTH, stepSize=BOOST_STEP, seed=SEED),
        "kernel_svm": KernelSVM("label"),
    }


def train_defect_classifiers(frame: DataFrame, trees: int = CLASS_TREES, rounds: int = BOOST_ROUNDS):
    """Models by name and their test metrics; ``frame`` has features (vector), label and is_train."""
    models, rows = {}, None
    for name, estimator in defect_classifiers(trees, rounds).items():
        models[name] = estimator.fit(frame.where("is_train"))
        tested = models[name].transform(frame.where(~F.col("is_train")))
        scores = classification_metrics(tested, "label", "prediction", 1.0).withColumn("model", F.lit(name))
        rows = scores if rows is None else rows.unionByName(scores)
    return models, rows


def score_defects(model, frame: DataFrame, key: str) -> DataFrame:
    """Label and highest class probability per row."""
    return model.transform(frame).select(
        key,
        F.when(F.col("prediction") == 1.0, "defect").otherwise("ok").alias("label"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts n of a vector as 1 + ln n."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = vector_to_array(F.col(self.getInputCol()))
        damped = F.transform(counts, lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(0.0))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(damped))


def deal_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores by their key, at most about ROWS_PER_TASK to a task, and in its order.

    A forest passes over its rows once per level or more, and a small written table would be a single task in each pass. In
    this order the same rows are drawn each time.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK + 1)
    return rows.repartition(tasks, key).sortWithinPartitions(key)


def text_classifier(text: str, label: str, max_terms: int = 500, trees: int = CLASS_TREES) -> Pipeline:
    """TF-IDF with damped counts over terms and pairs, then a deep forest with class weights."""
    damped = Sublinear()
    damped.set(damped.inputCol, "counts")
    damped.set(damped.outputCol, "tf")
    stages = [
        StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=TERM, gaps=False),
        StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=StopWordsRemover.loadDefaultStopWords("english")),
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=max_terms),
        damped,
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
        RandomForestClassifier(
            labelCol="label_no",
            featuresCol="features",
            weightCol="weight",
            numTrees=trees,
            maxDepth=TEXT_DEPTH,
            minInstancesPerNode=TEXT_LEAF,
            cacheNodeIds=True,  # each row remembers its nodes, instead of going down all trees again for every level
            seed=SEED,
        ),
    ]
    return Pipeline(stages=stages)


def top_classes(predicted: DataFrame, key: str, labels: Sequence[str], alternatives: int = 3, floor: float = 0.01) -> DataFrame:
    """Best class and up to three alternatives above one percent; ``labels`` in class order."""
    names = F.array(*[F.lit(x) for x in labels])
    ranked = F.array_sort(
        F.zip_with(vector_to_array("probability"), names, lambda p, n: F.struct((-p).alias("neg"), n.alias("name")))
    )
    frame = predicted.withColumn("_r", ranked)
    others = F.filter(F.slice("_r", 2, alternatives), lambda x: -x["neg"] > floor)
    return frame.select(
        key,
        F.col("_r")[0]["name"].alias("best"),
        (-F.col("_r")[0]["neg"]).alias("confidence"),
        F.transform(others, lambda x: F.struct(x["name"].alias("code"), (-x["neg"]).alias("confidence"))).alias(
            "alternatives"
        ),
    )
