"""Click-rate models on the log target with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from adlumen import schemas
from adlumen.functions import fixed_values as fixed
from adlumen.functions.affect import with_affect
from adlumen.functions.hashing import hash_bucket
from adlumen.functions.scoring import predicted_rate
from adlumen.functions.text import with_text_features
from adlumen.operators.clean import with_log_columns
from adlumen.operators.eda import union_all
from adlumen.operators.evaluate import regression_metrics
from adlumen.session import checkpointed

LABEL = "log_ctr"
#: Rows of a task of a fit: a learner runs some ten jobs per round, so its rows lie in few partitions.
TASK_ROWS = 250_000
#: Rows below which a task of a long fit does less work than its start costs.
LEAST_ROWS = 20_000

Result = TypeVar("Result")


@dataclass(frozen=True)
class ModelSizes:
    """Sizes of the learners; the defaults are the published ones."""

    boosting_rounds: int = 300
    step: float = 0.03
    depth: int = 5
    forest_trees: int = 200
    folds: int = 5
    parallelism: int = 4
    seed: int = field(default=42)


def model_input(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns as numbers with null as 0, and the columns to keep."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    return df.select(*keep, *numbers)


def training_rows(df: DataFrame, key: str = "post_id") -> DataFrame:
    """Full model columns, the log target, the rate, and fixed split and fold numbers per row."""
    prepared = with_log_columns(df).withColumns({
        "is_test": hash_bucket(F.col(key), 100) < 20,
        "fold": hash_bucket(F.col(key), 5, seed=7),
    })
    return model_input(prepared, fixed.FULL_COLUMNS, [key, "ctr_proxy", LABEL, "is_test", "fold"])


def kept_rows(rows: DataFrame, task_rows: int = TASK_ROWS, least_rows: int = 0) -> DataFrame:
    """The rows on their own, cached, in no more partitions than their number or the cores ask.

    Every task of a fit reports the metrics of the whole plan below it to the driver, so the plan that made the rows
    is cut off in the shared folder; the rows are far narrower than the texts by whose size they were dealt.
    With ``least_rows``, a table that has less than that per core lies in fewer partitions.
    """
    made = rows.persist()
    short = checkpointed(made)
    n_rows = short.count()
    made.unpersist()
    most = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // task_rows))
    if least_rows:
        most = min(most, max(1, n_rows // least_rows))
    return short.coalesce(most).persist()


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows (80/20 by the hash of the key, stable under any partitioning)."""
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


def boosted_trees(sizes: ModelSizes) -> GBTRegressor:
    return GBTRegressor(
        labelCol=LABEL, maxIter=sizes.boosting_rounds, stepSize=sizes.step, maxDepth=sizes.depth,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=sizes.seed,
    )


def random_forest(sizes: ModelSizes) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=LABEL, numTrees=sizes.forest_trees, seed=sizes.seed)


def linear(sizes: ModelSizes) -> LinearRegression:
    return LinearRegression(labelCol=LABEL, solver="normal", regParam=0.0)


LEARNERS = {"Linear": linear, "RandomForest": random_forest, "BoostedTrees": boosted_trees}


def assembled(columns: Sequence[str], learner: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), learner])


def with_prediction(model: PipelineModel, df: DataFrame, name: str = "ctr_score") -> DataFrame:
    """Add the predicted rate."""
    return model.transform(df).withColumn(name, predicted_rate(F.col("prediction"))).drop("features", "prediction")


def test_metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    """R2, RMSE and MAE on the original scale (unclipped back-transform, as published)."""
    predicted = model.transform(test).withColumn("_rate", F.expm1("prediction"))
    return regression_metrics(predicted, "ctr_proxy", "_rate")


class OriginalScaleR2(Evaluator):
    """R2 after transforming label and prediction back from the log scale."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rates = dataset.select(F.expm1(LABEL).alias("y"), F.expm1("prediction").alias("p"))
        return float(regression_metrics(rates, "y", "p").first()["r2"])

    def isLargerBetter(self) -> bool:
        return True


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], Result]], parallelism: int) -> list[Result]:
    """Results of the tasks in their order, ``parallelism`` of them run at a time.

    A boosted fit is some five short jobs a round, one after the other: one fit keeps few cores busy.
    """
    bound = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda task: task(), bound, chunksize=1)


def fold_rows(rows: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation rows of each fold; no part may be empty and no row outside the folds."""
    counts = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col("fold") == i) for i in range(folds)]).first()
    n_rows, sizes = counts[0], counts[1:]
    if n_rows != sum(sizes):
        raise ValueError(f"fold numbers must be in 0 .. {folds - 1}")
    for i, size in enumerate(sizes):
        if size in (0, n_rows):
            raise ValueError(f"the {'training' if size else 'validation'} rows of fold {i} are empty")
    return [(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)) for i in range(folds)]


def cross_validated(
    rows: DataFrame, specs: Mapping[tuple[str, str], Pipeline], evaluator: Evaluator, sizes: ModelSizes
) -> DataFrame:
    """Fold mean and population standard deviation of the metric per spec ``(subset, model)``.

    The fits of all specs and folds run side by side. None is fitted to all rows afterwards, as only metrics are asked for.
    """
    def metric(spec: Pipeline, judge: Evaluator, training: DataFrame, validation: DataFrame) -> float:
        return float(judge.evaluate(spec.fit(training).transform(validation)))

    # Copies, since a fit writes the parameters into the object that it shares with the JVM.
    tasks = [partial(metric, s.copy(), evaluator.copy(), *part) for part in fold_rows(rows, sizes.folds) for s in specs.values()]
    found = np.reshape(side_by_side(rows.sparkSession, tasks, sizes.parallelism), (sizes.folds, len(specs)))
    result = [
        (subset, model, i, float(mean), float(std))
        for i, ((subset, model), mean, std) in enumerate(zip(specs, found.mean(axis=0), found.std(axis=0)))
    ]
    return rows.sparkSession.createDataFrame(
        result, "subset string, model string, spec_ord int, cv_r2_mean double, cv_r2_std double"
    )


def cv_boosted_subsets(rows: DataFrame, subsets: Mapping[str, Sequence[str]], sizes: ModelSizes = ModelSizes()) -> DataFrame:
    """Cross-validated R2 of boosted trees on the original scale, for each subset of the columns."""
    specs = {(subset, "BoostedTrees"): assembled(columns, boosted_trees(sizes)) for subset, columns in subsets.items()}
    return cross_validated(rows, specs, OriginalScaleR2(), sizes)


def cv_boosted(rows: DataFrame, columns: Sequence[str], subset: str, sizes: ModelSizes = ModelSizes()) -> DataFrame:
    """The same for one set of columns."""
    return cv_boosted_subsets(rows, {subset: columns}, sizes)


def ablation(rows: DataFrame, sizes: ModelSizes = ModelSizes()) -> DataFrame:
    """Cross-validated R2 (log scale) of every feature subset with every learner."""
    specs = {
        (subset, name): assembled(columns, make(sizes))
        for subset, columns in fixed.ABLATION_SUBSETS.items() for name, make in LEARNERS.items()
    }
    return cross_validated(rows, specs, RegressionEvaluator(labelCol=LABEL, metricName="r2"), sizes)


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Normalised importance per input column, in column order."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip(names, weights))]
    return spark.createDataFrame(rows, "feature_ord int, feature string, importance double")


def positive_importances(importances: DataFrame) -> DataFrame:
    """Features with an effect, in ascending order for the chart."""
    return importances.where(F.col("importance") > 0).orderBy("importance")


def top_importances(importances: DataFrame, n: int = 8) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature_ord").limit(n)


# --- stored models ------------------------------------------------------------------------------


def importance_rows(spark: SparkSession, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Importances of several models as rows ``(subset, feature_ord, feature, importance)``."""
    parts = [feature_importances(spark, fitted).select(F.lit(subset).alias("subset"), "*") for subset, fitted in models.items()]
    return union_all(parts).to(schemas.IMPORTANCES)


def model_path(root: str, kind: str, prefix: str = "") -> str:
    """Where a model of kind ``full`` or ``content`` lies; the prefix keeps demo models apart."""
    return f"{root}/{prefix}{kind}"


def save_model(model: PipelineModel, root: str, kind: str, prefix: str = "") -> None:
    model.write().overwrite().save(model_path(root, kind, prefix))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_scorer(spark: SparkSession, root: str, prefix: str = "") -> tuple[PipelineModel, list[str]]:
    """The content model, or the full model when there is none, with its columns."""
    for kind, columns in (("content", fixed.CONTENT_COLUMNS), ("full", fixed.FULL_COLUMNS)):
        if _exists(spark, model_path(root, kind, prefix)):
            return PipelineModel.load(model_path(root, kind, prefix)), columns
    raise FileNotFoundError(f"no model below {root}; train one first")


def predict_ctr(
    df: DataFrame, scorer: tuple[PipelineModel, list[str]], text: str = "text", name: str = "ctr_score",
) -> DataFrame:
    """Predicted rate of new texts; context that is unknown for a new text counts as 0."""
    model, columns = scorer
    kept = [F.col(c).alias(f"_kept_{c}") for c in df.columns if c != name]
    featured = with_text_features(df.select(*kept, F.col(text).alias("_input")), "_input")
    featured = with_affect(featured, "_input", words="word_count")
    context = {c: F.lit(0.0) for c in fixed.CONTEXT_COLUMNS if c in columns}
    featured = featured.withColumns(context) if context else featured
    ready = model_input(featured, columns, [c for c in featured.columns if c.startswith("_kept_")])
    scored = with_prediction(model, ready, name)
    return scored.select(*[F.col(f"_kept_{c}").alias(c) for c in df.columns if c != name], name)


def metric_rows(metrics: DataFrame, subset: str, model: str) -> DataFrame:
    """One-row metric columns as long rows ``(metric, subset, model, value)``."""
    names = metrics.columns
    long = metrics.unpivot([], [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    return long.select("metric", F.lit(subset).alias("subset"), F.lit(model).alias("model"), "value").to(schemas.METRICS)
