"""Evaluation aggregates: brand prediction against labels, ROC-AUC, regression and fold metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions.hashing import hash_number
from adlumen.functions.statistics import pearson
from adlumen.functions.text import stripped
from adlumen.operators.brand import predicted_brand, score_of
from adlumen.operators.quantile import with_running_sums


def human_eval_rows(scored: DataFrame, text_id: str, source: str = "source_brand") -> DataFrame:
    """Prediction per text and whether it equals the source brand."""
    predicted = scored.withColumn("predicted_brand", predicted_brand())
    return predicted.withColumn("correct", F.col("predicted_brand") == F.col(source)).select(
        text_id, source, "scores", "predicted_brand", "correct"
    )


def uses_labels(df: DataFrame, label: str = "human_label") -> Column:
    """True in every row as soon as one label of the table is filled in (a scalar subquery)."""
    filled = F.bool_or(F.coalesce(stripped(F.col(label)) != "", F.lit(False)))
    return F.coalesce(df.agg(filled.alias("any_label")).scalar(), F.lit(False))


def with_truth(df: DataFrame, label: str = "human_label", source: str = "source_brand") -> DataFrame:
    """Add ``truth``: the label column if any label exists in the table, else the source brand."""
    chosen = F.when(uses_labels(df, label), F.col(label)).otherwise(F.col(source))
    return df.withColumn("truth", F.lower(stripped(chosen)))


def with_outcome(df: DataFrame) -> DataFrame:
    """Add ``own_score`` (score of the true brand) and ``is_correct``; both are null without a known truth."""
    judged = df.withColumn("own_score", score_of(F.col("truth")))
    right = (F.lower("predicted_brand") == F.col("truth")).cast("int")
    return judged.withColumn("is_correct", F.when(F.col("own_score").isNotNull(), right))


def human_eval_metrics(outcome: DataFrame) -> DataFrame:
    """Accuracy, correlation of score and correctness, and mean score of right and wrong predictions.

    ``n`` rows have a known truth and count; ``n_unjudged`` have none.
    """
    right = F.col("is_correct") == 1
    return outcome.agg(
        F.count("own_score").alias("n"),
        F.count_if(F.col("own_score").isNull()).alias("n_unjudged"),
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
        pearson(F.col("own_score"), F.col("is_correct")).alias("correlation"),
        F.avg(F.when(right, F.col("own_score"))).alias("mean_correct"),
        F.avg(F.when(~right, F.col("own_score"))).alias("mean_wrong"),
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null when only one class occurs.

    Rows are counted per distinct score before anything is ordered, and the order is built bucket by
    bucket, so no task sees all scores.
    """
    positive = F.col(label) == 1
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ordered = with_running_sums(counts, "score", ["pos", "neg"])
    # Products and sums of counts outgrow bigint at large sizes, so they are formed in double.
    won = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return ordered.agg(F.try_divide(F.sum(won), pairs).alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and MAE in one aggregate (per group with ``by``)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.regr_syy(y, y))).alias("r2"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def cv_scores(folds: DataFrame, value: str = "r2") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return folds.agg(F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"))


def univariate_cv(df: DataFrame, x: str, y: str, fold: str, folds: int = 5) -> DataFrame:
    """R2 per fold ``0 .. folds-1`` of a straight line fitted on the other folds.

    The line of a fold is fitted from centred moments: those of the table without the fold's share, so that no
    digits are lost to large sums. A fold without other rows or slope gets null.
    """
    df = df.where(F.col(fold).between(0, folds - 1))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    moments = {
        "n": F.regr_count(b, a).cast("double"), "mx": F.regr_avgx(b, a), "my": F.regr_avgy(b, a),
        "sxx": F.regr_sxx(b, a), "sxy": F.regr_sxy(b, a)}
    per_fold = df.groupBy(fold).agg(F.struct(*[m.alias(n) for n, m in moments.items()]).alias("f"))
    total = df.agg(F.struct(*[m.alias(n) for n, m in moments.items()]).alias("t")).scalar()

    def mean(name: str) -> Column:
        return F.try_divide(F.col("t.n") * F.col(f"t.{name}") - F.col("f.n") * F.col(f"f.{name}"), F.col("n"))

    rest = per_fold.withColumn("t", total).withColumn("n", F.col("t.n") - F.col("f.n")).withColumns({"mx": mean("mx"), "my": mean("my")})
    shift = F.try_divide(F.col("f.n") * F.col("n"), F.col("t.n")) * (F.col("mx") - F.col("f.mx"))
    sxx = F.col("t.sxx") - F.col("f.sxx") - shift * (F.col("mx") - F.col("f.mx"))
    sxy = F.col("t.sxy") - F.col("f.sxy") - shift * (F.col("my") - F.col("f.my"))
    lines = rest.withColumn("slope", F.try_divide(sxy, sxx)).select(
        fold, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
    # At most ``folds`` lines.
    fitted = df.join(F.broadcast(lines), fold).withColumn("_predicted", F.col("slope") * a + F.col("intercept"))
    return regression_metrics(fitted, y, "_predicted", [fold])


def best_row(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row with the highest value; the first in ``order`` wins a tie."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.max_by(row, F.struct(F.col(value), -F.col(order))).alias("_best")).select("_best.*")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded random order that does not depend on the partitioning."""
    return df.orderBy(hash_number(F.col(key), seed), key).limit(n)
