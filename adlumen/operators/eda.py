"""Descriptive statistics of cleaned, featurised posts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from adlumen.functions.fixed_values import CORRELATION_COLUMNS
from adlumen.operators.moments import correlations
from adlumen.operators.quantile import exact_quantile


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per listed column."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in columns], name, value)


def ctr_by_feature(
    df: DataFrame, features: Sequence[str] = ("has_question", "has_urgency"), target: str = "ctr_proxy"
) -> DataFrame:
    """Mean target and row count for value 0 and 1 of each feature; an empty side gives mean 0.

    All conditional means are taken in one aggregate row, which is then turned into rows.
    """
    parts = []
    for feature in features:
        for value in (0, 1):
            match = F.col(feature) == value
            parts += [
                F.coalesce(F.avg(F.when(match, F.col(target))), F.lit(0.0)).alias(f"{feature}_{value}_mean"),
                F.count_if(match).alias(f"{feature}_{value}_n"),
            ]
    cells = F.array(*[
        F.struct(
            F.lit(feature).alias("feature"), F.lit(value).alias("value"),
            F.col(f"{feature}_{value}_mean").alias("mean_ctr"), F.col(f"{feature}_{value}_n").alias("n"),
        )
        for feature in features for value in (0, 1)
    ])
    return df.agg(*parts).select(F.inline(cells))


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ols_trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """The fitted line at evenly spaced points between the smallest and largest x."""
    fit = df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"),
    )
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("low") + F.col("step") * ((F.col("high") - F.col("low")) / F.lit(float(points - 1)))
    return steps.withColumn("x", at).select("step", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))


def corr_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are known; a constant column gives null.

    One buffer of centred moments per task holds all pairs, see :mod:`adlumen.operators.moments`.
    """
    listed = list(columns)
    return correlations(df.select(*[F.col(c).cast("double").alias(c) for c in listed]), listed)


def summary_stats(df: DataFrame, target: str = "ctr_proxy") -> DataFrame:
    """Row count, mean and median target, mean word count."""
    median = exact_quantile(df, target, 0.5).scalar()
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_ctr"), F.avg("word_count").alias("mean_words"))
    return totals.withColumn("median_ctr", median)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)
