"""Report jobs: exploratory statistics and the brand reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.operators import brand, eda, evaluate
from adlumen.plans.training import featured_posts


def eda_report(posts: DataFrame, languages=("en",)) -> dict[str, DataFrame]:
    """Feature means, trend, trend line, correlations and summary of cleaned posts."""
    rows = featured_posts(posts, languages).select(*fixed.CORRELATION_COLUMNS, "has_urgency").persist()
    return {
        "ctr_by_feature": eda.ctr_by_feature(rows),
        "ols_trend": eda.ols_trend(rows, "word_count", "ctr_proxy"),
        "ols_trend_line": eda.ols_trend_line(rows, "word_count", "ctr_proxy"),
        "corr_matrix": eda.corr_matrix(rows),
        "summary_stats": eda.summary_stats(rows),
    }


def brand_proof_report(texts: DataFrame, refs: DataFrame, brands: Sequence[str], keep: Sequence[str], **calibration) -> DataFrame:
    """Proof table with one rounded score column per brand."""
    proof = brand.brand_proof(brand.with_all_scores(texts, refs, **calibration))
    return proof.select(
        *keep, *brand.pivoted(brands, digits=2),
        brand.round_binary(F.col("own_score"), 2).alias("own_score"),
        brand.round_binary(F.col("max_cross_score"), 2).alias("max_cross_score"),
        "own_higher_than_cross",
    )


def human_eval_report(rows: DataFrame) -> DataFrame:
    """Metrics of rows from :func:`evaluate.human_eval_rows` plus ``human_label``, with the AUC."""
    outcome = evaluate.with_outcome(evaluate.with_truth(rows))
    auc = evaluate.roc_auc(outcome, "own_score", "is_correct")
    return evaluate.human_eval_metrics(outcome).withColumn("auc", auc.scalar())
