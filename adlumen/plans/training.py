"""Training job: cleaned posts to stored models and a metrics table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.affect import with_affect
from adlumen.functions.text import with_text_features
from adlumen.operators import model as m
from adlumen.operators.clean import clean_posts
from adlumen.operators.eda import union_all
from adlumen.sources import files


@dataclass(frozen=True)
class TrainedModels:
    full: PipelineModel
    linear: PipelineModel
    content: PipelineModel
    metrics: DataFrame


def with_post_id(posts: DataFrame) -> DataFrame:
    """Posts with ``post_id``; where it is missing, a hash of the row.

    Equal rows get equal ids, so that they fall on the same side of the split and into the same fold.
    """
    if "post_id" in posts.columns:
        return posts
    row = [part for c in posts.columns for part in (F.col(c), F.col(c).isNull())]
    return posts.withColumn("post_id", F.xxhash64(*row))


def featured_posts(posts: DataFrame, languages=("en",), affect_source: str = "column") -> DataFrame:
    """Cleaned posts with features; ``affect_source="text"`` recomputes sentiment and toxicity from the
    text, as is done for new texts, instead of keeping the columns that came with the posts."""
    featured = with_text_features(clean_posts(with_post_id(posts), languages))
    return with_affect(featured, words="word_count") if affect_source == "text" else featured


def train(
    posts: DataFrame, sizes: m.ModelSizes = m.ModelSizes(), root: str | None = None, prefix: str = "",
    languages=("en",), affect_source: str = "column", cross_validate: bool = True,
) -> TrainedModels:
    """Fit the full, linear and content models and evaluate them.

    With ``root``, the two models that score texts, the importances of their columns and the metrics are stored
    below it, and the metrics are those read back.
    """
    kept = m.kept_rows(m.training_rows(featured_posts(posts, languages, affect_source)))
    rows = kept.coalesce(max(1, kept.count() // m.LEAST_ROWS))
    training, test = m.split_rows(rows)
    specs = [
        m.assembled(fixed.FULL_COLUMNS, m.boosted_trees(sizes)),
        m.assembled(fixed.FULL_COLUMNS, m.linear(sizes)),
        m.assembled(fixed.CONTENT_COLUMNS, m.boosted_trees(sizes)),
    ]
    full, linear, content = m.side_by_side(posts.sparkSession, [partial(s.fit, training) for s in specs], sizes.parallelism)
    if root is not None:
        m.save_model(full, root, "full", prefix)
        m.save_model(content, root, "content", prefix)
    parts = [
        m.metric_rows(rows.agg(F.count(F.lit(1)).alias("n_rows")), "all", "data"),
        m.metric_rows(m.test_metrics(full, test), "full", "BoostedTrees"),
        m.metric_rows(m.test_metrics(linear, test), "full", "Linear"),
        m.metric_rows(m.test_metrics(content, test), "content", "BoostedTrees"),
    ]
    if cross_validate:
        cv = m.cv_boosted_subsets(training, {"full": fixed.FULL_COLUMNS, "content": fixed.CONTENT_COLUMNS}, sizes)
        for subset in ("full", "content"):
            scores = cv.where(F.col("subset") == subset).select("cv_r2_mean", "cv_r2_std")
            parts.append(m.metric_rows(scores, subset, "BoostedTrees"))
    metrics = union_all(parts)
    if root is not None:
        spark = posts.sparkSession
        files.write_importances(m.importance_rows(spark, {"full": full, "content": content}), m.model_path(root, "importances", prefix))
        files.write_metrics(metrics, m.model_path(root, "metrics", prefix))
        metrics = files.read_metrics(spark, m.model_path(root, "metrics", prefix))
        kept.unpersist()
    return TrainedModels(full, linear, content, metrics)
