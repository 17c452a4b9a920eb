"""Composite scores and ranking of the variants of a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.rounding import round_binary
from adlumen.functions.scoring import blended, clamp, ctr_benchmark
from adlumen.operators.prefix import with_sums_before
from adlumen.operators.quantile import exact_quantile


def with_composite(
    df: DataFrame, ctr_weight: float = fixed.CTR_WEIGHT, given_ctr: str | None = None, given_brand: str | None = None
) -> DataFrame:
    """Unrounded blend of the benchmark and the brand score; given scores override the computed ones."""
    ctr = F.coalesce(F.col(given_ctr), F.col("ctr_score")) if given_ctr else F.col("ctr_score")
    brand = F.coalesce(F.col(given_brand), F.col("brand_score")) if given_brand else F.col("brand_score")
    scored = df.withColumns({"ctr_score": ctr.cast("double"), "brand_score": brand.cast("double")})
    scored = scored.withColumns({
        "ctr_normalized": ctr_benchmark(F.col("ctr_score")),
        "brand_normalized": clamp(F.col("brand_score"), 0.0, 100.0),
    })
    return scored.withColumn("composite_score", blended(F.col("ctr_normalized"), F.col("brand_normalized"), ctr_weight))


def score_batch(df: DataFrame, ctr_weight: float = fixed.CTR_WEIGHT) -> DataFrame:
    """Scores as shown to users: both parts rounded to one decimal first, then blended and rounded."""
    defaults = {
        "style": F.coalesce(F.col("style"), F.lit("unknown")) if "style" in df.columns else F.lit("unknown"),
        "needs_human_review": F.coalesce(F.col("needs_human_review"), F.lit(False))
        if "needs_human_review" in df.columns else F.lit(False),
    }
    scored = with_composite(df, ctr_weight).drop("composite_score").withColumns(defaults)
    shown = scored.withColumns({
        "ctr_benchmark": round_binary(F.col("ctr_normalized"), 1),
        "brand_scaled": round_binary(F.col("brand_score"), 1),
    })
    shown = shown.withColumns({
        "ctr_scaled": F.col("ctr_benchmark"),
        "_blend": blended(F.col("ctr_benchmark"), F.col("brand_scaled"), ctr_weight),
    })
    return shown.withColumn("composite_score", round_binary(F.col("_blend"), 1)).drop("_blend")


def ranked(
    df: DataFrame, group: str = "request_id", score: str = "composite_score", ordinal: str = "variant_ord", name: str = "rank",
) -> DataFrame:
    """Rank by descending score, ties in ordinal order, without putting a whole group into one task.

    Rows without a score come last; rows without a group are a group. A group of any size and with any scores is cut into
    ranges of rows, and each range starts at the number of the group's rows before it.
    """
    keyed = df.withColumn("_score", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    before = with_sums_before(keyed, {"_before": F.lit(1).cast("long")}, [F.col("_score").desc(), F.col(ordinal).asc()], [group])
    return before.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + 1).cast("int").alias(name))


def rank_variants(df: DataFrame, ctr_weight: float = fixed.CTR_WEIGHT) -> DataFrame:
    """``score_batch`` plus the rank within the request."""
    return ranked(score_batch(df, ctr_weight))


def soft_scaled(
    df: DataFrame, value: str, group: str = "request_id", floor: float = 10.0, ceiling: float = 95.0,
    name: str = "soft_score",
) -> DataFrame:
    """Values of a group spread over a range that is tighter for small groups; equal values get its middle."""
    bounds = df.groupBy(group).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(value).alias("_n"))
    low = F.when(F.col("_n") <= 2, F.lit(20.0)).when(F.col("_n") <= 3, F.lit(15.0)).otherwise(F.lit(float(floor)))
    high = F.when(F.col("_n") <= 2, F.lit(85.0)).when(F.col("_n") <= 3, F.lit(90.0)).otherwise(F.lit(float(ceiling)))
    width = F.col("_max") - F.col("_min")
    scaled = F.when(width < 1e-9, F.lit((floor + ceiling) / 2)).otherwise(
        low + (F.col(value) - F.col("_min")) / width * (high - low)
    )
    # One bounds row per group: a frequent group is split by the adaptive skew join, nothing is sorted.
    return df.join(bounds, group).withColumn(name, scaled).select(*df.columns, name)


def request_median(df: DataFrame, value: str = "ctr_score", group: str = "request_id") -> DataFrame:
    """Median per request; a request without values gets 0."""
    medians = exact_quantile(df, value, 0.5, [group], "ctr_median")
    return df.groupBy(group).agg(F.count(value).alias("n")).join(medians, group, "left").select(
        group, F.coalesce("ctr_median", F.lit(0.0)).alias("ctr_median"), "n"
    )


def with_request_median(df: DataFrame, value: str = "ctr_score", group: str = "request_id") -> DataFrame:
    """Add ``ctr_median`` of the row's request."""
    return df.join(exact_quantile(df, value, 0.5, [group], "ctr_median"), group, "left").withColumn(
        "ctr_median", F.coalesce("ctr_median", F.lit(0.0))
    )
