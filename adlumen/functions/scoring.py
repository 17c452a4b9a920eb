"""Score formulas as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from adlumen.functions import fixed_values as fixed


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    return (
        F.when(value < F.lit(float(low)), F.lit(float(low)))
        .when(value > F.lit(float(high)), F.lit(float(high)))
        .otherwise(value)
    )


def ctr_benchmark(
    ctr: Column,
    reference: float = fixed.BENCHMARK_REFERENCE,
    floor: float = fixed.BENCHMARK_FLOOR,
    ceiling: float = fixed.BENCHMARK_CEILING,
) -> Column:
    """Click rate on a 0-100 logarithmic scale."""
    positive = F.when(ctr > 0, ctr).when(ctr.isNotNull(), F.lit(0.0)).cast("double")
    return clamp(F.log1p(positive) / F.log1p(F.lit(float(reference))) * 100, floor, ceiling)


def calibrated_brand_score(
    similarity: Column,
    baseline: float = fixed.OFFBRAND_BASELINE,
    floor: float = fixed.BRAND_SCORE_FLOOR,
) -> Column:
    """Best cosine similarity as a 0-100 score, never below ``floor``."""
    scaled = (similarity.cast("double") - F.lit(float(baseline))) / F.lit(1.0 - baseline) * 100
    return clamp(clamp(scaled, 0.0, 100.0), floor, 100.0)


def blended(benchmark: Column, brand: Column, ctr_weight: float = fixed.CTR_WEIGHT) -> Column:
    return F.lit(float(ctr_weight)) * benchmark + F.lit(1 - ctr_weight) * brand


def length_penalty(char_count: Column) -> Column:
    """Zero inside the good length range, growing with the relative distance outside."""
    low, high = fixed.RULE_LENGTH_RANGE
    short = (F.lit(low) - char_count) / F.lit(low)
    long = (char_count - F.lit(high)) / F.lit(high)
    weight = F.lit(fixed.RULE_LENGTH_WEIGHT)
    return F.when(char_count < low, weight * short).when(char_count > high, weight * long).otherwise(0.0)


def rule_ctr(weights: Mapping[str, float] = fixed.RULE_WEIGHTS) -> Column:
    """Click rate (%) of the known rule, from the feature columns."""
    terms = [F.lit(float(w)) * F.col(name) for name, w in weights.items()]
    exponent = reduce(lambda a, b: a + b, terms, F.lit(fixed.RULE_INTERCEPT)) + length_penalty(F.col("char_count"))
    return clamp(F.exp(exponent), *fixed.RULE_CTR_RANGE)


def engagement_parts(ctr: Column, impressions: Column) -> dict[str, Column]:
    """Likes, shares and comments behind a click rate, after the lower limit on impressions."""
    shown = F.greatest(impressions, F.lit(fixed.MIN_IMPRESSIONS))
    total = ctr / F.lit(100.0) * shown
    parts = {name: F.rint(F.lit(share) * total).cast("bigint") for name, share in fixed.ENGAGEMENT_SHARES.items()}
    return {"impressions": shown.cast("bigint"), **parts}


def predicted_rate(log_prediction: Column) -> Column:
    """Prediction on the log scale back to a rate, never negative."""
    return F.greatest(F.lit(0.0), F.expm1(log_prediction))
