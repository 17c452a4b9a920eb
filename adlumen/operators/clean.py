"""Cleaning of engagement posts: filters, engagement rate, outlier limits and the funnel report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.operators.quantile import approximate_quantile, exact_quantile

REQUIRED = ("sentiment_score", "toxicity_score")


def in_languages(languages: Sequence[str] | None) -> Column:
    """The wanted languages, null being none of them; ``None`` keeps every row.

    A plain comparison, so that it reaches the file scan.
    """
    return F.lit(True) if languages is None else F.col("language").isin(*languages)


def was_shown() -> Column:
    return F.col("impressions") > 0


def engagement_rate() -> Column:
    """Likes, shares and comments per impression, in percent."""
    reactions = F.col("likes_count") + F.col("shares_count") + F.col("comments_count")
    return F.try_divide(reactions.cast("double"), F.col("impressions").cast("double")) * 100


def with_ctr_proxy(df: DataFrame) -> DataFrame:
    return df.withColumn("ctr_proxy", engagement_rate())


def shown_posts(df: DataFrame, languages: Sequence[str] | None = ("en",)) -> DataFrame:
    """Posts in the wanted languages with impressions, plus ``ctr_proxy``."""
    return with_ctr_proxy(df.where(in_languages(languages)).where(was_shown()))


def cutoff(df: DataFrame, column: str = "ctr_proxy", q: float = 0.99, exact: bool = True) -> Column:
    """The quantile of ``column`` as a scalar subquery: evaluated once, known to every task."""
    one_row = exact_quantile(df, column, q) if exact else approximate_quantile(df, column, q)
    return one_row.scalar()


def winsorized(df: DataFrame, column: str = "ctr_proxy", q: float = 0.99, exact: bool = True) -> DataFrame:
    """Values above the quantile become the quantile."""
    limited = df.withColumn("_limit", cutoff(df, column, q, exact))
    value = F.when(F.col(column) > F.col("_limit"), F.col("_limit")).otherwise(F.col(column))
    return limited.withColumn(column, value).drop("_limit")


def trimmed(df: DataFrame, column: str = "ctr_proxy", q: float = 0.99, exact: bool = True) -> DataFrame:
    """Rows above the quantile are dropped."""
    return df.withColumn("_limit", cutoff(df, column, q, exact)).where(F.col(column) <= F.col("_limit")).drop("_limit")


def clean_posts(df: DataFrame, languages: Sequence[str] | None = ("en",), exact: bool = True) -> DataFrame:
    """Filters, rate and limit, then rows without the required scores go (the limit still counts them)."""
    return winsorized(shown_posts(df, languages), exact=exact).dropna(subset=list(REQUIRED))


def clean_funnel(df: DataFrame, languages: Sequence[str] | None = ("en",)) -> DataFrame:
    """Row counts after each cleaning step, the limit and the rows at it, as one row."""
    limit = cutoff(shown_posts(df, languages))
    steps = with_ctr_proxy(df).select(
        in_languages(languages).alias("language_ok"),
        (in_languages(languages) & was_shown()).alias("shown"),
        F.col("ctr_proxy"),
        F.concat(*[F.col(c).cast("string") for c in REQUIRED]).isNotNull().alias("complete"),
        limit.alias("limit"),
    )
    return steps.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("language_ok").alias("n_language"),
        F.count_if("shown").alias("n_shown"),
        F.max("limit").alias("clip_value"),
        F.count_if(F.col("shown") & (F.col("ctr_proxy") >= F.col("limit"))).alias("n_at_limit"),
        F.count_if(F.col("shown") & F.col("complete")).alias("n_final"),
    )


def with_log_columns(df: DataFrame) -> DataFrame:
    """``log_impressions`` and the log target ``log_ctr``."""
    return df.withColumns({
        "log_impressions": F.log1p(F.col("impressions").cast("double")),
        "log_ctr": F.log1p("ctr_proxy"),
    })
