"""Exact order statistics without bringing a column, a group or a bucket of values to one task.

``percentile`` and ``median`` keep every distinct value of a group in the memory of one task. Here the values are counted
per distinct value, dealt by their hash, and the wanted ranks are found by radix selection on the bits of the double:
values are counted by their first bits, the value of these bits that holds the rank is kept, its values are counted by
the next bits, until all 64 bits are known. A round orders at most 2^22 counts per group, however many values there are
and however close they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.operators.prefix import with_sums_before
from adlumen.session import checkpointed

DIGITS = (22, 21, 21)
_MANTISSA = 52


def ordered_bits(value: Column) -> Column:
    """The 64 bits of a double as a long of the same order: equal values have equal bits; native, never null.

    The exponent comes from the logarithm, which may be one off beside a power of two, and is mended by comparing with
    the powers of two; scaling by these is exact. Below 2^-1022 the steps of the doubles are all 2^-1074.
    """
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = guess + F.when(size < power(guess), -1).when((guess < 1023) & (size >= power(guess + 1)), 1).otherwise(0)
    fraction = ((size * power(-exponent) - 1.0) * 2.0 ** _MANTISSA).cast("long")
    small = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    bits = (
        F.when(size == 0, F.lit(0)).when(size < 2.0 ** -1022, small).when(size == float("inf"), F.lit(2047 << _MANTISSA))
        .otherwise((exponent + 1023).cast("long") * (1 << _MANTISSA) + fraction))
    return F.coalesce(F.when(value < 0, -bits).otherwise(bits), F.lit(0)).cast("long")


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, ``_value``, ``_n``, ``_bits``) of every distinct value; null and NaN values, and null groups, are left out."""
    value = F.col(column).cast("double")
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], value.isNotNull() & ~F.isnan(value))
    counts = df.where(present).groupBy(*by, value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_bits", ordered_bits(F.col("_value")))


def exact_quantile(df: DataFrame, column: str, q: float, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """Quantile ``q`` with linear interpolation per group (one row in all without ``by``); nulls and NaN ignored.

    The counts are checkpointed in the shared folder: each round reads them, and ``df`` is computed once.
    """
    counts = checkpointed(value_counts(df, column, by))
    low, high = F.floor("_position"), F.ceil("_position")
    wanted, known = counts.withColumns({"_bucket": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")}), 0
    for digit in DIGITS:
        known += digit
        position = F.first("_position") if "_position" in wanted.columns else F.lit(None).cast("double")
        buckets = wanted.groupBy(*by, "_bucket", F.shiftright("_bits", 64 - known).alias("_next")).agg(
            F.sum("_n").alias("_size"), F.max("_value").alias("_value"), F.first("_before").alias("_before"), position.alias("_position"))
        # The counts of one bucket: 2^digit rows at most, whatever the number of values.
        of_bucket = Window.partitionBy(*by, "_bucket")
        smaller = F.sum("_size").over(of_bucket.orderBy("_next").rowsBetween(Window.unboundedPreceding, -1))
        placed = buckets.withColumns({
            "_first": F.col("_before") + F.coalesce(smaller, F.lit(0)),
            "_position": F.coalesce("_position", (F.sum("_size").over(of_bucket) - 1) * F.lit(float(q)))})
        held = placed.where((F.col("_first") <= high) & (F.col("_first") + F.col("_size") > low))
        if known < 64:
            chosen = held.select(*by, F.col("_next").alias("_bucket"), F.col("_first").alias("_before"), "_position")
            keyed = counts.withColumn("_bucket", F.shiftright("_bits", 64 - known))
            # Two buckets per group at most. Without groups that is a proven bound; else the planner chooses, and the
            # adaptive join splits a frequent bucket.
            wanted = keyed.join(chosen if by else F.broadcast(chosen), [*by, "_bucket"])
    # The last buckets are single values: the one at the rank below and the one at the rank above.
    picked = held.groupBy(*by).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.max("_position").alias("_position"))
    share = F.col("_position") - F.floor("_position")
    return picked.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias(name))


def approximate_quantile(df: DataFrame, column: str, q: float, accuracy: int = 10_000, name: str = "quantile") -> DataFrame:
    """One-pass quantile with bounded rank error, for when the exact value is not needed."""
    return df.agg(F.approx_percentile(column, F.lit(q), F.lit(accuracy)).alias(name))


def with_running_sums(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``<sum>_before`` for each column in ``sums``: its total over rows with a smaller ``value``.

    Expects one row per (``by``, ``value``); rows without a value or group are left out. Also adds ``<sum>_total`` per group.
    """
    present = df.dropna(subset=[value, *by])
    ordered = with_sums_before(present, {f"{s}_before": F.col(s) for s in sums}, [value], by)
    totals = ordered.groupBy(*by).agg(*[F.sum(s).alias(f"{s}_total") for s in sums])
    if by:
        return ordered.join(totals, list(by))
    row = totals.select(F.struct(*totals.columns)).scalar()
    return ordered.select(*ordered.columns, *[row.getField(c).alias(c) for c in totals.columns])
