"""Running sums in a total order without putting a group, or the whole table, into one task.

Rows are cut into ranges of (group, order) of about equal size, however the groups are distributed. Each range sums
its own groups; a group that goes on in the next ranges hands its sums over to them, so a range starts at most one group
with sums from before. Inside a range the order is a window over (range, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.session import checkpointed

RANGE = "_range"


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with the number of each row's range, ``_range``; ranges ascend in (``by``, ``order``).

    The cuts come from a sample of the rows, so the table is checkpointed in the shared folder: whatever reads it, also
    after a lost executor, sees the same ranges.
    """
    return checkpointed(df.repartitionByRange(*by, *order).withColumn(RANGE, F.spark_partition_id()))


def with_sums_before(df: DataFrame, sums: dict[str, Column], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """Add each sum of ``sums`` over the rows of the same ``by`` that come earlier in ``order``; nulls are a group.

    ``order`` has to be total, but for rows that are alike in all that matters.
    """
    placed = in_ranges(df, by, order)
    parts = placed.groupBy(RANGE, *by).agg(*[F.sum(c).alias(f"_{name}_part") for name, c in sums.items()])
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col(RANGE).alias("_of"), *[F.col(f"`{c}`").alias(f"_of_{i}") for i, c in enumerate(by)],
        F.count(F.lit(1)).over(earlier).alias("_n"), *[F.sum(f"_{name}_part").over(earlier).alias(f"_{name}_carried") for name in sums])
    # A range has one group at most that an earlier range has too: no more rows than ranges.
    carried = F.broadcast(carried.where("_n > 0").drop("_n"))
    same = F.col(RANGE) == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_of_{i}"))
    inside = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(carried, same, "left").select(*[F.col(f"`{c}`") for c in df.columns], *[
        (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"_{name}_carried", F.lit(0))).alias(name) for name, c in sums.items()])
