"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import released, written


def _with_least(sides: DataFrame) -> DataFrame:
    """``a``, ``b`` and the least neighbour of ``a`` (or ``a`` itself).

    The least neighbours are written first: joined from a plain exchange, the links of a frequent node can be split.
    """
    least = written(sides.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m")), "links-least")
    return sides.join(least, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = _with_least(down)
    return met.select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l")).select(
        "l.a", "l.b").where("a <> b").distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (``a``, ``b``); the root is the least node of its component.

    Each round is written to the shared folder; the rounds end when the table no longer changes.
    """
    current, before = written(links.where("a <> b").distinct(), f"{label}-0"), None
    round_ = 0
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if state == before or state[0] == 0:
            break
        before, round_, last = state, round_ + 1, current
        current = written(_small_star(_large_star(current)), f"{label}-{round_}")
        released(last)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
