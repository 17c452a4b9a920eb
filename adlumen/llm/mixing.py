"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words: the words of all sources are shared by weight, no target goes above
``cap`` times its source, and what such a source gives up is shared again. The level at which the shares stop is
found in closed form over the table of sources.

A source's weight changes with training time ``t`` in [0, 1] as ``1 + slope * (2t - 1)``. Integrated, its demand by
time ``t`` is ``target * (t + slope * (t^2 - t))``. The words of a source stand in a fixed hashed order; the time at
which demand reaches a document's first word is found by inverting the integral, and the demand of all sources at
that time is its position in training. A range sort by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.llm.common import word_count, written

WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3
ROWS_PER_BUCKET = 2_000
MADE = ["doc_id", "size", "source_size", "target", "taken", "source", "slope", "first_word", "all_targets", "all_bends", "position"]


def _cycled(values: Sequence[float], index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, cap: float = CAP) -> DataFrame:
    """One row per source: its number, size, weight, slope and target. ``sizes`` has ``source`` and ``size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_level = everything.orderBy(F.col("_full") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = totals.withColumn("source_no", F.row_number().over(by_name) - 1)
    numbered = numbered.withColumns({
        "weight": _cycled(weights, F.col("source_no"), "double"), "slope": _cycled(slopes, F.col("source_no"), "double"),
        "_full": F.col("source_size") * F.lit(float(cap)),
    })
    # Words shared in all = sum of min(full, level * weight), the lowest of the lines that take a prefix as full:
    # the level is the highest of their solutions.
    spent, taken = F.coalesce(F.sum("_full").over(by_level), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    line = (F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - taken)
    levelled = numbered.withColumn("_line", line).withColumn("_level", F.max("_line").over(everything))
    return levelled.withColumn("target", F.least(F.col("_full"), F.col("_level") * F.col("weight"))).select(
        "source", "source_no", "source_size", "weight", "slope", "target")


def _time(share: Column, slope: Column) -> Column:
    """Time at which ``share`` of a target is demanded: the root of slope t^2 + (1 - slope) t = share in [0, 1]."""
    b = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, share).otherwise(F.lit(2.0) * share / (b + root))


def _position(word: Column) -> Column:
    """Words demanded of all sources when the demand of a row's source reaches ``word``."""
    t = _time(word / F.col("target"), F.col("slope"))
    return F.col("all_targets") * t + F.col("all_bends") * (t * t - t)


def _numbered(sized: DataFrame, sources: DataFrame, n_buckets: int) -> DataFrame:
    """Rows with their source's numbers, their hash and the bucket of the hashed order; null ids come last, by size."""
    keyed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", *[f"s.{c}" for c in ("source_no", "source_size", "weight", "slope", "target")])
    keyed = keyed.withColumn("_hash", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("~")))
    prefix = F.coalesce(F.conv(F.substring("_hash", 1, 7), 16, 10).cast("double"), F.lit(0.0)) / F.lit(float(1 << 28))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(n_buckets) + F.col("size")).otherwise(F.floor(prefix * n_buckets))
    return keyed.withColumn("_bucket", bucket.cast("long"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, cap: float = CAP,
    rows_per_bucket: int = ROWS_PER_BUCKET, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``source``, ``text``) with what the mix takes of it, in training order.

    ``taken`` is whole passes over the source times the size, and in the last pass the words up to the target: the
    document on the boundary is cut there. ``position`` is the first training position, null when nothing is taken.
    ``carry`` names columns of ``docs`` to keep; an output name wins over theirs. A null text has size 0; a null
    source is a source of its own, last in order; rows with equal or null ids each count; no rows give no rows.

    Running sums use buckets of the hashed order, so that a source of any size is split over many tasks.
    """
    extra = [c for c in carry if c not in MADE]
    size = word_count(F.col("text")).alias("size")
    rows = written(docs.select("doc_id", "source", size), "mixing-sizes")
    n_buckets = max(1, -(-rows.count() // rows_per_bucket))
    sources = source_targets(rows, weights, slopes, cap)
    totals = _numbered(rows, sources, n_buckets).groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    sized = docs.select("doc_id", "source", size, *[F.col(c).alias(f"_carry_{c}") for c in extra]) if extra else rows
    keyed = _numbered(sized, sources, n_buckets)
    running = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("source_no", "_bucket", (F.sum("_sum").over(running) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(starts, ["source_no", "_bucket"]).withColumn(
        "_before", F.col("_start") + F.sum("size").over(inside) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    placed = placed.withColumn("passes", passes).withColumn("taken", F.col("passes") * F.col("size") + last)
    whole = sources.agg(
        F.sum("target").alias("all_targets"), F.sum(F.col("target") * F.col("slope")).alias("all_bends"))
    timed = placed.crossJoin(F.broadcast(whole)).withColumn("first_word", F.col("_before"))  # one row
    return timed.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("first_word")))).select(
        *MADE, *[F.col(f"_carry_{c}").alias(c) for c in extra],
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mix: DataFrame) -> DataFrame:
    """One row per document and pass: how many words to take from its start, in training order."""
    turns = mix.where("taken > 0").withColumn("pass", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return turns.withColumns({
        "words": words, "position": _position(F.col("first_word") + F.col("pass") * F.col("source_size")),
    }).orderBy("position", "doc_id", "pass")
