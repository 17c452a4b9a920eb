"""Quality rules with robust multivariate outliers.

Each text gives a vector of transformed statistics. Per language and source the centre and scatter of the clean bulk
are estimated by minimum covariance determinant, from four deterministic starts: medians with absolute deviations,
correlations of hyperbolic tangents, of spatial signs, and the moments of all rows. From each of them concentration
steps keep the share ``COVERED`` of rows nearest to the current estimate and estimate anew, until the determinant of the
scatter no longer falls; the estimate with the least determinant is the group's.

A step is one mergeable aggregate over all rows and starts: the moments of the rows are summed per group, start and bin
of the distance, and the bins nearest to the centre are added up until they hold the share, the last one in part.
Nothing but these sums (a bounded number of rows per group) reaches the task that inverts a scatter matrix. The floors of
the scatter are part of it in every step and in the determinant. Texts too far off by Mahalanobis distance are rejected.

Groups with fewer than ``min_group`` rows are pooled per language, and what is still too small over all languages;
a pool that stays too small rejects nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.llm.common import BLANKS, ROW, beside_row, utf8, with_mapped, written

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
COVERED = 0.75
STEPS = 50  # a bound only; a start ends when the logarithm of its determinant falls by less than ``FALL``
FALL = 1e-3
MIN_GROUP = 200
CUTOFF = 22.46  # squared distance; 0.999 of the chi-squared distribution with six degrees
#: Transformed statistics and the least standard deviation taken for each, as a scatter of bulk texts can be zero.
FLOORS = {"log_words": 0.5, "log_word_length": 0.08, "symbol_angle": 0.05, "duplicate_line_angle": 0.15, "repeat_angle": 0.15, "letter_angle": 0.08}
BINS = 256
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STATISTICS = BASE + ", stats array<double>"
_SYMBOLS = "#*$%&|<>"
_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows += codes[i:i + n] * _MULTIPLIERS[i % len(_MULTIPLIERS)]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple:
    """Base counts and the transformed vector (null where the text has no word)."""
    text = text or ""
    words = utf8(text).split()
    if not words:
        return 0, 0, 0, 0, 0, None
    n_words, word_chars = len(words), len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines, seen, n_dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            n_dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(words)
    letters = sum(map(len, _LETTERS.findall(text)))
    angle = lambda part, whole: float(np.arcsin(np.sqrt(min(1.0, part / whole))))
    vector = [
        float(np.log(n_words)), float(np.log(word_chars / n_words)), angle(n_symbols, word_chars), angle(n_dup, lines),
        angle(n_repeat, n_words), angle(letters, word_chars)]
    return n_words, word_chars, n_symbols, n_dup, n_repeat, vector


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return with_mapped(df, STATISTICS, lambda: statistics, [text], keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _pooled(rows: DataFrame, min_group: int) -> DataFrame:
    """Group of estimation of every (lang, source): (``lang``, ``source``, ``_group``)."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source"))
    by_lang = F.to_json(F.struct(F.lit(1).alias("level"), "lang"))
    first = sizes.withColumns({"_level": F.when(F.col("n") >= min_group, 2).otherwise(1), "_lang": by_lang, "_own": own})
    pools = first.where("_level = 1").groupBy("_lang").agg(F.sum("n").alias("_pool"))
    return first.join(pools, "_lang", "left").select(
        "lang", "source", F.when(F.col("_level") == 2, F.col("_own")).when(F.col("_pool") >= min_group, F.col("_lang"))
        .otherwise(F.lit("all")).alias("_group"))


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` has one row per (lang, source), nulls being values."""
    on = F.col("_r.lang").eqNullSafe(F.col("_t.lang")) & F.col("_r.source").eqNullSafe(F.col("_t.source"))
    return rows.alias("_r").join(table.alias("_t"), on, "left").select(
        "_r.*", *[f"_t.{c}" for c in table.columns if c not in ("lang", "source")])


def distance(stats: Column, centre: Column, precision: Column, n: int) -> Column:
    """Squared Mahalanobis distance; ``precision`` is flat, row by row. Native."""
    off = [F.element_at(stats, i + 1) - F.element_at(centre, i + 1) for i in range(n)]
    terms = [off[i] * off[j] * F.element_at(precision, i * n + j + 1) * (1.0 if i == j else 2.0) for i in range(n) for j in range(i, n)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


ESTIMATE = "_group string, start int, centre array<double>, precision array<double>, group_size long, log_det double, active boolean"


def _moments(vector: Column, p: int) -> dict[str, Column]:
    """Count, sums and sums of products of the parts of ``vector``; native and mergeable."""
    part = [F.get(vector, F.lit(i)) for i in range(p)]
    sums = {"n": F.count(F.lit(1))} | {f"s{i}": F.sum(part[i]) for i in range(p)}
    return sums | {f"c{i}_{j}": F.sum(part[i] * part[j]) for i in range(p) for j in range(i, p)}


def _mean_and_scatter(sums: pd.DataFrame, weights: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    total = {name: float(weights @ sums[name].to_numpy(dtype=float)) for name in sums.columns if name[0] in "sc" and name[1].isdigit()}
    n = float(weights @ sums["n"].to_numpy(dtype=float))
    mean = np.array([total[f"s{i}"] for i in range(p)]) / n
    scatter = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            scatter[i, j] = scatter[j, i] = total[f"c{i}_{j}"] / n - mean[i] * mean[j]
    return mean, scatter


def _estimate(key: tuple, centre: np.ndarray, scatter: np.ndarray, size: int, log_det: float, active: bool) -> pd.DataFrame:
    return pd.DataFrame({
        "_group": [key[0]], "start": [int(key[1])], "centre": [list(centre)], "precision": [list(np.linalg.inv(scatter).ravel())],
        "group_size": [size], "log_det": [log_det], "active": [active]})


def _begun(floors: Sequence[float]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Start estimate from the moments of one transform of the scaled vectors: one row."""

    def run(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        p = len(floors)
        middle, spread = (np.array(sums[c].iloc[0], dtype=float) for c in ("middle", "spread"))
        mean, shape = _mean_and_scatter(sums, np.ones(1), p)
        if key[1] == ALL_ROWS:
            middle = middle + mean * spread
        else:
            width = np.sqrt(np.maximum(np.diag(shape), 1e-12))
            shape = shape / np.outer(width, width)
            np.fill_diagonal(shape, 1.0)
        if key[1] == MEDIANS:
            shape = np.eye(p)
        scatter = shape * np.outer(spread, spread) + np.diag(np.square(floors))
        return _estimate(key, middle, scatter, int(sums["n"].iloc[0]), float("inf"), True)

    return run


def _concentrated(covered: float, floors: Sequence[float], fall: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One concentration step from the binned moments of one group and start: at most ``BINS`` rows.

    The share is held exactly: the last bin counts in part. A determinant that has not fallen leaves the estimate before.
    """
    p = len(floors)
    scale = _consistency(covered, p)

    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("_bin")
        counts = bins["n"].to_numpy(dtype=float)
        size = int(counts.sum())
        reached = np.cumsum(counts) - counts
        weights = np.clip((covered * size - reached) / counts, 0.0, 1.0)
        mean, scatter = _mean_and_scatter(bins, weights, p)
        # The nearest share of a normal cloud has too small a spread: scale so that its farthest distance fits.
        scatter = scatter * scale + np.diag(np.square(floors))
        log_det, before = float(np.linalg.slogdet(scatter)[1]), float(bins["log_det"].iloc[0])
        origin = np.array(bins["centre"].iloc[0], dtype=float)
        if log_det < before:
            return _estimate(key, origin + mean, scatter, size, log_det, before - log_det >= fall)
        earlier = np.linalg.inv(np.array(bins["precision"].iloc[0], dtype=float).reshape(p, p))
        return _estimate(key, origin, earlier, size, before, False)

    return run


def _consistency(share: float, p: int) -> float:
    """Factor that makes the scatter of the nearest ``share`` of a p-variate normal cloud unbiased."""
    x = np.linspace(1e-6, 20.0 + 10.0 * p, 20_000)

    def cumulated(k: float) -> np.ndarray:
        log_density = (k / 2 - 1) * np.log(x) - x / 2
        density = np.exp(log_density - log_density.max())
        return np.cumsum(density) / density.sum()

    quantile = x[np.searchsorted(cumulated(p), share)]
    return float(share / cumulated(p + 2)[np.searchsorted(x, quantile)])


MEDIANS, TANGENTS, SIGNS, ALL_ROWS = range(4)


def _starts(grouped: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Four estimates per group, from the moments of transforms of the vectors scaled by medians and absolute deviations."""
    p = len(floors)
    part = lambda i: F.get("stats", F.lit(i))
    middle = written(grouped.groupBy("_group").agg(
        F.array(*[F.percentile_approx(part(i), 0.5, 1000) for i in range(p)]).alias("middle")), "quality-middle")
    off = [part(i) - F.get("middle", F.lit(i)) for i in range(p)]
    spread = written(grouped.join(middle, "_group").groupBy("_group").agg(
        F.first("middle").alias("middle"),
        F.array(*[F.sqrt(F.pow(F.percentile_approx(F.abs(off[i]), 0.5, 1000) * 1.4826, 2) + floors[i] ** 2) for i in range(p)]).alias("spread")),
        "quality-spread")
    scaled = grouped.join(spread, "_group").select("_group", F.array(*[off[i] / F.get("spread", F.lit(i)) for i in range(p)]).alias("z"))
    z = [F.get("z", F.lit(i)) for i in range(p)]
    length = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    transforms = {
        MEDIANS: F.col("z"), TANGENTS: F.array(*[F.tanh(x) for x in z]),
        SIGNS: F.array(*[F.when(length > 0, x / length).otherwise(0.0) for x in z]), ALL_ROWS: F.col("z")}
    each = scaled.select("_group", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), v.alias("v")) for k, v in transforms.items()])).alias("t"))
    sums = each.groupBy("_group", F.col("t.start").alias("start")).agg(*[c.alias(name) for name, c in _moments(F.col("t.v"), p).items()])
    return sums.join(spread, "_group").groupBy("_group", "start").applyInPandas(_begun(floors), ESTIMATE)


def estimates(
    rows: DataFrame, floors: dict[str, float] = FLOORS, min_group: int = MIN_GROUP, covered: float = COVERED, steps: int = STEPS,
    fall: float = FALL,
) -> DataFrame:
    """Per (lang, source): ``centre``, ``precision``, ``group_size`` and ``log_det`` of its estimation group.

    ``rows`` (``lang``, ``source``, ``stats``) should be a written table, as it is read once per step. Rows without
    statistics take no part; an empty table gives no estimates.
    """
    p, least = len(floors), list(floors.values())
    rows = rows.where("stats is not null")
    groups = written(_pooled(rows, min_group), "quality-groups")
    grouped = written(_joined(rows, groups).select("_group", "stats"), "quality-grouped")
    current = written(_starts(grouped, least), "quality-start")
    for step in range(steps):
        active = current.where("active").select("_group", "start", "centre", "precision", "log_det")
        if active.isEmpty():
            break
        squared = distance(F.col("stats"), F.col("centre"), F.col("precision"), p)
        bin_of = F.least(F.greatest(F.floor(F.log2(F.greatest(squared, F.lit(0.0)) + 1e-9) * 16) + 64, F.lit(0)), F.lit(BINS - 1)).cast("int")
        off = F.array(*[F.get("stats", F.lit(i)) - F.get("centre", F.lit(i)) for i in range(p)])
        near = grouped.join(active, "_group").select("_group", "start", bin_of.alias("_bin"), off.alias("off"))
        binned = near.groupBy("_group", "start", "_bin").agg(*[c.alias(name) for name, c in _moments(F.col("off"), p).items()])
        stepped = binned.join(active, ["_group", "start"]).groupBy("_group", "start").applyInPandas(_concentrated(covered, least, fall), ESTIMATE)
        current = written(current.where("not active").unionByName(stepped), f"quality-step{step}")
    best = current.groupBy("_group").agg(F.min(F.struct("log_det", "start", "centre", "precision", "group_size")).alias("best"))
    return groups.join(best.select("_group", "best.*"), "_group").select("lang", "source", "centre", "precision", "group_size", "log_det")


def _verdict(rows: DataFrame, fitted: DataFrame, min_group: int, cutoff: float) -> DataFrame:
    """Adds ``base_failed``, ``distance`` and ``kept``; ``rows`` has the statistics, ``lang`` and ``source``."""
    judged = _joined(rows, fitted)
    far = F.when(F.col("group_size") >= min_group, distance(F.col("stats"), F.col("centre"), F.col("precision"), len(FLOORS)))
    return judged.withColumns({"base_failed": base_failed(), "distance": far}).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))


def judged(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): base counts, ``distance``, ``kept``.

    Null and empty texts have no words and fail the base rules; null languages and sources are groups of their own;
    rows with equal or null ids are each judged; other columns are not read; an empty table gives no rows.
    """
    rows = written(with_statistics(docs, "text", ["doc_id", "lang", "source"]), "quality-statistics")
    fitted = written(estimates(rows.where(~base_failed()).select("lang", "source", "stats"), min_group=min_group), "quality-estimates")
    return _verdict(rows, fitted, min_group, cutoff).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 4).alias("distance"))


def without_rejected(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged. Other columns may have any name.

    The estimates come from all rows; each row is then judged in the scan that returns it, so no text is shuffled.
    """
    beside = beside_row(docs, text="text", lang="lang", source="source")
    rows = written(with_statistics(beside.select("text", "lang", "source"), "text", ["lang", "source"]).where(~base_failed()).select(
        "lang", "source", "stats"), "quality-statistics")
    fitted = written(estimates(rows, min_group=min_group), "quality-estimates")
    measured = with_statistics(beside, "text", [ROW, "lang", "source"])
    return _verdict(measured, fitted, min_group, cutoff).where("kept").select(f"{ROW}.*")


def rows_per_reason(judgements: DataFrame) -> DataFrame:
    """How many rows fail the base rules, lie too far off, or stay."""
    reason = F.when(F.col("base_failed"), "base").when(~F.col("kept"), "outlier").otherwise("kept")
    return judgements.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))

