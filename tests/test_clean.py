import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlumen import schemas
from adlumen.operators import clean, eda, moments
from adlumen.operators.prefix import with_sums_before
from adlumen.operators.quantile import exact_quantile, ordered_bits, value_counts, with_running_sums


def post(i, lang="en", shown=100, likes=10, shares=5, comments=2, sentiment=0.5, toxicity=0.1):
    return (i, f"text {i}", lang, shown, likes, shares, comments, sentiment, toxicity, 0.0)


def test_rate(spark):
    df = spark.createDataFrame([post(1), post(2, shown=200, likes=20, shares=10, comments=4), post(3, shown=0)], schemas.POSTS)
    assert [r.ctr_proxy for r in clean.with_ctr_proxy(df).orderBy("post_id").collect()] == [17.0, 17.0, None]


def test_limit_is_taken_before_incomplete_rows_go(spark):
    rows = [post(i, likes=i, shares=0, comments=0) for i in range(100)] + [
        post(100, likes=10_000, sentiment=None), post(101, lang="tr"), post(102, lang=None), post(103, shown=0), post(104, shown=None)]
    df = spark.createDataFrame(rows, schemas.POSTS)
    rates = [float(i) for i in range(100)] + [10_007.0]
    limit = np.quantile(rates, 0.99)
    got = clean.clean_posts(df).orderBy("post_id").collect()
    assert len(got) == 100 and max(r.ctr_proxy for r in got) == pytest.approx(min(99.0, limit))
    funnel = clean.clean_funnel(df).first()
    assert (funnel.n_total, funnel.n_language, funnel.n_shown, funnel.n_final) == (105, 103, 101, 100)
    assert funnel.clip_value == pytest.approx(limit) and funnel.n_at_limit == sum(v >= limit for v in rates)
    everything = clean.clean_posts(df, languages=None)
    assert {r.post_id for r in everything.collect()} >= {101, 102}
    assert clean.trimmed(clean.shown_posts(df)).count() == sum(v <= limit for v in rates)


def test_no_rows(spark):
    df = spark.createDataFrame([], schemas.POSTS)
    assert clean.clean_posts(df).count() == 0
    assert clean.clean_funnel(df).first().n_total == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_equals_numpy(spark, q):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(0, 3, 999), "ties": rng.integers(-3, 4, 500).astype(float), "one": np.array([4.25]),
        "wide": np.concatenate([rng.lognormal(0, 8, 400), -rng.lognormal(0, 8, 401), [0.0, -0.0, 1e300, 5e-324]])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.quantile for r in exact_quantile(df, "v", q, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-300)
    alone = exact_quantile(df.where("g = 'normal'"), "v", q).collect()
    assert len(alone) == 1 and alone[0].quantile == got["normal"]


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    values = sorted({float(v) for v in rng.normal(0, 100, 300)} | {0.0, -1e-9})
    df = spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "v double, n long").repartition(5)
    got = {r.v: (r.n_before, r.n_total) for r in with_running_sums(df, "v", ["n"]).collect()}
    total = sum(range(1, len(values) + 1))
    assert got == {v: (sum(range(1, i + 1)), total) for i, v in enumerate(values)}


def test_bits_are_those_of_the_double(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308, float("inf"), 1.0, 3.0]
    values += [2.0 ** e * f for e in range(-1074, 1024) for f in (1.0, 1 + 2.0 ** -52)] + [2.0 ** e * (1 - 2.0 ** -53) for e in range(-1020, 1024)]
    values += [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(63)))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    rows = spark.createDataFrame([(s * v,) for v in values for s in (1, -1)], "v double")
    for r in rows.select("v", ordered_bits(F.col("v")).alias("bits")).collect():
        assert r.bits == struct.unpack(">q", struct.pack(">d", abs(r.v)))[0] * (-1 if r.v < 0 else 1), r.v


def rows_per_task(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_close_values_are_dealt_over_all_tasks(spark):
    """Ten million different values within 0.1 percent of each other: no task reads more than its share."""
    n = 10_000_000
    df = spark.range(n).select((1.0 + F.col("id") / F.lit(1e3 * n)).alias("v"), F.lit("hot").alias("g"))
    coalesce, parts = (spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = rows_per_task(value_counts(df, "v"))
        assert sum(tasks) == n and len(tasks) == 16 and max(tasks) < 1.2 * n / 16
        expected = 1.0 + 4_999_999.5 / (1e3 * n)
        assert exact_quantile(df, "v", 0.5).first().quantile == pytest.approx(expected, rel=1e-13)
        ordered = with_sums_before(df.where("v < 1.0001").withColumn("one", F.lit(1)), {"before": F.col("one")}, ["v"], ["g"])
        tasks = rows_per_task(ordered)
        assert sum(tasks) == n // 10 and len(tasks) >= 12 and max(tasks) < 2 * n / 10 / 16
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_running_sums_per_group(spark):
    rows = [(g, float(v), v + 1) for g, n in (("a", 500), ("b", 3), ("c", 1)) for v in range(n)] + [(None, 1.0, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    got = {(r.g, r.v): (r.n_before, r.n_total) for r in with_running_sums(df, "v", ["n"], ["g"]).collect()}
    assert got == {(g, float(v)): (v * (v + 1) // 2, n * (n + 1) // 2) for g, n in (("a", 500), ("b", 3), ("c", 1)) for v in range(n)}


def test_statistics(spark):
    rows = [(1, 0, 2, 1.0), (0, 0, 4, 2.0), (1, 0, 6, 6.0)]
    df = spark.createDataFrame(rows, "has_question int, has_urgency int, word_count int, ctr_proxy double")
    means = {(r.feature, r.value): (r.mean_ctr, r.n) for r in eda.ctr_by_feature(df).collect()}
    assert means == {("has_question", 0): (2.0, 1), ("has_question", 1): (3.5, 2), ("has_urgency", 0): (3.0, 3), ("has_urgency", 1): (0.0, 0)}
    slope, intercept = np.polyfit([2, 4, 6], [1, 2, 6], 1)
    trend = eda.ols_trend(df, "word_count", "ctr_proxy").first()
    assert (trend.slope, trend.intercept) == pytest.approx((slope, intercept))
    line = eda.ols_trend_line(df, "word_count", "ctr_proxy").orderBy("step").collect()
    assert len(line) == 100 and (line[0].x, line[-1].x) == (2.0, 6.0)
    matrix = {(r.col_a, r.col_b): r.r for r in eda.corr_matrix(df, ["has_urgency", "word_count", "ctr_proxy"]).collect()}
    assert matrix[("has_urgency", "word_count")] is None and matrix[("has_urgency", "has_urgency")] is None
    assert matrix[("word_count", "ctr_proxy")] == pytest.approx(np.corrcoef([2, 4, 6], [1, 2, 6])[0, 1])
    summary = eda.summary_stats(df).first()
    assert (summary.n, summary.mean_ctr, summary.median_ctr, summary.mean_words) == (3, 3.0, 2.0, 4.0)


def test_correlations_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=4000)
    rows = [(float(1e9 + x), float(-x + 0.5 * e), None if i % 3 else float(e), 0.1, None) for i, (x, e) in enumerate(zip(a, rng.normal(size=4000)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, none double").repartition(16)
    found = {(r.col_a, r.col_b): r.r for r in eda.corr_matrix(df, ["a", "b", "c", "same", "none"]).collect()}
    columns = [np.array([np.nan if r[i] is None else r[i] for r in rows]) for i in range(3)]
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            both = ~np.isnan(columns[i]) & ~np.isnan(columns[j])
            centred = [c[both] - np.float64(np.mean(c[both])) for c in (columns[i], columns[j])]
            assert found[x, y] == pytest.approx(np.corrcoef(*centred)[0, 1], abs=1e-9)
    assert all(found[x, y] is None for x in "abc" for y in ("same", "none")) and found["same", "same"] is None
    plan = moments.moments(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "corr(" not in plan
    empty = eda.corr_matrix(df.where("a is null"), ["a", "b"]).collect()
    assert [(r.col_a, r.col_b, r.r) for r in empty] == [("a", "a", None), ("a", "b", None), ("b", "a", None), ("b", "b", None)]
