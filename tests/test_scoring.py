import random

import pytest
from pyspark.sql import functions as F

from adlumen.functions import errors, scoring
from adlumen.operators import rank
from adlumen.operators.rules import with_rule_check

VARIANT = "request_id long, variant_ord int, style string, ctr_score double, brand_score double"


def test_benchmark_values_and_limits(table):
    df = table([2.0, 18.0, 0.0, -5.0, 1000.0, None], "ctr double")
    got = [r[0] for r in df.select(F.round(scoring.ctr_benchmark(F.col("ctr")), 1)).collect()]
    assert got == [30.7, 82.2, 10.0, 10.0, 98.0, None]


def test_brand_calibration(table):
    df = table([1.0, 0.3, -0.2, 0.65, None], "s double")
    got = [r[0] for r in df.select(scoring.calibrated_brand_score(F.col("s"))).collect()]
    assert got[:3] == [100.0, 0.1, 0.1] and got[3] == pytest.approx(50.0) and got[4] is None


def test_batch_scores_are_rounded_before_blending(table):
    df = table([(1, 0, "a", 2.0, 80.0), (1, 1, "b", 18.0, 20.0)], VARIANT)
    rows = rank.rank_variants(df).orderBy("rank").collect()
    assert [(r.style, r.ctr_benchmark, r.composite_score) for r in rows] == [("b", 82.2, 57.3), ("a", 30.7, 50.4)]


def test_composite_example(table):
    df = table([(61.0, 74.5)], "b double, s double")
    assert df.select(F.round(scoring.blended(F.col("b"), F.col("s")), 1)).first()[0] == 66.4


def test_given_scores_override(table):
    df = table([(1, 0, "a", 1.0, 150.0)], VARIANT).withColumns({"g": F.lit(80.0), "h": F.lit(None).cast("double")})
    row = rank.with_composite(df, 0.9, "g", "h").first()
    assert (row.ctr_score, row.brand_score, row.brand_normalized) == (80.0, 150.0, 100.0)
    assert row.composite_score == pytest.approx(0.9 * 98.0 + 0.1 * 100.0)


def test_missing_style_and_review_get_defaults(table):
    row = rank.score_batch(table([(1, 0, 2.0, 80.0)], "request_id long, variant_ord int, ctr_score double, brand_score double")).first()
    assert (row["style"], row["needs_human_review"]) == ("unknown", False)


def test_soft_scale(table):
    rows = [(1, v) for v in (5.0, 5.0, 5.0)] + [(2, 1.0), (2, 3.0)] + [(3, 1.0), (3, 2.0), (3, 3.0)] + [(4, v) for v in (0.0, 1.0, 2.0, 4.0)]
    got = rank.soft_scaled(table(rows, "request_id int, v double"), "v").orderBy("request_id", "v").collect()
    assert [r.soft_score for r in got] == [52.5] * 3 + [20.0, 85.0] + [15.0, 52.5, 90.0] + [10.0, 31.25, 52.5, 95.0]


def test_ranks_do_not_depend_on_partitions_or_group_sizes(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else i // 4, i, round(rng.random() * 10, 1) if i % 50 else None) for i in range(3000)]
    expected = {}
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (-(r[2] if r[2] is not None else -1e9), r[1]))
        expected.update({r[1]: n for n, r in enumerate(members, 1)})
    df = spark.createDataFrame(rows, "request_id int, variant_ord int, composite_score double")
    for partitions in (1, 16):
        got = rank.ranked(df.repartition(partitions)).collect()
        assert {r.variant_ord: r["rank"] for r in got} == expected


def test_a_request_of_a_million_scores_is_ranked_by_all_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(
        F.lit(1).alias("request_id"), F.col("id").alias("variant_ord"), F.pmod(F.xxhash64("id"), F.lit(1 << 50)).cast("double").alias("composite_score"))
    parts, coalesce = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rank.ranked(df)
        per_task = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(per_task) == n and max(per_task) < n / 4
        sums = got.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
        assert tuple(sums) == (1, n, n)
        top = {r["rank"]: r.variant_ord for r in got.where("rank <= 5").collect()}
        best = df.orderBy(F.desc("composite_score"), "variant_ord").limit(5).collect()
        assert top == {i: r.variant_ord for i, r in enumerate(best, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_rule_check(table):
    schema = "text string, preferred_vocabulary array<string>, forbidden_vocabulary array<string>"
    rows = [
        ("Great phone with seamless ecosystem", ["unfold", "seamless"], []),
        ("Maybe you should try to run?", [], ["maybe", "try to", "perhaps"]),
        ("Nothing here", ["Here"], None),
    ]
    got = with_rule_check(table(rows, schema)).collect()
    assert (got[0].passed, got[0].rule_penalty) == (True, 0)
    assert (got[1].violations, got[1].rule_penalty) == (["Contains forbidden language: maybe, try to"], 5)
    assert got[2].violations == ["Missing preferred vocabulary: Here"]  # vocabulary is matched as written


def test_rule_rate_and_length_penalty(table):
    names = list(scoring.fixed.RULE_WEIGHTS)
    df = table([(30, *[0.0] * len(names)), (100, *[0.0] * len(names)), (300, *[0.0] * len(names)), (100, 50.0, *[0.0] * (len(names) - 1))],
               "char_count int, " + ", ".join(f"{n} double" for n in names))
    import math

    got = [r[0] for r in df.select(scoring.rule_ctr()).collect()]
    assert got == pytest.approx([math.exp(1.6 - 0.275), math.exp(1.6), math.exp(1.6 - 0.55), 60.0])


def test_error_classes(table):
    messages = [
        "429 RESOURCE_EXHAUSTED, daily limit reached", "INVALID_ARGUMENT: API key not valid", "503 Unavailable: server overloaded",
        "model 404", "429 Too Many Requests", "rate limit exceeded", "invalid api key", "failed to generate", "500 internal"]
    df = table(messages, "m string")
    m = F.col("m")
    got = df.select(errors.error_class(m).alias("c"), errors.error_text(m).alias("t"), errors.is_transient(m).alias("r")).collect()
    assert [r.c for r in got] == ["quota", "key", "service", "not_found", "quota", "other", "key", "other", "other"]
    assert "kota" in got[0].t and "anahtar" in got[1].t and "kullanılamıyor" in got[2].t and got[5].t == messages[5]
    assert [r.r for r in got] == [True, False, True, False, True, True, False, True, True]


def test_waits(table):
    assert [r[0] for r in table([0, 1, 2], "a int").select(errors.wait_seconds(F.col("a"))).collect()] == [2, 4, 8]
