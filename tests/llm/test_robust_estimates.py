"""Minimum covariance determinant against plain concentration from many random starts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlumen.llm import quality

FLOORS = {"a": 0.05, "b": 0.05, "c": 0.05}


def brute(points, floors, covered=quality.COVERED, starts=300, seed=1):
    """Least log determinant, centre and scatter over random starts, each concentrated until nothing changes."""
    rng, (n, p) = np.random.default_rng(seed), points.shape
    h, scale, ridge = int(round(covered * n)), quality._consistency(covered, p), np.diag(np.square(floors))
    best = (np.inf, None, None)
    for _ in range(starts):
        chosen, last = rng.choice(n, p + 1, replace=False), np.inf
        while True:
            centre = points[chosen].mean(0)
            scatter = np.cov(points[chosen].T, bias=True) * scale + ridge
            log_det = np.linalg.slogdet(scatter)[1] if len(chosen) == h else np.inf
            if len(chosen) == h and log_det >= last - 1e-12:
                break
            last = log_det
            off = points - centre
            chosen = np.argsort(np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off), kind="stable")[:h]
        if last < best[0]:
            best = (last, centre, scatter)
    return best


def clouds(name, rng):
    bulk = rng.multivariate_normal([1, 2, 3], [[1, 0.9, 0], [0.9, 1, 0], [0, 0, 0.3]], 400)
    if name == "correlated":
        return bulk
    if name == "far":
        return np.vstack([bulk, rng.normal([30, -20, 5], 0.1, (90, 3))])
    return np.vstack([bulk, rng.multivariate_normal([1, 2, 3], np.diag([4, 4, 4]), 100), np.repeat([[3.0, 0.0, 3.0]], 20, 0)])


@pytest.mark.parametrize("name", ["correlated", "far", "mixed"])
def test_least_determinant(spark, name):
    points = clouds(name, np.random.default_rng(3))
    rows = spark.createDataFrame([("en", None, [float(x) for x in row]) for row in points], "lang string, source string, stats array<double>")
    got = quality.estimates(rows, FLOORS, min_group=50).collect()
    assert len(got) == 1 and got[0].group_size == len(points)
    log_det, centre, scatter = brute(points, list(FLOORS.values()))
    assert got[0].log_det <= log_det + 0.05
    assert np.allclose(got[0].centre, centre, atol=0.15)
    off = points - centre
    expected = np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off)
    off = points - np.array(got[0].centre)
    found = np.einsum("ni,ij,nj->n", off, np.array(got[0].precision).reshape(3, 3), off)
    assert np.mean((expected > 16.27) == (found > 16.27)) > 0.99


def test_steps_end_when_the_determinant_stops_falling(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("en", "s", [float(x) for x in row]) for row in clouds("far", rng)], "lang string, source string, stats array<double>")
    until = [quality.estimates(rows, FLOORS, 50, steps=steps).first().log_det for steps in (1, 50, 80)]
    assert until[0] >= until[1] == pytest.approx(until[2], abs=1e-9)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["wing", "harbour", "o", "stone", "lantern", "quiet", "of", "cartography"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 300))) for _ in range(260)]
    texts += [" ".join(rng.choice(words) + "##" for _ in range(60)) for _ in range(25)] + [None, "", "short text"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs, min_group=100).collect()}
    measured = {i: quality.statistics(t) for i, t in enumerate(texts)}
    passed = [i for i, m in measured.items() if m[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    points = np.array([measured[i][5] for i in passed])
    _, centre, scatter = brute(points, list(quality.FLOORS.values()))
    off = points - centre
    squared = dict(zip(passed, np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off)))
    assert len(got) == len(texts)
    for i, row in got.items():
        assert row.base_failed == (i not in squared)
        if row.base_failed:
            assert not row.kept
        elif abs(squared[i] - quality.CUTOFF) > 0.1 * quality.CUTOFF:
            assert row.kept == (squared[i] <= quality.CUTOFF), (i, squared[i], row.distance)
    assert {i for i in got if 260 <= i < 285 and got[i].kept} == set()


def test_no_rows_and_rows_alike(spark):
    schema = "lang string, source string, stats array<double>"
    assert quality.estimates(spark.createDataFrame([], schema), FLOORS).count() == 0
    assert quality.estimates(spark.createDataFrame([("en", "s", None)], schema), FLOORS).count() == 0
    alike = quality.estimates(spark.createDataFrame([("en", "s", [1.0, 2.0, 3.0])] * 60, schema), FLOORS, 50).first()
    assert np.allclose(alike.centre, [1, 2, 3]) and np.allclose(np.array(alike.precision).reshape(3, 3), np.eye(3) * 400)
    parts = spark.createDataFrame([("en", "s", [float(i % 7), 1.0, float(i % 3)]) for i in range(120)], schema)
    assert quality.estimates(parts.union(parts).withColumn("extra", F.lit(1)), FLOORS, 50).first().group_size == 240
