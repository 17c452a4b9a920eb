"""Every registered query against its SQL counterpart."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from checks.views import TABLES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not (n[:2] == "op" and n[2].isdigit())))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted(([comparable(row[i]) for i in order] for row in cursor.fetchall()), key=repr)
    assert sorted(([comparable(row[c]) for c in columns] for row in df.collect()), key=repr) == expected


def test_queries_without_sql():
    """What has no counterpart is learned, hashed by the engine, or answered by a provider."""
    corpus = {n for n in QUERIES if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}
    assert set(QUERIES) - set(ORACLES) - corpus == {
        "generate_batch", "train_full_gbt", "train_linear", "train_content_gbt", "cv_gbt",
        "feature_importances", "importances_positive", "importances_top8", "ablation", "predict_ctr", "model_roundtrip",
        "train_report", "embed_text", "campaign_provider"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
