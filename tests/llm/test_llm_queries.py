"""Registered corpus queries against DuckDB, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
OURS = [n for n in QUERIES if n.startswith("op") and n[2].isdigit()]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OURS) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(set(OURS) & set(ORACLES)))
def test_query_equals_sql(spark, duck, name):
    df, cursor = QUERIES[name](spark, FOLDER), duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == sorted(df.columns)
    expected = sorted((tuple(row[found.index(c)] for c in df.columns) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == columns
        after = {r.doc_id: r.text for r in made.collect()}
        assert set(after) <= set(before) and (name == "line_dedup") == (after != {d: before[d] for d in after})
        docs, before = spark.createDataFrame(made.collect(), made.schema), after
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(before)
