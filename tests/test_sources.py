import json

import pytest
from pyspark.sql import functions as F

from adlumen import schemas
from adlumen.operators import brand, catalog, model
from adlumen.plans import training
from adlumen.sources import files


def test_posts_survive_csv(spark, tmp_path):
    rows = [(1, 'He said "now", twice,\nthen left \\ end', "en", 10, 1, 2, 3, 0.5, None, 0.1), (2, "plain", "tr", 0, 0, 0, 0, None, 0.0, -1.5)]
    df = spark.createDataFrame(rows, schemas.POSTS).drop("post_id")
    files.write_csv(df.coalesce(1), str(tmp_path / "posts"))
    back = files.read_posts(spark, str(tmp_path / "posts"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_from_csv_to_stored_models(spark, tmp_path):
    rows = [(f"Deal {i % 7} now! #tag{i % 3} " + "great " * (i % 5), "en", 1000 + i, i % 50, i % 9, i % 4, 0.1 * (i % 10), 0.0, None) for i in range(120)]
    posts = spark.createDataFrame([(None, *r) for r in rows + rows[:5]], schemas.POSTS).drop("post_id")
    files.write_csv(posts, str(tmp_path / "posts"))
    read = training.with_post_id(files.read_posts(spark, str(tmp_path / "posts")))
    assert read.count() == 125 and read.select("post_id").distinct().count() == 120
    again = training.with_post_id(read.drop("post_id").repartition(5))
    assert sorted(r.post_id for r in again.collect()) == sorted(r.post_id for r in read.collect())
    root, sizes = str(tmp_path / "models"), model.ModelSizes(boosting_rounds=2, depth=2, step=0.3, folds=5)
    trained = training.train(files.read_posts(spark, str(tmp_path / "posts")), sizes, root=root)
    metrics = files.read_metrics(spark, f"{root}/metrics").collect()
    assert sorted(map(tuple, metrics)) == sorted(map(tuple, trained.metrics.collect()))
    assert {(r.metric, r.subset) for r in metrics} >= {("n_rows", "all"), ("cv_r2_mean", "full"), ("cv_r2_mean", "content"), ("r2", "content")}
    weights = files.read_importances(spark, f"{root}/importances").collect()
    assert {r.subset: sum(w.importance for w in weights if w.subset == r.subset) for r in weights} == pytest.approx({"full": 1.0, "content": 1.0})


def test_catalog_json(spark, tmp_path):
    entry = {"brand_id": "a", "brand_name": "A", "tone_category": "t", "brand_voice_summary": "v", "style_rules": ["r"],
             "reference_ad_copies": ["one", "two"]}
    data = {"brands": [entry, {**entry, "brand_id": "b", "preferred_vocabulary": ["x"]}, {**entry, "brand_name": "Last"}]}
    (tmp_path / "brands.json").write_text(json.dumps(data, indent=1), encoding="utf-8")
    brands = files.read_brand_catalog(spark, str(tmp_path / "brands.json"))
    got = {r.brand_id: r for r in brands.collect()}
    assert set(got) == {"a", "b"} and got["a"].brand_name == "Last" and got["a"].preferred_vocabulary is None
    refs = catalog.brand_references(brands).orderBy("brand_id", "ref_ord").collect()
    assert [(r.brand_id, r.ref_ord, r.ref_text) for r in refs][:2] == [("a", 1, "one"), ("a", 2, "two")]


def test_evaluation_csv(spark, tmp_path):
    (tmp_path / "eval.csv").write_text(
        "idx,source_brand,language,text,score_a,score_b,sbert_predicted_brand,sbert_correct,human_label\n"
        '1,a,en,"Hi, there",66.71,0.1,a,True,\n', encoding="utf-8")
    row = files.read_csv(spark, str(tmp_path / "eval.csv"), schemas.human_eval(["a", "b"])).withColumn("scores", brand.scores_from_columns(["a", "b"])).first()
    assert (row.text, row.scores[0].score, row.sbert_correct, row.human_label) == ("Hi, there", 66.71, True, None)


def test_metrics(spark, tmp_path):
    metrics = model.metric_rows(spark.range(1).select(F.lit(0.5).alias("r2"), F.lit(2.0).alias("rmse")), "full", "Linear")
    files.write_metrics(metrics, str(tmp_path / "m"))
    assert sorted(map(tuple, files.read_metrics(spark, str(tmp_path / "m")).collect())) == [
        ("r2", "full", "Linear", 0.5), ("rmse", "full", "Linear", 2.0)]
