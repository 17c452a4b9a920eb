from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from adlumen.functions import fixed_values as fixed, scoring
from adlumen.functions.affect import with_affect
from adlumen.functions.hashing import hash_bucket
from adlumen.functions.text import with_text_features
from adlumen.operators import embed, evaluate, model
from adlumen.plans import training
from adlumen.streaming import scoring as streams
from checks import queries

SMALL = model.ModelSizes(boosting_rounds=15, step=0.3, depth=4, forest_trees=5, folds=5)
PARTS = ["Buy now!", "Limited deal today", "#sale #new", "Is it you?", "🔥🔥", "GREAT NEWS", "bad and slow", "only 99 left", "@shop", "stupid scam"]


@pytest.fixture(scope="module")
def posts(spark):
    """Posts whose engagement follows the known rule."""
    rows = [(i, " ".join(p for j, p in enumerate(PARTS) if (i * 2654435761 >> (j + 4)) & 1) + f" item {i % 37}") for i in range(600)]
    df = spark.createDataFrame(rows, "post_id long, text_content string")
    rated = with_affect(with_text_features(df), words="word_count").withColumn("_ctr", scoring.rule_ctr())
    parts = scoring.engagement_parts(F.col("_ctr"), F.lit(100_000) + F.col("post_id"))
    return rated.select(
        "post_id", "text_content", F.lit("en").alias("language"), *[c.alias(n) for n, c in parts.items()],
        "sentiment_score", "toxicity_score", F.lit(None).cast("double").alias("buzz_change_rate")).cache()


@pytest.fixture(scope="module")
def few_rows(posts):
    """Model columns of the posts in one partition."""
    return model.training_rows(training.featured_posts(posts)).coalesce(1).cache()


def test_training_learns_the_rule_and_stores_models(spark, posts, tmp_path):
    trained = training.train(posts, SMALL, root=str(tmp_path), prefix="demo_", cross_validate=False)
    r2 = {(r.subset, r.model): r.value for r in trained.metrics.where("metric = 'r2'").collect()}
    assert r2[("content", "BoostedTrees")] > 0.5 and r2[("full", "BoostedTrees")] > 0.5
    with pytest.raises(FileNotFoundError):
        model.load_scorer(spark, str(tmp_path))  # the prefix keeps demo models apart
    scorer = model.load_scorer(spark, str(tmp_path), "demo_")
    assert scorer[1] == fixed.CONTENT_COLUMNS
    texts = spark.createDataFrame([(1, "Amazing! Best deal ever! Limited time now!"), (2, "This product is terrible and broken."), (3, None)], "id int, text string")
    rates = {r.id: r.ctr_score for r in model.predict_ctr(texts, scorer).collect()}
    assert all(v >= 0 for v in rates.values()) and rates[1] != rates[2]
    model.save_model(trained.full, str(tmp_path), "full", "only_")
    fallback = model.load_scorer(spark, str(tmp_path), "only_")
    assert fallback[1] == fixed.FULL_COLUMNS and model.predict_ctr(texts, fallback).count() == 3
    weights = model.feature_importances(spark, trained.content)
    assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert model.top_importances(weights, 3).count() == 3


def test_folds_and_split_are_stable(posts):
    rows = model.training_rows(training.featured_posts(posts))
    train, test = model.split_rows(rows)
    assert train.count() + test.count() == rows.count() and 0.1 < test.count() / rows.count() < 0.3
    again = model.training_rows(training.featured_posts(posts.repartition(13)))
    assert {(r.post_id, r.is_test, r.fold) for r in rows.collect()} == {(r.post_id, r.is_test, r.fold) for r in again.collect()}
    tiny = model.ModelSizes(boosting_rounds=2, depth=2, forest_trees=2, step=0.3)
    cv = model.cv_boosted(train, fixed.CONTENT_COLUMNS, "content", tiny).first()
    assert cv.cv_r2_mean < 1.0 and cv.cv_r2_std >= 0.0


def test_affect_source(posts):
    shifted = posts.withColumn("sentiment_score", F.lit(0.25))
    from_column = training.featured_posts(shifted).select("sentiment_score").distinct().collect()
    assert [r[0] for r in from_column] == [0.25]
    assert training.featured_posts(shifted, affect_source="text").select("sentiment_score").distinct().count() > 1


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "red shoe"), (2, "red shoe"), (3, "blue sky at night"), (4, "")], "id int, t string")
    fitted = embed.fit_embedder(df, "t", dimensions=64)
    rows = {r.id: r.text_vec for r in embed.embed_text(df, fitted, "t").collect()}
    assert rows[1] == rows[2] != rows[3] and sum(x * x for x in rows[1]) == pytest.approx(1.0, abs=1e-5)
    assert set(rows[4]) == {0.0}
    counted = df.withColumn("v", embed.encoder_column(lambda: lambda texts: [[len(t), 1.0] for t in texts], F.col("t")))
    assert counted.where("id = 1").first().v == [8.0, 1.0]


@pytest.mark.parametrize(("dimensions", "n"), [(64, 3), (37, 1), (100, 4)])
def test_embeddings_equal_those_of_spark_ml(spark, dimensions, n):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer
    from pyspark.ml.functions import vector_to_array

    texts = [None, "", "  ", "ab", "abc", "Red  SHOE\x1cred\tshoe", "\u0130\u015f \U0001f525\U0001f525 x", "a\U0001f525", "\u65e5\u672c\u8a9e " * 40, "long text " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    characters = df.withColumn("_chars", F.array_remove(F.split(embed._letters(F.col("t")), ""), ""))
    stages = [NGram(n=n, inputCol="_chars", outputCol="_grams"), HashingTF(numFeatures=dimensions, inputCol="_grams", outputCol="_counts"),
              IDF(inputCol="_counts", outputCol="_weighted"), Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")]
    wanted = Pipeline(stages=stages).fit(characters).transform(characters).select("id", vector_to_array("_unit", "float32").alias("v"))
    got = embed.embed_text(df, embed.fit_embedder(df, "t", dimensions, n), "t", "v")
    assert sorted(got.select("id", "v").collect()) == sorted(wanted.collect())


def test_embeddings_make_no_array_of_characters(spark):
    df = spark.createDataFrame([(1, "red shoe")], "id int, t string")
    plan = embed.embed_text(df, embed.fit_embedder(df, "t"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "array<string>" not in plan


def test_sample_and_buckets(spark):
    df = spark.range(1000)
    first = [r.id for r in evaluate.hash_sample(df, "id", 4).collect()]
    assert first == [r.id for r in evaluate.hash_sample(df.repartition(9), "id", 4).collect()] and len(first) == 4
    assert first != [r.id for r in evaluate.hash_sample(df, "id", 4, seed=1).collect()]
    sizes = df.groupBy(hash_bucket(F.col("id"), 5).alias("b")).count().collect()
    assert len(sizes) == 5 and min(r["count"] for r in sizes) > 140


def test_stream_equals_batch(spark, posts, tmp_path):
    texts = posts.select("post_id", "text_content").limit(50)
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("post_id long, text_content string").parquet(str(tmp_path / "in"))
    query = streams.scored_stream(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    columns = spark.table("scored").columns
    batch = streams.scored_stream(spark.read.parquet(str(tmp_path / "in"))).select(columns)
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, batch.collect()))
    variants = spark.createDataFrame([(1, i, "s", float(i), 50.0) for i in range(5)], "request_id long, variant_ord int, style string, ctr_score double, brand_score double")
    variants.write.parquet(str(tmp_path / "variants"))
    seen = []
    ranking = streams.ranked_batches(
        spark.readStream.schema(variants.schema).parquet(str(tmp_path / "variants")),
        lambda batch, number: seen.extend(batch.collect()), str(tmp_path / "state"))
    ranking.awaitTermination(120)
    assert {r.variant_ord: r["rank"] for r in seen} == {4: 1, 3: 2, 2: 3, 1: 4, 0: 5}


def test_kept_rows_are_cut_off_from_the_plan_that_made_them(spark):
    made = spark.range(1600).withColumn("text_content", F.lit("x")).repartition(40).select("id", F.length("text_content").alias("n"))
    kept = model.kept_rows(made, task_rows=100)
    assert kept.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 16)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "text_content" not in plan and "Exchange" not in plan
    assert sorted(kept.collect()) == sorted(made.collect())


def test_the_report_trains_on_kept_rows(spark, posts, monkeypatch):
    kept = []
    monkeypatch.setattr(model, "kept_rows", lambda rows, keep=model.kept_rows: kept.append(1) or keep(rows))
    training.train(posts, SMALL, cross_validate=False)
    assert kept


def test_a_small_table_of_a_long_fit_lies_in_few_partitions(spark):
    rows = spark.range(1600).repartition(40)
    assert [model.kept_rows(rows, least_rows=least).rdd.getNumPartitions() for least in (5000, 800)] == [1, 2]
    assert model.kept_rows(rows, task_rows=100, least_rows=10).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 16)
    assert model.kept_rows(rows, least_rows=5000).count() == 1600
    assert model.kept_rows(rows.where("id < 0"), least_rows=5000).count() == 0


@pytest.mark.parametrize("name", [
    "ablation", "cv_gbt", "feature_importances", "importances_positive", "importances_top8", "train_content_gbt", "train_full_gbt", "train_report",
])
def test_queries_train_learners_of_the_published_sizes(posts, few_rows, monkeypatch, name):
    asked = []
    monkeypatch.setattr(training, "featured_posts", lambda posts, *other, **named: posts)
    monkeypatch.setattr(model, "training_rows", lambda posts: few_rows)

    def tiny(make):
        def learner(sizes):
            asked.append((make.__name__, sizes))
            return make(model.ModelSizes(boosting_rounds=1, depth=1, forest_trees=1))
        return learner

    for label, make in list(model.LEARNERS.items()):
        learner = tiny(make)
        monkeypatch.setitem(model.LEARNERS, label, learner)
        monkeypatch.setattr(model, make.__name__, learner)
    assert getattr(queries, name)(SimpleNamespace(posts=posts, documents=posts)).count() > 0
    assert "boosted_trees" in {made for made, _ in asked} and {sizes for _, sizes in asked} == {model.ModelSizes()}


def test_cross_validation_equals_that_of_spark_ml(few_rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    sizes = model.ModelSizes(boosting_rounds=1, depth=2)
    specs = {("full", label): model.assembled(fixed.FULL_COLUMNS, model.LEARNERS[label](sizes)) for label in ("Linear", "BoostedTrees")}
    evaluator, plain = RegressionEvaluator(labelCol=model.LABEL, metricName="r2"), Pipeline(stages=[])
    wanted = CrossValidator(
        estimator=plain, estimatorParamMaps=[{plain.stages: s.getStages()} for s in specs.values()], evaluator=evaluator,
        numFolds=5, foldCol="fold").fit(few_rows)
    got = model.cross_validated(few_rows, specs, evaluator, sizes).orderBy("spec_ord").collect()
    assert [(r.subset, r.model) for r in got] == list(specs)
    assert [r.cv_r2_mean for r in got] == pytest.approx(wanted.avgMetrics)
    assert [r.cv_r2_std for r in got] == pytest.approx(wanted.stdMetrics)


def test_folds_without_rows_are_an_error(spark):
    rows = spark.range(20).withColumn("fold", (F.col("id") % 4).cast("int"))
    with pytest.raises(ValueError, match="validation rows of fold 4"):
        model.fold_rows(rows, 5)
    with pytest.raises(ValueError, match="0 .. 2"):
        model.fold_rows(rows, 3)
    with pytest.raises(ValueError, match="training rows of fold 0"):
        model.fold_rows(rows.withColumn("fold", F.lit(0)), 1)
    assert [(a.count(), b.count()) for a, b in model.fold_rows(rows, 4)] == [(15, 5)] * 4


def test_tasks_run_side_by_side_in_order(spark):
    from threading import Barrier

    meet = Barrier(2, timeout=60)
    tasks = [lambda i=i: (meet.wait(), spark.range(i).count())[1] for i in range(4)]
    assert model.side_by_side(spark, tasks, 2) == [0, 1, 2, 3]
