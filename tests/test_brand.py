import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlumen.operators.joins import lookup_join
from adlumen.operators import brand, catalog, evaluate

# Published scores of 15 texts against three brands, with the source brand of each text.
PUBLISHED = [
    ("samsung", 66.71, 0.1, 0.1), ("duolingo", 18.16, 56.6, 30.62), ("nike", 22.14, 28.3, 36.53),
    ("samsung", 33.06, 6.39, 0.1), ("duolingo", 0.1, 24.64, 13.82), ("nike", 0.1, 24.55, 21.01),
    ("samsung", 65.64, 0.1, 0.1), ("duolingo", 24.61, 40.12, 28.66), ("nike", 18.84, 32.87, 46.88),
    ("samsung", 39.54, 0.1, 0.1), ("duolingo", 15.1, 38.08, 30.58), ("nike", 0.1, 7.09, 17.26),
    ("samsung", 36.0, 0.1, 0.1), ("duolingo", 6.19, 24.4, 0.1), ("nike", 1.26, 18.31, 33.49),
]
NAMES = ["samsung", "duolingo", "nike"]


@pytest.fixture
def vectors(spark):
    """Skewed references and texts: one brand has most of both, with a null and a zero vector."""
    rng = np.random.default_rng(11)
    sizes = {"a": 40, "b": 5, "c": 1}
    refs = [(b, i + 1, [float(x) for x in rng.normal(size=8)]) for b, n in sizes.items() for i in range(n)]
    texts = [(i, "a" if i % 3 else "bcx"[i % 9 // 3], [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    texts += [(100, "a", None), (101, "b", [0.0] * 8)]
    return (spark.createDataFrame(texts, "text_id int, brand_id string, text_vec array<float>"),
            spark.createDataFrame(refs, "brand_id string, ref_ord int, ref_vec array<float>"))


def by_hand(texts, refs):
    def unit(v):
        v = np.asarray(v, dtype=np.float64)
        n = np.linalg.norm(v)
        return v / n if n else v

    out = {}
    for t in texts.collect():
        for r in refs.collect():
            if t.text_vec is not None:
                key = (t.text_id, r.brand_id)
                out[key] = max(out.get(key, -2.0), float(unit(t.text_vec) @ unit(r.ref_vec)))
    return out


@pytest.mark.parametrize("values", [10**6, 60])
def test_similarities_equal_all_pairs(vectors, values):
    """One block or many, the maxima are those over all pairs."""
    texts, refs = vectors
    expected = by_hand(texts, refs)
    everything = brand.with_brand_similarities(texts, refs, block_values=values).collect()
    got = {(r.text_id, s.brand_id): s.similarity for r in everything for s in (r.similarities or [])}
    assert len(everything) == 62 and got == pytest.approx(expected, abs=1e-6)
    assert all([s.brand_ord for s in r.similarities] == [0, 1, 2] for r in everything if r.similarities)
    own = {r.text_id: r.similarity for r in brand.with_own_similarity(texts, refs, block_values=values).collect()}
    assert len(own) == 62
    for t in texts.collect():
        want = expected.get((t.text_id, t.brand_id))
        assert own[t.text_id] is None if want is None else own[t.text_id] == pytest.approx(want, abs=1e-6)


def test_native_cosine_agrees(vectors):
    texts, refs = vectors
    one = refs.where("brand_id = 'c'").select(F.col("ref_vec").alias("r"))
    native = texts.join(F.broadcast(one)).select("text_id", brand.cosine_similarity(F.col("text_vec"), F.col("r")).alias("s"))
    arrow = brand.with_own_similarity(texts.withColumn("brand_id", F.lit("c")), refs)
    assert {r.text_id: r.s for r in native.collect()} == pytest.approx({r.text_id: r.similarity for r in arrow.collect()}, abs=1e-6)


def test_validation_and_baseline(vectors):
    _, refs = vectors
    rows = {r.brand_id: r for r in brand.validate_alignment(refs).collect()}
    assert all(r.own_mean == pytest.approx(100.0) and r.own_higher for r in rows.values())
    expected = [max(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for y in others)
                for b in "abc" for x in [np.array(r.ref_vec) for r in refs.where(F.col("brand_id") == b).collect()]
                for other in "abc" if other != b
                for others in [[np.array(r.ref_vec) for r in refs.where(F.col("brand_id") == other).collect()]]]
    assert brand.offbrand_baseline(refs).first().baseline == pytest.approx(np.mean(expected), abs=1e-6)


@pytest.fixture
def published(spark):
    rows = [(i, src, *scores, None) for i, (src, *scores) in enumerate(PUBLISHED, 1)]
    df = spark.createDataFrame(rows, "idx int, source_brand string, score_samsung double, score_duolingo double, score_nike double, human_label string")
    return df.withColumn("scores", brand.scores_from_columns(NAMES))


def test_published_evaluation(published):
    rows = evaluate.human_eval_rows(published, "idx")
    assert [r.idx for r in rows.where(~F.col("correct")).collect()] == [6]
    outcome = evaluate.with_outcome(evaluate.with_truth(rows.join(published.select("idx", "human_label"), "idx")))
    m = evaluate.human_eval_metrics(outcome).first()
    assert m.accuracy == pytest.approx(14 / 15)
    assert m.correlation == pytest.approx(0.325771, abs=1e-6)
    assert m.mean_correct == pytest.approx(39.925) and m.mean_wrong == pytest.approx(21.01)
    assert evaluate.roc_auc(outcome, "own_score", "is_correct").first().auc == pytest.approx(13 / 14)


def test_labels_replace_the_source_as_soon_as_one_exists(published):
    rows = evaluate.human_eval_rows(published, "idx").withColumn(
        "human_label", F.when(F.col("idx") == 6, F.lit(" Duolingo ")))
    truth = {r.idx: r.truth for r in evaluate.with_truth(rows).collect()}
    assert truth[6] == "duolingo" and truth[1] is None
    metrics = evaluate.human_eval_metrics(evaluate.with_outcome(evaluate.with_truth(rows))).first()
    assert (metrics.accuracy, metrics.n, metrics.n_unjudged) == (1.0, 1, 14)


def test_proof(published):
    proof = brand.brand_proof(published)
    assert [r.idx for r in brand.proof_failures(proof, "idx").collect()] == [6]
    summary = brand.proof_summary(proof).first()
    assert (summary.n, summary.n_own_higher, summary.all_positive) == (15, 14, True)
    wide = published.select("idx", *brand.pivoted(NAMES, 2)).where("idx = 2").first()
    assert (wide.score_samsung, wide.score_duolingo) == (18.16, 56.6)


def test_ties_go_to_the_first_brand(table):
    df = table([(1, 5.0, 7.0, 7.0)], "idx int, score_x double, score_y double, score_z double")
    scored = df.withColumn("scores", brand.scores_from_columns(["x", "y", "z"]))
    assert scored.select(brand.predicted_brand()).first()[0] == "y"
    assert brand.predicted_brand_of(brand.score_matrix(scored, "idx"), "idx").first().predicted_brand == "y"


def test_auc(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(-5, 6, 400), rng.integers(0, 2, 400))]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    expected = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert evaluate.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc == pytest.approx(expected)
    assert evaluate.roc_auc(spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int"), "s", "y").first().auc is None


def test_folds_and_metrics(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    y = 2 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, fold int")
    want = []
    for k in range(4):
        hold = np.arange(200) % 4 == k
        a, b = np.polyfit(x[~hold], y[~hold], 1)
        want.append(1 - ((y[hold] - a * x[hold] - b) ** 2).sum() / ((y[hold] - y[hold].mean()) ** 2).sum())
    folds = evaluate.univariate_cv(df, "x", "y", "fold")
    assert [r.r2 for r in folds.orderBy("fold").collect()] == pytest.approx(want)
    both = evaluate.cv_scores(folds).first()
    assert (both.cv_mean, both.cv_std) == pytest.approx((np.mean(want), np.std(want)))
    assert evaluate.best_row(folds.select("fold", "r2"), "r2", "fold").first().fold == int(np.argmax(want))


def test_catalog_upsert(spark):
    schema = ("form_ord int, brand_id string, brand_name string, tone_category string, brand_voice_summary string, "
              "style_rules string, preferred_vocabulary string, forbidden_vocabulary string, reference_ad_copies string")
    forms = spark.createDataFrame([
        (1, " x ", "X", " ", "voice", "", "a, ,b", "", "one\n\n two \r\nthree"),
        (2, "x", "X2", "Bold", "", "r1\nr2", "", "c", "only"),
        (3, "", "No id", "", "", "", "", "", "ref"),
        (4, "y", "Y", "", "", "", "", "", " \n "),
    ], schema)
    old = catalog.parsed_forms(forms.where("form_ord = 1")).drop("form_ord", "reject_reason").withColumn("brand_name", F.lit("old"))
    first = old.first()
    assert (first.brand_id, first.tone_category, first.reference_ad_copies) == ("x", "Genel", ["one", "two", "three"])
    assert first.preferred_vocabulary == ["a", "b"] and len(first.style_rules) == 1
    other = old.withColumn("brand_id", F.lit("z"))
    merged, rejected = catalog.upsert_brands(old.unionByName(other), forms)
    got = {r.brand_id: r for r in merged.collect()}
    assert set(got) == {"x", "z"} and got["x"].brand_name == "X2" and got["z"].brand_name == "old"
    assert {r.form_ord: r.reject_reason for r in rejected.collect()} == {3: "id and name are required", 4: "references are required"}


def test_lookup_keeps_unknown_keys(spark):
    rows = spark.range(300).select(F.col("id").alias("variant_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("brand_id"))
    keys = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "brand_id string, v int")
    assert lookup_join(rows, keys, "brand_id").count() == 300
    assert catalog.unknown_brands(rows, keys).count() == 6


def test_uneven_vectors_are_an_error():
    with pytest.raises(ValueError):
        brand.batch_matrix(pa.array([[1.0, 2.0, 3.0], [1.0] * 5], pa.list_(pa.float32())))


def test_equal_ids_keep_their_own_vectors(spark):
    texts = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0])], "text_id int, brand_id string, text_vec array<float>")
    refs = spark.createDataFrame([("a", i, [1.0, 0.0]) for i in range(9)], "brand_id string, ref_ord int, ref_vec array<float>")
    for values in (100, 4):
        got = sorted(r.similarity for r in brand.with_own_similarity(texts, refs, block_values=values).collect())
        assert got == pytest.approx([0.0, 1.0])


def test_stored_references_are_shared_and_read_in_blocks(spark, vectors):
    texts, refs = vectors
    files = brand.stored_references(refs, block_values=24)
    assert brand.stored_references(files) is files and files.brands() == ["a", "b", "c"]
    blocks = list(files.blocks())
    assert sum(len(b) for b, _ in blocks) == 46 and max(rows.size for _, rows in blocks) <= 24
    assert all((b[1:] >= b[:-1]).all() for b, _ in blocks)
    expected = by_hand(texts, refs)
    scored = brand.with_own_similarity(texts, files)
    got = {r.text_id: r.similarity for r in scored.collect()}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({t.text_id: expected[t.text_id, t.brand_id] for t in texts.collect() if (t.text_id, t.brand_id) in expected}, abs=1e-6)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan  # however many blocks there are
    assert brand.with_brand_similarities(texts, refs.limit(0)).where("size(similarities) > 0").count() == 0
    assert brand.with_own_similarity(texts, refs.limit(0)).where("similarity is not null").count() == 0


def test_driver_holds_none_of_the_references(spark):
    """Ten times as many references leave the driver's Python memory where it was."""
    import tracemalloc

    texts = spark.createDataFrame([(1, "b1", [1.0, 2.0])], "text_id int, brand_id string, text_vec array<double>")
    peaks = []
    for n in (20_000, 200_000):
        refs = spark.range(n).select(
            F.concat(F.lit("b"), F.col("id") % 5).alias("brand_id"), F.col("id").alias("ref_ord"),
            F.array(F.sin("id"), F.cos("id")).alias("ref_vec"))
        tracemalloc.start()
        best = brand.with_own_similarity(texts, refs, block_values=4096).first().similarity
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        own = np.arange(1, n, 5)
        assert best == pytest.approx(((np.sin(own) + 2 * np.cos(own)) / np.sqrt(5)).max())
    assert max(peaks) < 4_000_000 and peaks[1] < 1.5 * peaks[0]
