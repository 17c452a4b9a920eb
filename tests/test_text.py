import random

from pyspark.sql import functions as F

from adlumen.functions import text as tx
from adlumen.functions.rounding import round_binary


def features(table, *texts):
    df = table([(i, t) for i, t in enumerate(texts)], "id int, text_content string")
    return [r.asDict() for r in tx.with_text_features(df).orderBy("id").collect()]


def test_counts_and_urgency(table):
    row = features(table, "Hello! Limited time deal now!")[0]
    assert (row["char_count"], row["word_count"], row["urgency_count"], row["has_urgency"]) == (29, 5, 3, 1)
    assert (row["has_question"], row["has_exclamation"]) == (0, 1)


def test_empty_and_null_texts_have_no_features(table):
    for row in features(table, "", None):
        assert all(row[c] == 0 for c in tx.TEXT_FEATURES)


def test_urgency_terms_of_both_languages(table):
    rows = features(
        table, "Really? Yes! Limited now.", "Hurry! Today only - exclusive deal! Must have!",
        "Son şans! Bugün al, hem şimdi indirim, fırsat kaçırma!", "SON ŞANS, SINIRLI İNDİRİM", "nowhere dealer")
    assert [r["urgency_count"] for r in rows] == [2, 5, 6, 3, 0]
    assert (rows[0]["has_question"], rows[0]["has_exclamation"]) == (1, 1)


def test_emoji_tags_and_calls_to_action(table):
    rows = features(
        table, "Amazing deal! 🔥 #Tech #Sale #NewRelease @Brand", "Grab yours today!", "Hemen al, bugün keşfet!",
        "Just a casual sentence.", "❤️ ok")
    assert (rows[0]["emoji_count"], rows[0]["hashtag_count"], rows[0]["has_hashtag"], rows[0]["has_mention"]) == (1, 3, 1, 1)
    assert [r["has_cta"] for r in rows[1:4]] == [1, 1, 0]
    assert rows[4]["emoji_count"] == 2  # a variation selector counts as one more


def test_ratios(table):
    rows = features(table, "BEST BEST BEST inventory", "a²b 12 x\x1cy z", "Éa éb Ⓐ")
    assert (rows[0]["word_diversity"], rows[0]["all_caps_ratio"]) == (0.5, 0.75)
    assert (rows[1]["word_count"], rows[1]["numeric_ratio"]) == (5, 0.4)
    assert rows[2]["all_caps_ratio"] == round(2 / 3, 3)


def test_other_columns_stay(table):
    df = table([("Hi", 1)], "text_content string, extra int")
    assert tx.with_text_features(df).columns == ["text_content", "extra", *tx.TEXT_FEATURES]


def test_custom_terms(table):
    df = table(["red RED reddish blue sky"], "t string")
    counted = df.select(tx.urgency_count(F.col("t"), ["red", "blue sky"]), tx.has_phrase(F.col("t"), ["dish"])).first()
    assert tuple(counted) == (3, 0)


def test_normalize(table):
    df = table(["  a \n\t b. ", "word " * 10, "."], "t string")
    plain = [r[0] for r in df.select(tx.normalize_text(F.col("t"), 10)).collect()]
    loud = [r[0] for r in df.select(tx.normalize_text(F.col("t"), 10, F.lit(True))).collect()]
    assert plain == ["a b.", "word word", "."]
    assert loud == ["a b!", "word word!", "!"]


def test_rounding_equals_the_rounding_of_stored_values(spark):
    rng = random.Random(1)
    values = [rng.randint(1, 5000) / rng.randint(1, 400) for _ in range(5000)]
    values += [2.675, 0.0625, 0.5, 1.5, 2.5, 0.125, 0.375, -2.675, -0.0625, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", *[round_binary(F.col("x"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect():
        assert (r.d1, r.d2, r.d3) == (round(r.x, 1), round(r.x, 2), round(r.x, 3))


def test_features_are_one_projection_without_python_or_shuffle(table):
    plan = tx.with_text_features(table(["a"], "text_content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
