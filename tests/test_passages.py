"""Passages of texts: the patterns find in them what they find in the whole texts."""

import random

from pyspark.sql import functions as F

from adlumen.functions import affect, fixed_values as fixed, text as tx
from adlumen.functions.passages import passages

PARTS = [
    "now", "NOW", "Nowé", "last chance", "last  chance", "LAST CHANCE", "lımıted", "LİMİTED", "ſhop today", "şimdi", "ŞİMDİ", "now_", "1now", "buy now",
    "not", "noté", "best", "best's", "kötü", "geç", "geç değil", "iyi, değil", "iyi ... 123 é ...................... değil",
    "iyi ............................. x değil", "ve", "é", "ß", "ok", "great", "şu", "🔥", "don't", "'", "never", "-", "...", "\n", "foo bar baz qux", "𐐀"]


def texts():
    rng = random.Random(3)
    joined = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*joined, None, "", " ", "now", "no"]


def test_patterns_find_the_same_in_passages(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, t string").withColumn("low", F.lower("t"))
    t, low, near = F.col("t"), F.col("low"), F.col("near")
    custom = ["go on", "é", "foo", "bar baz", "#x", "🔥"]
    for column, terms, found in [
            (t, [*fixed.URGENCY_TERMS, *fixed.CTA_PHRASES], lambda c: F.struct(tx.urgency_count(c), tx.has_phrase(c))),
            (t, custom, lambda c: tx.urgency_count(c, custom)),
            (low, fixed.TURKISH_FUNCTION_WORDS, lambda c: c.rlike(tx.whole_words(fixed.TURKISH_FUNCTION_WORDS, any_case=False)))]:
        got = df.withColumn("near", passages(column, terms))
        assert got.where(~found(near).eqNullSafe(found(column))).count() == 0
    for lexicon in (affect.ENGLISH, affect.TURKISH):
        got = df.withColumn("near", lexicon.near(low)).select(
            lexicon.compound(lexicon.relevant(near)).alias("a"), lexicon.compound(lexicon.relevant(low)).alias("b"))
        assert got.where("not a <=> b").count() == 0


def test_no_pattern_of_terms_reads_whole_texts(spark):
    """Costly patterns read passages, a small part of a long text without terms."""
    df = spark.createDataFrame([("lorem ipsum dolor " * 1000 + "iyi değil " + "sit amet " * 1000,)], "t string")
    near = df.select(F.length(affect.TURKISH.near(F.col("t"))), F.length(passages(F.col("t"), fixed.URGENCY_TERMS))).first()
    assert near[0] < 100 and near[1] == 0
    plan = affect.with_affect(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
