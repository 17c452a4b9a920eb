import random
import re

import pytest
from pyspark.sql import functions as F

from adlumen.functions import affect, fixed_values as fixed


def scores(table, *texts):
    rows = affect.with_affect(table([(i, t) for i, t in enumerate(texts)], "id int, text_content string"))
    return [(r.sentiment_score, r.toxicity_score) for r in rows.orderBy("id").collect()]


def test_blank_texts_are_neutral(table):
    assert scores(table, "", None, " \n\t ") == [(0.0, 0.0)] * 3


@pytest.mark.parametrize("text, expected", [
    ("Amazing! Best deal ever! Absolutely love it!", 1.0),
    ("This product is terrible, broken and useless.", -1.0),
    ("This is not a great experience.", -1.0),
    ("This is not, as we hoped it would be, a great experience", -1.0),
    ("not good!", 0.1),
    ("It is okay I guess!", 0.0),
    ("Bu ürün iyi değil.", -1.0),
    ("Bu ürün iyi ve değil.", 1.0),
    ("Berbat ve kötü bir ürün, kesinlikle iyi değil.", -1.0),
    ("Harika! Muhteşem bir ürün, mükemmel, bayıldım!", 1.0),
    ("Kötü değil!", 1.0),
])
def test_sentiment(table, text, expected):
    assert scores(table, text)[0][0] == pytest.approx(expected)


@pytest.mark.parametrize("text, expected", [
    ("A seamless ecosystem for the future.", 0.0),
    ("You stupid idiot, this is a total scam.", 1.0),
    ("Bu ürün aptalca, dolandırıcı ve saçmalık.", 1.0),
    ("whatever you say about this thing is fine with me", 0.3),
    ("ve mal " + "kelime " * 18, 0.3),
    ("the mall " + "word " * 18, 0.0),
])
def test_toxicity(table, text, expected):
    assert scores(table, text)[0][1] == pytest.approx(expected)


def test_turkish_detection(table):
    df = table(["Straße", "çok", "ve sonra", "vest", "une façon", "de rien", "plain english"], "t string")
    assert [r[0] for r in df.select(affect.is_turkish(F.col("t"))).collect()] == [False, True, True, False, True, True, False]


def test_compounds_equal_a_word_by_word_walk(spark):
    """Random token soups against a plain walk over the words."""
    rng = random.Random(7)
    pool_en = ["great", "bad", "not", "never", "hate", "free", "x", "don't", "Table"]
    pool_tr = ["iyi", "kötü", "değil", "yok", "mal", "berbat", "güzel", "kolay"]

    def soup(pool):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", ".\n", " 7 "]) for _ in range(rng.randint(0, 14)))

    def english(text):
        score = hits = 0
        flip = False
        for word in re.findall(r"[a-z']+", text.lower()):
            if word in fixed.NEGATORS_EN:
                flip = True
            elif word in fixed.POSITIVE_EN or word in fixed.NEGATIVE_EN:
                sign = 1 if word in fixed.POSITIVE_EN else -1
                score, hits, flip = score + (-sign if flip else sign), hits + 1, False
        return score / hits if hits else 0.0

    def turkish(text):
        words = re.findall(rf"[a-z{fixed.TURKISH_LETTERS}']+", text.lower())
        signs = []
        for word, following in zip(words, [*words[1:], ""]):
            sign = 1 if word in fixed.POSITIVE_TR else -1 if word in fixed.NEGATIVE_TR else 0
            if sign:
                signs.append(-sign if following in fixed.NEGATORS_TR else sign)
        return sum(signs) / len(signs) if signs else 0.0

    texts = [soup(pool_en) for _ in range(300)] + [soup(pool_tr) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text_content string")
    both = affect.with_compound(affect.with_compound(df, affect.ENGLISH, name="en"), affect.TURKISH, name="tr")
    for row in both.collect():
        assert row.en == pytest.approx(english(row.text_content)), row.text_content
        assert row.tr == pytest.approx(turkish(row.text_content)), row.text_content
