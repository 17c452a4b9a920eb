import random

from pyspark.sql import functions as F

from adlumen.functions.affect import ENGLISH, TURKISH, SentimentLexicon, with_compound
from adlumen.operators import lexicon


def as_table(spark, lists):
    rows = [(w, 1) for w in lists.positive] + [(w, -1) for w in lists.negative] + [(w, 0) for w in lists.negators]
    return spark.createDataFrame(rows + rows[:2] + [(None, 1), ("x", None)], "term string, mark int")


def test_a_table_scores_as_the_lists_do(spark):
    rng = random.Random(4)
    for lists in (ENGLISH, TURKISH, SentimentLexicon(["up", "both"], ["down", "both", "nay"], ["nay", "not"])):
        words = [*lists.positive, *lists.negative, *lists.negators, "filler", "Up", "x"]
        texts = [rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(150)]
        texts += [texts[0]] * 5 + [None, "", "!!"]
        df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, text_content string, term string")
        table = as_table(spark, lists)
        got = lexicon.with_lexicon_compound(df, table, letters=lists.letters, negator_follows=lists.negator_follows)
        assert got.columns == ["i", "text_content", "term", "compound"]
        expected = {r.i: round(r.compound, 12) for r in with_compound(df, lists).collect()}
        assert {r.i: round(r.compound, 12) for r in got.collect()} == expected


def test_fifty_thousand_terms(spark):
    marked = spark.range(50_000).select(
        F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("term"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("mark"))
    df = spark.createDataFrame([(1, "wbcde wbcdd plain"), (2, "wj wa"), (3, "nothing")], "i int, text_content string")
    scored = lexicon.with_lexicon_compound(df, marked)
    assert {r.i: r.compound for r in scored.collect()} == {1: 0.0, 2: -1.0, 3: 0.0}  # 1234 and 1233, 9 and 0
    few = lexicon.with_lexicon_compound(df, marked.limit(3))
    plans = [q._jdf.queryExecution().analyzed().toString() for q in (scored, few)]
    assert abs(len(plans[0]) - len(plans[1])) < 500


def test_terms_anywhere(spark):
    terms = ["(", "(a|b)*", "ab", "needle", "needles", "needless", "é", "😀😀x", "two words", "\n", "", None, "ab", "zz"]
    texts = ["f(a|b)*", "xNEEDLEs!", "needless two  words", "two words\nab", "😀😀xé", "", None, "needless" * 20_000 + "zz"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[0])], "i int, text_content string").withColumn("_gram", F.lit(1))
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = {i: sum(t in (x or "").lower() for t in {t for t in terms if t}) for i, x in [*enumerate(texts), (99, texts[0])]}
    for gram in (1, 3, 5):
        assert {r.i: r.n_terms for r in lexicon.with_term_hits(df, table, gram=gram).collect()} == expected
    assert {r.n_terms for r in lexicon.with_term_hits(df, table.limit(0)).collect()} == {0}
    assert lexicon.with_term_hits(df.limit(0), table).count() == 0


def test_terms_are_read_in_blocks_and_no_row_is_shuffled(spark):
    terms = spark.createDataFrame([(f"term{i}",) for i in range(40)], "term string").repartition(3)
    df = spark.createDataFrame([(i, " ".join(f"TERM{j}" for j in range(i))) for i in range(41)], "i int, text_content string")
    got = lexicon.with_term_hits(df, terms, block_terms=4)
    assert {r.i: r.n_terms for r in got.collect()} == {i: i for i in range(41)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
