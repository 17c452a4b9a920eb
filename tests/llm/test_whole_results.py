"""Cases in which an operator once did less than its whole job."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from adlumen.llm import lines, quality, shingles, suffixes

RNG = random.Random(17)
WORDS = [a + b for a in ("ba", "den", "ko", "lur", "mi", "sot", "ven", "wa") for b in ("", "chi", "dal", "er", "gon", "ip", "nal", "ru")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_texts_with_a_tenth_of_symbols_go(spark):
    rows = [(i, prose(RNG.randint(40, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " | ".join(prose(2) for _ in range(60)), "en", "s") for i in range(20)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    shares = [r.n_symbols / r.word_chars for r in got.where("doc_id >= 1000").collect()]
    assert 0.05 < min(shares) and max(shares) < 0.2
    assert got.where("doc_id >= 1000 and kept").count() == 0 and got.where("doc_id < 1000 and not kept").count() == 0


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similar(a, b):
    return not a | b or 5 * len(a & b) >= 4 * len(a | b)


def test_near_sets_share_a_key():
    import numpy as np

    rng = random.Random(1)
    for _ in range(4000):
        n = rng.choice([1, 2, 4, 5, 6, 9, 12, 20, 40, 90, 300, 1000])
        both = [rng.getrandbits(64) for _ in range(n)]
        others = n // 4
        left = rng.choice([0, others // 2, others])
        a, b = (np.unique(np.array(both + [rng.getrandbits(64) for _ in range(k)], np.uint64)) for k in (left, others - left))
        assert shingles.near(a, b) and len(np.intersect1d(shingles.keys_of(a), shingles.keys_of(b)))


def test_near_dedup_links_every_pair_of_similar_texts(spark):
    rng = random.Random(6)
    texts = [None, "", "one two", "One  two", "one two three"]
    for n in (9, 30, 120, 400):
        for _ in range(8):
            text = prose(n, rng)
            texts.append(text)
            for _ in range(4):
                words = text.split()
                for _ in range(rng.randint(0, max(1, n // 25))):
                    words[rng.randrange(len(words))] = "edit" + rng.choice(WORDS)
                texts.append(text := " ".join(words))
    sets = [_set(t) for t in texts]
    top = list(range(len(texts)))
    linked = [[j for j, b in enumerate(sets) if _similar(a, b)] for a in sets]
    for _ in texts:
        top = [min(top[j] for j in js) for js in linked]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    expected = {t for t in top}
    assert len(expected) < len(texts) - 40
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    assert shingles.one_of_each(docs.limit(0)).count() == 0
    rows = shingles.with_sketch(docs, "text", ["doc_id"])
    names = {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        names.setdefault(bytes(r.fp), r.doc_id)
    for cell in (60, 4_000_000):  # buckets in many cells, or in one
        parts = {}
        for r in shingles.components_of(docs, rows, cell).collect():
            parts.setdefault(bytes(r.root), set()).add(names[bytes(r.node)])
        several = {}
        for d, t_ in enumerate(top):
            several.setdefault(t_, set()).add(d)
        known = {frozenset(g & set(names.values())) for g in several.values() if len(g & set(names.values())) > 1}
        assert {frozenset(p) for p in parts.values()} == known


def test_near_dedup_of_odd_rows(spark):
    base = prose(50)
    rows = [(None, base, "x"), (None, base, "x"), (3, base + " end", "y"), (3, prose(40), "z"), (4, None, None), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("size", F.lit("s")).withColumn("key", F.lit(0))
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, rows[2][1]), (3, rows[3][1]), (4, "")])


def test_sketches_rule_out_no_near_pair():
    import numpy as np

    rng = random.Random(5)
    for n in (1, 3, 9, 40, 41, 300, 2100):
        sets = []
        for _ in range(12):
            base = [rng.getrandbits(64) for _ in range(n)]
            for k in (0, n // 12, n // 9, n // 5, n // 2):
                sets.append(np.unique(np.array(base[k // 2:] + [rng.getrandbits(64) for _ in range(k - k // 2)], np.uint64)))
        group = shingles.possible(np.array([len(s) for s in sets]), [shingles.sketch_of(s) for s in sets])
        near = [(i, j) for i in range(len(sets)) for j in range(i) if shingles.near(sets[i], sets[j])]
        assert near and all(group[i] == group[j] >= 0 for i, j in near)
        assert n < 40 or len(set(group.tolist()) - {-1}) == 12  # sets of other bases are ruled out


def test_links_of_a_bucket_are_fewer_than_its_members():
    import numpy as np

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(200)]
    sets = [np.unique(np.array(base[:170 + i % 30] + [rng.getrandbits(64) for _ in range(i % 40)], np.uint64)) for i in range(300)]
    links = [(a, b) for a, met in shingles.forest(sets) for b in met.tolist()]
    top = list(range(300))
    near = [[j for j in range(300) if shingles.near(sets[i], sets[j])] for i in range(300)]
    for _ in range(20):
        top = [min(top[j] for j in js) for js in near]
    assert all(shingles.near(sets[a], sets[b]) for a, b in links) and len(links) == 300 - len(set(top))
    mine = list(range(300))
    for _ in range(300):
        for a, b in links:
            mine[a] = mine[b] = min(mine[a], mine[b])
    assert mine == top


def test_each_row_loses_its_own_lines(spark):
    a, b, c = (prose(10) for _ in range(3))
    rows = [(0, f"{a}\n{b}\n{c}"), (5, f"{a}\nown one"), (5, f"{b}\nown two"), (5, f"{c}\nown three"), (None, f"new line\n{a}"),
            (None, f"new line\n{b}"), (None, "twice\n\nof it"), (None, "twice\n\nof it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.text for r in lines.without_repeated_lines(docs).collect()))
    assert left == sorted([rows[0][1], "own one", "own two", "own three", "new line", "", "twice\n\nof it", ""])
    got = sorted((repr(r.doc_id), list(r.removed_lines), r.n_removed) for r in lines.line_report(docs).collect())
    assert got == sorted([("0", [], 0), *[("5", [0], 1)] * 3, ("None", [1], 1), ("None", [0, 1], 2), ("None", [], 0), ("None", [0, 2], 2)])


def test_spans_of_rows_without_id_meet_their_own_row_only(spark):
    shared = prose(60)
    texts = [shared + prose(5) + "é" for _ in range(12)] + [shared, shared, None, ""]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    ties = docs.select("text", F.xxhash64("text").alias("tie")).collect()
    assert all(suffixes._tie(r.text) == r.tie for r in ties)
    got = suffixes.without_repeats(docs)
    assert "_tie" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.n_removed >= len(shared) for r in got.collect()) == [False] * 2 + [True] * 14


def test_near_dedup_links_by_fingerprints_too(spark):
    from adlumen.llm import simhash

    rng = random.Random(8)
    # A text that repeats itself, and one with an end of its own: near fingerprints, but sets of shingles that are not near.
    often = [f"{prose(12, rng)} " * 40 for _ in range(20)]
    apart = lambda a, b: ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (1 << 64) - 1).bit_count()
    far = next((a, a + "one two three four") for a in often if apart(a, a + "one two three four") <= simhash.REACH)
    rows = [(3, prose(40, rng)), (4, None), (5, ""), (10, far[0]), (11, far[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not shingles.near(*map(shingles.shingles, far))
    names = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert names == {3: 3, 4: 4, 5: 4, 10: 10, 11: 10}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {3, 4, 10}
