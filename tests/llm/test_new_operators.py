"""Toxicity, fill-in-middle and hard negatives against brute force, with the edge cases of every operator."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlumen.llm import fim, negatives, toxicity

RNG = random.Random(23)


# --- fill-in-middle -----------------------------------------------------------------------------


def filled(doc_id, text, epoch=1):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


PIECES = ["a", "Bz", "é", " ", "\n", "<", "P", ">", "S", "M", "<P>", "😀", "word", "[", "{", "@", "`", "\x00"]
TEXTS = [None, ""] + ["".join(RNG.choice(PIECES) for _ in range(RNG.randint(0, 40))) for _ in range(600)]


@pytest.mark.parametrize("block, window, step", [(1 << 20, 1 << 18, 1 << 12), (50, 7, 5), (1, 3, 2)])
def test_blocks_and_windows_of_any_size_give_the_same(monkeypatch, block, window, step):
    for name, value in (("BLOCK", block), ("WINDOW", window), ("STEP", step)):
        monkeypatch.setattr(fim, name, value)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    got, back = [], []
    for rows, data, offsets in fim._blocks([batch.slice(0, 100), batch.slice(100)], "text"):
        ids = rows.column(0).to_pylist()
        *columns, out, ends = fim.rearrange(data, offsets, ids, 1, 90, 20)
        got += zip(ids, *columns, fim._strings(out, ends).to_pylist())
        made, where, broken = fim.put_back(out, ends, columns[1])
        assert not broken.any()
        back += fim._strings(made, where).to_pylist()
    assert got == [filled(i, t) for i, t in enumerate(TEXTS)]
    assert back == [t or "" for t in TEXTS]


def test_fill_in_middle_of_tables(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS[:60])] + [(None, "one two three", "y", 2)] * 2 + [(5, "other é text", "z", 3), (900, "word é " * 60_000, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").withColumn("restored", F.lit(0))
    made = fim.restored(fim.transformed(docs))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.columns == [*columns, "restored"]
    got = made.collect()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted((filled(i, t) for i, t, _, _ in rows), key=repr)
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t, _, _ in rows)
    assert {"plain", "psm", "spm"} <= {r.form for r in got}
    other = fim.transformed(docs, epoch=2).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, fim.transformed(docs).collect()))
    assert sorted((tuple(r) for r in other), key=repr) == sorted((filled(i, t, 2) for i, t, _, _ in rows), key=repr)
    assert fim.restored(fim.transformed(docs.limit(0))).count() == 0


def test_outputs_of_another_form_give_null(spark):
    rows = [("psm", "<P>a<S>c<M>b"), ("spm", "<S>c<P>a<M>b"), ("psm", "<P>a<S>c"), ("spm", "<P>a<S>c<M>b"), (None, "a"), ("plain", None), ("psm", "")]
    got = [r.restored for r in fim.restored(spark.createDataFrame(rows, "form string, output string").coalesce(1)).collect()]
    assert got == ["abc", "abc", None, None, None, "", None]


# --- hard negatives -----------------------------------------------------------------------------


def mined(rows):
    """Rows (id, vector, label) that are all usable and have ids of their own."""
    rows = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for i, v, label in rows:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for j, w, other in rows if j != i)
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score]
            out += [(i, j, rank, s[1], -score, -s[0]) for rank, s in enumerate(fits[:3], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(df, **options).collect())


@pytest.mark.parametrize("shard_rows", [17, 8192])
def test_hard_negatives_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist(), int(rng.integers(0, 4))) for i in range(0, 300)]
    rows += [(i, [0.5, 0.5, 0.0, -0.25, 0.0, 1.0], i % 3) for i in range(300, 420)]  # one frequent vector
    rows += [(i, [0.0] * 6, i % 3) for i in range(440, 460)]  # only zeros
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("tie", F.lit(1))
    expected = mined([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert found(df, shard_rows=shard_rows) == expected and len(expected) > 50


def test_hard_negatives_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 4).astype(float).tolist(), i % 3) for i in range(1, 120)]
    unusable = [
        (None, [1.0] * 4, 1), (150, None, 1), (200, [1.0] * 4, None), (250, [1.0, None, 1.0, 1.0], 1), (300, [1.0, math.nan, 1.0, 1.0], 1),
        (350, [1.0, math.inf, 1.0, 1.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    repeated = spark.createDataFrame(rows + unusable + rows[:70], schema)
    assert found(repeated, shard_rows=25) == mined(rows)
    short = [(i, v[:2] if i % 4 == 0 else v, label) for i, v, label in rows]
    assert found(spark.createDataFrame(short, schema)) == mined([(i, v + [0.0] * (4 - len(v)), label) for i, v, label in short])
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(50, [1.0], 1)], schema)) == []
    huge = spark.createDataFrame([(50, [1e300, 1.0], 1), (51, [1e300, 1.0], 1), (52, [5e4, 1.0], 2), (53, [], 2)], schema)
    assert [r[:4] for r in found(huge)] == [(50, 51, 1, 52)]
    twice = [(50, [1.0, 2.0], 1), (50, [2.0, 1.0], 1), (51, [2.0, 2.0], 1), (52, [1.0, 1.0], 2)]
    assert {r[0] for r in found(spark.createDataFrame(twice, schema))} == {50}


def test_reading_ends_before_all_rows_are_met():
    rng = np.random.default_rng(7)
    matrix = (rng.normal(size=(4000, 4)) ** 3 * 100).astype(np.int64)
    lists = negatives.SortedLists(np.arange(4000), np.zeros(4000, np.int64), np.zeros(4000, np.int64), matrix)
    anchor = np.array([300, -200, 10, 0])
    met = sum(len(fresh) for (fresh, _, threshold), _ in zip(lists.read(anchor), range(3)))
    assert met < 1000
    got = lists.best(anchor, np.ones(4000, bool), 3, [(None, None)])[0]
    scores = matrix @ anchor
    assert [s for _, _, s in got] == sorted(scores.tolist(), reverse=True)[:3]


# --- toxicity -----------------------------------------------------------------------------------

BAD = ["grobol", "snarkip", "wezzle"]


def prose(n, rng=RNG):
    return " ".join(rng.choice("ba den ko lur mi sot ven wa".split()) + rng.choice("chi dal er gon nal ru".split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(1500):
        text = prose(RNG.randint(5, 80))
        if i % 6 == 0:
            text += " " + " ".join(RNG.choice(BAD) for _ in range(RNG.randint(1, 4))).capitalize()
        rows.append((i, text, int(i % 6 == 0)))
    rows += [(2000 + i, t, 0) for i, t in enumerate([None, "", " \n", prose(20_000)])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("fold", F.lit(9))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, 1), (8, None)], "doc_id long, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxic_texts_are_found(labelled):
    docs, labels, truth = labelled
    model = toxicity.learned(docs, labels)
    assert {t for t, _ in model.terms} == {f"{w}$" for w in BAD} | {w[:k] for w in BAD for k in range(4, len(w))}
    got = toxicity.scored(docs, model).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == truth[r.doc_id]
        assert bool(r.evidence) == bool(truth[r.doc_id]) and all(e.toxic == 1 for e in r.evidence)


def test_labels_and_held_out_rows_teach_nothing_they_should_not(spark, labelled):
    docs, labels, _ = labelled
    rows = toxicity.examples(docs, labels).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == r.fold != 0 for r in rows)
    assert not {7, 8, None} & {r.doc_id for r in rows}  # both labels, a null label, no id
    assert toxicity.examples(docs.union(docs), labels, most=100).count() == 100
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(tuple(r)[:4] for r in toxicity.scored(docs, toxicity.learned(docs, t)).collect()) for t in (labels, turned))
    assert one == two


def test_scores_of_edge_tables(spark, labelled):
    docs, labels, _ = labelled
    none = toxicity.learned(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs.limit(20), none).collect()} == {0.5}
    model = toxicity.learned(docs, labels)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, "grobol"), (1, None), (1, "a Grobol!"), (1, "a Grobol!")], "doc_id long, text string")
    got = toxicity.scored(odd, model).collect()
    assert sorted(r.predicted for r in got) == [0, 1, 1, 1] and [r.held_out for r in got if r.doc_id is None] == [True]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    vectors = []
    for i in range(900):
        ids = sorted(rng.choice(40, size=int(rng.integers(0, 6)), replace=False).tolist())
        weights = rng.choice([1.0, 2.0, 3.0], size=len(ids))
        weights = (weights / np.linalg.norm(weights)).tolist() if ids else []
        vectors.append((str(i), int(rng.integers(0, 2)), ids, weights))
    index = toxicity.BlockMaxIndex.of(vectors, 40, block=8)
    dense = np.zeros((len(index.names), 40))
    by_name = {name: (ids, weights) for name, _, ids, weights in vectors}
    for e, name in enumerate(index.names):
        dense[e, by_name[name][0]] = by_name[name][1]
    assert index.votes.sum() + index.empty_votes.sum() == len(vectors)
    skipped = 0
    for _, _, ids, weights in vectors[:200]:
        if not ids:
            continue
        query = np.zeros(40)
        query[ids] = weights
        cosines = dense @ query
        least = np.sort(cosines[cosines > 0])[-min(7, int((cosines > 0).sum()))]
        expected = np.flatnonzero((cosines >= least - 1e-9) & (cosines > 0))
        found_, _, visited = index.nearest(ids, weights, 7)
        assert sorted(found_.tolist()) == expected.tolist()
        skipped += visited < index.maxima.shape[1]
    assert skipped > 100
