"""Toxicity scores from the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index.

Terms are words (runs of letters, lower case) as a whole, written ``word$``, and beginnings of longer words, four to eight
letters. A term is kept if it goes with the label in the examples by a chi-squared test; so the vectors of most texts have
few entries, and many have none. Examples with equal vectors are one entry of the index with the number of each label.

The entries are sorted by their terms and cut into blocks of ``BLOCK``. Per term and block the index has the postings and
their largest weight. The largest weights bound the cosine of all entries of a block with a text, so blocks are visited
by falling bound, and the search ends when the bound is below the k-th best cosine: no entry that counts is missed, and
entries as near as the k-th all count. Their votes weigh one over their distance; a logistic curve, fitted on examples
that are not in the index, turns the share of the votes into a probability.

Learned is from a sample of at most ``EXAMPLES`` labelled rows (``TERMS`` terms): this bounds all that the driver gathers and
that the tasks are sent. All documents are scored, whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.llm.common import map_rows, with_mapped, written

#: Rows whose crc32(doc_id) has remainder 0 by FOLDS are held out of learning; those with 1 fit the curve; the others are the index.
FOLDS = 5
EXAMPLES, TERMS = 10_000, 4_096
#: Least chi-squared value of a kept term (p below 1e-7, as there are about a million terms) and least number of examples with it.
CHI_SQUARED, LEAST_EXAMPLES = 30.0, 3
NEIGHBOURS, BLOCK = 20, 64
#: Added to a distance before it divides, and the weight of the overall share of toxic examples among the votes.
NEARNESS, PRIOR = 0.05, 1.0
_SLACK = 1e-9
_WORD = re.compile(r"[^\W\d_]+")
_SHORTEST, _LONGEST = 4, 8


def fold(doc_id: Column) -> Column:
    """Remainder that sets a row's part in learning; a row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def words_of(text: str | None) -> Iterator[str]:
    return (m[0] for m in _WORD.finditer((text or "").lower()))


def terms_of(word: str) -> list[str]:
    return [f"{word}$", *[word[:k] for k in range(_SHORTEST, min(len(word), _LONGEST + 1))]]


# --- examples -----------------------------------------------------------------------------------


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """At most ``most`` labelled rows that are not held out (``doc_id``, ``text``, ``toxic``, ``fold``), those of smallest hash.

    Ids with a null label, or with both labels, teach nothing; rows of equal id and text are one.
    """
    clear = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"), F.count_if(F.col("toxic").isNull()).alias("_none"))
    clear = clear.where("toxic = _most and _none = 0 and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    learning = clear.where(fold(F.col("doc_id")) != 0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    known = rows.select("doc_id", "tie").distinct().join(learning, "doc_id")
    picked = written(known.orderBy(F.xxhash64("doc_id", "tie"), "doc_id", "tie").limit(most), "toxicity-picked")
    once = rows.join(F.broadcast(picked), ["doc_id", "tie"]).groupBy("doc_id", "tie").agg(  # at most ``most`` ids and hashes
        F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return written(once.select("doc_id", "text", "toxic", fold(F.col("doc_id")).alias("fold")), "toxicity-examples")


def kept_terms(rows: DataFrame, chi_squared: float = CHI_SQUARED, most: int = TERMS) -> list[tuple[str, float]]:
    """Terms that go with the label, with their inverse document frequency, the most telling ones first."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic")).first()
    n, n_toxic = totals.n, totals.n_toxic or 0
    if not 0 < n_toxic < n:
        return []

    def make() -> Callable[..., Iterable[tuple]]:
        return lambda text, toxic: ((t, toxic) for t in {t for w in set(words_of(text)) for t in terms_of(w)})

    seen = map_rows(rows, "term string, toxic int", make, ["text", "toxic"])
    counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("df_toxic")).where(F.col("df") >= LEAST_EXAMPLES)
    expected = F.col("df") * (n_toxic / n)
    spread = expected * (1 - n_toxic / n) * (1 - (F.col("df") - 0.5) / n)
    value = F.pow(F.col("df_toxic") - expected, 2) / spread
    telling = counts.where(F.col("df_toxic") > expected).withColumn("value", value).where(F.col("value") >= chi_squared)
    found = telling.orderBy(F.desc("value"), "term").limit(most).collect()
    return [(r.term, math.log(1 + n / r.df)) for r in found]


# --- vectors and index --------------------------------------------------------------------------


class Vectors:
    """Unit vectors over the kept terms: term numbers, ascending, and weights (1 + log tf) * idf."""

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.number = {term: i for i, (term, _) in enumerate(terms)}
        self.idf = [idf for _, idf in terms]
        self.heads = {term.rstrip("$")[:_SHORTEST] for term, _ in terms}

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        heads, number = self.heads, self.number
        words = Counter(w for w in words_of(text) if w[:_SHORTEST] in heads)
        counts: Counter[int] = Counter()
        for word, n in words.items():
            for term in terms_of(word):
                if term in number:
                    counts[number[term]] += n
        ids = sorted(counts)
        weights = [(1 + math.log(counts[i])) * self.idf[i] for i in ids]
        length = math.sqrt(math.fsum(w * w for w in weights))
        return ids, [w / length for w in weights]


@dataclass
class BlockMaxIndex:
    """Entries in blocks; ``starts[t, b]`` is the first posting of term ``t`` in block ``b``."""

    maxima: np.ndarray
    starts: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    votes: np.ndarray
    #: An example of each entry, for evidence, and the votes of the examples without any term.
    names: list[str]
    empty_votes: np.ndarray
    block: int

    @classmethod
    def of(cls, vectors: list[tuple[str, int, list[int], list[float]]], n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        entries: dict[tuple, list] = {}
        empty = np.zeros(2)
        for name, toxic, ids, weights in sorted(vectors):
            if ids:
                found = entries.setdefault((tuple(ids), tuple(round(w, 12) for w in weights)), [name, np.zeros(2)])
                found[1][toxic] += 1
            else:
                empty[toxic] += 1
        order = sorted(entries, key=lambda e: (e[0][int(np.argmax(e[1]))], e))  # by the term of most weight: blocks of like entries
        n_blocks = -(-len(order) // block)
        postings = sorted((t, i, w) for i, (ids, weights) in enumerate(order) for t, w in zip(ids, weights))
        term = np.array([p[0] for p in postings], np.int64)
        entry = np.array([p[1] for p in postings], np.int64)
        weight = np.array([p[2] for p in postings])
        cells = term * n_blocks + entry // block
        starts = np.searchsorted(cells, np.arange(n_terms * n_blocks + 1))
        maxima = np.zeros(n_terms * n_blocks)
        np.maximum.at(maxima, cells, weight)
        bounds = np.zeros((n_terms, n_blocks + 1), np.int64)
        for b in range(n_blocks + 1):
            bounds[:, b] = starts[np.arange(n_terms) * n_blocks + b]
        votes = np.array([entries[e][1] for e in order]).reshape(-1, 2)
        return cls(maxima.reshape(n_terms, n_blocks), bounds, entry, weight, votes, [entries[e][0] for e in order], empty, block)

    def nearest(self, ids: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` entries of highest cosine and those as near as the k-th, their cosines, and the number of visited blocks."""
        bounds = np.zeros(self.maxima.shape[1])
        for t, w in zip(ids, weights):
            bounds += w * self.maxima[t]
        found, cosines, least, visited = np.zeros(0, np.int64), np.zeros(0), 0.0, 0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or bounds[b] < least - _SLACK:
                break
            visited += 1
            scores = np.zeros(self.block)
            for t, w in zip(ids, weights):
                low, high = self.starts[t, b], self.starts[t, b + 1]
                scores[self.entry[low:high] - b * self.block] += w * self.weight[low:high]
            met = np.flatnonzero(scores > 0)
            found, cosines = np.concatenate([found, met + b * self.block]), np.concatenate([cosines, scores[met]])
            if len(found) >= k:
                least = float(np.partition(cosines, -k)[-k])
                near = cosines >= least - _SLACK
                found, cosines = found[near], cosines[near]
        order = np.lexsort((found, -cosines))
        return found[order], cosines[order], visited

    def vote(self, ids: list[int], weights: list[float], k: int) -> tuple[float, list[tuple[str, float, int]]]:
        """Share of toxic votes, and per entry that voted: an example, its cosine and the label that most of its copies have."""
        everyone = self.votes.sum(axis=0) + self.empty_votes
        overall = (everyone[1] + 0.5) / (everyone.sum() + 1)
        if not ids:
            return float((self.empty_votes[1] + PRIOR * overall) / (self.empty_votes.sum() + PRIOR)), []
        found, cosines, _ = self.nearest(ids, weights, k)
        nearness = NEARNESS / (NEARNESS + np.maximum(0.0, 1 - cosines))  # 1 at no distance
        counted = nearness[:, None] * self.votes[found]
        share = (counted[:, 1].sum() + PRIOR * overall) / (counted.sum() + PRIOR)
        return float(share), [(self.names[i], float(c), int(self.votes[i, 1] > self.votes[i, 0])) for i, c in zip(found, cosines)]


def logit(share: np.ndarray | float) -> np.ndarray | float:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def curve(shares: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the logit of the votes; without both labels, the votes stay."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    x, y = logit(shares), np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    ridge = np.diag([1e-2, 1e-6])  # keeps the slope finite where votes and labels agree wholly
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        gradient = design.T @ (p - y) + ridge @ (at - [1.0, 0.0])
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, gradient)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-3), float(at[1])


@dataclass
class Model:
    """What the tasks need to score a text."""

    terms: list[tuple[str, float]]
    index: BlockMaxIndex
    slope: float = 1.0
    intercept: float = 0.0
    neighbours: int = NEIGHBOURS

    def scorer(self) -> Callable[[str | None], tuple[float, list[tuple[str, float, int]]]]:
        vectors = Vectors(self.terms)

        def score(text: str | None) -> tuple[float, list[tuple[str, float, int]]]:
            share, evidence = self.index.vote(*vectors(text), self.neighbours)
            return float(1 / (1 + np.exp(-(self.slope * logit(share) + self.intercept)))), evidence

        return score


def learned(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, chi_squared: float = CHI_SQUARED, neighbours: int = NEIGHBOURS) -> Model:
    """Model from a sample of labelled rows; without examples every score is one half."""
    rows = examples(docs, labels, most)
    index_rows = rows.where("fold <> 1")
    terms = kept_terms(index_rows, chi_squared)

    def make() -> Callable[..., tuple]:
        vectors = Vectors(terms)
        return lambda text: vectors(text)

    made = with_mapped(rows, "ids array<int>, weights array<double>", make, ["text"], ["doc_id", "toxic", "fold"])
    found = [(str(r.doc_id), r.toxic, r.ids, r.weights, r.fold) for r in made.collect()]  # at most ``most`` short vectors
    index = BlockMaxIndex.of([f[:4] for f in found if f[4] != 1], max(1, len(terms)))
    judged = [f for f in found if f[4] == 1]
    shares = np.array([index.vote(ids, weights, neighbours)[0] for _, _, ids, weights, _ in judged])
    slope, intercept = curve(shares, np.array([f[1] for f in judged], dtype=int)) if judged else (1.0, 0.0)
    return Model(terms, index, slope, intercept, neighbours)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``evidence`` (example, cosine, label; nearest first) of each row.

    A text without kept terms, null and empty ones too, has the share of toxic examples among those without terms, and no
    evidence. Rows with equal or null ids are each returned; other columns are not read; an empty table gives no rows.
    """
    def make() -> Callable[..., tuple]:
        score = model.scorer()

        def run(text: str | None) -> tuple:
            value, evidence = score(text)
            return value, [{"example": e, "cosine": c, "toxic": t} for e, c, t in evidence]

        return run

    made = with_mapped(docs, "score double, evidence array<struct<example:string,cosine:double,toxic:int>>", make, ["text"], ["doc_id"])
    return made.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
