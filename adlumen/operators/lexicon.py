"""Lexicons of any size as tables: words and terms are joined to texts, and the plan does not grow with them.

:mod:`adlumen.functions.affect` puts its lists into regular expressions, which suits some hundred words. Here a lexicon
is a table that Spark broadcasts or shuffles as its size asks. Texts are known by the SHA-256 of their lower-cased
form, so equal texts are scored once, and only tokens are shuffled, not the texts.

Terms that may stand anywhere in a text are not joined, as a text has as many grams as letters: Spark writes the terms to
the shared folder, and tasks read them in blocks past their texts. No row is shuffled.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions.text import clean_string
from adlumen.operators.brand import parquet_batches
from adlumen.session import shared_dir

#: Letters by which a longer term is looked up before it is compared as a whole.
GRAM = 5
#: Terms that a task holds at a time.
BLOCK_TERMS = 100_000

#: Slots of the filter of grams, one byte each.
SLOT_BITS = 20

#: By the length of the gram: the slots of the grams, and the terms of each.
Block = dict[int, tuple[np.ndarray, dict[str, list[str]]]]


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_lowered", F.lower(clean_string(F.col(text)))).withColumn("_text_key", F.sha2("_lowered", 256))


def precedence(lexicon: DataFrame) -> DataFrame:
    """One ``mark`` per term: a negator (0) goes before a positive word (1), that before a negative one (-1).

    Terms and marks that are null go.
    """
    known = lexicon.where(F.col("term").isNotNull() & F.col("mark").isNotNull())
    order = F.when(F.col("mark") == 0, 0).when(F.col("mark") > 0, 1).otherwise(2)
    return known.groupBy("term").agg(F.min(order).alias("_order")).select(
        "term", F.when(F.col("_order") == 2, -1).otherwise(F.col("_order")).alias("mark"))


def _mean_of_hits(hits: Column, negator_follows: bool) -> Column:
    """Mean mark of the sorted ``hits (at, mark)`` with negations; 0 without any."""

    def signed(hit: Column, i: Column) -> Column:
        other = F.get(hits, i + 1 if negator_follows else i - 1)
        negated = (other["mark"] == 0) & ((other["at"] == hit["at"] + 1) if negator_follows else F.lit(True))
        return F.when(F.coalesce(negated, F.lit(False)), -hit["mark"]).otherwise(hit["mark"])

    # A negator has mark 0 and adds nothing to the sum.
    total = F.aggregate(F.transform(hits, signed), F.lit(0), lambda a, b: a + b)
    n = F.size(F.filter(hits, lambda hit: hit["mark"] != 0))
    return F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))


def with_lexicon_compound(
    df: DataFrame, lexicon: DataFrame, text: str = "text_content", name: str = "compound", letters: str = "a-z'",
    negator_follows: bool = False,
) -> DataFrame:
    """``df`` plus the mean of the lexicon's hits in every text, by ``lexicon (term, mark)`` with marks 1, -1 and 0.

    A token is a run of ``letters`` of the lower-cased text. A negator (mark 0) flips the next hit, however far away it
    is; with ``negator_follows`` one that is the very next token flips the hit before it. Null and empty texts and
    texts without hits score 0; repeated terms count by :func:`precedence`.
    """
    rows = _keyed(df, text)
    tokens = rows.select("_text_key", F.posexplode(F.regexp_extract_all("_lowered", F.lit(f"[{letters}]+"), 0)).alias("at", "term"))
    found = tokens.join(precedence(lexicon), "term")
    # A set, so that copies of a text add nothing: they are merged before the shuffle.
    hits = found.groupBy("_text_key").agg(F.sort_array(F.collect_set(F.struct("at", "mark"))).alias("_hits"))
    scores = hits.select("_text_key", _mean_of_hits(F.col("_hits"), negator_follows).alias("_score"))
    kept = [F.col(c) for c in df.columns if c != name]
    return rows.join(scores, "_text_key", "left").select(*kept, F.coalesce("_score", F.lit(0.0)).alias(name))


def _gram_slots(text: str, n: int) -> np.ndarray:
    """The slot of each gram of ``n`` characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    mixed = np.zeros(max(0, len(codes) - n + 1), np.uint32)
    for k in range(n):
        mixed = mixed * np.uint32(16_777_619) + codes[k:k + len(mixed)]
    return mixed * np.uint32(2_654_435_769) >> np.uint32(32 - SLOT_BITS)


def _block(terms: list[str], gram: int) -> Block:
    listed: dict[int, dict[str, list[str]]] = {}
    for term in terms:
        listed.setdefault(min(len(term), gram), {}).setdefault(term[:gram], []).append(term)
    block: Block = {}
    for n, grams in listed.items():
        known = np.zeros(1 << SLOT_BITS, bool)
        known[_gram_slots("".join(grams), n)[::n]] = True
        block[n] = known, grams
    return block


def _blocks(folder: str, gram: int, rows: int) -> Iterator[Block]:
    """The stored terms, about ``rows`` at a time."""
    terms: list[str] = []
    for batch in parquet_batches(folder, rows):
        terms += batch.column(0).to_pylist()
        if len(terms) >= rows:
            yield _block(terms, gram)
            terms = []
    if terms:
        yield _block(terms, gram)


def _held(folder: str, gram: int, rows: int) -> Callable[[], Iterator[Block]]:
    """The blocks, read anew each time, but for terms of one block, which is kept."""
    first = list(itertools.islice(_blocks(folder, gram, rows), 2))
    if len(first) < 2:
        return lambda: iter(first)
    first.clear()
    return lambda: _blocks(folder, gram, rows)


def _n_terms(text: str, block: Block) -> int:
    found = 0
    for n, (known, listed) in block.items():
        grams = {text[i:i + n] for i in np.flatnonzero(known[_gram_slots(text, n)]).tolist()}
        found += sum(len(term) == n or term in text for gram in listed.keys() & grams for term in listed[gram])
    return found


def with_term_hits(
    df: DataFrame, terms: DataFrame, text: str = "text_content", name: str = "n_terms", gram: int = GRAM,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``df`` plus the number of different ``terms (term)`` that the lower-cased text contains, wherever they stand.

    Terms are looked up by their first ``gram`` characters among the grams of the text, and the candidates are then
    compared as wholes. Null and empty terms go; a null text contains none. Terms are taken as they are, not lower-cased.
    A task holds about ``block_terms`` terms; more are read in blocks, anew for every batch of texts.
    """
    folder = f"{shared_dir(df.sparkSession)}/terms/{uuid.uuid4().hex}"
    terms.where(F.length("term") > 0).select(F.col("term").cast("string").alias("term")).distinct().write.parquet(folder)

    @F.pandas_udf("int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blocks = _held(folder, gram, block_terms)
        for batch in batches:
            found = [0] * len(batch)
            for block in blocks():
                for i, lowered in enumerate(batch):
                    found[i] += _n_terms(lowered, block)
            yield pd.Series(found, dtype="int32")

    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, hits(F.lower(clean_string(F.col(text)))).alias(name))
