"""Text vectors from hashed character n-grams, weighted by rarity and scaled to unit length.

An offline stand-in for a sentence encoder: its scores are not comparable with an encoder's, so the
off-brand baseline has to be measured anew for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions.text import clean_string, collapse_spaces

TILE_BYTES = 1 << 16  # of text hashed at a time, but for a longer text: its arrays fit a core's cache


@dataclass(frozen=True)
class Embedder:
    """Weights of the n-grams by bucket: as many as the vectors have dimensions."""

    n: int
    weights: tuple[float, ...]


def _letters(text: Column) -> Column:
    return F.lower(collapse_spaces(clean_string(text)))


def murmur3(byte_at: Callable[[int], np.ndarray], lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """MurmurHash3 (32 bits) of many byte strings at once; ``byte_at(k)`` gives byte ``k`` of each, or anything past its end."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(word: np.ndarray) -> np.ndarray:
        return turned(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    state, longest = np.full(len(lengths), seed, np.uint32), int(lengths.max(initial=0))
    same = longest == lengths.min(initial=longest)
    for low in range(0, longest, 4):
        word = np.zeros(len(lengths), np.uint32)
        for k in range(low, min(low + 4, longest)):
            byte = byte_at(k).astype(np.uint32) << np.uint32(8 * (k - low))
            word |= byte if same else np.where(k < lengths, byte, np.uint32(0))
        # A word of fewer than four bytes, the last one, is mixed in without the second step.
        state ^= mixed(word)
        whole = turned(state, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        state = (whole if low + 4 <= longest else state) if same else np.where(low + 4 <= lengths, whole, state)
    state ^= lengths.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        state = (state ^ (state >> np.uint32(shift))) * np.uint32(factor)
    return state ^ (state >> np.uint32(16))


def _tile_counts(data: np.ndarray, sizes: np.ndarray, dimensions: int, n: int) -> np.ndarray:
    """Matrix of texts and buckets from the texts' UTF-8 bytes in a row and the bytes of each.

    A gram is hashed as its characters with blanks between them, as Spark ML's ``NGram`` and ``HashingTF`` do.
    """
    if not (data & 0x80).any():
        text = np.repeat(np.arange(len(sizes)), sizes)
        grams = max(0, len(text) - n + 1)
        lengths, blank = np.full(grams, 2 * n - 1), np.full(grams, 0x20, np.uint8)
        byte_at = lambda k: blank if k % 2 else data[k // 2:k // 2 + grams]
    else:
        first = (data & 0xC0) != 0x80
        number = np.cumsum(first) - 1  # of the character that a byte belongs to
        text = np.repeat(np.arange(len(sizes)), sizes)[first]
        grams = max(0, len(text) - n + 1)
        # Every character followed by a blank; a gram is a part of it without the last blank.
        spaced = np.full(len(data) + len(text) + 4 * n + n, 0x20, np.uint8)
        spaced[np.arange(len(data)) + number] = data
        starts = np.append((np.arange(len(data)) + number)[first], len(data) + len(text))
        lengths = starts[n:n + grams] - starts[:grams] - 1
        byte_at = lambda k: spaced[starts[:grams] + k]
    within = text[:grams] == text[n - 1:]
    buckets = murmur3(byte_at, lengths).view(np.int32) % np.int32(dimensions)
    cells = text[:grams] * dimensions + buckets
    return np.bincount(cells[within], minlength=len(sizes) * dimensions).reshape(len(sizes), dimensions)


def gram_counts(texts: pa.Array, dimensions: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of texts in the batch and how often each bucket's grams occur in them, a tile of texts at a time."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = sizes == pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    for alike in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        tiles = np.cumsum(sizes[alike]) // TILE_BYTES
        for at in np.split(alike, np.flatnonzero(np.diff(tiles)) + 1) if len(alike) else ():
            data = np.frombuffer(b"".join(texts.take(pa.array(at)).cast(pa.binary()).to_pylist()), np.uint8)
            yield at, _tile_counts(data, sizes[at], dimensions, n)


def fit_embedder(df: DataFrame, text: str, dimensions: int = 256, n: int = 3) -> Embedder:
    """Fit the n-gram weights on a table of texts: the driver gets one number per dimension."""

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, counts in gram_counts(batch.column(0), dimensions, n):
                found += np.count_nonzero(counts, axis=0)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "found": [found.tolist()]})

    tallied = df.select(_letters(F.col(text)).alias("_text")).mapInArrow(tallies, "rows long, found array<long>")
    sums = tallied.select("rows", F.posexplode("found").alias("bucket", "found")).groupBy("bucket").agg(
        F.sum("rows").alias("rows"), F.sum("found").alias("found"))
    weight = F.ln((F.col("rows") + 1.0) / (F.col("found") + 1.0))
    fitted = sums.select("bucket", "rows", weight.alias("weight")).orderBy("bucket").collect()
    if not fitted or not fitted[0].rows:
        raise ValueError("no texts to fit the weights on")
    return Embedder(n, tuple(row.weight for row in fitted))


def embed_text(df: DataFrame, model: Embedder, text: str, name: str = "text_vec") -> DataFrame:
    """Add the vector of ``text`` as an array of floats."""
    dimensions = len(model.weights)

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.array(model.weights)[:, None]
        for texts in batches:
            units = np.zeros((len(texts), dimensions), np.float32)
            for at, counts in gram_counts(texts, dimensions, model.n):
                weighted = counts.T * weights
                lengths = np.sqrt((weighted * weighted).sum(axis=0))
                units[at] = np.divide(weighted, lengths, out=np.zeros_like(weighted), where=lengths > 0).T
            ends = np.arange(0, units.size + 1, dimensions, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(units.ravel()))

    return df.select(*df.columns, vectors(_letters(F.col(text))).alias(name))


def encoder_column(load: Callable[[], Callable[[list[str]], np.ndarray]], text: Column) -> Column:
    """Vectors from any encoder: ``load`` runs once per worker and returns texts -> matrix."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.fillna("").tolist()), dtype=np.float32)))

    return encode(text)
