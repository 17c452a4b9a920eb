"""Benchmark decontamination by multi-pattern search after Wu and Manber, with words as letters.

Patterns are the windows of ``width`` words of the benchmark items. A table of blocks (two adjacent words) tells how
far the search may jump; where it may not, the hash of the window's last block picks the few patterns to test, the
word at the front rules most of them out, and a direct comparison confirms the rest. Items of fewer words are one
pattern each, searched with a table of their own length.

Spark writes the benchmark into the shared folder in blocks of bounded size; the driver sees their number only. A task
reads one block at a time, makes its tables and runs them over the texts it holds, so memory is one block and its tables
however many there are: no document is shuffled, no join is made, nothing is broadcast. The folder has to be one that
pyarrow opens on the executors (mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from adlumen.llm.common import ROW, SLICE, beside_row, parquet_batches, utf8
from adlumen.session import shared_dir

WIDTH = 13
BLOCK_BYTES = 2 * 1024 * 1024  # its tables take about 200 MB
HIT_SHARE = 20  # contaminated from one word in so many
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_BLANKS = bytes(0x20 if b in _SEPARATORS else b for b in range(256))
FOUND = "n_words long, n_hit long, spans array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8."""
    return utf8(text).lower().translate(_TO_BLANKS).split()


class Searcher:
    """Tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length = length
        self.single = length == 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            if self.single:
                self.buckets.setdefault(pattern[0], []).append((pattern, items))
                continue
            for end in range(1, length):
                block = pattern[end - 1:end + 1]
                distance = length - 1 - end
                if distance < self.shift.get(block, length - 1):
                    self.shift[block] = distance
            self.buckets.setdefault(pattern[-2:], []).append((pattern, items))

    def found(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of every occurrence."""
        n, length, shift, buckets = len(words), self.length, self.shift, self.buckets
        if self.single:
            for i, word in enumerate(words):
                for _, items in buckets.get(word, ()):
                    yield i, items
            return
        far, at = length - 1, length - 1
        while at < n:
            block = (words[at - 1], words[at])
            jump = shift.get(block, far)
            if jump:
                at += jump
                continue
            start = at - far
            first, window = words[start], None
            for pattern, items in buckets[block]:
                if pattern[0] == first:
                    window = window or tuple(words[start:at + 1])
                    if pattern == window:
                        yield start, items
            at += 1


def searchers(items: list[tuple[str, str | None]], width: int = WIDTH) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(width, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            patterns = by_length.setdefault(length, {}).setdefault(tuple(words[start:start + length]), [])
            if not patterns or patterns[-1] != item:
                patterns.append(item)
    return [Searcher(patterns, length) for length, patterns in sorted(by_length.items())]


def _merged(spans: list[int], new: list[tuple[int, int]]) -> list[int]:
    """Disjoint sorted [start, end) pairs, flat, of both."""
    pairs = sorted([*zip(spans[::2], spans[1::2]), *new])
    out: list[int] = []
    for start, end in pairs:
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


@dataclass(frozen=True)
class BenchmarkFiles:
    """Stored benchmark: the items (id, text) of block ``i`` are in the folder ``block=i``."""

    folder: str
    n_blocks: int

    def items(self, block: int) -> list[tuple[str, str]]:
        rows = [row for batch in parquet_batches(f"{self.folder}/block={block}") for row in batch.to_pylist()]
        return sorted((row["item_id"], row["text"]) for row in rows)


class Tables:
    """Searchers of one block at a time."""

    def __init__(self, files: BenchmarkFiles, width: int):
        self.files, self.width = files, width
        self.at, self.made = None, []

    def of(self, block: int) -> list[Searcher]:
        if block != self.at:
            self.made = []  # freed before the next are made
            self.made, self.at = searchers(self.files.items(block), self.width), block
        return self.made


def _search(files: BenchmarkFiles, width: int, n_kept: int, out: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The text is the column after the kept ones."""
    types = [to_arrow_type(f.dataType) for f in out.fields[n_kept:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, order = Tables(files, width), list(range(files.n_blocks))
        for batch in batches:
            n, texts = batch.num_rows, batch.column(n_kept)
            n_words = [0] * n
            spans: dict[int, list[int]] = {}
            items: dict[int, set[str]] = {}
            for block in order or [None]:
                searched = [] if block is None else tables.of(block)
                for low in range(0, n, SLICE):
                    for row, text in enumerate(texts.slice(low, SLICE).to_pylist(), low):
                        words, new = words_of(text), []
                        n_words[row] = len(words)
                        for table in searched:
                            for start, names in table.found(words):
                                items.setdefault(row, set()).update(names)
                                new.append((start, start + table.length))
                        if new:
                            spans[row] = _merged(spans.get(row, []), new)
            order.reverse()  # the next batch begins with the tables that are made
            for low in range(0, n, SLICE):
                rows = range(low, min(n, low + SLICE))
                found = [spans.get(row, []) for row in rows]
                made = [
                    n_words[low:low + SLICE], [sum(f[1::2]) - sum(f[::2]) for f in found], found,
                    [sorted(items.get(row, ())) for row in rows]]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(low, SLICE) for i in range(n_kept)], *[pa.array(m, t) for m, t in zip(made, types)]],
                    names=out.fieldNames())

    return run


def stored_benchmark(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> BenchmarkFiles:
    """Write the items with an id and a text once, in blocks of ``block_bytes`` expected bytes.

    A block takes the different (id, text) that hash to it, so neither a repeated row nor a frequent id makes one larger;
    an item of more bytes is in a block whole. A benchmark without such items has no block.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = BenchmarkFiles(f"{shared_dir(benchmark.sparkSession)}/corpus/benchmark-{uuid.uuid4().hex}", -(-total // block_bytes))
    if files.n_blocks:
        numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(files.n_blocks)))
        numbered.repartition("block").write.partitionBy("block").parquet(files.folder)
    return files


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str, keep: list[str], width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_hit``, ``spans`` (disjoint [start, end) of hit words, flat) and sorted ``items`` of each row."""
    files = stored_benchmark(benchmark, block_bytes)
    out = T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL(FOUND).fields])
    return docs.select(*keep, F.col(text).alias("_searched")).mapInArrow(_search(files, width, len(keep), out), out)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = HIT_SHARE) -> DataFrame:
    """Contamination of each row of ``docs`` (``doc_id``, ``text``) by ``benchmark`` (``item_id``, ``text``).

    A null text has no words; an item without id, text or words has no window; texts that share an id are one item; rows with
    equal or null ids are each judged; other columns are not read; empty tables give no rows or no hits.
    """
    found = occurrences(docs, benchmark, "text", ["doc_id"], width)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words"), share).alias("contaminated"),
    )


def is_contaminated(n_hit, n_words, share: int = HIT_SHARE):
    return (n_hit > 0) & (n_hit * share >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = HIT_SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged. Other columns may have any name.

    Null and empty texts have no words and stay; rows with equal or null ids and repeated rows are each judged; an
    empty benchmark keeps all rows, an empty table gives no rows.
    """
    kept = occurrences(beside_row(docs, _text="text"), benchmark, "_text", [ROW], width)
    return kept.where(~is_contaminated(F.col("n_hit"), F.col("n_words"), share)).select(f"{ROW}.*")
