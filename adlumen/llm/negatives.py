"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt by hash into shards of about ``SHARD`` rows; all anchors meet every shard, as a stream. A shard keeps a
sorted list of its rows per dimension. For an anchor the lists are read from the end its sign asks for, a stretch of all
lists at a time; rows met for the first time are scored in full, in integers. What the last rows read would score
together is the threshold: no unread row has more. Reading stops once the threshold is strictly below the last score that
counts, so rows that tie with it have all been met.

There are two searches: the first finds the positives (the best rows of the anchor's label), the second all negatives
whose score lies in the window of a positive, one window per positive at a time. The best of a shard are few per anchor
and are merged by a window function that keeps partial ranks before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.llm.common import written

SHARD = 8192
FIRST_STRETCH = 16
SCALE, LARGEST = 256, 1 << 24
ANCHOR_STEP, SHIFTED_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95


def participants(embeddings: DataFrame) -> DataFrame:
    """(``vec_id``, ``tie``, ``label``, ``vec``) of the rows that take part; ``tie`` is a hash of label and vector."""
    value = F.col("embedding")
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & whole)
    label = F.when(F.col("vec_id") % SHIFTED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    scaled = F.transform(value, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("int"))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("vec"))
    return found.select("vec_id", F.xxhash64("label", "vec").alias("tie"), "label", "vec")


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; a shorter vector ends in zeros, a longer one than ``width`` is cut."""
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


class SortedLists:
    """Rows of a shard with the order of every dimension."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        _, once = np.unique(np.stack([ids, ties], axis=1), axis=0, return_index=True)  # repeated rows count once
        self.ids, self.ties, self.labels, matrix = ids[once], ties[once], labels[once], matrix[once]
        # Products of doubles are exact here as long as the sums stay below 2^53.
        exact = matrix.shape[1] * float(np.abs(matrix).max(initial=0)) * LARGEST < 2 ** 53
        self.matrix = matrix.astype(np.float64 if exact else np.int64)
        self.order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.matrix, self.order.astype(np.int64), axis=0)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows met anew and their scores, with the threshold for the others (none after the last row)."""
        anchor = anchor.astype(self.matrix.dtype)
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth, stretch = np.zeros(n, bool), 0, FIRST_STRETCH
        while depth < n:
            end = min(n, depth + stretch) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            if end == n:
                met[:] = True
            else:
                met[self.order[n - end:n - depth, up].ravel()] = True
                met[self.order[depth:end, down].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            threshold = None if seen.all() else int(self.values[n - end, up] @ anchor[up] + self.values[end - 1, down] @ anchor[down])
            yield fresh, (self.matrix[fresh] @ anchor).astype(np.int64), threshold
            if threshold is None:
                return
            depth, stretch = end, 2 * stretch

    def best(self, anchor: np.ndarray, counts: np.ndarray, k: int, windows: list[tuple[int | None, int | None]]) -> list[list[tuple[int, int, int]]]:
        """Per window of scores (low, high) the first ``k`` rows of ``counts``: id, tie and score."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside: list[np.ndarray] = []
        for fresh, new, threshold in self.read(anchor):
            fits = counts[fresh]
            rows, scores = np.concatenate([rows, fresh[fits]]), np.concatenate([scores, new[fits]])
            inside = [
                np.flatnonzero((scores >= low if low is not None else True) & (scores <= high if high is not None else np.ones(len(scores), bool)))
                for low, high in windows]
            if threshold is None or all(self._settled(scores[at], k, low, threshold) for at, (low, _) in zip(inside, windows)):
                break
        found = []
        for at in inside:
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
            order = at[np.lexsort((self.ties[rows[at]], self.ids[rows[at]], -scores[at]))][:k]
            found.append([(int(self.ids[rows[i]]), int(self.ties[rows[i]]), int(scores[i])) for i in order])
        return found

    @staticmethod
    def _settled(scores: np.ndarray, k: int, low: int | None, threshold: int) -> bool:
        if len(scores) >= k:
            return threshold < int(np.partition(scores, -k)[-k])
        return low is not None and threshold < low


def window_of(score: int) -> tuple[int, int]:
    """Negative scores s with LEAST_PERCENT * score <= 100 * s <= MOST_PERCENT * score."""
    return -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100


def _searched(rows: DataFrame, anchors: DataFrame, n_shards: int, same_label: bool, k: int) -> DataFrame:
    """The best ``k`` rows of every shard per anchor and window number (``no``); ``anchors`` has ``scores`` of its positives."""
    shard = F.pmod(F.xxhash64("vec_id", "tie"), F.lit(n_shards)).cast("int")
    columns = ["shard", "is_anchor", "vec_id", "tie", "label", "vec", "scores"]
    dealt = rows.select(shard.alias("shard"), F.lit(False).alias("is_anchor"), *columns[2:6], F.lit(None).cast("array<long>").alias("scores")).union(
        anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("is_anchor"), *columns[2:]))
    names = ["anchor_id", "anchor_tie", "no", "vec_id", "tie", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        lists: SortedLists | None = None
        current: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, is_anchor = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(low, high - low)
                if shards[low] != current:
                    current, held, lists = shards[low], [], None
                if not is_anchor[low]:
                    held.append(part)
                    continue
                if lists is None:
                    if not held:
                        continue  # a shard without rows
                    table = pa.Table.from_batches(held).combine_chunks()
                    numbers = [table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "tie", "label")]
                    lists, held = SortedLists(*numbers, _matrix(table.column("vec").chunk(0))), []
                yield from _answered(lists, part, same_label, k, names)

    grouped = dealt.repartition("shard").sortWithinPartitions("shard", "is_anchor")
    return grouped.mapInArrow(run, "anchor_id long, anchor_tie long, no int, vec_id long, tie long, score long")


def _answered(lists: SortedLists, anchors: pa.RecordBatch, same_label: bool, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    column = lambda name: anchors.column(anchors.schema.get_field_index(name))
    out: list[tuple] = []
    matrix = _matrix(column("vec"), lists.matrix.shape[1])
    for anchor, vec_id, tie, label, scores in zip(matrix, *(column(c).to_pylist() for c in ("vec_id", "tie", "label", "scores"))):
        counts = lists.labels == label if same_label else lists.labels != label
        if same_label:
            counts &= ~((lists.ids == vec_id) & (lists.ties == tie))
        windows = [(None, None)] if same_label else [window_of(s) for s in scores]
        for no, found in enumerate(lists.best(anchor, counts, k, windows)):
            out += [(vec_id, tie, no, *f) for f in found]
    if out:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out), kinds)], names=names)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and window over all shards, with their ``place`` from 1."""
    order = Window.partitionBy("anchor_id", "anchor_tie", "no").orderBy(F.desc("score"), "vec_id", "tie")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def is_anchor() -> Column:
    return F.col("vec_id") % ANCHOR_STEP == 0


def hard_negatives(embeddings: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores for every anchor and positive.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Repeated rows count
    once; different rows that share an id are rows of their own, and ties of equal ids go by a hash of label and vector.
    A vector shorter than others goes on with zeros. Scaled components end at 2^24 on both sides, so that scores are
    longs. An anchor without positives, or a positive without negatives, gives no row, as does an empty table.
    """
    rows = written(participants(embeddings), "negatives-rows")
    n_shards = max(1, -(-rows.count() // shard_rows))
    anchors = rows.where(is_anchor()).distinct()
    none = F.lit(None).cast("array<long>").alias("scores")
    positives = written(_first(_searched(rows, anchors.select("*", none), n_shards, True, POSITIVES), POSITIVES), "negatives-positives")
    listed = positives.groupBy("anchor_id", "anchor_tie").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("scores"))  # POSITIVES at most
    asked = anchors.join(listed.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_tie").alias("tie"), F.col("scores.score").alias("scores")), ["vec_id", "tie"])
    negatives = _first(_searched(rows, asked, n_shards, False, NEGATIVES), NEGATIVES)
    first = positives.select(
        "anchor_id", "anchor_tie", (F.col("place") - 1).alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(first, ["anchor_id", "anchor_tie", "no"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
