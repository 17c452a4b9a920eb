"""SimHash near duplicates, found by generalised pigeonhole.

Two fingerprints that differ in at most ``reach`` bits must, if the bits are cut into parts with thresholds whose
``threshold + 1`` add up to ``reach + 1``, be within its threshold in at least one part. The bits are ordered so that
correlated ones share a part (the correlations come from all fingerprints); thresholds are given out by dynamic
programming on the estimated numbers of keys and candidates. Every fingerprint is put under its own value of a part
and probes all values within the part's threshold; candidates are verified on all 64 bits.

Equal fingerprints are one node. In a bucket, a breadth-first walk yields a spanning forest of the verified links
instead of all pairs: as many rows as members at most, with the same components. Buckets over ``cell`` members are
split into cells that together meet every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from adlumen.llm.common import ROW, beside_row, map_rows, utf8, with_mapped, written
from adlumen.llm.components import components

BITS = 64
SHINGLE = 4
SEED = 42
REACH = 4
CELL = 4096
#: Costs of a shuffled key and of a verified candidate, relative to each other.
KEY_COST, CANDIDATE_COST = 1.0, 0.004


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text; 0 without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:max(1, len(words) - width + 1)]
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    set_bits, n = np.zeros(BITS, np.int64), len(starts)
    for low in range(0, n, 1 << 16):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[low:low + (1 << 16)], stops[low:low + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return with_mapped(df, "fp long", lambda: lambda value: (fingerprint(value),), [text], keep)


# --- parts and thresholds ----------------------------------------------------------------------


def _bit_counts(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together: 64 x 64 sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().tolist(), float(n)], pa.float64())], names=["at", "n"])

    sums = fingerprints.select("fp").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for row in sums.collect():  # 4,097 numbers
        flat[row.at] = row.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    """Row per fingerprint, column 0 is its lowest bit."""
    return ((fps.astype(np.int64).view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def bit_order(n: int, together: np.ndarray) -> list[int]:
    """Bits in an order in which the next one is the one most correlated with the last four."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    order = [int(np.unravel_index(correlation.argmax(), correlation.shape)[0])]
    while len(order) < BITS:
        near = correlation[order[-4:]].sum(axis=0)
        near[order] = -1
        order.append(int(near.argmax()))
    return order


def _within(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0..most of the bits, given each bit's chance to differ."""
    exactly = np.zeros(most + 2)
    exactly[0] = 1.0
    for d in differ:
        exactly[1:] = exactly[1:] * (1 - d) + exactly[:-1] * d
        exactly[0] *= 1 - d
    return np.cumsum(exactly[:most + 1])


def _ball(bits: int, radius: int) -> int:
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (bits - k) // (k + 1)
    return total


def allocate(n: int, together: np.ndarray, reach: int = REACH) -> list[tuple[list[int], int]]:
    """Parts (bit numbers) with thresholds; parts that are not probed are left out."""
    order, share = bit_order(n, together), np.diag(together) / max(n, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, reach + 2):
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        # state: threshold + 1 spent so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            chance = _within(differ[part], reach)
            following: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in states.items():
                for threshold in range(-1, reach - spent + 1):
                    added = 0.0 if threshold < 0 else (
                        KEY_COST * n * _ball(len(part), threshold) + CANDIDATE_COST * n * n / 2 * float(chance[threshold]))
                    option = (cost + added, [*chosen, threshold])
                    if spent + threshold + 1 not in following or option < following[spent + threshold + 1]:
                        following[spent + threshold + 1] = option
            states = following
        cost, chosen = states[reach + 1]
        plan = [(part, threshold) for part, threshold in zip(parts, chosen) if threshold >= 0]
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


# --- candidates ---------------------------------------------------------------------------------


def _keys(parts: list[tuple[list[int], int]]) -> Callable[[], Callable[..., Iterator[tuple]]]:
    def make() -> Callable[..., Iterator[tuple]]:
        masks = []
        for bits, threshold in parts:
            flips = [0]
            for k in range(1, threshold + 1):
                flips += [sum(1 << b for b in chosen) for chosen in combinations(bits, k)]
            masks.append((sum(1 << b for b in bits), flips))

        def run(fp: int) -> Iterator[tuple]:
            for part, (mask, flips) in enumerate(masks):
                value = fp & mask
                for flip in flips:
                    key = value ^ flip
                    yield part, key - (1 << 64) if key >> 63 else key

        return run

    return make


def _forest(members: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the members of a bucket, by a breadth-first walk."""
    left = members
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(left ^ node) <= reach
            if near.any():
                met, left = left[near], left[~near]
                front.extend(met)
                yield np.full(len(met), node), met


def _bucket_links(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            fps = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            groups = np.split(fps, cuts)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, group in enumerate(groups):
                at = 0 if i == 0 else cuts[i - 1]
                key = tuple(keys[at])
                if key != last and held:
                    found += _forest(np.concatenate(held), reach)
                    held = []
                last = key
                held.append(group)
            if found:
                yield out(found)
        if held and (found := list(_forest(np.concatenate(held), reach))):
            yield out(found)

    return run


def links(fingerprints: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints (``fp``) at most ``reach`` bits apart."""
    n, together = _bit_counts(fingerprints)
    parts = allocate(n, together, reach)
    keys = map_rows(fingerprints.select("fp"), "part int, value long", _keys(parts), ["fp"], ["fp"])
    large = keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select(
        "part", "value", F.ceil(F.col("n") * 2 / cell).cast("int").alias("salts"))
    salted = keys.join(large, ["part", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda other: other != F.col("salt"))
    cells = F.transform(others, lambda other: F.least(other, F.col("salt")) * F.col("salts") + F.greatest(other, F.col("salt")))
    dealt = salted.select("part", "value", F.explode(F.coalesce(cells, F.array(F.lit(0)))).alias("cell"), "fp")
    grouped = dealt.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell")
    return grouped.mapInArrow(_bucket_links(reach), "a long, b long").distinct()


# --- documents ----------------------------------------------------------------------------------


def members_of(fingerprints: DataFrame, reach: int, cell: int) -> DataFrame:
    """(``fp``, ``root``) of every distinct fingerprint."""
    distinct = written(fingerprints.select("fp").distinct(), "simhash-distinct")
    found = components(links(distinct, reach, cell), "simhash-links")
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id reachable) of each row.

    Null and empty texts have fingerprint zero and are linked like any other; a null id gets the component of its
    fingerprint and is no component's name unless all its ids are null; equal ids and repeated rows are each
    returned; other columns are not read; an empty table gives no rows.
    """
    rows = written(with_fingerprint(docs, "text", ["doc_id"]), "simhash-rows")
    members = written(members_of(rows, reach, cell), "simhash-members")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = members.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(members.join(named, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """The row of each component with the smallest id, unchanged; ids are compared as they are, null last.

    Of equal ids in a component, and of rows without id, the one with the smallest hash of the row's plain columns stays.
    """
    beside = identified(docs)
    rows = written(with_fingerprint(beside.select("_id", "_tie", "_text"), "_text", ["_id", "_tie"]), "simhash-rows")
    return least_rows(beside, rows, written(members_of(rows, reach, cell), "simhash-members"))


def identified(docs: DataFrame) -> DataFrame:
    """Rows beside their id, text and the hash of their plain columns."""
    plain = [f"{ROW}.`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    return beside_row(docs, _id="doc_id", _text="text").withColumn("_tie", F.xxhash64(*plain))


def least_rows(beside: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """The least row of each root of ``members`` (``fp``, ``root``); ``rows`` has ``_id``, ``_tie`` and ``fp``."""
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_tie").alias("t"))
    best = rows.groupBy("fp").agg(F.min(order).alias("best")).join(members, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = best.select(F.col("best.i").alias("_id"), F.col("best.t").alias("_tie"))
    # Rows that agree in id and hash are repeated rows: one of them is enough.
    met = beside.select(ROW, "_id", "_tie").alias("d").join(
        kept.alias("k"), (F.col("d._tie") == F.col("k._tie")) & F.col("d._id").eqNullSafe(F.col("k._id")), "left_semi")
    repeated = rows.groupBy("_id", "_tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        met = met.dropDuplicates(["_id", "_tie"])
    return met.select(f"{ROW}.*")
