"""Near duplicates by exact Jaccard similarity of word shingles.

Texts are sets of shingles of ``SHINGLE`` words (A-Z in lower case), a shorter text being one shingle; texts of equal sets
are one node. Two nodes are linked if their sets have a similarity of ``LEAST`` or more, and no such pair is missed:

* In any one order of all shingles, the first ``n - ceil(LEAST n) + 1`` shingles of two near sets (n being a set's own size)
  have one in common. These are the keys of a set. Rare shingles come first, so that sets which share but a passage or a
  template seldom meet. How rare they are is told by a table of counts per hash slot, of fixed size; counts that are off
  cost time only, as every set is ordered by the same table.
* Keys with the same members are one bucket. Its members are compared by parity sketches: the slots in which two sets have
  different parities are no more than the shingles in which they differ, so too many of them rule a pair out for sure. What
  is not ruled out makes groups, over all buckets; each set travels to its group once.
* The sets of a group are compared where they are, by a walk: a set that is near to another one joins it and is not compared
  with its like again. So a group gives fewer links than it has members, all verified, and the components are those of all
  pairs. Buckets and groups of over ``CELL`` shingles are cut into cells that together meet every pair.

Sets are hashed anew where they are needed, as they take more room than the texts; a text with many copies sends its keys
once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.llm.common import released, slices, utf8, with_mapped, written
from adlumen.llm.components import components
from adlumen.llm.simhash import CELL as FINGERPRINTS, REACH, fingerprint, identified, least_rows, members_of

SHINGLE = 5
#: Least similarity as a fraction.
LEAST = (4, 5)
#: Slots of the table of counts (one byte each, 8 MB), packed in chunks; shingles of a bucket that one task compares.
SLOT_BITS, CHUNK_BITS = 23, 16
#: Slots of the filter of ids, one bit each.
FILTER_BITS = 27
CELL = 4_000_000


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; empty without words."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:max(1, len(words) - width + 1)]
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def node_of(hashes: np.ndarray) -> bytes:
    """Name of a set, 128 bits."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def keys_of(hashes: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """Distinct keys of a set; two sets near to each other share at least one under the same ``levels`` of the slots."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    first = n + n * -LEAST[0] // LEAST[1] + 1
    order = np.argsort(levels[_slots(hashes)], kind="stable") if levels is not None else np.arange(n)
    return hashes[order[:first]]


# --- sets and keys ------------------------------------------------------------------------------


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles per slot, eight slots per shingle or more, a power of two and 64 at least; in words of 64 slots."""
    slots = 1 << max(6, int(8 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer slots."""
    while len(sketch) > words:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def with_sketch(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``fp`` (the node), the ``size`` and ``sketch`` of its set, and the ``mark`` of the text: its SimHash fingerprint."""

    def make() -> Callable[..., tuple]:
        def run(value: str | None) -> tuple:
            hashes = shingles(value)
            return node_of(hashes), len(hashes), sketch_of(hashes).tobytes(), fingerprint(value)

        return run

    return with_mapped(df, "fp binary, size int, sketch binary, mark long", make, [text], keep)


def _new_sets(batches: Iterator[pa.RecordBatch], wanted: Callable[[bytes], bool] = lambda node: True) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """Nodes and sets of a few texts (column 0), each node once per task."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        found = []
        for text in batch.column(0).to_pylist():
            hashes = shingles(text)
            node = node_of(hashes)
            if node not in seen and wanted(node):
                found.append((node, hashes))
            seen.add(node)
        if found:
            yield found


def slot_levels(texts: DataFrame) -> np.ndarray:
    """A byte per slot that grows with the number of its shingles, over all nodes.

    A task leaves out the slots that it meets once: these are the rare ones. So few rows travel, and 2^23 bytes in all reach
    the driver, packed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for found in _new_sets(batches):
            slots, counts = np.unique(_slots(np.concatenate([h for _, h in found])), return_counts=True)
            total[slots] += counts.astype(np.int32)
        at = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["slot", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots, counts = (batch.column(i).to_numpy() for i in (0, 1))
            levels = np.minimum(255, np.log2(counts + 1) * 6).astype(np.uint8)
            for chunk in np.unique(slots >> CHUNK_BITS):
                inside = slots >> CHUNK_BITS == chunk
                chunks.setdefault(int(chunk), np.zeros(1 << CHUNK_BITS, np.uint8))[slots[inside] & ((1 << CHUNK_BITS) - 1)] = levels[inside]
        yield pa.RecordBatch.from_arrays([
            pa.array(list(chunks), pa.int32()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], names=["chunk", "levels"])

    counted = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    packed = counted.repartition(F.shiftright("slot", CHUNK_BITS)).mapInArrow(pack, "chunk int, levels binary")
    levels = np.zeros((1 << (SLOT_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for row in packed.collect():  # 128 rows at most
        levels[row.chunk] = np.frombuffer(row.levels, np.uint8)
    return levels.ravel()


def _keys(texts: DataFrame) -> DataFrame:
    """(``key``, ``id``, ``size``): the keys of every node, at most once per task.

    ``id`` has 64 bits of the node. Sets are fetched by it, so two nodes that share one are both fetched and compared.
    """
    levels = texts.sparkSession.sparkContext.broadcast(slot_levels(texts))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _new_sets(batches):
            keys = [keys_of(hashes, levels.value) for _, hashes in found]
            counts = [len(k) for k in keys]
            ids = np.array([id_of(node) for node, _ in found], np.int64)
            sizes = np.array([len(h) for _, h in found], np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(sizes, counts))],
                names=["key", "id", "size"])

    return texts.mapInArrow(run, "key long, id long, size int")


def id_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def node_id(node: Column) -> Column:
    """``id_of`` as a native column."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _buckets(texts: DataFrame, cell: int) -> DataFrame:
    """(``key``, ``cell``, ``id``) of the nodes that meet, each set of members under one key only."""
    keys = _keys(texts)
    shared = written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"), "shingles-shared")
    met = written(keys.join(shared, "key"), "shingles-keys")
    # Members without another one of a size that can be near are out.
    up, down = LEAST
    by_size = Window.partitionBy("key").orderBy("size", "id")
    close = (F.lag("size").over(by_size) * down >= F.col("size") * up) | (F.col("size") * down >= F.lead("size").over(by_size) * up)
    members = written(met.distinct().withColumn("close", close).where("close").drop("close"), "shingles-close")
    alike = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor("id").alias("one"), F.bit_xor(F.xxhash64("id")).alias("two"))
    once = alike.groupBy("n", "one", "two").agg(F.min(F.struct("key", "total")).alias("b")).select("b.key", "b.total")
    found = written(in_cells(members.join(written(once, "shingles-buckets"), "key"), cell), "shingles-members")
    released(shared, met, members)
    return found


def in_cells(members: DataFrame, cell: int) -> DataFrame:
    """(``key``, ``cell``, ``id``): a key whose members have over ``cell`` shingles in ``total`` in cells that together meet every pair."""
    salts = F.when(F.col("total") > cell, F.ceil(F.col("total") * 2 / cell)).otherwise(1).cast("int")
    salted = members.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda other: other != F.col("salt"))
    cells = F.transform(others, lambda other: F.least(other, F.col("salt")) * F.col("salts") + F.greatest(other, F.col("salt")))
    return salted.select("key", F.explode(F.when(F.col("salts") > 1, cells).otherwise(F.array(F.lit(0)))).alias("cell"), "id")


# --- comparing ----------------------------------------------------------------------------------


def forest(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Links (a member, the members it brings in) of a spanning forest of the near pairs of ``sets``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(len(values), bool)
    left = np.argsort(sizes, kind="stable")
    up, down = LEAST
    empty = left[sizes[left] == 0]
    if len(empty) > 1:
        yield int(empty[0]), empty[1:]
    left = left[sizes[left] > 0]
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            node = front.pop()
            low, high = np.searchsorted(sizes[left], [-(-sizes[node] * up // down), sizes[node] * down // up + 1])
            tried = left[low:high]
            if not len(tried):
                continue
            own = codes[starts[node]:starts[node + 1]]
            flags[own] = True
            ends = np.cumsum(sizes[tried])
            at = np.arange(ends[-1]) + np.repeat(starts[tried] - (ends - sizes[tried]), sizes[tried])
            both = np.add.reduceat(flags[codes[at]], ends - sizes[tried], dtype=np.int64)
            flags[own] = False
            met = both * down >= up * (sizes[tried] + sizes[node] - both)
            if met.any():
                yield node, tried[met]
                front.extend(tried[met].tolist())
                left = np.concatenate([left[:low], tried[~met], left[high:]])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each bucket, without the key columns that come first; rows come sorted by key."""
    held: list[tuple] = []
    last: tuple | None = None
    for batch in slices(batches):
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if row[:n_keys] != last:
                if held:
                    yield last, held
                held, last = [], row[:n_keys]
            held.append(row[n_keys:])
    if held:
        yield last, held


def possible(sizes: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Numbers of groups of sets that are not ruled out to be near, directly or by others; -1 for sets that are with none."""
    group = np.full(len(sizes), -1)
    order = np.argsort(sizes, kind="stable")
    by_words: dict[int, np.ndarray] = {}
    left, up, down = order, *LEAST
    while len(left):
        start, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            low, high = np.searchsorted(sizes[left], [-(-sizes[node] * up // down), sizes[node] * down // up + 1])
            tried = left[low:high]
            if not len(tried):
                continue
            words = min(len(sketches[node]), len(sketches[tried[0]]))
            if words not in by_words:
                by_words[words] = np.stack([folded(s, words) if len(s) >= words else np.zeros(words, np.uint64) for s in sketches])
            apart = np.bitwise_count(by_words[words][tried] ^ by_words[words][node]).sum(axis=1, dtype=np.int64)
            met = apart <= (down - up) * (sizes[tried] + sizes[node]) // (down + up)
            if met.any():
                group[start] = start
                group[tried[met]] = start
                front.extend(tried[met].tolist())
                left = np.concatenate([left[:low], tried[~met], left[high:]])
    return group


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (ids) from the first member of each possible group of a bucket to the others."""
    for _, rows in _groups(batches, 2):
        ids, sizes, sketches = zip(*rows)
        group = possible(np.array(sizes, np.int64), [np.frombuffer(s, np.uint64) for s in sketches])
        kept = np.flatnonzero((group >= 0) & (group != np.arange(len(group))))
        if len(kept):
            numbers = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[group[kept]]), pa.array(numbers[kept])], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of every cell."""
    for _, rows in _groups(batches, 2):
        nodes, sets = zip(*rows)
        pairs = [(nodes[a], nodes[b]) for a, met in forest([np.frombuffer(s, np.uint64) for s in sets]) for b in met.tolist()]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in zip(*pairs)], names=["a", "b"])


def _id_filter(ids: DataFrame) -> Callable[[], np.ndarray]:
    """A bit per slot of the ids (2^FILTER_BITS, 16 MB): says of most other ids that they are not among them."""
    low, chunk_bits = FILTER_BITS - CHUNK_BITS - 3, CHUNK_BITS + 3

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for chunk in np.unique(slots >> chunk_bits):
                bits = chunks.setdefault(int(chunk), np.zeros(1 << chunk_bits, bool))
                bits[slots[slots >> chunk_bits == chunk] & ((1 << chunk_bits) - 1)] = True
        yield pa.RecordBatch.from_arrays([
            pa.array(list(chunks), pa.int32()), pa.array([np.packbits(c).tobytes() for c in chunks.values()], pa.binary())], names=["chunk", "bits"])

    slots = ids.select(F.shiftrightunsigned("id", 64 - FILTER_BITS).alias("slot")).distinct()
    packed = slots.repartition(F.shiftright("slot", chunk_bits)).mapInArrow(pack, "chunk int, bits binary")
    bits = np.zeros((1 << low, 1 << CHUNK_BITS), np.uint8)
    for row in packed.collect():  # 16 MB at most
        bits[row.chunk] = np.frombuffer(row.bits, np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(bits.ravel())
    return lambda: sent.value


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(``id``, ``node``, ``hashes``) of the nodes with one of ``ids``, and of a few others; a node once per task at most."""
    bits = _id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = bits()

        def wanted(node: bytes) -> bool:
            slot = int.from_bytes(node[:8], "big") >> (64 - FILTER_BITS)
            return bool(present[slot >> 3] >> (7 - (slot & 7)) & 1)

        for found in _new_sets(batches, wanted):
            yield pa.RecordBatch.from_arrays([
                pa.array([id_of(node) for node, _ in found], pa.int64()), pa.array([node for node, _ in found], pa.binary()),
                pa.array([hashes.tobytes() for _, hashes in found], pa.binary())], names=["id", "node", "hashes"])

    return texts.mapInArrow(run, "id long, node binary, hashes binary")


def components_of(texts: DataFrame, sketches: DataFrame, cell: int = CELL) -> DataFrame:
    """(``node``, ``root``) of the nodes of ``texts`` (``text``) that are near to another one, directly or by others.

    ``sketches`` (``fp``, ``size``, ``sketch``) is a written table of the same texts, made by ``with_sketch``.
    """
    buckets = _buckets(texts.select("text"), cell)
    of_id = sketches.groupBy(node_id(F.col("fp")).alias("id"), "fp").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sorted_by = lambda df: df.repartition("key", "cell").sortWithinPartitions("key", "cell")
    sketched = buckets.join(of_id, "id").select("key", "cell", "id", "size", "sketch")
    possible_links = written(sorted_by(sketched).mapInArrow(_sifted, "a long, b long").distinct(), "shingles-possible")
    released(buckets)
    parts = written(components(possible_links, "shingles-parts"), "shingles-parts").select(F.col("node").alias("id"), F.col("root").alias("key"))
    sizes = sketches.select(node_id(F.col("fp")).alias("id"), "size").join(parts, "id").groupBy("id", "key").agg(F.max("size").alias("size"))
    totals = sizes.groupBy("key").agg(F.sum("size").alias("total"))
    left = written(in_cells(parts.join(totals, "key"), cell), "shingles-left")
    once = _sets_of(texts.select("text"), left).groupBy("id", "node").agg(F.first("hashes").alias("hashes"))
    dealt = left.join(once, "id").select("key", "cell", "node", "hashes")
    return components(sorted_by(dealt).mapInArrow(_linked, "a binary, b binary"), "shingles-links")


def with_marks(members: DataFrame, rows: DataFrame, reach: int = REACH) -> DataFrame:
    """``members`` (``fp``, ``root``) with the components that texts of near fingerprints share made one.

    ``rows`` (``fp``, ``mark``) has the fingerprint of every text; those at most ``reach`` bits apart link.
    """
    alike = members_of(rows.select(F.col("mark").alias("fp")), reach, FINGERPRINTS)
    names = alike.select(F.col("fp").alias("mark"), F.col("root").alias("alike"))
    roots = written(rows.select("fp", "mark").distinct().join(members, "fp").join(names, "mark").select("alike", "root").distinct(), "shingles-alike")
    least = roots.groupBy("alike").agg(F.min("root").alias("b"))
    links = roots.join(least, "alike").where("root <> b").select(F.col("root").alias("a"), "b")
    tops = components(links, "shingles-tops").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return members.join(tops, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component with the smallest id, unchanged; ids are compared as they are, null last.

    Texts are linked by their fingerprints, as ``simhash.near_duplicates`` links them, and by the similarity of their sets,
    which also finds the near texts whose fingerprints differ in more bits. Null and empty texts have the empty set and are
    one node. Of equal ids in a component, and of rows without id, the one with the smallest hash of the row's plain columns
    stays. An empty table gives no rows.
    """
    beside = identified(docs)
    sketched = written(with_sketch(beside.select("_id", "_tie", "_text"), "_text", ["_id", "_tie"]), "shingles-rows")
    found = written(components_of(docs, sketched).withColumnRenamed("node", "fp"), "shingles-found")
    rows = sketched.select("_id", "_tie", "fp")
    members = written(rows.select("fp").distinct().join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "shingles-members-of")
    return least_rows(beside, rows, written(with_marks(members, sketched), "shingles-roots"))
