"""Removal of byte strings that repeat in the corpus, by deep-shallow sorting of sampled suffixes.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts anywhere else. Every window of that length
holds an anchor: of its ``GRAM``-byte strings the one with the least hash, the last of equal ones. The anchor depends on
the window's bytes alone, so equal windows have equal anchors at equal places, and only suffixes at anchors have to be
sorted. Neighbouring windows share their anchor; they are one run, kept as a few numbers.

1. Runs whose anchor string occurs once in the corpus cannot repeat. (A count per anchor, merged before the shuffle.)
2. Runs whose whole bytes occur twice repeat in full. (A count per run content.)
3. What is left shares an anchor string with other contents: the suffixes from the anchor are put in order by multikey
   quicksort to a shallow depth, and by blind tries where they agree for longer; the bytes before the anchor likewise.
   The common lengths of neighbours in both orders give the windows that repeat. The work is near linear in the
   contents of a group. Groups with more than ``GROUP`` contents are counted per window instead, by a mergeable
   aggregate, which gives the same result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from adlumen.llm.common import map_rows, slices, utf8, with_mapped, written

LENGTH = 200
GRAM = 32
CHUNK = 1 << 22
GROUP = 50_000
SHALLOW = 16
FEW = 12
_ODD = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


# --- anchors ------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _SPREAD
    width, step = 1, 0
    while width < gram:
        h = h[:-width] * _ODD[step % len(_ODD)] + h[width:]
        h ^= h >> np.uint64(29)
        h *= _SPREAD
        width, step = 2 * width, step + 1
    return h


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, last window, anchor, hash of the anchor string."""
    found = []
    for low in range(0, max(0, len(data) - length + 1), chunk):
        part = np.frombuffer(data, np.uint8, min(len(data), low + chunk + length - 1) - low, low)
        h = gram_hashes(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        # The higher half orders, the lower half makes the last of equal hashes the least.
        least = _least_in_windows((h >> np.uint64(32) << np.uint64(32)) | (_LOW - place), length - gram + 1)
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        stops = np.concatenate([starts[1:], [len(anchor)]]) - 1
        at = anchor[starts]
        found.append((starts + low, stops + low, at + low, h[at].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _tie(text: str | None) -> int:
    """What ``F.xxhash64`` gives for the text."""
    return 42 if text is None else int.from_bytes(xxhash.xxh64_digest(utf8(text), 42), "big", signed=True)


def _rows_of(docs: DataFrame, columns: str) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(columns).fields])


def _all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all documents: ``doc_id``, ``tie``, ``anchor``, ``content``, ``first``, ``windows``, ``before``."""
    out = _rows_of(docs, "tie long, anchor long, content long, first int, windows int, before int")
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            parts, rows, ties, size = [], [], [], 0
            texts = batch.column(1).to_pylist()

            def made() -> pa.RecordBatch:
                counts = [len(p[0]) for p in parts]
                columns = [batch.column(0).take(pa.array(np.repeat(rows, counts), pa.int64())), pa.array(np.repeat(np.array(ties, np.int64), counts), pa.int64())]
                columns += [pa.array(np.concatenate([p[i] for p in parts]), t) for i, t in enumerate(types[2:])]
                return pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

            for i, text in enumerate(texts):
                data = utf8(text)
                first, last, anchor, gram_hash = runs(data, length, gram)
                if not len(first):
                    continue
                content = np.fromiter(
                    (digest(data[a:b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)).view(np.int64)
                parts.append((gram_hash, content, first.astype(np.int32), (last - first + 1).astype(np.int32), (anchor - first).astype(np.int32)))
                rows.append(i)
                ties.append(_tie(text))
                size += len(first)
                if size > 50_000:
                    yield made()
                    parts, rows, ties, size = [], [], [], 0
            if parts:
                yield made()

    return docs.select("doc_id", "text").mapInArrow(run, out)


# --- deep-shallow sorting -----------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Branch:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.children, self.leaf = depth, {}, leaf


def _letter(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> Iterator[tuple[int, int]]:
    """(member, common length with the one before) of the members in order; all agree up to ``depth``.

    Branches hold only the depth and the letters at which strings part. A string goes down by these letters without
    comparing what is skipped, is compared once with the leaf it meets, and is put in where the two part.
    """
    root: _Branch | int = members[0]
    equal: dict[int, list[int]] = {members[0]: [members[0]]}
    for new in members[1:]:
        s, node = strings[new], root
        while isinstance(node, _Branch):
            child = node.children.get(_letter(s, node.depth))
            node = node.leaf if child is None else child
        other = strings[node]
        parted = common(s, other, depth)
        if parted == len(s) == len(other):
            equal[node].append(new)
            continue
        equal[new] = [new]
        above, letter, node = None, 0, root
        while isinstance(node, _Branch) and node.depth < parted:
            above, letter = node, _letter(s, node.depth)
            node = node.children[letter]
        if isinstance(node, _Branch) and node.depth == parted:
            node.children[_letter(s, parted)] = new
            continue
        branch = _Branch(parted, new)
        branch.children[_letter(other, parted)] = node
        branch.children[_letter(s, parted)] = new
        if above is None:
            root = branch
        else:
            above.children[letter] = branch
    stack: list[tuple[_Branch | int, int]] = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, _Branch):
            ordered = sorted(node.children.items(), reverse=True)
            stack += [(child, node.depth) for _, child in ordered[:-1]]
            stack.append((ordered[-1][1], shared))
        else:
            for i, member in enumerate(equal[node]):
                yield member, len(strings[member]) if i else shared


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW, few: int = FEW) -> tuple[list[int], list[int]]:
    """Order of the strings and each one's common length with the one before; they agree up to ``depth``.

    Multikey quicksort by single letters up to ``shallow`` letters more; what still agrees then, and groups of ``few``
    or less, goes to a blind trie.
    """
    order: list[int] = []
    lengths: list[int] = []
    limit = depth + shallow
    stack = [(list(range(len(strings))), depth, depth)]
    while stack:
        members, at, shared = stack.pop()  # shared: with what stands before the group
        if len(members) <= few or at >= limit:
            for i, (member, length) in enumerate(blind_trie(strings, members, at)):
                order.append(member)
                lengths.append(length if i else shared)
            continue
        pivot = _letter(strings[members[len(members) // 2]], at)
        less = [m for m in members if _letter(strings[m], at) < pivot]
        same = [m for m in members if _letter(strings[m], at) == pivot]
        more = [m for m in members if _letter(strings[m], at) > pivot]
        groups = []
        for part, deeper in ((less, at), (same, at + 1 if pivot >= 0 else limit), (more, at)):
            if part:
                groups.append((part, deeper, at if groups else shared))
        if pivot < 0:  # equal strings: they end here
            groups = [(part, deeper if part is not same else max(limit, at), first) for part, deeper, first in groups]
        stack += reversed(groups)
    return order, lengths


def repeated_windows(contents: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each content (bytes, anchor's place, windows) the [first, last] windows that another content has too.

    All contents hold the same anchor string at their anchor. Contents are merged in falling order of their common
    length after the anchor; a merged set is kept in order of the bytes before the anchor, where only neighbours can
    have the most in common.
    """
    after = [data[at:] for data, at, _ in contents]
    before = [data[:at][::-1] for data, at, _ in contents]
    order, lengths = deep_shallow(after)
    left_order, left_lengths = deep_shallow(before)
    rank = [0] * len(contents)
    for i, member in enumerate(left_order):
        rank[member] = i
    found: list[list[tuple[int, int]]] = [[] for _ in contents]

    def left_common(a: int, b: int) -> int:
        return left_lengths[max(a, b)] if abs(a - b) == 1 else common(before[left_order[a]], before[left_order[b]])

    def met(a: int, b: int, right: int) -> None:
        left = left_common(a, b)
        if left + right < length:
            return
        for x in (left_order[a], left_order[b]):
            _, at, windows = contents[x]
            low, high = max(length - right, at - windows + 1), min(left, at)  # bytes before the anchor
            if low <= high:
                found[x].append((at - high, at - low))

    set_of = list(range(len(contents)))
    sets: dict[int, list[int]] = {i: [rank[order[i]]] for i in range(len(contents))}

    def top(i: int) -> int:
        while set_of[i] != i:
            set_of[i] = set_of[set_of[i]]
            i = set_of[i]
        return i

    for i in sorted(range(1, len(contents)), key=lambda i: -lengths[i]):
        a, b = top(i - 1), top(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets.pop(b)
        set_of[b] = a
        for r in small:
            place = bisect_left(large, r)
            if place:
                met(large[place - 1], r, lengths[i])
            if place < len(large):
                met(r, large[place], lengths[i])
            large.insert(place, r)
    return found


# --- corpus -------------------------------------------------------------------------------------

def _cut(length: int) -> Callable[[], Callable[..., Iterator[tuple]]]:
    """Bytes of the wanted runs of a document."""

    def make() -> Callable[..., Iterator[tuple]]:
        def run(tie: int, text: str | None, wanted: list) -> Iterator[tuple]:
            if _tie(text) != tie:
                return
            data = utf8(text)
            for w in wanted:
                yield (
                    w["anchor"], w["content"], w["first"], w["windows"], w["before"], w["n"],
                    data[w["first"]:w["first"] + w["windows"] + length - 1])

        return run

    return make


def _cut_windows(length: int) -> Callable[[], Callable[..., Iterator[tuple]]]:
    """Hash and place of every window of the wanted runs."""

    def make() -> Callable[..., Iterator[tuple]]:
        def run(tie: int, text: str | None, wanted: list) -> Iterator[tuple]:
            if _tie(text) != tie:
                return
            data = utf8(text)
            for w in wanted:
                for start in range(w["first"], w["first"] + w["windows"]):
                    h = xxhash.xxh3_128_digest(data[start:start + length])
                    yield h, w["anchor"], w["content"], start, w["n"]

        return run

    return make


def _sorted_groups(length: int, out) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Intervals from runs sorted by anchor; all runs of an anchor are in one partition."""
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        rows: list[tuple] = []

        def close() -> None:
            # A content stands once per row that repeats its document; its bytes are one string.
            distinct = {g[2]: g for g in group}
            members = list(distinct.values())
            if len(members) > 1:
                spans = repeated_windows([(g[7], g[5], g[4]) for g in members], length)
                for g, found in zip(members, spans):
                    if g[6] == 1:
                        rows.extend((g[0], g[8], g[3] + a, g[3] + b + length) for a, b in found)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=out.fieldNames())

        for batch in batches:
            columns = ["doc_id", "anchor", "content", "first", "windows", "before", "n", "bytes", "tie"]
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if group and row[1] != group[0][1]:
                    close()
                    group = []
                group.append(row)
            if len(rows) > 20_000:
                yield made()
                rows = []
        if group:
            close()
        if rows:
            yield made()

    return run


def _wanted(contents: DataFrame) -> DataFrame:
    """Runs to cut, gathered per document."""
    return contents.groupBy(F.col("place.doc_id").alias("_doc"), F.col("place.tie").alias("_tie")).agg(F.collect_list(F.struct(
        "anchor", "content", "place.first", "place.windows", "place.before", "n")).alias("wanted"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(``doc_id``, ``tie``, ``start``, ``end``) of byte ranges made of windows that occur elsewhere; they may overlap.

    ``tie`` is a hash of the text: rows that share an id and text are copies of each other.
    """
    found = _all_runs(docs, length, gram)
    # Written, so that the join reads it from a plain exchange and can split the runs of a frequent anchor.
    shared = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    kept = written(found.join(shared, "anchor"), "suffix-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "first", "windows", "before")
    contents = written(kept.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "suffix-contents")
    whole = kept.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "doc_id", "tie", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (length - 1)).alias("end"))
    sizes = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    mixed = contents.join(sizes, "anchor")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_own"))

    def cut(runs_: DataFrame, make, schema: str) -> DataFrame:
        wanted = _wanted(runs_)
        # Same side and keys as in the last join of ``without_repeats``, so that one exchange of the texts serves all.
        met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tie")))
        return map_rows(met, schema, make(length), ["_tie", "text", "wanted"], ["doc_id", "_tie"]).withColumnRenamed("_tie", "tie")

    few = cut(mixed.where(F.col("contents") <= group), _cut,
              "anchor long, content long, first int, windows int, before int, n long, bytes binary")
    out = _rows_of(docs, "tie long, start int, end int")
    by_anchor = few.repartition("anchor").sortWithinPartitions("anchor")
    partly = by_anchor.mapInArrow(_sorted_groups(length, out), out)

    many = cut(mixed.where(F.col("contents") > group), _cut_windows, "window binary, anchor long, content long, start int, n long")
    windows = many.dropDuplicates(["doc_id", "tie", "start", "content"])
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("window")
    counted = windows.where("n = 1").join(again, "window").select("doc_id", "tie", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(partly).unionByName(counted)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``.

    ``kept`` are the remaining bytes, which need not be valid UTF-8. A null or empty text has no bytes; texts shorter
    than ``length`` stay whole; repeated rows are copies and go if long enough; ids may be equal or null; other columns
    are not read; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, gram, group)
    per_doc = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_own"))
    met = texts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tie")), "left")

    def make() -> Callable[..., tuple]:
        def run(text: str | None, spans: list | None) -> tuple:
            data = utf8(text)
            own = sorted((s["start"], s["end"]) for s in spans) if spans else []
            parts, at, n_spans = [], 0, 0
            end = -1
            for start, stop in own:
                if start > end:
                    parts.append(data[at:start])
                    n_spans += 1
                end = max(end, stop)
                at = end
            parts.append(data[at:])
            kept = b"".join(parts)
            return len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept

        return run

    return with_mapped(met, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", make, ["text", "spans"], ["doc_id"])
