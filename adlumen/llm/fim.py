"""Fill-in-middle transformation by displacement scatter.

The bytes of a block of texts stand one after the other in one buffer. A scan over them marks the cuts, the first bytes
of tokens (runs of ASCII letters, any other code point alone). Every text is cut twice; each of its three parts moves as
a whole, so a difference array with one entry per part holds all displacements: its cumulative sum gives every byte its
output shift, and one scatter writes the outputs of all texts. The sentinels fill the gaps. The way back finds the
sentinels in the output, makes the difference array of the original order, and gathers. Nothing is done per character.

Blocks have about ``BLOCK`` bytes (a longer text is a block of its own), and shifts are held for ``WINDOW`` bytes at a time,
so that beside input and output a task needs the same memory for texts of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Sentinels before prefix, suffix and middle. None begins with the end of another one, so the first one found is the one meant.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
EPOCH, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
BLOCK, WINDOW, STEP = 1 << 20, 1 << 18, 1 << 12


def draws(doc_id: object, epoch: int = EPOCH) -> list[int]:
    """Four numbers of 32 bits from the id; a row without id has those of the empty id."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


class Marks:
    """Marked bytes with counts per ``STEP``: how many stand before a place, and where the one with a number is."""

    def __init__(self, marked: np.ndarray) -> None:
        self.marked = marked
        steps = [np.count_nonzero(marked[i:i + STEP]) for i in range(0, len(marked), STEP)]
        self.before = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]).astype(np.int64)

    def rank(self, place: int) -> int:
        step = place // STEP
        return int(self.before[step]) + int(np.count_nonzero(self.marked[step * STEP:place]))

    def select(self, number: int) -> int:
        step = int(np.searchsorted(self.before, number, side="right")) - 1
        return step * STEP + int(np.flatnonzero(self.marked[step * STEP:(step + 1) * STEP])[number - self.before[step]])


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the first bytes of code points and of tokens."""
    points = (data & 0xC0) != 0x80
    letters = ((data | 0x20) - np.uint8(97)) < 26
    joined = np.zeros(len(data), bool)
    joined[1:] = letters[1:] & letters[:-1]
    joined[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    return points, points & ~joined


def _found(data: np.ndarray, mark: bytes) -> np.ndarray:
    places = np.flatnonzero(data[:max(0, len(data) - 2)] == mark[0])
    return places[(data[places + 1] == mark[1]) & (data[places + 2] == mark[2])]


def _moved(source: np.ndarray, size: int, events: np.ndarray, shifts: np.ndarray, gather: bool) -> np.ndarray:
    """Bytes of ``source`` in an array of ``size``; from each place of ``events`` on, in order, the byte is off by ``shifts``.

    A scatter walks over the input and writes at place + shift, a gather walks over the output and reads there.
    """
    out = np.zeros(size, np.uint8)
    steps = np.diff(shifts, prepend=0)
    total, carry = (size if gather else len(source)), 0
    for low in range(0, total, WINDOW):
        high = min(total, low + WINDOW)
        first, last = np.searchsorted(events, [low, high])
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, events[first:last] - low, steps[first:last])
        difference[0] += carry
        shift = np.cumsum(difference)
        carry = int(shift[-1])
        places = shift + np.arange(low, high)
        if gather:
            out[low:high] = source[places]
        else:
            out[places] = source[low:high]
    return out


def _in_order(*columns: np.ndarray) -> np.ndarray:
    return np.stack(columns, axis=1).ravel()


def rearrange(data: np.ndarray, offsets: np.ndarray, ids: list, epoch: int, fim_percent: int, spm_percent: int) -> tuple:
    """``n``, ``form``, characters of prefix and of middle, and bytes and offsets of the outputs of a block."""
    points, tokens = map(Marks, cuts(data, offsets))
    holders = np.zeros(len(ids), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        places = _found(data, mark)
        owner = np.searchsorted(offsets, places, side="right") - 1
        holders[owner[places + MARK <= offsets[owner + 1]]] = True
    starts, ends = offsets[:-1], offsets[1:]
    first, second = ends.copy(), ends.copy()
    counts, forms, prefix_chars, middle_chars = [], [], [], []
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        before = tokens.rank(start)
        n = tokens.rank(end) - before
        h1, h2, h3, h4 = draws(ids[i], epoch)
        counts.append(n)
        if start == end or holders[i] or h3 % 100 >= fim_percent:
            forms.append("plain")
            prefix_chars.append(None)
            middle_chars.append(None)
            continue
        forms.append("spm" if h4 % 100 < spm_percent else "psm")
        first[i], second[i] = (end if k == n else tokens.select(before + k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        at = [points.rank(place) for place in (start, int(first[i]), int(second[i]))]
        prefix_chars.append(at[1] - at[0])
        middle_chars.append(at[2] - at[1])
    kind = np.array(forms, dtype=object)
    plain, spm = kind == "plain", kind == "spm"
    sizes = ends - starts + np.where(plain, 0, 3 * MARK)
    out_offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    begin, prefix, suffix = out_offsets[:-1], first - starts, ends - second
    prefix_at = begin + np.where(plain, 0, np.where(spm, 2 * MARK + suffix, MARK))
    middle_at = begin + np.where(plain, prefix, 3 * MARK + prefix + suffix)
    suffix_at = begin + np.where(plain, second - starts, np.where(spm, MARK, 2 * MARK + prefix))
    out = _moved(data, int(out_offsets[-1]), _in_order(starts, first, second), _in_order(prefix_at - starts, middle_at - first, suffix_at - second), False)
    for mark, at in ((PREFIX, prefix_at), (SUFFIX, suffix_at), (MIDDLE, middle_at)):
        out[(at[~plain] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    return counts, forms, prefix_chars, middle_chars, out, out_offsets


def put_back(data: np.ndarray, offsets: np.ndarray, forms: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the outputs were made of, and which outputs are none; these give no bytes."""
    places = {mark: _found(data, mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    starts, ends = offsets[:-1], offsets[1:]
    parts = np.zeros((len(forms), 6), np.int64)  # first and last byte of prefix, middle and suffix
    broken = np.zeros(len(forms), bool)
    for i, (form, start, end) in enumerate(zip(forms, starts.tolist(), ends.tolist())):
        if form == "plain":
            parts[i] = start, end, end, end, end, end
            continue
        lead, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
        at = [start]
        for mark in (inner, MIDDLE):
            k = int(np.searchsorted(places[mark], at[-1] + MARK))
            at.append(int(places[mark][k]) if k < len(places[mark]) else end)
        if form not in ("psm", "spm") or bytes(data[start:start + MARK]) != lead or at[2] + MARK > end:
            broken[i] = True
            parts[i] = start
            continue
        one, two, three = (start + MARK, at[1]), (at[1] + MARK, at[2]), (at[2] + MARK, end)
        prefix, suffix = (one, two) if form == "psm" else (two, one)
        parts[i] = (*prefix, *three, *suffix)
    lengths = parts[:, 1::2] - parts[:, ::2]
    out_offsets = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))]).astype(np.int64)
    begins = out_offsets[:-1, None] + np.concatenate([np.zeros((len(forms), 1), np.int64), np.cumsum(lengths, axis=1)[:, :2]], axis=1)
    return _moved(data, int(out_offsets[-1]), begins.ravel(), (parts[:, ::2] - begins).ravel(), True), out_offsets, broken


# --- tables -------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the bytes of their texts (null: none) and offsets, about ``BLOCK`` bytes or one row at a time."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        _, where, values = texts.buffers()
        if not batch.num_rows:
            continue
        offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, side="right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low]:offsets[high]], (offsets[low:high + 1] - offsets[low]).astype(np.int64)
            low = high


def _strings(data: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    made = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return made if missing is None or not missing.any() else pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), made)


def transformed(docs: DataFrame, epoch: int = EPOCH, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``doc_id``, ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    A null or empty text is plain with an empty output, as is, unchanged, a text that holds a sentinel. The cuts come from
    the id and ``epoch``, so reruns agree; rows with equal ids draw alike, and rows without id as an empty id would.
    Repeated rows are each returned; other columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _blocks(batches, "text"):
            ids = rows.column(0)
            counts, forms, prefix, middle, out, ends = rearrange(data, offsets, ids.to_pylist(), epoch, fim_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(counts, pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                _strings(out, ends)], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(made: DataFrame) -> DataFrame:
    """``made`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone.

    Null for an output that is none of its form, and for a null ``form``; a null output counts as empty.
    """
    kept = [c for c in made.columns if c != "restored"]
    schema = T.StructType([*[made.schema[c] for c in kept], T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _blocks(batches, "output"):
            forms = rows.column(rows.schema.get_field_index("form")).to_pylist()
            out, ends, broken = put_back(data, offsets, forms)
            yield pa.RecordBatch.from_arrays([*rows.columns, _strings(out, ends, broken)], names=schema.fieldNames())

    return made.select(*kept).mapInArrow(run, schema)
