"""Line deduplication by deletion neighbourhoods.

Lines are compared as words (A-Z in lower case, white space between words ignored). A line goes when an equal line, or
one within an edit of one word, stands earlier in the corpus; the edit is allowed between lines of ``EDIT_WORDS`` words
or more, shorter lines must be equal. "Earlier" compares (doc_id, line number), null ids last, and among rows without id
also the hash of the text and, for equal texts, of the row.

A row is known by its id and the hash of its text, ``tie``: rows that share an id, or have none, keep lists of their own.

Two lines one edit apart become equal when the edited word is taken out. So a line's neighbourhood, all its variants
with one word less, is emitted as hashed keys. Lines of one length that are an edit apart share a variant at the same
place, and all lines that share it are an edit apart from each other, so that the earliest per (variant, place) decides
for all of them: no pairs are made however many lines share a template. A line one word shorter is a variant itself.
Found edits are verified on the words.

Only lines that can have a neighbour emit their variants: one edit leaves the first or the last half untouched, so lines
are counted by hashes of both halves first, and a line that shares neither has no neighbour. Of their variants only one
hash each is counted then; variants that no other line has, nearly all, go no further.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from adlumen.llm.common import ROW, beside_row, map_rows, released, utf8, with_mapped, written

EDIT_WORDS = 8
_TWO = struct.Struct(">qq")
_ONE = struct.Struct(">q")
HAS_WORD = r"[^\n]*[^\x20\x09-\x0D][^\n]*"


def words_of(line: str) -> list[bytes]:
    return utf8(line).lower().split()


def line_key(words: list[bytes]) -> tuple[int, int]:
    return _TWO.unpack(xxhash.xxh3_128_digest(b" ".join(words)))


def half_lengths(n: int) -> list[int]:
    """Lengths of the halves that a line of ``n`` words shares with a neighbour of as many or one more, and of one less."""
    return [n // 2, n // 2 - 1] if n % 2 == 0 else [n // 2]


def half_keys(words: list[bytes]) -> list[int]:
    """Hash of the first and of the last words, for each length of the halves."""
    keys = []
    for k in half_lengths(len(words)):
        for side, part in ((b"<", words[:k]), (b">", words[-k:])):
            keys.append(_ONE.unpack(xxhash.xxh3_64_digest(side + str(k).encode() + b" " + b" ".join(part)))[0])
    return keys


def variants(words: list[bytes], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Key and place of every variant that leaves one of the ``shared`` halves (numbers in ``half_keys``) untouched."""
    n, lengths = len(words), half_lengths(len(words))
    places = set()
    for i in shared:
        k = lengths[i // 2]
        places.update(range(k, n) if i % 2 == 0 else range(n - k))
    for place in sorted(places):
        yield (*line_key(words[:place] + words[place + 1:]), place)


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are equal or one insertion, deletion or substitution apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    front = next((i for i in range(n) if a[i] != b[i]), n)
    back = next((i for i in range(n - front) if a[-1 - i] != b[-1 - i]), n - front)
    return max(len(a), len(b)) - front - back <= 1


def _lines(docs: DataFrame, edit_words: int) -> DataFrame:
    """One row per line with a word: ``doc_id``, ``tie``, ``line``, ``h1``, ``h2``, ``halves``."""

    def make() -> Callable[..., Iterator[tuple]]:
        def run(text: str | None) -> Iterator[tuple]:
            for number, line in enumerate(text.split("\n") if text else ()):
                words = words_of(line)
                if words:
                    yield number, *line_key(words), half_keys(words) if len(words) >= edit_words else []

        return run

    return map_rows(_tied(docs), "line int, h1 long, h2 long, halves array<long>", make, ["text"], ["doc_id", "tie"])


def _tied(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))


def _place() -> Column:
    """Rows without id are places of their own."""
    own = F.when(F.col("doc_id").isNull(), F.col("tie")).otherwise(F.lit(0).cast("long"))
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", own.alias("own"))


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie"))


def _candidates(docs: DataFrame, firsts: DataFrame, edit_words: int) -> DataFrame:
    """Lines that share a half with another line: ``h1``, ``h2``, ``first``, ``shared``, ``content``; a written table.

    A place stands for the line that is first there, so the halves travel without keys and go to their document at once.
    Where rows share an id, a place may have several lines; each is found at its own first place as well, and the
    earliest place of a line counts.
    """
    halves = firsts.select("first.doc_id", "tie", "first.line", F.posexplode("halves").alias("half_no", "half"))
    # Counts are written before they are joined: a join of plain exchanges can split a frequent key.
    common = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "lines-halves")
    per_doc = halves.join(common, "half").groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(
        F.collect_list(F.struct("line", "half_no")).alias("wanted"))  # lines of one document, four numbers at most each
    texts = _tied(docs).join(per_doc, _same_row())

    def make() -> Callable[..., Iterator[tuple]]:
        def run(text: str | None, wanted: list) -> Iterator[tuple]:
            lines = (text or "").split("\n")
            shared: dict[int, set[int]] = {}
            for w in wanted:
                shared.setdefault(w["line"], set()).add(w["half_no"])
            for number in sorted(shared):
                words = words_of(lines[number]) if number < len(lines) else []
                own = [i for i in sorted(shared[number]) if i < 2 * len(half_lengths(len(words)))]
                if len(words) >= edit_words and own:
                    yield *line_key(words), number, own, b" ".join(words).decode("utf-8", "surrogatepass")

        return run

    made = map_rows(texts, "h1 long, h2 long, line int, shared array<int>, content string", make, ["text", "wanted"], ["doc_id", "tie"])
    earliest = F.min(F.struct(_place().alias("first"), "shared", "content")).alias("_earliest")
    found = written(made.groupBy("h1", "h2").agg(earliest).select("h1", "h2", "_earliest.*"), "lines-candidates")
    released(common)
    return found


def _meeting(lines: DataFrame) -> DataFrame:
    """Lines of which a variant, or the line itself (place -1), occurs again: ``h1``, ``h2``, ``first``, ``content``, ``places``; a written table.

    Variants are compared by the first half of their key here, whatever their place, so that all that meet are kept.
    """

    def make() -> Callable[..., Iterator[tuple]]:
        def run(content: str, shared: list[int]) -> Iterator[tuple]:
            words = utf8(content).split()
            yield line_key(words)[0], -1
            for v1, _, place in variants(words, shared):
                yield v1, place

        return run

    keyed = map_rows(lines, "v1 long, place int", make, ["content", "shared"], ["h1", "h2"])
    common = written(keyed.groupBy("v1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v1"), "lines-common")
    places = keyed.join(common, "v1").groupBy("h1", "h2").agg(F.collect_list("place").alias("places"))  # a line's words at most
    met = written(lines.select("h1", "h2", "first", "content").join(places, ["h1", "h2"]), "lines-meeting")
    released(common)
    return met


def _later(lines: DataFrame) -> DataFrame:
    """Keys (``h1``, ``h2``) of the lines of ``lines`` that have a verified neighbour with an earlier first place; a written table."""

    def make() -> Callable[..., Iterator[tuple]]:
        def run(content: str, places: list[int]) -> Iterator[tuple]:
            words = utf8(content).split()
            for place in places:
                if place >= 0:
                    yield *line_key(words[:place] + words[place + 1:]), place

        return run

    made = map_rows(lines, "v1 long, v2 long, place int", make, ["content", "places"], ["h1", "h2", "first"])
    own = F.struct("first", "h1", "h2")
    # Lines of equal length: the earliest line of each variant and place.
    best = written(made.groupBy("v1", "v2", "place").agg(F.min(own).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-variants")
    same = made.join(best, ["v1", "v2", "place"]).where(F.col("best.first") < F.col("first")).select(
        "h1", "h2", F.col("best.h1").alias("w1"), F.col("best.h2").alias("w2"))
    # A line and its variants: at most one line equals a variant.
    short = lines.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.col("first").alias("short_first"))
    met = made.join(short, ["v1", "v2"])
    longer = met.where(F.col("short_first") < F.col("first")).select("h1", "h2", F.col("v1").alias("w1"), F.col("v2").alias("w2"))
    shorter = met.where(F.col("first") < F.col("short_first")).groupBy("v1", "v2").agg(F.min(own).alias("best")).select(
        F.col("v1").alias("h1"), F.col("v2").alias("h2"), F.col("best.h1").alias("w1"), F.col("best.h2").alias("w2"))
    pairs = same.union(longer).union(shorter).distinct()
    contents = lines.select("h1", "h2", "content")
    winners = contents.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("content").alias("other"))

    def verify() -> Callable[..., tuple]:
        return lambda a, b: (one_edit(a.split(" "), b.split(" ")),)

    checked = with_mapped(
        pairs.join(contents, ["h1", "h2"]).join(winners, ["w1", "w2"]), "near boolean", verify, ["content", "other"], ["h1", "h2"])
    found = written(checked.where("near").select("h1", "h2").distinct(), "lines-near")
    released(best)
    return found


def repeated_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(``doc_id``, ``tie``, ``line``, ``h1``, ``near``) of every line that goes; ``near`` if only an edited line is earlier.

    Rows that share an id are one place: an equal line at the same number there is one occurrence. Equal texts without id
    are told apart by ``_copies`` only.
    """
    rows = written(_lines(docs, edit_words), "lines")
    firsts = written(rows.groupBy("h1", "h2").agg(
        F.min(F.struct(_place().alias("first"), "tie")).alias("at"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n")).select(
        "h1", "h2", "at.*", "halves", "n"), "lines-first")
    candidates = _candidates(docs, firsts.where(F.size("halves") > 0), edit_words)
    meeting = _meeting(candidates)
    released(candidates)
    near = _later(meeting)
    released(meeting)
    # The first place matters for equal lines only; single lines without a neighbour are not shuffled again.
    equal = firsts.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    edited = near.select("h1", "h2", F.lit(None).cast(firsts.schema["first"].dataType).alias("first"), F.lit(True).alias("near"))
    marked = written(equal.union(edited).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.bool_or("near").alias("near")), "lines-marked")
    released(firsts, near)
    met = rows.select("doc_id", "tie", "line", "h1", "h2").join(marked, ["h1", "h2"])
    return met.where(F.col("near") | (_place() > F.col("first"))).select("doc_id", "tie", "line", "h1", "near")


def _per_document(repeated: DataFrame) -> DataFrame:
    gone = F.array_sort(F.collect_set(F.struct("line", "h1", "near")))  # lines of one document
    return repeated.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(gone.alias("_gone"))


def _copies(docs: DataFrame) -> DataFrame:
    """Row, ``doc_id``, ``text``, ``tie`` and whether an equal text without id stands earlier, all of whose lines then do."""
    plain = [f"{ROW}.`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    beside = lambda df: beside_row(df, doc_id="doc_id", text="text", tie=F.xxhash64("text"))
    known = beside(docs.where("doc_id is not null")).withColumn("copy", F.lit(False))
    number = F.row_number().over(Window.partitionBy("tie", "text").orderBy(F.xxhash64(*plain)))
    return known.union(beside(docs.where("doc_id is null")).withColumn("copy", number > 1))


def line_report(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): lines with a word, removed ones, and which (from 0).

    Null and empty texts have no lines; lines without a word stay; rows that share an id, or have none, have lists of their own; an empty table gives no rows.
    """
    gone = _per_document(repeated_lines(docs, edit_words))
    counts = _copies(docs).select(
        "doc_id", "tie", F.coalesce(F.regexp_count("text", F.lit(HAS_WORD)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("copy"), F.split("text", "\n", -1)).alias("_lines"))
    lists = F.coalesce("_gone", F.array().cast(gone.schema["_gone"].dataType))
    numbered = F.transform("_lines", lambda line, i: F.when(line.rlike(HAS_WORD), i))
    out = F.coalesce(F.filter(numbered, lambda i: i.isNotNull()), F.transform(lists, lambda g: g["line"]))
    return counts.join(gone, _same_row(), "left").select(
        "doc_id", "n_lines", F.size(out).cast("long").alias("n_removed"),
        F.size(F.filter(lists, lambda g: g["near"])).cast("long").alias("n_near"), out.alias("removed_lines"))


def without_repeated_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_chars``, if there, counted anew.

    A row whose lines all go stays with an empty text. Null texts stay null; other columns stay as they are.
    """
    gone = _per_document(repeated_lines(docs, edit_words))
    beside = _copies(docs).join(gone, _same_row(), "left")

    def make() -> Callable[..., tuple]:
        def run(text: str | None, out: list | None, copy: bool) -> tuple:
            if text is None or not (out or copy):
                return (text,)
            if copy:
                return ("\n".join(line for line in text.split("\n") if not words_of(line)),)
            marked = {g["line"] for g in out}
            left = [line for number, line in enumerate(text.split("\n")) if number not in marked]
            return ("\n".join(left),)

        return run

    made = with_mapped(beside, "_left string", make, ["text", "_gone", "copy"], [ROW])
    return made.select(*[
        F.col("_left").alias(c) if c == "text"
        else F.when(F.col("_left") == F.col(f"{ROW}.text"), F.col(f"{ROW}.n_chars")).otherwise(F.length("_left")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
