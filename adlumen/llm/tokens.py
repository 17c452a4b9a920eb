"""Token counts with a shortcut for whole tokens.

A byte-level BPE vocabulary cuts a text into pre-tokens and merges the bytes of each. Which vocabulary strings encode
alone as one token is proved once, on the driver, by merging each of them; the proven strings go to the tasks as a set
of at most the vocabulary's size. A pre-token in the set counts one without merging; only the rest is merged, by the
vocabulary's own merge rules, with a bounded memory of recent results.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from adlumen.llm.common import with_mapped

LIMIT = 512
MEMORY = 300_000
#: The fixed pre-token pattern of byte-level BPE; white space is the Unicode property.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Merger(dict):
    """Token count of a pre-token, merged when it is not remembered; forgets everything when full."""

    def __init__(self, model, size: int = MEMORY):
        super().__init__()
        self.model, self.size = model, size
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]

    def spelled(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(self.spelled(piece)))
        if len(self) >= self.size:
            self.clear()
        self[piece] = n
        return n


def whole_tokens(specification: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the merge rules turn into one token."""
    tokenizer = Tokenizer.from_str(specification)
    merger, pattern = Merger(tokenizer.model), regex.compile(PRE_TOKENS)
    byte_of = {letter: b for b, letter in byte_letters().items()}
    proved = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not all(letter in byte_of for letter in token):
            continue
        try:
            text = bytes(byte_of[letter] for letter in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.findall(text) == [text] and merger[text] == 1:
            proved.add(text)
    return frozenset(proved)


def counter(specification: str, whole: frozenset[str], memory: int = MEMORY) -> Callable[[str], int]:
    """Function from a text to its number of tokens; strings of added tokens count one each."""
    settings = json.loads(specification)
    added = [t["content"] for t in settings.get("added_tokens", [])]
    split = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))).split if added else lambda text: [text]
    pieces_of, rest = regex.compile(PRE_TOKENS).findall, Merger(Tokenizer.from_str(specification).model, memory)

    def count(text: str) -> int:
        total = -1
        for segment in split(text):
            pieces = pieces_of(segment)
            others = [piece for piece in pieces if piece not in whole]
            total += 1 + len(pieces) - len(others) + sum([rest[piece] for piece in others])
        return total

    return count


def _supported(specification: str) -> None:
    settings = json.loads(specification)
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or settings.get("normalizer"):
        raise ValueError("the shortcut is for byte-level vocabularies without normalizer and prefix space")
    if model["type"] != "BPE" or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in settings["added_tokens"]):
        raise ValueError("the shortcut is for deterministic BPE with plain added tokens")


#: The counter a worker made last, with the shared value it was made from.
_LAST: list[tuple[object, Callable[[str], int]]] = []


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row, whole texts.

    ``path`` is the vocabulary file on the driver. A null text counts as empty; rows with equal or null ids are each
    counted; other columns are not read; an empty table gives no rows. No shuffle.
    """
    with open(path, encoding="utf-8") as file:
        specification = file.read()
    _supported(specification)
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((specification, whole_tokens(specification)))  # bounded by the vocabulary

    def make() -> Callable[[str | None], tuple]:
        if not _LAST or _LAST[0][0] is not shared.value:
            _LAST[:] = [(shared.value, counter(*shared.value))]
        count = _LAST[0][1]

        def run(text: str | None) -> tuple:
            n = count(text) if text else 0
            return len(text.encode("utf-8", "surrogatepass")) if text else 0, n, n > limit

        return run

    return with_mapped(docs, "n_bytes long, n_tokens long, over_limit boolean", make, ["text"], ["doc_id"])
