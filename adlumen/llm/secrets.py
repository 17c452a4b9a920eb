"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, per content and version of
the rules, what was found. A run scans only contents whose pair with the current rules is not in the ledger, adds them,
and joins the findings back to all paths that hold the content. Changed rules have another version, so that all
contents are scanned again without touching older entries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import map_rows, utf8, written

#: Fixed kinds, in order, with their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
FORGE_TOKEN = r"gh[opsur]_[A-Za-z0-9]{36,}"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", ACCESS, 0, 20), Rule("hex", HEX, 0, 24))
RULES = (*BASE_RULES, Rule("private_key", PRIVATE_KEY), Rule("forge_token", FORGE_TOKEN), Rule("web_token", WEB_TOKEN))
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scanner(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[str, int, int]]]:
    compiled = [(i, r.kind, re.compile(r.pattern, re.ASCII).finditer, r.group, r.least) for i, r in enumerate(rules)]

    def scan(text: str) -> list[tuple[str, int, int]]:
        found = [
            (m.start(), i, kind, m.end())
            for i, kind, matches, group, least in compiled for m in matches(text) if m.end(group) - m.start(group) >= least]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    return scan


def read_ledger(spark, path: str, version: str) -> DataFrame:
    """Findings (``blob``, ``findings``) under the rules of ``version``; empty where no ledger is."""
    schema = f"blob string, findings {FINDINGS}, rules string"
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.where(F.col("rules") == version).select("blob", "findings")


def _once_per_task(texts: DataFrame, text: str) -> DataFrame:
    """(``blob``, ``text``) of every content, at most once per task: copies are dropped before the shuffle."""

    def make() -> Callable[..., Iterator[tuple]]:
        seen: set[bytes] = set()

        def run(value: str | None) -> Iterator[tuple]:
            digest = hashlib.sha256(utf8(value))
            if digest.digest() not in seen:
                seen.add(digest.digest())
                yield digest.hexdigest(), value or ""

        return run

    return map_rows(texts, "blob string, content string", make, [text])


def _scanned(contents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def make() -> Callable[..., Iterator[tuple]]:
        scan, seen = scanner(rules), set()

        def run(blob: str, content: str) -> Iterator[tuple]:
            if blob not in seen:
                seen.add(blob)
                yield blob, [{"kind": k, "start": a, "end": b} for k, a, b in scan(content)]

        return run

    return map_rows(contents, f"blob string, findings {FINDINGS}", make, ["blob", "content"])


def update_ledger(versions: DataFrame, text: str, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the contents of ``versions`` that the ledger lacks, append them, and return all entries of these rules.

    An append is one Spark write: a failed run leaves the ledger as it was, and a content that two runs add at the
    same time is one entry when read.
    """
    spark, version = versions.sparkSession, rules_version(rules)
    known = read_ledger(spark, ledger, version)
    unseen = _once_per_task(versions, text).repartition("blob").join(known.select("blob"), "blob", "left_anti")
    _scanned(unseen, rules).withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    once = read_ledger(spark, ledger, version).groupBy("blob").agg(F.first("findings").alias("findings"))
    return written(once, "ledger-entries")  # joined from a plain exchange, a frequent content can be split


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``blob`` and ``findings`` of each row (path) of ``docs``.

    A null text is an empty content; equal texts share one scan; rows with equal or null ids are each returned;
    other columns are not read; an empty table gives no rows. Offsets count code points, the end is exclusive.
    """
    entries = update_ledger(docs, "text", ledger, rules)
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    return paths.join(entries, "blob").select("doc_id", "blob", "findings")
