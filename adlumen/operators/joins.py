"""Lookup joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from adlumen.session import checkpointed

Lookup = Callable[[DataFrame, DataFrame, str, str], DataFrame]

ASKED_BYTES = 8 << 20  # of JSON: less than what the planner broadcasts by its own estimates


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to a lookup ``table`` with one row per ``key``; rows whose key the table lacks stay.

    No hint and no measuring: the planner broadcasts a table that its statistics show to be small, and of a larger one
    the adaptive skew join splits the rows of a frequent key.
    """
    return rows.join(table, key, how)


def asked_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """The same for ``rows`` that are cheap to read twice: what they ask for of ``table`` is cut from its plan first.

    Its size is measured as it is written. What is small goes to the tasks: rows of a handful of keys would else meet in
    as many tasks, and a planner that knows only the size of the whole table does not see it. Of more the planner decides.
    """
    seen = Observation()
    asked = table.join(rows.select(key).distinct(), key, "left_semi")
    kept = checkpointed(asked.observe(seen, F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")))
    small = (seen.get["bytes"] or 0) <= ASKED_BYTES
    return lookup_join(rows, F.broadcast(kept) if small else kept, key, how)
