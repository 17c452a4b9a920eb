"""Provider error messages: classes, transience and the waits between attempts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from adlumen.functions import fixed_values as fixed


def marks_pattern(marks: Sequence[str], *more: str) -> str:
    return "|".join([*map(re.escape, marks), *more])


#: One table of rules for tasks and columns: patterns of lower-case messages, and the seconds before the first retry.
QUOTA = marks_pattern(fixed.QUOTA_MARKS)
TRANSIENT = marks_pattern(fixed.TRANSIENT_MARKS, r"\A5")
REWRITE_QUOTA = marks_pattern(fixed.REWRITE_QUOTA_MARKS)
FIRST_WAIT = 2


def mentions(message: Column, marks: Sequence[str]) -> Column:
    lowered = F.lower(message)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in marks])


def error_class(message: Column) -> Column:
    """First matching class name, else ``other``."""
    out = F
    for name, marks, _ in fixed.ERROR_CLASSES:
        out = out.when(mentions(message, marks), F.lit(name))
    return out.otherwise(F.lit("other"))


def error_text(message: Column) -> Column:
    """Message of the first matching class, else the message itself."""
    out = F
    for _, marks, text in fixed.ERROR_CLASSES:
        out = out.when(mentions(message, marks), F.lit(text))
    return out.otherwise(message)


def error_detail(message: Column) -> Column:
    """Part after the first colon, or the whole message."""
    return F.when(F.contains(message, F.lit(":")), F.regexp_replace(message, r"^[^:]*:", "")).otherwise(message)


def is_transient(message: Column) -> Column:
    return F.lower(message).rlike(TRANSIENT)


def wait_seconds(attempt: Column) -> Column:
    """Back-off after the attempt with this zero-based number: 2, 4, 8, ..."""
    return (F.lit(FIRST_WAIT) * F.pow(F.lit(2), attempt)).cast("int")
