"""Vocabulary rules of a brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions.fixed_values import PENALTY_PER_VIOLATION
from adlumen.functions.text import clean_string


def found_terms(text: Column, terms: Column) -> Column:
    """Terms that occur in the lower-cased text as substrings (terms are taken as written)."""
    lowered = F.lower(clean_string(text))
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(lowered, t))


def violations(text: Column, preferred: Column, forbidden: Column) -> Column:
    """Array of violation messages."""
    missing = (F.size(F.coalesce(preferred, F.array())) > 0) & (F.size(found_terms(text, preferred)) == 0)
    hits = found_terms(text, forbidden)
    return F.array_compact(F.array(
        F.when(missing, F.concat(F.lit("Missing preferred vocabulary: "), F.array_join(preferred, ", "))),
        F.when(F.size(hits) > 0, F.concat(F.lit("Contains forbidden language: "), F.array_join(hits, ", "))),
    ))


def with_rule_check(df: DataFrame, text: str = "text", penalty: int = PENALTY_PER_VIOLATION) -> DataFrame:
    """Add ``violations``, ``passed`` and ``rule_penalty``; needs the two vocabulary columns."""
    found = violations(F.col(text), F.col("preferred_vocabulary"), F.col("forbidden_vocabulary"))
    checked = df.withColumn("violations", found)
    return checked.withColumns({
        "passed": F.size("violations") == 0,
        "rule_penalty": F.size("violations") * F.lit(penalty),
    })
