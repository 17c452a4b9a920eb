"""Brand catalog: duplicates, references, lookups and upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.text import stripped
from adlumen.operators.joins import lookup_join

LINES = r"\R|[\x1C-\x1E]"


def last_per_brand(entries: DataFrame, position: str, key: str = "brand_id") -> DataFrame:
    """Of entries with the same id the one with the highest position; a mergeable aggregate."""
    columns = [c for c in entries.columns if c not in (key, position)]
    last = F.max_by(F.struct(*columns), position).alias("_entry")
    return entries.groupBy(key).agg(last).select(key, "_entry.*")


def brand_references(catalog: DataFrame) -> DataFrame:
    """One row per reference copy with its one-based ordinal."""
    return catalog.select("brand_id", F.posexplode("reference_ad_copies").alias("pos", "ref_text")).select(
        "brand_id", (F.col("pos") + 1).alias("ref_ord"), "ref_text"
    )


def first_references(refs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` references of each brand."""
    return refs.where(F.col("ref_ord") <= n)


def reference_bullets(refs: DataFrame, n: int, name: str = "references") -> DataFrame:
    """The first ``n`` references of each brand as a bulleted text; at most ``n`` rows per group are gathered."""
    lines = F.array_sort(F.collect_list(F.struct("ref_ord", "ref_text")))
    top = first_references(refs, n).groupBy("brand_id").agg(lines.alias("_lines"))
    return top.select("brand_id", bullets(F.col("_lines.ref_text")).alias(name))


def bullets(lines: Column) -> Column:
    """Array of strings as lines that start with a dash."""
    return F.array_join(F.transform(lines, lambda line: F.concat(F.lit("- "), line)), "\n")


def with_brand(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of known brands with the brand's columns."""
    return lookup_join(rows, catalog, "brand_id", "inner")


def unknown_brands(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Brand ids that the catalog does not have, with their row counts."""
    known = catalog.select("brand_id")
    asked = rows.groupBy("brand_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(known, "brand_id", "left_anti")


def label_of(code: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code; an unknown code is its own label."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), code)


def fallback_chain(primary: Column, models: Sequence[str] = tuple(fixed.FALLBACK_MODELS)) -> Column:
    """The primary model followed by all others in order."""
    others = F.filter(F.array(*[F.lit(m) for m in models]), lambda m: m != primary)
    return F.concat(F.array(primary), others)


def parsed_list(text: Column, separator: str) -> Column:
    """Parts of a text, trimmed, blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.array_remove(F.transform(parts, lambda part: stripped(part)), "")


def parsed_forms(forms: DataFrame) -> DataFrame:
    """Catalog rows from form texts (``form_ord`` and the brand columns as plain text).

    Lines become lists, defaults fill tone and rules, and ``reject_reason`` names what is missing.
    """

    def tidy(name: str) -> Column:
        return stripped(F.coalesce(F.col(name), F.lit("")))

    rules, references = parsed_list(F.col("style_rules"), LINES), parsed_list(F.col("reference_ad_copies"), LINES)
    default_rules = F.array(*[F.lit(r) for r in fixed.DEFAULT_STYLE_RULES])
    return forms.select(
        "form_ord",
        tidy("brand_id").alias("brand_id"),
        tidy("brand_name").alias("brand_name"),
        F.when(tidy("tone_category") == "", F.lit(fixed.DEFAULT_TONE)).otherwise(tidy("tone_category")).alias("tone_category"),
        tidy("brand_voice_summary").alias("brand_voice_summary"),
        F.when(F.size(rules) == 0, default_rules).otherwise(rules).alias("style_rules"),
        parsed_list(F.col("preferred_vocabulary"), ",").alias("preferred_vocabulary"),
        parsed_list(F.col("forbidden_vocabulary"), ",").alias("forbidden_vocabulary"),
        references.alias("reference_ad_copies"),
        F.when((tidy("brand_id") == "") | (tidy("brand_name") == ""), F.lit("id and name are required"))
        .when(F.size(references) == 0, F.lit("references are required")).alias("reject_reason"),
    )


def upsert_brands(catalog: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog with the valid forms merged in by id (the last form of an id counts), and the rejects."""
    parsed = parsed_forms(forms)
    accepted = last_per_brand(parsed.where(F.col("reject_reason").isNull()).drop("reject_reason"), "form_ord")
    merged = catalog.join(accepted.select("brand_id"), "brand_id", "left_anti").unionByName(accepted)
    return merged, parsed.where(F.col("reject_reason").isNotNull())
