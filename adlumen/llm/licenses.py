"""Licence scans by canonical digest.

Texts are brought to a canonical form (A-Z in lower case, copyright lines out, punctuation to blanks, equivalent
spellings to one), digested with SHA-256 and joined to the digests of known licences in the same form. Whole texts are
looked up, and every whole line, as notices are mostly single lines. Everything is a native expression. The digest of
every line may cross a shuffle (182 MB for 0.5 GB of texts), no text does.

Known are whole texts of the short permissive licences, the headers of two long ones, and for every licence in
``license_texts.NAMES`` its identifier lines and notices made by rule. A licence inside a longer text is found by its
notices only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlumen.llm.license_texts import KNOWN, SPELLINGS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t\r]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}\x{A0}\x{A9}\x{2010}-\x{201F}]+"


def canonical(text: Column) -> Column:
    """Canonical form: words between single blanks; null becomes empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    without = F.regexp_replace(lowered, COPYRIGHT_LINE, "\n")
    # Doubled blanks let spellings that stand side by side all be replaced; they become single at the end.
    form = F.concat(F.lit(" "), F.regexp_replace(without, PUNCTUATION, "  "), F.lit(" "))
    for words, standard in SPELLINGS:
        form = F.replace(form, F.lit(f" {words.replace(' ', '  ')} "), F.lit(f" {standard.replace(' ', '  ')} "))
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(``digest``, ``license``) of the known texts; of two licences with one digest the first by name."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences of each row of ``docs`` (``doc_id``, ``text``).

    ``n_lines`` are the lines with a canonical word, ``n_notices`` those that are a known text, ``notices`` the sorted
    licences of these, and ``text_license`` the licence that the whole text is (null: none). A null or empty text has
    no lines; rows that share an id, or have none, share the sum of their findings; other columns are not read; empty
    tables give no rows or no findings.
    """
    whole = docs.select("doc_id", F.struct(F.lit(True).alias("whole"), digest(F.col("text")).alias("digest")).alias("unit"), F.lit(0).alias("n"))
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    forms = lines.select("doc_id", canonical(F.col("line")).alias("form")).where("form <> ''")
    parts = forms.select("doc_id", F.struct(F.lit(False).alias("whole"), F.sha2(F.col("form").cast("binary"), 256).alias("digest")).alias("unit"), F.lit(1).alias("n"))
    units = whole.union(parts).select("doc_id", "unit.whole", "unit.digest", "n")
    names = known.select("digest", "license")
    per_line = units.join(names, "digest", "left")
    return per_line.groupBy("doc_id").agg(
        F.sum("n").cast("long").alias("n_lines"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
    )
