"""The corpus pipeline: rules, lines, near duplicates, benchmarks, mixture.

Every stage works on what the one before kept; each result is written as Parquet and read again. All but the last
return the columns of their input, extra ones included. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adlumen.llm import decontaminate, lines, mixing, quality, shingles
from adlumen.llm.common import benchmark, documents, ready, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their language and source.

    Null and empty texts go, as they have no words; rows with equal or null ids and repeated rows are each judged; null
    languages and sources are groups of their own.
    """
    ready(spark)
    return quality.without_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus.

    Null texts stay null, a text whose lines all go stays empty; of rows alike in id and text the lines stay in each, and
    of equal texts without id in one.
    """
    ready(spark)
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by op9's fingerprints or by a similarity of 0.8 or more of their five-word shingles.

    Fingerprints link at 4 or fewer differing bits, found by generalised pigeonhole as in op9; the exact similarity adds the
    near texts whose fingerprints are further apart.
    Null and empty texts are one group; a text of fewer than five words is one shingle; the least id of a group stays, an id before none.
    """
    ready(spark)
    return shingles.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts stay; items without id or text have no windows; an empty benchmark keeps all documents.
    """
    ready(spark)
    return decontaminate.without_contaminated(docs, benchmark(spark, sf_dir))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them, in training order.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source, the last in order.
    """
    ready(spark)
    return mixing.mixed(docs, carry=["lang", "text"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("source_mixing", source_mixing),
]

#: Fingerprints and robust estimates have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
