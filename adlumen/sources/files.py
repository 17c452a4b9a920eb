"""File sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from adlumen import schemas
from adlumen.operators.catalog import last_per_brand


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with header and quotes doubled inside quoted fields.

    A file with line breaks within fields cannot be split, it is one task; for files without them turn
    ``multi_line`` off, and large files are split.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that :func:`read_csv` reads back unchanged."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Engagement posts without an id column, as exported by the platforms."""
    return read_csv(spark, path, T.StructType([f for f in schemas.POSTS if f.name != "post_id"]))


def read_brand_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Brand catalog JSON, one row per brand; of repeated ids the last entry counts."""
    nested = spark.read.schema(schemas.BRAND_FILE).option("multiLine", True).json(path)
    entries = nested.selectExpr("posexplode(brands) as (position, brand)").select("position", "brand.*")
    return last_per_brand(entries, "position")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def write_importances(importances: DataFrame, path: str) -> None:
    """Feature importances as JSON lines."""
    importances.write.mode("overwrite").json(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.IMPORTANCES).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).json(path)
