"""The brand catalog, saved in versions: an upsert is there as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlumen import schemas
from adlumen.operators.catalog import upsert_brands
from adlumen.sources.snapshots import complete, numbered, removed

VERSION = "version-"


class BrandStore:
    """Catalog versions under ``path``. Readers may be many; one job at a time saves.

    A version is a folder that is never changed. It is in force from the moment on at which Spark commits it; a job
    that dies before leaves the last version in force, and its folder's number is not used again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, ascending."""
        return complete(self.path, VERSION)

    def read(self, version: int | None = None) -> DataFrame:
        """The catalog of a version, by default the last one; empty before the first."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], schemas.BRAND)
        wanted = known[-1] if version is None else version
        if wanted not in known:
            raise ValueError(f"no version {wanted} in {self.path}")
        return self.spark.read.schema(schemas.BRAND).parquet(f"{self.path}/{VERSION}{wanted}")

    def save(self, catalog: DataFrame) -> int:
        """Write ``catalog`` as the next version and return its number."""
        number = max(numbered(self.path, VERSION), default=0) + 1
        catalog.select(*schemas.BRAND.names).write.mode("errorifexists").parquet(f"{self.path}/{VERSION}{number}")
        return number

    def upsert(self, forms: DataFrame) -> DataFrame:
        """Save the last version with the valid ``forms`` merged in; returns the rejected ones with their reason.

        Without a valid form nothing is saved.
        """
        merged, rejected = upsert_brands(self.read(), forms)
        if rejected.count() < forms.count():
            self.save(merged)
        return rejected

    def prune(self, keep: int = 2) -> list[int]:
        """Delete all but the last ``keep`` versions, and what jobs that died have left before them; returns the numbers deleted."""
        if keep < 1:
            raise ValueError("the last version is kept")
        known = self.versions()
        first = known[-keep] if len(known) >= keep else (known[0] if known else 0)
        old = [n for n in numbered(self.path, VERSION) if n < first]
        for number in old:
            removed(self.path, f"{VERSION}{number}")
        return old
