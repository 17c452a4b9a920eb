"""Store of generated texts, keyed by model and prompt.

A folder of Parquet files: ``base-N`` holds compacted entries, ``log-N`` what was put since; both are partitioned
by model and by the first two digits of the key, and sorted by key. The state in force is the last base that was
written as a whole (Spark's ``_SUCCESS`` file) with the logs of its number and later ones. Reading keeps the newest
entry of each key, so that a replaced text needs no rewrite. A lookup reads the partitions of its keys alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from adlumen import schemas
from adlumen.session import arrow_folder
from adlumen.sources.snapshots import complete, numbered, removed

BASE, LOG = "base-", "log-"
STORED = T.StructType([*schemas.CACHE.fields, T.StructField("bucket", T.StringType())])


def cache_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\n"), prompt), 256)


def _bucket(key: Column) -> Column:
    """The first two digits of a key, of which there are 256."""
    return F.substring(key, 1, 2).alias("bucket")


def newest(entries: DataFrame) -> DataFrame:
    """Latest entry per key. Prompts are an aggregate of their own, so that they are not shuffled where nothing reads them."""
    order = F.struct("created_at", "text")
    others = [c for c in schemas.CACHE.names if c not in ("cache_key", "created_at", "text")]
    last = entries.groupBy("cache_key").agg(
        F.max(order).alias("_last"), *[F.max_by(c, order).alias(c) for c in others])
    return last.select("cache_key", *others, "_last.*").select(schemas.CACHE.names)


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries after writing ``fresh`` over ``cache``: a fresh entry replaces the one with its key."""
    latest = newest(fresh)
    return cache.join(latest.select("cache_key"), "cache_key", "left_anti").unionByName(latest)


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key is stored."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_semi")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key is not stored."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


class GenerationCache:
    """The store at ``path`` (a folder all executors can reach, and pyarrow on the driver).

    Several jobs may read and put at once; ``compact`` and ``clear`` belong to one job while no other one puts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self) -> int:
        """Number of the base in force; 0 before the first one."""
        return max(complete(self.path, BASE), default=0)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        # Each folder is a table of its own to the partition discovery; there are two or three.
        tables = [self.spark.read.schema(STORED).parquet(f"{self.path}/{folder}") for folder in folders]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], STORED)

    def _written(self) -> DataFrame:
        """Everything in force, replaced entries included; empty when nothing was stored yet."""
        now = self._generation()
        return self._read([f"{BASE}{n}" for n in [now] if n] + [f"{LOG}{n}" for n in numbered(self.path, LOG) if n >= now])

    def _write(self, entries: DataFrame, folder: str, mode: str) -> None:
        """One file per model and bucket if they are small; large ones are cut by the adaptive plan."""
        rows = entries.select(*schemas.CACHE.names, _bucket(F.col("cache_key"))).hint("rebalance", "model", "bucket")
        ordered = rows.sortWithinPartitions("model", "bucket", "cache_key")
        writer = ordered.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("model", "bucket")
        writer.parquet(f"{self.path}/{folder}")

    def entries(self) -> DataFrame:
        """Newest entry per key."""
        return newest(self._written().drop("bucket"))

    def texts_of(self, prompts: DataFrame, models: Sequence[str]) -> DataFrame:
        """Add ``stored`` to rows with distinct ``prompt_key`` and ``prompt``: the map of known texts per model.

        The driver gets the buckets of the keys asked for (256 at most), which become filters on the partitions; no
        other entry is read, and no stored prompt. The map has as many entries as models at most.
        """
        chain = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
        asked = prompts.select("prompt_key", "prompt", chain).select(
            "prompt_key", "model", cache_key(F.col("model"), F.col("prompt")).alias("cache_key"))
        buckets = sorted(asked.agg(F.collect_set(_bucket(F.col("cache_key")))).first()[0])
        kept = F.col("model").isin(list(models)) & F.col("bucket").isin(buckets)
        put = self._written().where(kept).select("cache_key", "model", "text", "created_at")
        last = asked.join(put, ["model", "cache_key"]).groupBy("prompt_key", "model").agg(
            F.max_by("text", F.struct("created_at", "text")).alias("text"))
        known = last.groupBy("prompt_key").agg(F.map_from_entries(F.collect_list(F.struct("model", "text"))).alias("stored"))
        return prompts.join(known, "prompt_key", "left")

    def put(self, texts: DataFrame) -> None:
        """Store rows with ``model``, ``prompt`` and ``text``."""
        rows = texts.where(F.col("text").isNotNull()).select(
            cache_key(F.col("model"), F.col("prompt")).alias("cache_key"), "model", "prompt", "text",
            F.current_timestamp().alias("created_at"),
        )
        log = max([self._generation(), *numbered(self.path, LOG)])
        self._write(rows, f"{LOG}{log}", "append")

    def compact(self) -> None:
        """Write the newest entry of each key as the next base.

        A log is opened for the next number first, then the base is written; until its ``_SUCCESS`` file is there, the
        old base and all logs stay in force, so a run that dies loses nothing and can be repeated. What the base before
        replaced is deleted; the last state stays for readers that have begun.
        """
        self._next(self.entries())

    def _next(self, entries: DataFrame) -> None:
        now = self._generation()
        system, root = arrow_folder(self.path)
        system.create_dir(f"{root}/{LOG}{now + 1}", recursive=True)
        self._write(entries, f"{BASE}{now + 1}", "overwrite")
        for kind in (BASE, LOG):
            for old in numbered(self.path, kind):
                if old < now:
                    removed(self.path, f"{kind}{old}")

    def clear(self) -> int:
        """Forget everything; returns the number of entries there were."""
        n = self.entries().count()
        self._next(self.spark.createDataFrame([], schemas.CACHE))
        return n
