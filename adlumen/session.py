"""Session defaults and the shared folder for checkpoints and written results."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("adlumen")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    The library has no fallback: a folder of one machine would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured


def set_local_shared_dir(spark: SparkSession) -> None:
    """For tests and benchmarks on one machine: set a checkpoint folder where none is set."""
    if spark.sparkContext.master.startswith("local["):
        if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adlumen-"))


def arrow_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder for Arrow, whose name for Spark's ``s3a`` is ``s3``."""
    if folder.startswith(("s3a:", "s3n:")):
        folder = "s3" + folder[3:]
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder.removeprefix("file:")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder (used where a recomputation could differ)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they were started (like ``--py-files``)."""
    package = Path(__file__).resolve().parent
    if any(package.name in Path(f).name for f in spark.sparkContext.listFiles):
        return
    target = Path(tempfile.mkdtemp(prefix=f"{package.name}-ship-")) / package.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
