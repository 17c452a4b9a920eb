"""Helpers of the corpus operators: streams over Arrow batches, written stages, rows kept beside new columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from adlumen.session import arrow_folder, set_local_shared_dir, shared_dir, ship_package

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ROW = "_row"
SLICE = 500


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty; native."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a stage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def parquet_batches(folder: str) -> Iterator[pa.RecordBatch]:
    """Rows of a table in the shared folder, read inside a task; a folder that no row was written to has none."""
    system, path = arrow_folder(folder)
    for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")):
        with system.open_input_file(file) as opened:
            yield from pq.ParquetFile(opened).iter_batches(use_threads=False)


def released(*tables: DataFrame) -> None:
    """Empty tables that ``written`` made and that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(table.written_at)


def beside_row(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The whole row as one struct and the named columns beside it, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[
        (F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that the Python objects of few texts are in memory at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], inputs: Sequence[str], keep: Sequence[str] = (),
    batch_rows: int = 20_000,
) -> DataFrame:
    """Rows made from rows, streamed in Arrow batches.

    ``make()`` runs once per task and returns a function from the values of ``inputs`` to output tuples of
    ``schema``. Each output tuple is preceded by the values of the ``keep`` columns of its input row.
    """
    added = T.StructType.fromDDL(schema)
    kept = [df.schema[c] for c in keep]
    out = T.StructType([*kept, *added.fields])
    used = df.select(*keep, *[c for c in inputs if c not in keep])
    at = [used.columns.index(c) for c in inputs]
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names, n_kept = out.fieldNames(), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()

        def made(batch: pa.RecordBatch, origin: list[int], rows: list[tuple]) -> pa.RecordBatch:
            index = pa.array(origin, pa.int64())
            columns = [batch.column(i).take(index) for i in range(n_kept)]
            values = zip(*rows) if rows else [()] * len(types)
            columns += [pa.array(v, t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            origin: list[int] = []
            rows: list[tuple] = []
            for i, values in enumerate(zip(*[batch.column(j).to_pylist() for j in at])):
                for row in function(*values):
                    origin.append(i)
                    rows.append(row)
                if len(rows) >= batch_rows:
                    yield made(batch, origin, rows)
                    origin, rows = [], []
            if rows:
                yield made(batch, origin, rows)

    return used.mapInArrow(run, out)


def with_mapped(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]], inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``map_rows`` for functions that return exactly one tuple per row."""

    def one() -> Callable[..., Iterable[tuple]]:
        function = make()
        return lambda *values: (function(*values),)

    return map_rows(df, schema, one, inputs, keep)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def ready(spark: SparkSession) -> None:
    """Folder and package for a query; both are set once per session."""
    set_local_shared_dir(spark)
    ship_package(spark)
