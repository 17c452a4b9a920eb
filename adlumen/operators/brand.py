"""Brand alignment: similarity of text vectors to a brand's reference vectors, and its reports.

Tables: texts with a vector column, and references ``(brand_id, ref_ord, ref_vec)``.

Spark writes the references, ordered by brand, as Parquet files in the shared folder. A task streams these files in
blocks of bounded size past its texts, a tile at a time, and keeps running maxima. Neither the driver nor the plan, a
broadcast or a task's memory grows with the references; rows are never shuffled or joined back by an id. The shared
folder must be one that pyarrow opens on the executors: a mounted folder, HDFS, S3 or GCS.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.rounding import round_binary
from adlumen.functions.scoring import calibrated_brand_score
from adlumen.session import arrow_folder, shared_dir

BLOCK_VALUES = 4 * 1024 * 1024  # numbers of a block in a task: 32 MB
TILE_VALUES = 4 * 1024 * 1024  # cosines held at a time


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, accumulated in double; a zero vector gives 0."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).when(length.isNotNull(), F.lit(0.0))


# --- stored references ---------------------------------------------------------------------------


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def batch_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an Arrow list column and the positions of its non-null rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = np.flatnonzero(np.asarray(vectors.is_valid()))
    lengths = np.unique(np.asarray(vectors.drop_null().value_lengths()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(present), -1) if len(present) else np.zeros((0, 1))), present


@dataclass(frozen=True)
class ReferenceFiles:
    """Folder of stored references: ``brands`` (brand_id, brand_ord) and ``vectors`` (brand_ord, ref_vec), brand by brand."""

    folder: str
    block_values: int = BLOCK_VALUES

    def brands(self) -> list[str]:
        found = [row for table in parquet_batches(f"{self.folder}/brands", 1 << 16) for row in table.to_pylist()]
        return [row["brand_id"] for row in sorted(found, key=lambda row: row["brand_ord"])]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Brand numbers and unit vectors, at most ``block_values`` numbers at a time."""
        for batch in parquet_batches(f"{self.folder}/vectors", self._rows()):
            yield batch.column("brand_ord").to_numpy(), batch_matrix(batch.column("ref_vec"))[0]

    def _rows(self) -> int:
        for batch in parquet_batches(f"{self.folder}/vectors", 1):
            return max(1, self.block_values // max(1, len(batch.column("ref_vec")[0])))
        return 1


def parquet_batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    system, path = arrow_folder(folder)
    for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with system.open_input_file(file) as opened:
            yield from pq.ParquetFile(opened).iter_batches(rows, use_threads=False)


def stored_references(refs: DataFrame | ReferenceFiles, block_values: int = BLOCK_VALUES) -> ReferenceFiles:
    """Write the references with a vector once; stored ones are returned as they are, so that several scores can share them."""
    if isinstance(refs, ReferenceFiles):
        return refs
    folder = f"{shared_dir(refs.sparkSession)}/references/{uuid.uuid4().hex}"
    present = refs.where(F.col("ref_vec").isNotNull() & F.col("brand_id").isNotNull())
    names = present.select("brand_id").distinct()
    # One row per brand; every row of the results holds as many.
    names.withColumn("brand_ord", F.row_number().over(Window.orderBy("brand_id")) - 1).write.parquet(f"{folder}/brands")
    brands = refs.sparkSession.read.schema("brand_id string, brand_ord int").parquet(f"{folder}/brands")
    numbered = present.join(brands, "brand_id").select("brand_ord", "ref_vec")
    numbered.repartitionByRange("brand_ord", F.xxhash64("ref_vec")).sortWithinPartitions("brand_ord").write.parquet(f"{folder}/vectors")
    return ReferenceFiles(folder, block_values)


# --- similarities -------------------------------------------------------------------------------


def _tiles(units: np.ndarray, rows: int) -> Iterator[slice]:
    step = max(1, TILE_VALUES // max(1, rows))
    return (slice(low, low + step) for low in range(0, len(units), step))


def _raise_all(best: np.ndarray, units: np.ndarray, brands: np.ndarray, refs: np.ndarray) -> None:
    """Raise the best cosines per (text, brand) by a block whose brands stand together."""
    starts = np.flatnonzero(np.r_[True, brands[1:] != brands[:-1]])
    for tile in _tiles(units, len(refs)):
        maxima = np.maximum.reduceat(units[tile] @ refs.T, starts, axis=1)
        for i, brand in enumerate(brands[starts]):
            np.fmax(best[tile, brand], maxima[:, i], out=best[tile, brand])


def _raise_own(best: np.ndarray, units: np.ndarray, wanted: np.ndarray, brands: np.ndarray, refs: np.ndarray) -> None:
    """Raise the best cosine of each text to its own brand."""
    for brand in np.intersect1d(np.unique(brands), wanted):
        at, own = np.flatnonzero(wanted == brand), refs[brands == brand]
        for tile in _tiles(units[at], len(own)):
            best[at[tile]] = np.fmax(best[at[tile]], (units[at[tile]] @ own.T).max(axis=1))


def _held(files: ReferenceFiles) -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The blocks, read anew each time, but for a table of one block, which is kept."""
    first = list(itertools.islice(files.blocks(), 2))
    if len(first) < 2:
        return lambda: iter(first)
    first.clear()
    return files.blocks


def with_brand_similarities(
    texts: DataFrame, refs: DataFrame | ReferenceFiles, vector: str = "text_vec", block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Add ``similarities``: the best cosine to every brand, as an array in brand order (as long as the brand list)."""
    return texts.withColumn("similarities", _maxima(stored_references(refs, block_values))(F.col(vector)))


def _maxima(files: ReferenceFiles):
    @F.arrow_udf("array<struct<brand_id:string,brand_ord:int,similarity:double>>")
    def maxima(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, blocks = files.brands(), _held(files)
        for vectors in batches:
            units, present = batch_matrix(vectors)
            best = np.full((len(units), len(names)), np.nan)
            for brands, rows in blocks() if len(units) else ():
                _raise_all(best, units, brands, rows)
            lengths = np.zeros(len(vectors), np.int64)
            lengths[present] = len(names)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.r_[np.isin(np.arange(len(vectors)), present, invert=True), False])
            cells = pa.StructArray.from_arrays([
                pa.array(names * len(units), pa.string()), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(units))),
                pa.array(best.ravel(), mask=np.isnan(best.ravel()))], names=["brand_id", "brand_ord", "similarity"])
            yield pa.ListArray.from_arrays(ends, cells)

    return maxima


def with_own_similarity(
    texts: DataFrame, refs: DataFrame | ReferenceFiles, vector: str = "text_vec", brand: str = "brand_id", block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Add ``similarity``: the best cosine to the row's own brand; null for an unknown brand."""
    return texts.withColumn("similarity", _own(stored_references(refs, block_values))(F.col(vector), F.col(brand)))


def _own(files: ReferenceFiles):
    @F.arrow_udf("double")
    def similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        number, blocks = {name: i for i, name in enumerate(files.brands())}, _held(files)
        for vectors, brands in batches:
            units, present = batch_matrix(vectors)
            wanted = np.array([number.get(b, -1) for b in brands.to_pylist()], dtype=np.int64)[present]
            best = np.full(len(units), np.nan)
            for of, rows in blocks() if len(units) else ():
                _raise_own(best, units, wanted, of, rows)
            out = np.full(len(vectors), np.nan)
            out[present] = best
            yield pa.array(out, mask=np.isnan(out))

    return similarity


# --- scores -------------------------------------------------------------------------------------


def with_brand_score(
    texts: DataFrame, refs: DataFrame | ReferenceFiles, vector: str = "text_vec", brand: str = "brand_id",
    baseline: float = fixed.OFFBRAND_BASELINE, floor: float = fixed.BRAND_SCORE_FLOOR,
) -> DataFrame:
    """Add ``brand_score`` for the row's own brand."""
    scored = with_own_similarity(texts, refs, vector, brand)
    return scored.withColumn("brand_score", calibrated_brand_score(F.col("similarity"), baseline, floor)).drop("similarity")


def with_all_scores(
    texts: DataFrame, refs: DataFrame | ReferenceFiles, vector: str = "text_vec",
    baseline: float = fixed.OFFBRAND_BASELINE, floor: float = fixed.BRAND_SCORE_FLOOR,
) -> DataFrame:
    """Add ``scores``: array of (brand_id, brand_ord, score) over all brands."""
    scored = with_brand_similarities(texts, refs, vector)
    scores = F.transform("similarities", lambda s: F.struct(
        s.brand_id.alias("brand_id"), s.brand_ord.alias("brand_ord"),
        calibrated_brand_score(s.similarity, baseline, floor).alias("score"),
    ))
    return scored.withColumn("scores", scores).drop("similarities")


def score_matrix(scored: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per text and brand."""
    return scored.select(*keep, F.inline("scores"))


def score_of(brand: Column) -> Column:
    """Score of one brand out of ``scores``; null when the brand is unknown."""
    return F.get(F.filter("scores", lambda s: s.brand_id == brand), F.lit(0)).score


def pivoted(brands: Sequence[str], digits: int | None = None) -> list[Column]:
    """One ``score_<brand>`` column per listed brand, read out of ``scores`` within the row."""
    columns = []
    for brand in brands:
        score = score_of(F.lit(brand))
        columns.append((score if digits is None else round_binary(score, digits)).alias(f"score_{brand}"))
    return columns


def predicted_brand() -> Column:
    """Brand with the highest score; the first brand wins a tie."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s.score, -s.brand_ord, s.brand_id.alias("brand_id"))))
    return best.brand_id


def predicted_brand_of(rows: DataFrame, text_id: str) -> DataFrame:
    """The same from the long form, as a mergeable aggregate."""
    return rows.groupBy(text_id).agg(
        F.max_by("brand_id", F.struct("score", -F.col("brand_ord"))).alias("predicted_brand")
    )


def brand_proof(scored: DataFrame, source: str = "source_brand") -> DataFrame:
    """Own score, best score of another brand, and whether the own one is higher (before rounding)."""
    others = F.array_max(F.transform(F.filter("scores", lambda s: s.brand_id != F.col(source)), lambda s: s.score))
    return scored.withColumns({"own_score": score_of(F.col(source)), "max_cross_score": others}).withColumn(
        "own_higher_than_cross", F.col("own_score") > F.col("max_cross_score")
    )


def proof_failures(proof: DataFrame, *keep: str) -> DataFrame:
    """One row per violated claim."""
    claims = F.array_compact(F.array(
        F.when(F.col("own_score") <= 0, F.lit("own_score <= 0")),
        F.when(~F.col("own_higher_than_cross"), F.lit("own not higher than cross")),
    ))
    return proof.select(*keep, F.explode(claims).alias("reason"))


def proof_summary(proof: DataFrame) -> DataFrame:
    """Number of texts, of texts that beat every other brand, and whether all scores are positive."""
    positive = F.forall("scores", lambda s: s.score > 0)
    return proof.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("own_higher_than_cross").alias("n_own_higher"),
        F.bool_and(positive).alias("all_positive"),
    )


def validate_alignment(
    refs: DataFrame, baseline: float = fixed.OFFBRAND_BASELINE, floor: float = fixed.BRAND_SCORE_FLOOR,
    own_refs: int = 3, cross_refs: int = 2,
) -> DataFrame:
    """Per brand: mean score of its first references to itself and to the other brands."""
    first = refs.where(F.col("ref_ord") <= max(own_refs, cross_refs)).select(
        F.col("brand_id").alias("own_brand"), "ref_ord", "ref_vec"
    )
    rows = score_matrix(with_all_scores(first, refs, "ref_vec", baseline, floor), "own_brand", "ref_ord")
    own = (F.col("brand_id") == F.col("own_brand")) & (F.col("ref_ord") <= own_refs)
    cross = (F.col("brand_id") != F.col("own_brand")) & (F.col("ref_ord") <= cross_refs)
    means = rows.groupBy(F.col("own_brand")).agg(
        F.avg(F.when(own, F.col("score"))).alias("own_mean"), F.avg(F.when(cross, F.col("score"))).alias("cross_mean")
    )
    return means.select(
        F.col("own_brand").alias("brand_id"), "own_mean", "cross_mean", (F.col("own_mean") > F.col("cross_mean")).alias("own_higher")
    )


def offbrand_baseline(refs: DataFrame) -> DataFrame:
    """Mean best cosine between a reference and each other brand: the calibration base of an embedder."""
    keyed = refs.select(F.col("brand_id").alias("own_brand"), "ref_vec")
    rows = with_brand_similarities(keyed, refs, "ref_vec").select("own_brand", F.inline("similarities"))
    return rows.where(F.col("brand_id") != F.col("own_brand")).agg(F.avg("similarity").alias("baseline"))


def scores_from_columns(brands: Sequence[str]) -> Column:
    """``scores`` from one ``score_<brand>`` column per brand, as the evaluation files hold them."""
    return F.array(*[
        F.struct(F.lit(b).alias("brand_id"), F.lit(i).alias("brand_ord"), F.col(f"score_{b}").alias("score"))
        for i, b in enumerate(brands)
    ])
