"""int8 vectors: calibration ranges, quantization, the vector contract."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import read_table, table_exists, write_table

CALIBRATION_SCHEMA = "dim INT, lo DOUBLE, hi DOUBLE"


def _unpacked(packed: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` bytes each, as ``embed`` packs them."""
    begin = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if size and len(packed) else 0
    data = np.frombuffer(packed.buffers()[2], np.uint8)[begin:begin + size * len(packed)] if size and len(packed) else np.zeros(0, np.uint8)
    return data.view("<f4").reshape(len(packed), size // 4)


def same_length(lists: pa.Array) -> np.ndarray:
    """A column of lists, or of packed floats, as a matrix; vectors of different lengths, or with nulls inside, are an error."""
    if pa.types.is_binary(lists.type):
        sizes = pc.unique(pc.binary_length(lists)).to_pylist()
        if None in sizes or len(sizes) > 1 or any(n % 4 for n in sizes):
            raise ValueError("vectors of different lengths or nulls: select those that are valid first")
        return _unpacked(lists, sizes[0] if sizes else 0)
    values = lists.flatten()
    if lists.null_count or values.null_count or len(set(lists.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of different lengths or with nulls: select those that are valid first")
    return values.to_numpy(zero_copy_only=False).reshape(len(lists), len(values) // max(1, len(lists)))


def valid_rows(lists: pa.Array, dims: int) -> np.ndarray:
    """Flags of the vectors with exactly ``dims`` elements and no null."""
    if pa.types.is_binary(lists.type):
        return pc.binary_length(lists).fill_null(-1).to_numpy(zero_copy_only=False) == 4 * dims
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok, values = lengths == dims, lists.flatten()
    if values.null_count:
        row = np.repeat(np.arange(len(lists)), np.maximum(lengths, 0))
        ok[row[values.is_null().to_numpy(zero_copy_only=False)]] = False
    return ok


def _range_rows(lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo.astype(np.float64)), pa.array(hi.astype(np.float64))]


def calibrate(vectors: DataFrame, batch_column: str | None = None) -> DataFrame:
    """(dim, lo, hi): range of each dimension over all vectors.

    Every task first reduces its own rows to one range per dimension, so only
    ``tasks x dims`` rows are shuffled. Vectors must be of one length (see ``validate``). With ``batch_column`` ranges are kept per batch instead.
    """
    if batch_column is not None:
        values = vectors.select(F.col(batch_column).alias("batch"),
                                F.posexplode("embedding").alias("dim", "value"))
        return values.groupBy("batch", "dim").agg(
            F.min(F.col("value").cast("double")).alias("lo"), F.max(F.col("value").cast("double")).alias("hi"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            matrix = same_length(lists)
            below, above = matrix.min(axis=0), matrix.max(axis=0)
            lo = below if lo is None else np.minimum(lo, below)
            hi = above if hi is None else np.maximum(hi, above)
        if lo is not None:
            yield pa.RecordBatch.from_arrays(_range_rows(lo, hi), ["dim", "lo", "hi"])

    rows = vectors.where("embedding IS NOT NULL").select(F.col("embedding").cast("array<float>"))
    return (rows.mapInArrow(ranges, CALIBRATION_SCHEMA)
            .groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def _packed(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.simpleString() == "binary"


def survey(vectors: DataFrame, dims: int) -> DataFrame:
    """(dim, lo, hi, accepted, rejected): the ranges of the valid vectors, and in the row of dimension -1 how
    many are valid and how many are not. One scan of the vectors; a task gives ``dims + 1`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dims, np.inf, np.float32), np.full(dims, -np.inf, np.float32)
        accepted = rejected = 0
        for batch in batches:
            lists = batch.column(0)
            ok = valid_rows(lists, dims)
            n = int(ok.sum())
            accepted, rejected = accepted + n, rejected + len(ok) - n
            if n:
                matrix = same_length(lists if n == len(ok) else lists.filter(pa.array(ok)))
                np.minimum(lo, matrix.min(axis=0), out=lo)
                np.maximum(hi, matrix.max(axis=0), out=hi)
        counts = [pa.array([-1], pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        names = ["dim", "lo", "hi", "accepted", "rejected"]
        yield pa.RecordBatch.from_arrays([*counts, pa.array([accepted]), pa.array([rejected])], names)
        if accepted:
            yield pa.RecordBatch.from_arrays([*_range_rows(lo, hi), *[pa.nulls(dims, pa.int64())] * 2], names)

    rows = vectors.select("embedding" if _packed(vectors) else F.col("embedding").cast("array<float>"))
    return (rows.mapInArrow(run, f"{CALIBRATION_SCHEMA}, accepted BIGINT, rejected BIGINT").groupBy("dim")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))


def _ranges_column(calibration: DataFrame) -> Column:
    """The calibration as one array, fetched once as a scalar subquery; one entry per dimension."""
    packed = F.array_sort(F.collect_list(F.struct("dim", "lo", ((F.col("hi") - F.col("lo")) / 255).alias("step"))))
    return calibration.agg(packed.alias("ranges")).scalar()


def _ranges(calibration: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Low ends and steps by dimension; a row of the calibration each."""
    table = calibration.select("dim", "lo", "hi").toArrow().sort_by("dim")
    lo, hi = (table.column(c).to_numpy().astype(np.float64) for c in ("lo", "hi"))
    with np.errstate(all="ignore"):
        return lo, (hi - lo) / 255


def levels(values: np.ndarray, lo: np.ndarray, step: np.ndarray) -> np.ndarray:
    """``trunc((v - lo) / step - 128)`` within [-128, 127]; a constant dimension gives 0."""
    with np.errstate(all="ignore"):
        level = values.astype(np.float64)
        level -= lo
        level /= step
    level -= 128
    level[np.isnan(level)] = 127
    np.clip(level, -128, 127, out=level)
    # a cast to a whole number truncates toward zero
    return np.where(step == 0, np.int8(0), level.astype(np.int8))


def _level_lists(lists: pa.Array, lo: np.ndarray, step: np.ndarray) -> pa.Array:
    """Levels of a batch. Vectors of another length are filled up; what has no value or no range is at the low end."""
    dims = len(lo)
    if len(lists) and valid_rows(lists, dims).all():
        matrix = levels(same_length(lists), lo, step)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(lists) + 1) * dims).astype(np.int32)), pa.array(matrix.ravel()))
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    given = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    made = np.where(there, np.maximum(given, dims), 0)
    begin = np.r_[0, np.cumsum(made)]
    dim = np.arange(begin[-1]) - np.repeat(begin[:-1], made)
    flat, value, known = lists.flatten(), np.zeros(begin[-1]), np.zeros(begin[-1], bool)
    place = np.arange(len(flat)) + np.repeat(begin[:-1] - (np.cumsum(given) - given), given)
    value[place] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    known[place] = flat.is_valid().to_numpy(zero_copy_only=False)
    level, ranged = np.full(begin[-1], -128, np.int8), dim < dims
    found = levels(value[ranged], lo[dim[ranged]], step[dim[ranged]])
    level[ranged] = np.where(known[ranged] | (step[dim[ranged]] == 0), found, np.int8(-128))
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(level), mask=pa.array(~there))


def quantize(vectors: DataFrame, calibration: DataFrame) -> DataFrame:
    """(id, qv) under a given calibration, which is fetched at once, a row for each dimension; values
    outside its ranges clamp."""
    lo, step = _ranges(calibration)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _level_lists(batch.column(1), lo, step)], ["id", "qv"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"id {id_type}, qv array<tinyint>")


def index_rows(vectors: DataFrame, calibration: DataFrame) -> DataFrame:
    """(id, qv, norm) of the valid vectors, in one pass; ``norm`` as of ``with_norm``."""
    lo, step = _ranges(calibration)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(valid_rows(batch.column(1), len(lo))))
            if not batch.num_rows:
                continue
            qv = _level_lists(batch.column(1), lo, step)
            wide = same_length(qv).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))  # of an exact whole number
            yield pa.RecordBatch.from_arrays([batch.column(0), qv, pa.array(norm)], ["id", "qv", "norm"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"id {id_type}, qv array<tinyint>, norm double")


def dequantized(qv: Column, ranges: Column) -> Column:
    """Approximate original values, ``qv * step + lo`` counted from the low end."""
    return F.zip_with(qv, ranges, lambda v, r: ((v.cast("double") + 128) * r["step"] + r["lo"]).cast("float"))


def dequantize(quantized_vectors: DataFrame, calibration: DataFrame) -> DataFrame:
    ranged = quantized_vectors.select("id", "qv", _ranges_column(calibration).alias("ranges"))
    return ranged.select("id", dequantized(F.col("qv"), F.col("ranges")).alias("embedding"))


def with_norm(vectors: DataFrame) -> DataFrame:
    """Add ``norm``, the length of ``qv``, from an exact whole-number sum."""
    squares = F.aggregate("qv", F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long") * v.cast("long"))
    return vectors.withColumn("norm", F.sqrt(squares.cast("double")))


def validate(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Vectors of exactly ``dims`` elements without nulls, as flags: adds ``valid``."""
    ok = (F.size(column) == dims) & ~F.exists(column, lambda v: v.isNull())
    return vectors.withColumn("valid", F.coalesce(ok, F.lit(False)))


def validation_counts(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """(dims, accepted, rejected)."""
    return validate(vectors, dims, column).agg(
        F.count_if("valid").alias("accepted"), F.count_if(~F.col("valid")).alias("rejected")).select(
        F.lit(dims).alias("dims"), "accepted", "rejected")


def commonest_length(vectors: DataFrame) -> int:
    """Elements that most vectors have; 0 where there is none."""
    size = F.floor(F.octet_length("embedding") / 4) if _packed(vectors) else F.size("embedding")
    sizes = vectors.where("embedding IS NOT NULL").groupBy(size.alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    return most["dims"] if most else 0


def accepted(vectors: DataFrame, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The valid vectors, and (dims, accepted, rejected). Without ``dims`` the commonest length counts."""
    if dims is None:
        dims = commonest_length(vectors)
    return validate(vectors, dims).where("valid").drop("valid"), validation_counts(vectors, dims)


def save_vector_index(vectors: DataFrame, path: str, mode: str = "ignore", dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write calibration and ``id, qv, norm`` under ``path``; return (index, calibration).

    ``vectors(id, embedding)`` holds lists or packed floats. It is scanned twice, and once more for the commonest length where ``dims`` is not given, so it
    should be a stored table of floats. Vectors of another length or with nulls are left out before the
    ranges are taken, and counted in ``path/validation``.
    """
    spark = vectors.sparkSession
    if mode != "ignore" or not table_exists(spark, f"{path}/vectors"):
        dims = commonest_length(vectors) if dims is None else dims
        found = cut(survey(vectors, dims))  # a row for each dimension
        counted = found.where("dim = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("accepted", "rejected")])
        write_table(counted.select(F.lit(dims).alias("dims"), "accepted", "rejected").coalesce(1), f"{path}/validation")
        write_table(found.where("dim >= 0").select("dim", "lo", "hi").coalesce(1), f"{path}/calibration")
        ranges = spark.read.parquet(f"{path}/calibration")
        write_table(index_rows(vectors, ranges), f"{path}/vectors")
    return read_table(spark, f"{path}/vectors"), read_table(spark, f"{path}/calibration")
