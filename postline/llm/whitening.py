"""Embedding whitening with MLlib's BlockMatrix.

1. Each entry c becomes the integer x = floor(scale * c).  The *fit list* holds
   every distinct x vector once; its size n and the sums S per dimension are
   integers.
2. The centred fit rows are indexed and dealt into blocks of about ``ROWS`` rows;
   transpose times itself gives the scatter matrix.  The blocks of the long side are
   multiplied in many tasks (``SPLIT`` blocks each) and their products added, so
   no task sees more than its blocks.
3. The scatter matrix, one number for each pair of dimensions, comes to the driver: ``eigh``
   there gives the components and the whitening matrix.
4. Another BlockMatrix of all rows (copies included), multiplied by the whitening
   matrix, projects them; rows and projections meet by the row's index, which is
   unique, so copies of one vector are dealt like any other rows.
5. ``identity_error`` is measured on the projected fit list, not derived.

What goes through the driver: numbers per dimension and pair of dimensions, the
number of rows of each partition, and MLlib's list of block places (at most ``MAX_BLOCKS``).

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped,
and so are vectors whose length is not the commonest of the table (ties: the longer); null and repeated ids
stay rows of their own; other columns are ignored; components whose eigenvalue is zero (to
double precision) can't be scaled and give no rows, so a table of one distinct
vector, of empty vectors or without rows gives none; ``deviation`` is null where it
doesn't fit a long.  Equal eigenvalues: components in the order that eigh gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postline.session import written

SCALE = 256
COMPONENTS = 4
ROWS = 1024                 # rows of a block, at least
COLUMNS = 1024              # columns of a block
SPLIT = 16                  # blocks multiplied by one task, about
MAX_BLOCKS = 1_000_000      # blocks of rows; beyond, blocks get more rows


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written with their place (partition p, row r of it), which stays the same from then on."""
    return written(rows.withColumns({"p": F.spark_partition_id(), "r": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _indexed(rows: DataFrame) -> DataFrame:
    """Places as indices 0, 1, 2, ...; one row a partition is sent to all tasks."""
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "p").withColumn("index", F.col("before") + F.col("r")).drop("p", "r", "before")


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sums of its dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(-1, dims)
                wide = int(np.abs(x.astype(np.float64)).max()) * len(x) >= 1 << 62
                n += len(x)
                total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], ["n", "s"])

    parts = fit.select("x").mapInArrow(run, "n long, s array<decimal(38,0)>")
    found = (parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
             .orderBy("i").collect())
    return (int(found[0]["n"]), [int(r["s"]) for r in found]) if found else (0, [])


def _blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """A matrix of rows (index, vector: array of doubles) in blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(max(ROWS, -(-n // MAX_BLOCKS)), COLUMNS)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix.  The middle dimension, the long one, is split over tasks."""
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, -(-blocks // SPLIT))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _project(matrix: BlockMatrix, by: np.ndarray, spark: SparkSession) -> DataFrame:
    """(index, w) for all rows: the rows times a small matrix."""
    small = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(by)], "index long, vector array<double>")
    factor = MLUtils.convertVectorColumnsFromML(small.select("index", array_to_vector("vector").alias("vector")), "vector")
    product = matrix.multiply(IndexedRowMatrix(factor, *by.shape).toBlockMatrix(COLUMNS, COLUMNS)).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("w"))


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum of (n * x - S)^2, exact; null if it doesn't fit."""
    if any(abs(s) >= 1 << 63 for s in sums):
        return F.lit(None).cast("long")
    apart = F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in sums]),
                       lambda a, s: F.try_subtract(F.try_multiply(a, F.lit(n).cast("long")), s))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda total, v: F.try_add(total, F.try_multiply(v, v)))


def components(fit: BlockMatrix, n: int, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the variance, and the whitening matrix, of the leading
    components of centred rows."""
    values, vectors = np.linalg.eigh((lambda v: (v + v.T) / 2)(_scatter(fit) / n))
    values, vectors = values[::-1], vectors[:, ::-1]
    whole = values[:count] > max(values[0], 0) * len(values) * np.finfo(float).eps
    values, vectors, trace = values[:count][whole], vectors[:, :count][:, whole], values.sum()
    return values / trace if len(values) else values, vectors / np.sqrt(values)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable vector and leading component: vec_id, component (from
    1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    found = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where(_finite(F.col("c")))
    found = _placed(found.select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(scale)))).alias("x")), "whiten_rows")
    common = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = common["d"] if common else 0
    rows = _indexed(found).where(F.size("x") == dims)
    fit = _placed(found.where(F.size("x") == dims).select("x").distinct(), "whiten_fit")
    n, sums = _sums(fit, dims) if dims else (0, [])
    empty = found.limit(0).select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in
                                              (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"),
                                               ("identity_error", "double"))])
    if not n:
        return empty
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with("x", mean, lambda a, m: a.cast("double") - m).alias("vector")
    matrix = _blocks(_indexed(fit).select("index", centred), n, dims)
    explained, whitening = components(matrix, n, count)
    k = len(explained)
    if not k:
        return empty
    fitted = _project(matrix, whitening, spark)
    entries = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i + 1)]
    error = fitted.agg(F.greatest(*entries) if len(entries) > 1 else entries[0]).first()[0]
    total = found.count()
    projected = _project(_blocks(rows.select("index", centred), total, dims), whitening, spark)
    named = rows.select("index", "vec_id", _deviation(F.col("x"), n, sums).alias("deviation")).join(projected, "index")
    share = F.array(*[F.lit(float(e)) for e in explained])
    return (named.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    share[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error")))
