"""Vectors in blocks: what exact and approximate search share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries that are multiplied at once, and bytes of each side in one cell of their grid.
BLOCK, QUERY_BLOCK, CELL_BYTES = 2048, 512, 24 << 20


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v, dim) of vectors that are not null and hold finite numbers only; v keeps its type.

    Rows without a vec_id take no part. Rows that share a vec_id count once, with their least vector.
    """
    good = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    if nonzero:
        good += " and exists(v, x -> x <> 0)"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).filter(good)
    return v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix_of(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def slices_of(table: pa.Table, rows: int):
    for at in range(0, len(table), rows):
        yield table.slice(at, rows)


def meet(vectors: DataFrame, queries: DataFrame, score, ddl: str, vector_bytes: int, query_bytes: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``score`` over vectors beside queries of the same length (columns vec_id, v, dim and others), in the cells of a grid.

    A vector has a row and goes to every column, a query has a column and goes to every row. A cell holds about
    ``cell_bytes`` of each side, so either side may be of any size. score gets (vector table, query table, dim) of a cell,
    each in the order of vec_id, and gives Arrow batches.
    """
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    n_rows = max(math.ceil(vector_bytes / cell_bytes), min(spread, math.ceil(vector_bytes / (1 << 20))), 1)
    n_cols = max(1, math.ceil(query_bytes / cell_bytes))
    left = vectors.withColumn("row", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))))
    right = queries.withColumn("col", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def cell(key, own, asked):
        out = [*score(own.sort_by("vec_id"), asked.sort_by("vec_id"), key[0].as_py())] if len(own) and len(asked) else []
        return pa.Table.from_batches(out) if out else empty

    empty = _arrow_of(ddl).empty_table()
    key = ["dim", "row", "col"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(cell, ddl)


def _arrow_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])
