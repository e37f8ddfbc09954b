"""What both vector searches share: cleaning, lengths, and Arrow columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part: id and vector not null, all components finite. Floats stay floats, other numbers become doubles."""
    single = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def by_length(rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """Vectors of each length by themselves: an inner product is of two of a length."""
    found = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row for each length
    return [(n, rows if len(found) == 1 else rows.where(F.size("v") == n)) for n in found]


def one_each(df: DataFrame) -> DataFrame:
    """Of rows that share an id the smallest vector: as a query an id counts once."""
    return df.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else np.zeros((0, 0))
