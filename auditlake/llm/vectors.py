"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.col(vector_col).isNotNull() & F.forall(F.col(vector_col).cast("array<double>"), lambda c: F.coalesce(finite(c), F.lit(False)))


def floored(vector_col: str, scale: int) -> Column:
    """floor(scale * c) of every entry, as long. Entries beyond the range of long become its ends."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))


def padded(vectors: DataFrame, column: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """Vectors filled up with zeros to the longest, or the next multiple; and that width."""
    width = vectors.agg(F.max(F.size(column))).first()[0] or 0
    width = -(-width // multiple) * multiple
    return vectors.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(column)))), width


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A batch's vectors of equal width, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrices(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield matrix(batch.column(k), width)
