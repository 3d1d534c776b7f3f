"""Greedy, order-dependent packing into units, streamed: a task holds one unit's state, never a whole group.

Units are cut sequentially by definition, so rows of one group go through one task in order; memory stays constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def greedy(rows: DataFrame, by: str, order: list[str], size: str, cap: int, most: int | None = None, joint: int = 0) -> DataFrame:
    """A column unit, from 0 in each group: a new one begins when the next row would exceed cap (or most rows).

    joint is the length of what stands between two rows of a unit. A row over the cap stands alone.
    """
    schema = StructType([*rows.schema.fields, StructField("unit", LongType())])
    arrow = to_arrow_schema(schema)
    at_key, at_size = rows.columns.index(by), rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, count, unit, begun = None, 0, 0, 0, False
        for batch in batches:
            units = []
            for k, s in zip(batch.column(at_key).to_pylist(), batch.column(at_size).to_pylist(), strict=True):
                s = s or 0
                if not begun or k != key:
                    key, total, count, unit, begun = k, 0, 0, 0, True
                elif total + joint + s > cap or (most and count >= most):
                    total, count, unit = 0, 0, unit + 1
                total, count = total + s + (joint if count else 0), count + 1
                units.append(unit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.int64())], schema=arrow)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def until_full(rows: DataFrame, by: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """Rows until the running total reaches the cap; the row that crosses it is kept."""
    before = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < cap).drop("_before")


def equal_budget(cap: int, joint: int, n: int) -> int:
    """What each of n parts may take of a budget when the joints between them count."""
    return max(0, (cap - joint * (n - 1)) // n) if n else 0
