"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_path
from ..sources.adapters import VIEWS, split_expressions, table
from ..streaming import logs
from .catalogue import query
from .findings import KEYED


@query(f"WITH {KEYED} SELECT key, min(ord) AS ord, count(*) AS n FROM keyed GROUP BY key")
def streamed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_path(spark, "pool")
    stream = logs.file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    logs.grow_pool(spark, stream.selectExpr(*split_expressions(VIEWS["candidates_v"][1])), f"{base}/pool", f"{base}/state")
    return logs.read_pool(spark, f"{base}/pool").select("key", "ord", "n")
