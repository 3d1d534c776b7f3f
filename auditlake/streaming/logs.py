"""Streams over append-only logs: the pool of findings grows batch by batch, and rounds are counted by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import findings


def grow_pool(spark: SparkSession, rows: DataFrame, pool_path: str, checkpoint: str) -> None:
    """Run a stream of candidates to its end; each batch appends the identities that the pool lacks and how often each was seen."""

    def add(batch: DataFrame, number: int) -> None:
        keyed = batch.select(F.array_join(findings.candidate_key(), "|").alias("key"), "ord").groupBy("key").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
        keyed.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{pool_path}/number={number}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_pool(spark: SparkSession, pool_path: str) -> DataFrame:
    """key, first ordinal, rows, and the batch that brought the key."""
    rows = spark.read.parquet(f"{pool_path}/number=*")
    return rows.groupBy("key").agg(F.min("ord").alias("ord"), F.sum("n").alias("n"), F.min("batch").alias("new_in"))


def file_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """A stream over a table's files; the pattern lets path be a single file too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def rounds_by_day(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events per type and day, late ones within the watermark counted, a day's state dropped after it."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
