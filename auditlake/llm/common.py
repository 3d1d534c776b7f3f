"""Shared plumbing of the training-data operators: the shared folder, written tables, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract here: blank, tab, line feed, vertical tab, form feed, return.
WS_CLASS = r"[\x20\x09-\x0D]"

#: A side is broadcast only when it was counted first and has at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode (tests), where the session names none, is one made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths that this session's operators wrote; clear_scratch drops them.
_scratch: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Drop all intermediate tables. Results that were not written yet read them, so call it after their last use."""
    while _scratch:
        drop_path(spark, _scratch.pop())


def located(df: DataFrame) -> DataFrame:
    """The rows with file and row number at hand (_metadata): as they are if they come from files that have them, else written first."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return df
    except AnalysisException:
        return materialise(df, "source")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.mkdirs(where)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def small_enough(df: DataFrame, bytes_per_row: int) -> bool:
    """Whether the counted rows stay under BROADCAST_BYTES; callers shuffle instead when they don't."""
    most = BROADCAST_BYTES // bytes_per_row
    return df.limit(most + 1).count() <= most


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores; tables of more splits than that are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered_id(column: str = "doc_id") -> Column:
    """A struct by which min() takes the smallest id, null ids last."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("id"))
