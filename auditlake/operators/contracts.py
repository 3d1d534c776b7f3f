"""Contract assertions: each returns the rows that break it, as check and subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(rows: DataFrame, name: str, subject: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("violation"), subject.cast("string").alias("subject"))


def duplicates(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return _named(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), name, F.concat_ws("/", *(F.col(k).cast("string") for k in key)))


def orphans(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, name: str) -> DataFrame:
    return _named(rows.select(key).distinct().join(dimension.select(F.col(dimension_key).alias(key)).distinct(), key, "left_anti"), name, F.col(key))


def out_of_sequence(rows: DataFrame, by: str, number: str, name: str) -> DataFrame:
    """Groups whose numbers aren't 1, 2, 3, ..."""
    n = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(number)))
    return _named(n.filter(F.col("_k") != F.col(number)).select(by).distinct(), name, F.col(by))


def unsorted(rows: DataFrame, key: str, items: str, name: str) -> DataFrame:
    return _named(rows.filter(F.array_sort(items) != F.col(items)), name, F.col(key))


def overlapping_scopes(checks: DataFrame, key: str, scopes: str, name: str) -> DataFrame:
    """Scopes claimed by more than one check."""
    return duplicates(checks.select(key, F.explode(F.array_distinct(scopes)).alias("scope")), ["scope"], name)


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
