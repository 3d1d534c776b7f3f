"""Closed line intervals per file: merging, measuring, overlap, containment, nearest enclosing.

Overlap and membership joins are equi-joins on file and a bin of lines, so a long file's intervals fall into many
tasks; a pair that shares several bins is reported in the first it shares only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def merge(rows: DataFrame, by: list[str], start: str = "lo", end: str = "hi") -> DataFrame:
    """Maximal runs of intervals that overlap or touch (the next begins at most one after the end)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Equal intervals are one before they are sorted.
    return rows.select(*by, start, end).distinct().withColumn("island", island).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def union_length(rows: DataFrame, by: list[str], start: str = "lo", end: str = "hi") -> DataFrame:
    """How many places half-open intervals cover together."""
    merged = merge(rows.select(*by, start, (F.col(end) - 1).alias(end)).filter(F.col(start) <= F.col(end)), by, start, end)
    return merged.groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + 1).alias("covered"))


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(end / BIN)))


def overlap(left: DataFrame, right: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """Pairs of intervals (lo, hi) and (lo_r, hi_r) of one file that share a place; or the left rows of such pairs."""
    a = left.withColumn("_bin", _bins(F.col("lo"), F.col("hi")))
    b = right.withColumn("_bin", _bins(F.col("lo_r"), F.col("hi_r")))
    met = a.join(b, [by, "_bin"]).filter((F.col("lo") <= F.col("hi_r")) & (F.col("hi") >= F.col("lo_r")))
    pairs = met.filter(F.col("_bin") == F.floor(F.greatest("lo", "lo_r") / BIN)).drop("_bin")
    return pairs if how == "inner" else pairs.select(*left.columns).distinct()


def members(points: DataFrame, ranges: DataFrame, by: str, point: str, inside: bool = True) -> DataFrame:
    """Points that lie in some (inside) or in no range (lo, hi) of their file; points without a place are in none."""
    b = ranges.select(by, "lo", "hi").distinct().withColumn("_bin", _bins(F.col("lo"), F.col("hi")))
    a = points.withColumn("_bin", F.floor(F.col(point) / BIN))
    on = (a[by] == b[by]) & (a["_bin"] == b["_bin"]) & (a[point] >= b["lo"]) & (a[point] <= b["hi"])
    return a.join(b, on, "left_semi" if inside else "left_anti").drop("_bin")


def outermost(rows: DataFrame, by: str, ord_col: str) -> DataFrame:
    """Rows not nested in another of their file; of equal ones the first stays.

    In order of start and falling end an interval is nested exactly if one before it reaches its end, so one running maximum replaces a self-join.
    """
    w = Window.partitionBy(by).orderBy("lo", F.desc("hi"), ord_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("hi").over(w)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("hi"))).drop("_reach")


def nearest_enclosing(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """For each inner interval the narrowest outer one (lo_r, hi_r) that holds it and is longer; ties go to the first start."""
    pairs = overlap(inner, outer, by).filter((F.col("lo_r") <= F.col("lo")) & (F.col("hi_r") >= F.col("hi")) & (F.col("hi_r") - F.col("lo_r") > F.col("hi") - F.col("lo")))
    best = F.min(F.struct((F.col("hi_r") - F.col("lo_r")).alias("width"), F.col("lo_r"), F.col("hi_r")))
    return pairs.groupBy(*inner.columns).agg(best.alias("b")).select(*inner.columns, "b.lo_r", "b.hi_r")


def not_only_nested(definitions: DataFrame, nested: DataFrame, changed: DataFrame, by: str) -> DataFrame:
    """Definitions with a changed line that lies in none of the changed definitions nested in them. changed: by, line (distinct)."""
    lines = overlap(definitions, changed.select(by, F.col("line").alias("lo_r"), F.col("line").alias("hi_r")), by).withColumnRenamed("lo_r", "line").drop("hi_r")
    lines = lines.withColumn("_bin", F.floor(F.col("line") / BIN))
    inner = nested.select(by, F.col("lo").alias("lo_n"), F.col("hi").alias("hi_n")).distinct().withColumn("_bin", _bins(F.col("lo_n"), F.col("hi_n")))
    on = (lines[by] == inner[by]) & (lines["_bin"] == inner["_bin"]) & (F.col("lo_n") >= F.col("lo")) & (F.col("hi_n") <= F.col("hi")) & (F.col("hi_n") - F.col("lo_n") < F.col("hi") - F.col("lo")) & F.col("line").between(F.col("lo_n"), F.col("hi_n"))
    return lines.join(inner, on, "left_anti").select(*definitions.columns).distinct()
