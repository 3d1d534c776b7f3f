"""Contract facts: scope, call edges by key, caller indexes, normalised function records, import trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def in_scope(path: Column, root: str, is_interface: Column, rules: P.PathRules) -> Column:
    """Contracts below the root or without a path that are neither noise nor interfaces."""
    below = path.isNull() | (path == "") | path.startswith(root.rstrip("/") + "/")
    return below & ~F.coalesce(P.is_noise(path, rules), F.lit(False)) & ~is_interface


def normalised(functions: DataFrame, key: list[str], arrays: list[str]) -> DataFrame:
    """One record per function, its lists sorted and without repeats."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return functions.groupBy(*key).agg(*map(union, arrays))


def call_edges(calls: DataFrame, fragments: DataFrame) -> DataFrame:
    """source, target of calls (source, key) to fragments (target, key); a function's calls of itself are dropped."""
    return calls.join(fragments, "key").filter("source <> target").select("source", "target").distinct()


def callers(calls: DataFrame) -> DataFrame:
    """callee, callers (sorted) from rows (caller, callees)."""
    return calls.select("caller", F.explode("callees").alias("callee")).groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def import_in_tree(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """spec_id, in_tree: whether a specifier's dotted or slashed path, or any end of it, names a folder of the tree."""
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(P.directories(F.col("path"))), F.lit(1))), lambda i: F.array_join(F.slice(P.directories(F.col("path")), 1, i), "/"))).alias("folder")).filter("folder <> ''")
    names = folders.select(F.substring_index("folder", "/", -1).alias("folder")).unionByName(folders).distinct()
    parts = F.split(F.regexp_replace("spec", r"\.", "/"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    hit = specifiers.select("spec_id", F.explode(ends).alias("folder")).join(names, "folder", "left_semi").select("spec_id").distinct().withColumn("_in", F.lit(True))
    return specifiers.select("spec_id").join(hit, "spec_id", "left").select("spec_id", F.coalesce("_in", F.lit(False)).alias("in_tree"))
