"""Names across modules: imports, re-exports under other names, default exports and star re-exports, followed to where a name is defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dropped, fixpoint, written

#: A name that stands for all of a module's names, and the one that a star doesn't pass on.
STAR, DEFAULT = "*", "default"


def reachable(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs joined by a path of edges, by joining paths with paths until there is no new pair."""
    pairs = written(edges.select("src", "dst").distinct(), "reach")
    n = pairs.count()
    while True:
        longer = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        after = written(pairs.unionByName(longer).distinct(), "reach")
        dropped(pairs)
        now = after.count()
        if now == n:
            return after
        pairs, n = after, now


def resolve_names(starts: DataFrame, bindings: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, gaps). ends: file, name, target_file, target_name of each start (file, name), as many as a name has; gaps: starts that end nowhere.

    bindings: file, name, source_file, source_name. The name is another module's (or, for a default export, the module's own) name. The name * passes all names of the source but
    the default one; a source name of * is the module as a whole, which is an end. definitions: file, name; a defined name goes before any binding of it, a bound one before
    what a star passes. Cycles and missing names end nowhere.
    """
    node = lambda f, n: F.struct(F.col(f).alias("file"), F.col(n).alias("name"))
    defined = written(definitions.select("file", "name").distinct(), "defined")
    explicit = written(bindings.filter(F.col("name") != STAR).join(defined, ["file", "name"], "left_anti").select("file", "name", "source_file", "source_name").distinct(), "explicit")
    stars = written(bindings.filter(F.col("name") == STAR).select(F.col("file").alias("src"), F.col("source_file").alias("dst")).filter("src <> dst").distinct(), "stars")
    held = defined.unionByName(explicit.select("file", "name")).distinct()
    # Names that a module could pass: those that a module it reaches by stars has itself.
    passed = reachable(stars).join(held.select(F.col("file").alias("dst"), "name"), "dst").filter(F.col("name") != DEFAULT).select(F.col("src").alias("file"), "name").distinct()
    passed = written(passed.join(held, ["file", "name"], "left_anti"), "passed")
    known = held.unionByName(passed).select(F.col("file").alias("dst"), "name")
    star_edges = passed.withColumnRenamed("file", "src").join(stars, "src").join(known, ["dst", "name"], "left_semi").select(node("src", "name").alias("node"), node("dst", "name").alias("target"))
    edges = explicit.select(node("file", "name").alias("node"), node("source_file", "source_name").alias("target")).unionByName(star_edges)
    reached = fixpoint(edges, starts.select(node("file", "name").alias("node"))).select("start", "node.file", "node.name")
    whole = explicit.filter(F.col("source_name") == STAR).select(F.col("source_file").alias("file"), F.lit(STAR).alias("name")).distinct()
    found = reached.join(defined.unionByName(whole).distinct(), ["file", "name"])
    ends = written(found.select(F.col("start.file").alias("file"), F.col("start.name").alias("name"), found["file"].alias("target_file"), found["name"].alias("target_name")), "ends")
    return ends, starts.select("file", "name").distinct().join(ends, ["file", "name"], "left_anti")
