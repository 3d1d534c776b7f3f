"""Bounded traversal, paths, fixpoints and components over dependency edges (src, dst).

Loops run on the driver, one written round at a time: each round joins a frontier with the edges and removes what was
seen. Rounds are bounded by a depth or end when nothing new appears; lineage is cut each round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; one of our own only where it is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "round") -> DataFrame:
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written rounds that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges reachable from the seeds (node) with their least hop, from 1. The frontier goes on over call edges only."""
    frontier = seeds.select("node").distinct()
    found = None
    visited = frontier
    for hop in range(1, depth + 1):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").withColumn("hop", F.lit(hop))
        if found is not None:
            step = step.join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        step = written(step.select("src", "dst", "kind", "hop"), "hops")
        found = step if found is None else found.unionByName(step)
        frontier = step.filter("kind = 'call'").select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        visited = visited.unionByName(frontier).distinct()
    return found


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """path: node lists from a seed over call edges without repeats or other seeds, that end at the depth or where nothing follows."""
    call = edges.filter("kind = 'call'").select("src", "dst").join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    paths = seeds.select(F.array("node").alias("path"))
    out = []
    for _ in range(depth):
        last = paths.withColumn("src", F.element_at("path", -1))
        grown = last.join(call, "src").filter(~F.array_contains("path", F.col("dst"))).select("path", F.concat("path", F.array("dst")).alias("next"))
        grown = written(grown, "paths")
        out.append(paths.join(grown.select("path").distinct(), "path", "left_anti"))
        paths = grown.select(F.col("next").alias("path"))
    out.append(paths)
    all_paths = out[0]
    for p in out[1:]:
        all_paths = all_paths.unionByName(p)
    return all_paths.filter(F.size("path") > 1)


def closure(paths: DataFrame) -> DataFrame:
    """Distinct edges along paths."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst")))
    return paths.select(F.inline(steps)).distinct()


def fixpoint(bindings: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: where following bindings (node, target) from each start ends: all nodes without a binding that can be reached. Walks that never leave a cycle end nowhere.

    Each round doubles the length of the walks, so a chain takes rounds in the logarithm of its length; once they are as long as there are nodes, whoever still walks is in a cycle.
    """
    bound = written(bindings.select("node", "target").distinct(), "bindings")
    nodes = bound.select("node").distinct()
    n = nodes.count()
    ends = nodes.withColumnRenamed("node", "target").withColumn("going", F.lit(True))
    walks = written(bound.join(ends, "target", "left").select("node", "target", F.coalesce("going", F.lit(False)).alias("going")), "walks")
    length = 1
    while length < n and not walks.filter("going").isEmpty():
        step = walks.select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("going").alias("on"))
        longer = walks.filter("going").join(step, "target").select("node", F.col("next").alias("target"), F.col("on").alias("going"))
        after = written(walks.filter("NOT going").unionByName(longer).distinct(), "walks")
        dropped(walks)
        walks, length = after, 2 * length
    begun = starts.select(F.col("node").alias("start")).distinct()
    moved = begun.join(walks.filter("NOT going").select(F.col("node").alias("start"), F.col("target").alias("node")), "start")
    stayed = begun.join(nodes.withColumnRenamed("node", "start"), "start", "left_anti").select("start", F.col("start").alias("node"))
    return moved.unionByName(stayed).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) of every node of the edges: large and small stars until nothing changes."""
    e = written(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter("hi <> lo").distinct(), "stars")
    figures = (F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")))
    before = e.agg(*figures).first()
    while before[0]:
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = written(both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select("node", F.least("node", "m").alias("m")), "stars")
        large = written(e.join(least, F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo")).distinct(), "stars")
        smallest = written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "stars")
        small = large.join(smallest, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        after = written(small.unionByName(smallest.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct(), "stars")
        dropped(e, least, large, smallest)
        e = after
        now = e.agg(*figures).first()
        if now == before:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def neighbours(edges: DataFrame, seeds: DataFrame, kind: str = "import") -> DataFrame:
    """seed, node, hop, direction: files imported by and importing each seed, within two hops, nearest first; the seed itself excluded."""
    imports = edges.filter(F.col("kind") == kind).select("src", "dst")
    both = imports.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("forward").alias("direction")).unionByName(imports.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("reverse").alias("direction")))
    one = seeds.select(F.col("node").alias("seed")).join(both, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("node"), "direction", F.lit(1).alias("hop"))
    two = one.select("seed", F.col("node").alias("a"), "direction").join(both, ["a", "direction"]).select("seed", F.col("b").alias("node"), "direction", F.lit(2).alias("hop"))
    return one.unionByName(two).filter("seed <> node").groupBy("seed", "node", "direction").agg(F.min("hop").alias("hop"))


def resolve(references: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """References (source, name) joined to definitions (target, name): exact where one target fits, else ambiguous; targets in the source itself are dropped."""
    met = references.join(definitions, name).filter("source <> target").distinct()
    sizes = met.groupBy("source", name).agg(F.count_distinct("target").alias("n"))
    return met.join(sizes, ["source", name]).withColumn("resolution", F.when(F.col("n") == 1, "exact").otherwise("ambiguous")).drop("n")


def suffixes(path: str):
    """All suffixes of a path at slashes, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def suffix_resolution(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """spec_id, path: files that end in the specifier's path at a slash; exact if one does. Suffixes meet by equality, never by a nested loop."""
    ends = files.select("path", F.explode(suffixes("path")).alias("suffix"))
    met = specifiers.join(ends, specifiers["spec"] == ends["suffix"]).groupBy("spec_id").agg(F.count("*").alias("n_files"), F.min("path").alias("path"))
    return met.withColumn("resolution", F.when(F.col("n_files") == 1, "exact").otherwise("ambiguous"))


def unique_basename(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """want_id, path: the file with a basename, if there is exactly one."""
    named = files.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return wanted.join(named, "name").select("want_id", "path")
