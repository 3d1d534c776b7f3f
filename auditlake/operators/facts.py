"""Source facts: dependency edges from definitions, calls and imports, and focused units around flagged functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import fixpoint, resolve
from .units import undominated, within_budget


def import_targets(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("", ".py", ".js", ".ts", "/index.js", "/__init__.py")) -> DataFrame:
    """source, spec, target: the first existing file of a relative, absolute or package path with a known extension.

    Relative specifiers are normalised against the source's folder; others are tried as they stand, then below the source's folder.
    """
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    below = F.when(folder == "", F.col("spec")).otherwise(F.concat_ws("/", folder, F.col("spec")))
    bases = F.when(F.col("spec").startswith("."), F.array(normal_path(below))).otherwise(F.array(F.col("spec"), normal_path(below)))
    tried = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, extensions)), lambda e: F.concat(b, e))))
    each = imports.select("source", "spec", F.posexplode(tried).alias("pos", "path"))
    return each.join(files.select("path").distinct(), "path").groupBy("source", "spec").agg(F.min_by("path", "pos").alias("target"))


def normal_path(path: Column) -> Column:
    """Without . and empty segments, .. taking back the segment before it."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"), empty,
        lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(parts, "/")


def dependency_edges(definitions: DataFrame, calls: DataFrame, imports: DataFrame, files: DataFrame, bindings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, gaps). edges: source, target, kind, reference, resolution. gaps: what resolves to nothing.

    definitions: target, name. calls: source, name. imports: source, spec. bindings (node, target) re-export names "file:name".
    """
    called = resolve(calls, definitions, "name").select("source", "target", F.lit("call").alias("kind"), F.col("name").alias("reference"), "resolution")
    found = import_targets(imports, files)
    if bindings is not None:
        starts = found.select(F.col("target").alias("node")).distinct()
        ends = fixpoint(bindings, starts).select(F.col("start").alias("target"), F.col("node").alias("end"))
        found = found.join(ends, "target", "left").select("source", "spec", F.coalesce("end", "target").alias("target"))
    imported = found.filter("source <> target").select("source", "target", F.lit("import").alias("kind"), F.col("spec").alias("reference"), F.lit("exact").alias("resolution"))
    edges = called.unionByName(imported).distinct()
    open_calls = calls.select("source", F.lit("call").alias("kind"), F.col("name").alias("reference")).distinct().join(definitions.select(F.col("name").alias("reference")).distinct(), "reference", "left_anti")
    open_imports = imports.select("source", "spec").distinct().join(found.select("source", "spec"), ["source", "spec"], "left_anti").select("source", F.lit("import").alias("kind"), F.col("spec").alias("reference"))
    return edges, open_calls.unionByName(open_imports)


def focused_units(functions: DataFrame, calls: DataFrame, flagged: Column, budget: int) -> DataFrame:
    """unit, members: each flagged function with callees and callers while they fit, units within larger ones left out.

    functions: file, name, size and flags. calls: file, caller, callee.
    """
    seeds = functions.filter(flagged).select("file", F.col("name").alias("unit"), F.col("name").alias("member"), F.lit(0).alias("step"))
    ends = calls.select("file", F.col("caller").alias("unit"), F.col("callee").alias("member"), F.lit(1).alias("step")).unionByName(calls.select("file", F.col("callee").alias("unit"), F.col("caller").alias("member"), F.lit(2).alias("step")))
    rows = seeds.unionByName(ends.join(seeds.select("file", "unit"), ["file", "unit"])).filter("step = 0 OR member <> unit")
    rows = rows.groupBy("file", "unit", "member").agg(F.min("step").alias("step")).join(functions.select("file", F.col("name").alias("member"), "size"), ["file", "member"])
    keyed = rows.withColumn("key", F.concat_ws("\x1f", "file", "unit"))
    taken = within_budget(keyed.select("key", "file", "unit", "member", "step", "size"), "key", ["step", "member"], "size", budget).filter("taken")
    specs = taken.groupBy("file", "unit").agg(F.array_sort(F.collect_set("member")).alias("members"))
    return undominated(specs, "file", "unit", "members").select("file", "unit", "members")
