"""What a review looks at and how its runs are judged: stacks, entry points, exports, context around hunks, run states, attribution."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from .intervals import members


class Stack(NamedTuple):
    """A stack profile as data: name, file globs, markers in the content (whatever the case)."""

    name: str
    globs: tuple[str, ...]
    markers: tuple[str, ...]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def named(path: Column, globs: tuple[str, ...]) -> Column:
    return _any([path.rlike(T.glob_regex(g)) for g in globs])


def marked(text: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any([F.contains(low, F.lit(m.lower())) for m in markers])


def stacks(files: DataFrame, profiles: tuple[Stack, ...], by: list[str]) -> DataFrame:
    """by and, for each profile, how many files (path, text) carry it by name or content."""
    return files.groupBy(*by).agg(*(F.count_if(named(F.col("path"), s.globs) | marked(F.col("text"), s.markers)).alias(s.name) for s in profiles))


def entrypoints(files: DataFrame, globs: Column, markers: tuple[str, ...], rules: P.PathRules) -> DataFrame:
    """Files (path, text) where requests may come in: no tests or skipped folders, and named like one (globs) or a source with a marker. Columns globbed and marked tell why."""
    path = F.col("path")
    rows = files.withColumns({"globbed": globs, "marked": marked(F.col("text"), markers)})
    return rows.filter(~P.is_test(path, rules) & ~P.is_skipped(path, rules) & (F.col("globbed") | (P.is_source(path, rules) & F.col("marked"))))


def exporting(files: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Files (text) that match any of a language's export patterns; all of them are put into one, so a text is gone through once."""
    return files.filter(F.col("text").rlike("|".join(f"(?:{p})" for p in patterns)))


def graph_summary(edges: DataFrame) -> DataFrame:
    """kind, resolution, n_edges, n_sources, n_targets of a dependency graph."""
    return edges.groupBy("kind", "resolution").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"), F.count_distinct("dst").alias("n_targets"))


def rendered_edges(edges: DataFrame) -> DataFrame:
    """file, rendered: a file's edges, one a line, by target."""
    line = F.concat("kind", F.lit(" "), F.col("dst").cast("string"))
    return edges.groupBy(F.col("src").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", line.alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))


def context_lines(ranges: DataFrame, around: int) -> DataFrame:
    """file, line: lines at most so far before or after a range (file, lo, hi) that lie in none."""
    d = ranges.select("file", "lo", "hi").distinct()
    near = F.concat(F.sequence(F.col("lo") - around, F.col("lo") - 1), F.sequence(F.col("hi") + 1, F.col("hi") + around))
    lines = d.select("file", F.explode(near).alias("line")).filter("line >= 1").distinct()
    return members(lines, d, "file", "line", inside=False)


def target_order() -> list[Column]:
    """Targets with most findings first, then those of most kinds, then by name."""
    return [F.desc("n_findings"), F.desc("n_kinds"), F.col("target")]


def run_consistency(state: Column, complete: Column, errors: Column) -> Column:
    """What is odd about a run's state, its completion and its errors, or `consistent`."""
    odd = F.when(state == "running", "still running").when(complete & (errors > 0), "complete with errors")
    return odd.when((state == "complete") & ~complete, "state without completion").otherwise("consistent")


def repeated_contract(runs: DataFrame, by: str) -> DataFrame:
    """by, same_target, same_denominator: whether all runs (by, target, n) of one arm are of one target and count the same checks."""
    return runs.groupBy(by).agg((F.count_distinct("target") == 1).alias("same_target"), (F.count_distinct("n") == 1).alias("same_denominator"))


def attribution(claims: DataFrame, by: str) -> DataFrame:
    """by, ref: of all claims (by, ref, level) the one of the highest level."""
    return claims.groupBy(by).agg(F.max_by("ref", "level").alias("ref"))


def provenance_value(value: Column, kind: str) -> Column:
    """A provenance field as number, flag or text; blank texts and what doesn't fit are null."""
    return F.nullif(F.trim(value), F.lit("")) if kind == "string" else value.try_cast(kind)
