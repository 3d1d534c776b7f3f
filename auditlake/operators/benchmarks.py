"""Benchmark manifests as rows: tasks, cases, denominators, schema checks, merged results, printed summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def task_rows(manifests: DataFrame) -> DataFrame:
    """One row per task of manifests (id, revision, tasks: array of id, kind, revision): its scope, revision (its own or the manifest's) and name."""
    t = manifests.select("id", "revision", F.posexplode("tasks").alias("ord", "t"))
    name = F.coalesce(F.nullif(F.col("t.id"), F.lit("")), F.concat(F.col("t.kind"), F.lit("-"), (F.col("ord") + 1).cast("string")))
    return t.select(F.col("id").alias("benchmark"), F.col("ord"), name.alias("task"), F.concat_ws(":", "id", name).alias("scope"), F.col("t.kind").alias("kind"), F.coalesce("t.revision", "revision").alias("revision"))


def clean_first(checks: DataFrame) -> DataFrame:
    """A column place: clean checks before findings, otherwise as they came. checks: benchmark, ord, expectation."""
    from pyspark.sql import Window

    return checks.withColumn("place", F.row_number().over(Window.partitionBy("benchmark").orderBy((F.col("expectation") == "finding").cast("int"), "ord")))


def with_denominators(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every case with its result; one that failed keeps its denominators, all its findings missed, and counts one error."""
    r = results.withColumn("_ran", F.lit(True))
    out = cases.join(r, key, "left")
    ran = F.col("_ran").isNotNull()
    return out.select(*cases.columns, F.coalesce("found", F.lit(0)).alias("found"), F.when(ran, F.col("missed")).otherwise(F.col("n_findings")).alias("missed"), F.coalesce("false_positives", F.lit(0)).alias("false_positives"), F.coalesce("errors", F.lit(1)).alias("errors"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Results summed, their ids qualified by scope and joined in order. parts: scope, found_ids, found, missed, false_positives, errors."""
    ids = F.flatten(F.collect_list(F.transform("found_ids", lambda x: F.concat(F.col("scope"), F.lit(":"), x))))
    sums = [F.sum(c).alias(c) for c in ("found", "missed", "false_positives", "errors")]
    return parts.groupBy(*by).agg(*sums, F.array_sort(ids).alias("found_ids"))


def case_counts(cases: DataFrame, by: list[str]) -> DataFrame:
    """Positive and clean cases, and how many are done."""
    return cases.groupBy(*by).agg(F.count_if(F.col("expectation") == "finding").alias("positive"), F.count_if(F.col("expectation") == "clean").alias("clean"), F.count_if("done").alias("done"), F.count("*").alias("cases"))


def expectation_outcome(expectation: Column, n_findings: Column) -> Column:
    """A case without an answer key: positive cases want any finding, clean ones none."""
    return F.when(expectation == "finding", F.when(n_findings > 0, "found").otherwise("missed")).otherwise(F.when(n_findings > 0, "fp").otherwise("quiet"))


def schema_errors(records: DataFrame, key: str, shape: dict[str, tuple[str, bool]], text_col: str = "json") -> DataFrame:
    """key, path, error of JSON records against a closed shape {field: (kind, required)}; kinds: string, integer, boolean, array, object. Sorted by path within a record."""
    v = F.try_parse_json(F.col(text_col))
    kinds = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
    found = []
    for name, (kind, required) in sorted(shape.items()):
        field = F.try_variant_get(v, f"$.{name}", "variant")
        wrong = ~F.startswith(F.schema_of_variant(field), F.lit(kinds[kind]))
        missing = F.when(field.isNull(), F.lit("missing") if required else F.lit(None).cast("string"))
        found.append(F.struct(F.lit(name).alias("path"), F.coalesce(F.when(field.isNotNull() & wrong, F.lit(f"not {kind}")), missing).alias("error")))
    known = F.array(*map(F.lit, shape))
    extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(text_col), F.array().cast("array<string>")), known), lambda k: F.struct(k.alias("path"), F.lit("unknown field").alias("error")))
    errors = F.when(v.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("not JSON").alias("error")))).otherwise(F.array_sort(F.filter(F.concat(F.array(*found), extra), lambda e: e["error"].isNotNull())))
    return records.select(key, F.inline(errors))


def comparison_lines(arms: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, line: before and after of each column with their ratio where both aren't zero and differ. arms: key and before_x, after_x."""
    def part(c: str) -> Column:
        a, b = F.col(f"before_{c}"), F.col(f"after_{c}")
        ratio = F.when((a != 0) & (b != 0) & (a != b), F.concat(F.lit(" (x"), F.bround(b / a, 2).cast("string"), F.lit(")"))).otherwise("")
        return F.concat(F.lit(f"{c} "), a.cast("string"), F.lit(" -> "), b.cast("string"), ratio)

    return arms.select(key, F.concat_ws("; ", *map(part, columns)).alias("line"))


def all_results(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def headline(found: Column, missed: Column, false_positives: Column) -> Column:
    """recall 0.5, precision 0.5."""
    return F.concat(F.lit("recall "), T.ratio(found, found + missed, 4, 0.0).cast("string"), F.lit(", precision "), T.ratio(found, found + false_positives, 4, 1.0).cast("string"))
