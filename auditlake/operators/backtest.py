"""Two arms compared: flips, rates by axis, arm totals, coverage, regression and completeness gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per check: flips between two runs (columns hit, catch_rate), and the move of the rate."""
    a, b = before.select(key, F.col("hit").alias("hit_before"), F.col("catch_rate").alias("rate_before")), after.select(key, F.col("hit").alias("hit_after"), F.col("catch_rate").alias("rate_after"))
    both = a.join(b, key, "full_outer")
    was, now = F.coalesce("hit_before", F.lit(False)), F.coalesce("hit_after", F.lit(False))
    return both.select(
        key, F.when(~was & now, "newly_found").when(was & ~now, "newly_missed").when(was & now, "still_found").otherwise("still_missed").alias("flip"),
        F.bround(F.coalesce("rate_after", F.lit(0.0)) - F.coalesce("rate_before", F.lit(0.0)), 3).alias("rate_move"),
    )


def by_axis(flips: DataFrame, axes: DataFrame, key: str) -> DataFrame:
    """Flips per label of a multi-valued axis; checks without one count as unattributed."""
    labelled = flips.join(axes, key, "left").withColumn("label", F.explode_outer("labels")).withColumn("label", F.coalesce("label", F.lit("unattributed")))
    return labelled.groupBy("label", "flip").agg(F.count("*").alias("n"))


def arm_totals(records: DataFrame, by: str, summed: list[str], last: list[str], order: Column) -> DataFrame:
    """Failed calls and seconds sum over records; what counts kept findings is that of the last record."""
    return records.groupBy(by).agg(*(F.sum(c).alias(c) for c in summed), *(F.max_by(c, order).alias(c) for c in last), F.count("*").alias("records"))


def comparable(totals: DataFrame, by: str, counters: list[str]) -> DataFrame:
    """Whether an arm may be compared: it has records and all these counters are zero; the reason names those that aren't."""
    reasons = F.filter(F.array(*(F.when(F.col(c) != 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in counters)), lambda x: x.isNotNull())
    return totals.select(by, (F.size(reasons) == 0).alias("comparable"), F.array_join(reasons, ", ").alias("reason"))


def coverage(facts: DataFrame, dims: DataFrame, ref: str) -> DataFrame:
    """Counts of positive and clean evidence per knowledge ref, zero for refs without any; refs without a dimension are skipped."""
    positive = F.col("expectation") == "finding"
    agg = facts.groupBy(ref).agg(F.count_if(positive).alias("positive"), F.count_if(~positive).alias("clean"), F.count_if(F.col("path") == "diff").alias("diff"), F.count_if(F.col("path") == "repository").alias("repository"))
    out = dims.join(agg, ref, "left")
    return out.select(ref, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("positive", "clean", "diff", "repository"))).withColumn("problem", F.when(F.col("positive") == 0, "no positive evidence").when(F.col("clean") == 0, "no clean evidence"))


def gate(checks: dict[str, DataFrame], detail: str = "detail") -> DataFrame:
    """check, passed, failures, first detail: one row per named check; a check's rows are its failures."""
    parts = [f.agg(F.lit(name).alias("check_name"), (F.count("*") == 0).alias("passed"), F.count("*").alias("failures"), F.min(detail).alias("first_failure")) for name, f in checks.items()]
    return reduce(DataFrame.unionByName, parts)
