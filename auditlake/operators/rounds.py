"""Rounds of judgment: replies by role with fallback, convergence, usage and time accounting, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def converged(rounds: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """A flag per round: the last k rounds found nothing new, were clean and left nothing pending."""
    quiet = ((F.col("new_findings") == 0) & F.col("clean") & ~F.col("pending")).cast("int")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(k - 1), 0)
    return rounds.withColumn("converged", (F.min(quiet).over(w) == 1) & (F.count("*").over(w) == k))


def role_fallback(replies: DataFrame, by: list[str], roles: list[str]) -> DataFrame:
    """The reply of the last role that gave one, by unit and round: judge, else challenger, else finder. Fallen back is flagged."""
    wide = replies.groupBy(*by).agg(*(F.min(F.when(F.col("role") == r, F.struct("ord", "text"))).alias(f"_{r}") for r in roles))
    last = roles[::-1]
    return wide.select(*by, F.coalesce(*(F.col(f"_{r}")["text"] for r in last)).alias("text"), F.coalesce(*(F.when(F.col(f"_{r}").isNotNull(), F.lit(r)) for r in last)).alias("role"), F.col(f"_{last[0]}").isNull().alias("fallback"))


def usage_delta(usage: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Per pass what a running total grew by since the pass before."""
    w = Window.partitionBy(by).orderBy(*order)
    return usage.withColumn("delta", F.col(column) - F.lag(column, 1, 0).over(w))


def stage_seconds(timeline: DataFrame, by: list[str]) -> DataFrame:
    """Seconds per stage. Tenths are summed as whole numbers, so the order of rows doesn't matter."""
    tenths = F.sum(F.bround(F.col("seconds") * 10).cast("bigint"))
    return timeline.groupBy(*by).agg((tenths / 10).alias("seconds"), F.count("*").alias("n"))


def outcome(rounds: DataFrame, failures: DataFrame, by: str) -> DataFrame:
    """Errors summed over rounds, pending of the last round only, failures last written by (index, total, paths), reasons joined."""
    r = rounds.groupBy(by).agg(F.sum("errors").alias("errors"), F.max_by("pending", "round").alias("pending"), F.max("round").alias("rounds"))
    last = failures.groupBy(by, "index", "total", "paths").agg(F.max_by("reason", "round").alias("reason"))
    joined = last.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"), F.count("*").alias("failures"))
    return r.join(joined, by, "left").withColumns({"failures": F.coalesce("failures", F.lit(0)), "reasons": F.coalesce("reasons", F.lit(""))}).withColumn("complete", (F.col("errors") == 0) & (F.col("failures") == 0) & ~F.col("pending"))


def replay(prompts: DataFrame, replies: DataFrame, on: list[str]) -> DataFrame:
    """Judgments from a table of recorded replies; a prompt without one gets an error row, never a clean result."""
    out = prompts.join(replies, on, "left")
    return out.withColumn("error", F.when(F.col("text").isNull() | (F.trim("text") == ""), "no reply"))


def sibling_outcomes(judgments: DataFrame, by: str) -> DataFrame:
    """by, judgments, failed, clean, failures of each unit from its judgments (by, place, label, error): a failed one is told with its place among its siblings and leaves theirs standing."""
    n = F.count("*").over(Window.partitionBy(by))
    told = F.concat(F.col("error"), F.lit(" [knowledge judgment "), F.col("place").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(" for "), F.col("label"), F.lit("]"))
    rows = judgments.withColumn("_n", n).groupBy(by).agg(F.count("*").alias("judgments"), F.count("error").alias("failed"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("place", told.alias("t"))))).alias("_f"))
    return rows.select(by, "judgments", "failed", (F.col("failed") == 0).alias("clean"), F.transform("_f", lambda x: x["t"]).alias("failures"))


def standing_findings(findings: DataFrame, judgments: DataFrame, by: str) -> DataFrame:
    """findings (by, place and what they hold) of judgments that didn't fail."""
    return findings.join(judgments.filter("error IS NULL").select(by, "place"), [by, "place"], "left_semi")
