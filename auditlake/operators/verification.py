"""Refutation votes, independent confirmers, resumable verification, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdicts(votes: DataFrame, confirmers: DataFrame, found_by: DataFrame) -> DataFrame:
    """candidate, verdict (kept, incomplete, dropped), n_votes, n_errors.

    votes: candidate, refuted, failed. confirmers: candidate, label, upheld, failed. found_by: candidate, labels.
    An error keeps a finding and leaves it incomplete; one vote that it is real keeps it; else every independent confirmer,
    one whose label didn't find it or that has none, must uphold the refutation, and without any the finding is kept.
    """
    v = votes.groupBy("candidate").agg(F.count("*").alias("n_votes"), F.count_if("failed").alias("n_failed"), F.count_if(~F.col("failed") & ~F.col("refuted")).alias("n_real"))
    independent = confirmers.join(found_by, "candidate", "left").filter((F.col("label") == "") | ~F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), F.col("label")))
    c = independent.groupBy("candidate").agg(F.count("*").alias("n_confirmers"), F.count_if("failed").alias("c_failed"), F.count_if(~F.col("failed") & ~F.col("upheld")).alias("c_against"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    verdict = (
        F.when(F.col("n_failed") > 0, "incomplete").when(F.col("n_real") > 0, "kept").when(zero("n_confirmers") == 0, "kept")
        .when(zero("c_failed") > 0, "incomplete").when(zero("c_against") > 0, "kept").otherwise("dropped")
    )
    return v.join(c, "candidate", "left").select("candidate", verdict.alias("verdict"), "n_votes", (F.col("n_failed") + zero("c_failed")).alias("n_errors"))


def resume(findings: DataFrame, verified: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(open, done): findings without a completed verdict in the checkpoint, and those with one beside it."""
    complete = verified.filter("verdict <> 'incomplete'")
    return findings.join(complete.select(key), key, "left_anti"), findings.join(complete, key)


def attribute_roles(judged: DataFrame, roles: DataFrame) -> DataFrame:
    """found_by of judged items: the labels of roles whose item has the same key or the same title."""
    by_key = judged.join(roles.select("unit", "key", "label"), ["unit", "key"]).select("unit", "key", "label")
    by_title = judged.select("unit", "key", "title").join(roles.select("unit", "title", "label"), ["unit", "title"]).select("unit", "key", "label")
    labels = by_key.unionByName(by_title).groupBy("unit", "key").agg(F.array_sort(F.collect_set("label")).alias("found_by"))
    return judged.join(labels, ["unit", "key"], "left").withColumn("found_by", F.coalesce("found_by", F.array().cast("array<string>")))
