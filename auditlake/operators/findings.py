"""Union of findings: identity keys, folding, severity medians, provenance, collapse, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def candidate_key(by_file: bool = False) -> Column:
    """Identity of a candidate: its symbol, else its endpoint, else its line (by_file only), else its file; with its category.

    With by_file two rows are the same only within one file.
    """
    category, file = F.lower("category"), F.lower("file")
    symbol, endpoint = T.symbol_tail(F.col("symbol")), T.endpoint_normal(F.col("endpoint"))
    parts = lambda *x: F.array(*(F.coalesce(y, F.lit("")) for y in x))
    key = F.when(symbol != "", parts(F.lit("sym"), file, category, symbol))
    if not by_file:
        return key.when(endpoint != "", parts(F.lit("ep"), endpoint, category)).otherwise(parts(F.lit("fc"), file, category))
    key = key.when(endpoint != "", parts(F.lit("fc"), file, category, endpoint))
    return key.when(F.col("line").isNotNull(), parts(F.lit("fl"), file, category, F.col("line").cast("string"))).otherwise(parts(F.lit("fc"), file, category))


def finding_key() -> Column:
    """Identity of a diff finding: place, category, description and anchor (its own place on the new side by default)."""
    anchor = F.coalesce("change_anchor", F.struct(F.col("file"), F.col("line"), F.lit("new").alias("side")))
    return F.struct("file", "line", "category", "description", anchor.alias("anchor"))


def fold_evidence(pieces: Column) -> Column:
    """Pieces in order joined by "; ", each unless it is contained in what is there."""
    return F.aggregate(pieces, F.lit(""), lambda a, x: F.when(a.contains(x), a).when(a == "", x).otherwise(F.concat(a, F.lit("; "), x)))


def union_findings(rows: DataFrame, key: Column, with_evidence: bool = True) -> DataFrame:
    """One row per identity: the first row's columns, confirmed if any is, labels united, median severity, and on demand folded evidence.

    Equal evidence is reduced to its first place before it is collected, so a key's list holds distinct texts only.
    """
    keyed = rows.withColumn("key", key).withColumn("rank", T.severity_rank(F.col("severity")))
    first = keyed.groupBy("key").agg(
        F.min_by(F.struct("category", "file", "line", "symbol", "endpoint"), "ord").alias("first"), F.min("ord").alias("ord"), F.count("*").alias("n_rows"),
        F.max(F.when(F.col("status") == "confirmed", 1).otherwise(0)).alias("confirmed"), F.array_sort(F.collect_set("label")).alias("found_by"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)").alias("median"),
    )
    columns = [
        "key", "ord", "first.*", F.when(F.col("confirmed") == 1, "confirmed").otherwise("blocked").alias("status"), T.severity_of_rank(F.col("median").cast("int")).alias("severity"),
        "found_by", F.size("found_by").alias("consensus"), "n_rows",
    ]
    if not with_evidence:
        return first.select(*columns)
    evidence = keyed.filter(F.col("evidence") != "").groupBy("key", "evidence").agg(F.min("ord").alias("at")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "evidence"))).alias("e"))
    out = first.join(evidence, "key", "left")
    return out.select(*columns, fold_evidence(F.transform(F.coalesce("e", F.array().cast("array<struct<at:bigint,evidence:string>>")), lambda x: x["evidence"])).alias("evidence"))


#: Ordinals of findings that one task numbers.
STRETCH = 1 << 18


def rank_findings(union: DataFrame) -> DataFrame:
    """position by consensus, then severity, then first appearance."""
    # Counting by (consensus, severity, stretch of ordinals) first leaves the global order to sums over few groups; no task sorts all rows
    # of a common severity.
    group = ["consensus", "level", "stretch"]
    rows = union.withColumns({"level": T.severity_rank(F.col("severity")), "stretch": F.floor(F.col("ord") / STRETCH)})
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("consensus"), "level", "stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*group).orderBy("ord"))
    return rows.withColumn("within", within).join(before, group).withColumn("position", F.col("before") + F.col("within")).drop("before", "within", "level", "stretch")


def collapse_colocated(rows: DataFrame) -> DataFrame:
    """Of rows with equal file, line and category (lower case) the first stays, nothing is folded; rows without a place all stay."""
    placed = F.col("line").isNotNull() & (F.col("file") != "")
    w = Window.partitionBy(F.lower("file"), "line", F.lower("category"), F.when(~placed, F.col("ord"))).orderBy("ord")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def severity_breakdown(rows: DataFrame, by: list[str], severity: Column) -> DataFrame:
    """Counts of each level, zero where there is none."""
    level = T.severity(severity)
    return rows.groupBy(*by).agg(*(F.count_if(level == x).alias(f"n_{x.lower()}") for x in T.LEVELS), F.count("*").alias("n_all"))


def new_identities(pool: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """Identities of rows that the pool (a column key) lacks."""
    return rows.select(key.alias("key")).distinct().join(pool.select("key").distinct(), "key", "left_anti")
