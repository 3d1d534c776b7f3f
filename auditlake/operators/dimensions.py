"""Dimensions of classes and guides: aliases, merged attributes, references, closed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def aliases(classes: DataFrame) -> DataFrame:
    """alias, id of classes (ord, id, aliases); of one alias declared twice the last declaration counts."""
    each = classes.select("ord", "id", F.explode(F.transform("aliases", T.category_spelling)).alias("alias")).unionByName(classes.select("ord", "id", T.category_spelling(F.col("id")).alias("alias")))
    return each.groupBy("alias").agg(F.max_by("id", "ord").alias("id"))


def canonical(rows: DataFrame, category: str, known: DataFrame, closed: bool) -> DataFrame:
    """A column canonical: the class of an alias; unknown spellings stay as they are, or become other in a closed set."""
    spelled = rows.withColumn("_c", T.category_spelling(F.col(category)))
    out = spelled.join(known.select(F.col("alias").alias("_c"), F.col("id").alias("_id")), "_c", "left")
    return out.withColumn("canonical", F.coalesce("_id", F.lit("other") if closed else F.col("_c"))).drop("_c", "_id")


def merged_arrays(rows: DataFrame, by: list[str], columns: list[str], order: str) -> DataFrame:
    """Each column's arrays joined in order, every value at its first place only."""
    def one(c: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]))).alias(c)

    return rows.groupBy(*by).agg(*map(one, columns))


def references(knowledge: DataFrame, key: str) -> DataFrame:
    """key, kind, name of knowledge refs (a column refs): vuln:x, and the last part of guide:a/b/c."""
    r = knowledge.select(key, F.explode("refs").alias("ref"))
    return r.select(key, F.substring_index("ref", ":", 1).alias("kind"), F.substring_index(F.substring_index("ref", ":", -1), "/", -1).alias("name"))


def repeated_references(files: DataFrame) -> DataFrame:
    """ref, n of refs that more than one file declares."""
    return files.groupBy("ref").agg(F.count_distinct("path").alias("n")).filter("n > 1")


def prefixed(path: Column, prefix: Column) -> Column:
    """A path below a prefix; an empty prefix changes nothing."""
    return F.when(prefix == "", path).otherwise(F.concat_ws("/", F.regexp_replace(prefix, "/$", ""), path))


def shown_anchor(file: Column, line: Column, anchor: Column) -> Column:
    """file:line (side) of an anchor, null where it is the finding's own place."""
    own = (anchor["file"] == file) & anchor["line"].eqNullSafe(line) & (anchor["side"] == "new")
    return F.when(anchor.isNotNull() & ~own, F.concat(anchor["file"], F.lit(":"), anchor["line"].cast("string"), F.lit(" ("), anchor["side"], F.lit(")")))


def anchor(file: Column, line: Column, side: Column) -> Column:
    """A valid anchor, or null: a file, a line from 1 and a known side."""
    n = T.line_number(line.cast("string"))
    return F.when((file != "") & n.isNotNull() & side.isin("old", "new"), F.struct(file.alias("file"), n.alias("line"), side.alias("side")))
