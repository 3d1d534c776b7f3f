"""Views over the star-schema and text tables that have the shape of this library's inputs, each also as SQL.

Every relation carries an ordinal: first one wins is always decided by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Both engines read these expressions alike, so that a view is stated once.
VIEWS = {
    "candidates_v": (
        "events",
        """event_id AS ord, event_type AS category, concat('src/mod', user_id % 20, '.py') AS file,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 97 + 1 END AS line,
           CASE WHEN event_id % 3 = 0 THEN concat('Mod.fn_', event_id % 11) ELSE '' END AS symbol,
           CASE WHEN event_id % 3 = 1 THEN concat('GET /items/', CASE WHEN event_id % 2 = 0 THEN '<id>' ELSE '{key}' END, '/v', event_id % 13) ELSE '' END AS endpoint,
           CASE WHEN value > 80 THEN 'critical risk' WHEN value > 40 THEN 'HIGH' WHEN value > 15 THEN 'unclear' ELSE 'low' END AS severity,
           concat('seen at ', user_id % 20, ':', event_id % 5) AS evidence,
           CASE WHEN event_id % 4 = 0 THEN 'confirmed' ELSE 'blocked' END AS status, concat('model-', event_id % 3) AS label""",
    ),
    "intervals_v": ("lineitem", "l_partkey AS file, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, CAST(l_quantity * 3 AS INT) AS lo, CAST(l_quantity * 3 AS INT) + CAST(l_linenumber AS INT) AS hi"),
    "files_v": ("documents", "doc_id, concat(CASE WHEN doc_id % 9 = 0 THEN 'tests/' WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 13 = 0 THEN 'build/' ELSE '' END, lang, '/', source, '/', CASE WHEN doc_id % 10 = 0 THEN 'test_' ELSE '' END, 'f', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.sol' WHEN 3 THEN '.js' ELSE '' END) AS path, text, n_chars"),
    "runs_v": ("labels", "doc_id AS check_id, quality, toxic"),
    "votes_v": ("lineitem", "l_orderkey AS candidate, l_linenumber AS vote, l_partkey AS tie, l_returnflag <> 'R' AS refuted, l_suppkey % 50 = 0 AS failed, concat('model-', l_suppkey % 3) AS label, l_linestatus = 'O' AS upheld"),
    "usage_v": ("events", "user_id AS unit, event_id AS pass, ts, event_type AS stage, round(value, 1) AS seconds, CAST(event_id % 100 AS BIGINT) AS used"),
    "rounds_v": ("conversations", "conv_id AS unit, turn AS round, role AS stage, text"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*split_expressions(columns))


def split_expressions(columns: str) -> list[str]:
    """At commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"{name} AS (SELECT {columns} FROM {source})"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow one another in an order: src, dst, kind, resolution, one row per edge (its first occurrence)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.when(F.col("l_returnflag") == "R", "import").otherwise("call").alias("kind"), F.when(F.col("l_linestatus") == "O", "exact").otherwise("ambiguous").alias("resolution")
    )
    return rows.filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind"), F.max("resolution").alias("resolution"))


EDGES_SQL = """edges_v AS (SELECT src, dst, min(kind) AS kind, max(resolution) AS resolution FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst,
    CASE WHEN l_returnflag = 'R' THEN 'import' ELSE 'call' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'exact' ELSE 'ambiguous' END AS resolution FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
