"""Queries over grounding: evidence, budgets, assembled contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding
from ..sources.adapters import EDGES_SQL, edges, table
from .catalogue import query


@query(f"WITH {EDGES_SQL} SELECT src AS source, dst AS target, concat(src, ' ', kind, 's ', dst, CASE WHEN resolution = 'ambiguous' THEN ' (ambiguous)' ELSE '' END) AS summary, CAST(resolution = 'ambiguous' AS INT) AS rank FROM edges_v")
def relationship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "kind", "resolution")
    return grounding.relationships(e).withColumns({"source": F.col("source").cast("bigint"), "target": F.col("target").cast("bigint")})


_SLICES = "SELECT l_partkey % 1500 AS file, CAST(l_quantity AS INT) AS lo, CAST(l_quantity AS INT) + l_linenumber * 40 - 60 AS hi, concat('s', l_suppkey % 9) AS source, l_orderkey % 9 = 0 AS inc FROM lineitem"


@query(f"""WITH e AS ({_SLICES}), g AS (SELECT file, lo, hi, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM e WHERE (file, lo, hi) NOT IN (SELECT (file, lo, hi) FROM e WHERE inc) GROUP BY file, lo, hi),
  h AS (SELECT g.*, d.text, g.lo >= 0 AND g.lo < g.hi AND g.hi <= coalesce(length(d.text), 0) AS valid, concat(g.file, ':', g.lo, ':', g.hi) AS identity FROM g LEFT JOIN documents d ON d.doc_id = g.file)
  SELECT concat('ev-', substr(sha256(identity), 1, 12)) AS evidence_id, concat(sources, ' -> ', identity) AS label, CASE WHEN valid THEN substr(text, lo + 1, hi - lo) END AS text, CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS state FROM h""")
def evidence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 1500 AS file", "CAST(l_quantity AS INT) AS lo", "CAST(l_quantity AS INT) + l_linenumber * 40 - 60 AS hi", "concat('s', l_suppkey % 9) AS source", "l_orderkey % 9 = 0 AS inc")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    return grounding.catalogue(rows, rows.filter("inc"), files).select("evidence_id", "label", "text", "state")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
  g AS (SELECT source, doc_id, k, least(n_chars, 60000 // n) AS share, 60000 - least(n_chars, 60000 // n) AS rest FROM d WHERE k = 1 UNION ALL
    SELECT d.source, d.doc_id, d.k, least(d.n_chars, g.rest // (d.n - d.k + 1)), g.rest - least(d.n_chars, g.rest // (d.n - d.k + 1)) FROM g JOIN d ON d.source = g.source AND d.k = g.k + 1) SELECT source, doc_id, share FROM g""")
def proportional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.shares(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 60_000).select("source", "doc_id", "share")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END, n_chars, doc_id) AS k FROM documents WHERE n_chars <= 3000),
  g AS (SELECT source, doc_id, k, n_chars AS total, TRUE AS taken FROM d WHERE k = 1 UNION ALL SELECT d.source, d.doc_id, d.k, CASE WHEN g.total + d.n_chars <= 9000 THEN g.total + d.n_chars ELSE g.total END, g.total + d.n_chars <= 9000 FROM g JOIN d ON d.source = g.source AND d.k = g.k + 1) SELECT source, doc_id FROM g WHERE taken""")
def caller_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") % 7 == 0).alias("required"), F.col("n_chars").alias("size"), F.col("doc_id").alias("start"))
    return grounding.caller_snippets(rows, "source", 3000, 9000).select("source", "doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), r AS (SELECT DISTINCT l_partkey AS file, l_linenumber AS lo, l_linenumber + 1 AS hi FROM lineitem)
  SELECT doc_id AS file, string_agg(t, chr(10) ORDER BY line) AS text FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.file = doc_id AND line BETWEEN lo AND hi) GROUP BY doc_id""")
def changed_lines_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")
    ranges = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS file", "l_linenumber AS lo", "l_linenumber + 1 AS hi").distinct()
    return grounding.changed_text(lines, ranges)


@query("""SELECT o_orderkey AS doc, concat('src/f', o_custkey % 50, '.py') AS path FROM orders WHERE o_custkey % 50 < 30 UNION SELECT o_orderkey, concat('src/f', o_orderkey % 50, '.py') FROM orders WHERE o_orderkey % 50 < 30""")
def owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("src/f"), (F.col(c) % 50).cast("string"), F.lit(".py"))
    text = F.concat(F.lit("prose names src/f1.py only\n- Files: "), name("o_custkey"), F.lit("\n| unit | "), name("o_orderkey"), F.lit(" |"))
    inventory = spark.range(30).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    return grounding.owned_files(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), text.alias("text")), inventory)


@query("""SELECT f.fragment, min(f.plan) AS plan FROM (SELECT o_orderkey AS plan, unnest([o_custkey, o_custkey + 1]) AS fragment FROM orders) f GROUP BY f.fragment""")
def fragment_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.first_owner(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("seeds")))


@query("""WITH b AS (SELECT l_suppkey AS source, l_partkey AS target, CASE WHEN l_linenumber = 1 THEN '*' ELSE concat('n', l_linenumber) END AS local FROM lineitem), m AS (SELECT p_partkey AS file, concat('m', p_size % 5) AS name FROM part)
  SELECT DISTINCT source, name FROM (SELECT source, local AS name FROM b WHERE local <> '*' UNION ALL SELECT source, m.name FROM b JOIN m ON m.file = target WHERE local = '*')""")
def bound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS source", "l_partkey AS target", "CASE WHEN l_linenumber = 1 THEN '*' ELSE concat('n', l_linenumber) END AS local")
    return grounding.local_names(b, table(spark, sf_dir, "part").selectExpr("p_partkey AS file", "concat('m', p_size % 5) AS name"))


@query()
def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("path"), (F.col("doc_id") % 5 == 0).alias("changed"), "text")
    return grounding.assemble(parts, "source", 6000).select("source", "text", F.size("omitted").alias("n_omitted"))
