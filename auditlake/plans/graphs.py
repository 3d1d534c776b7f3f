"""Queries over dependency edges, paths and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, modules
from ..sources.adapters import EDGES_SQL, edges, table, view, view_sql
from .catalogue import query

#: Traversals begin at the parts of one type, which stand for the changed files.
CHANGED = "p_type = 'PROMO'"
SEEDS = f"src IN (SELECT p_partkey FROM part WHERE {CHANGED})"


def _seeds(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    changed = table(spark, sf_dir, "part").filter(CHANGED).select(F.col("p_partkey").alias("src"))
    return e.join(changed, "src", "left_semi").select(F.col("src").alias("node")).distinct()


@query(f"""WITH {EDGES_SQL}, one AS (SELECT src, dst, kind, 1 AS hop FROM edges_v WHERE {SEEDS}), f AS (SELECT DISTINCT dst AS node FROM one WHERE kind = 'call'),
  two AS (SELECT e.src, e.dst, e.kind, 2 AS hop FROM edges_v e JOIN f ON f.node = e.src), u AS (SELECT * FROM one UNION ALL SELECT * FROM two) SELECT src, dst, min(hop) AS hop FROM u GROUP BY src, dst""")
def dependency_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.written(edges(spark, sf_dir), "edges")
    return graph.hops(e, _seeds(spark, sf_dir, e), 2).select("src", "dst", "hop")


PATHS = f"""WITH {EDGES_SQL}, seeds AS (SELECT DISTINCT src AS node FROM edges_v WHERE {SEEDS}), c AS (SELECT src, dst FROM edges_v WHERE kind = 'call' AND dst NOT IN (SELECT node FROM seeds)),
  p1 AS (SELECT s.node AS a, c.dst AS b FROM seeds s JOIN c ON c.src = s.node), p2 AS (SELECT a, b, c.dst AS d FROM p1 JOIN c ON c.src = b WHERE c.dst <> a AND c.dst <> b)"""


@query(f"{PATHS} SELECT concat(a, '>', b, '>', d) AS path FROM p2 UNION ALL SELECT concat(a, '>', b) FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.a = p1.a AND p2.b = p1.b)")
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.written(edges(spark, sf_dir), "edges")
    return graph.simple_paths(e, _seeds(spark, sf_dir, e), 2).select(F.array_join("path", ">").alias("path"))


@query(f"{PATHS} SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM p1 UNION ALL SELECT b, d FROM p2)")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.written(edges(spark, sf_dir), "edges")
    return graph.closure(graph.simple_paths(e, _seeds(spark, sf_dir, e), 2))


@query("""WITH RECURSIVE b AS (SELECT concat('c', c_custkey) AS node, concat('n', c_nationkey) AS target FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation
    UNION ALL SELECT 'r1', 'r2' UNION ALL SELECT 'r2', 'r1' UNION ALL SELECT 'r2', 'x'),
  w AS (SELECT concat('c', c_custkey) AS start, concat('c', c_custkey) AS node FROM customer UNION SELECT w.start, b.target FROM w JOIN b ON b.node = w.node)
  SELECT start AS origin, node FROM w WHERE node NOT IN (SELECT node FROM b)""")
def symbol_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    b = customer.selectExpr("concat('c', c_custkey) AS node", "concat('n', c_nationkey) AS target").union(nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    b = b.union(spark.createDataFrame([("r1", "r2"), ("r2", "r1"), ("r2", "x")], "node string, target string"))
    return graph.fixpoint(b, customer.selectExpr("concat('c', c_custkey) AS node")).withColumnRenamed("start", "origin")


#: Modules made of the parts: each defines a name, binds one of another module's names, its default one or a whole module, and some pass on all names of another.
_BINDINGS = """SELECT concat('m', p_partkey) AS file, CASE p_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE concat('g', p_partkey % 5) END AS name, concat('m', CASE p_partkey % 5 WHEN 1 THEN p_partkey ELSE (p_partkey * 7 + p_size) % 150 END) AS source_file,
  CASE p_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN concat('f', p_partkey % 3) WHEN 2 THEN concat('g', p_size % 5) WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'default' ELSE '*' END ELSE concat('f', p_size % 3) END AS source_name FROM part"""
_DEFINED = "SELECT concat('m', p_partkey) AS file, concat('f', p_partkey % 3) AS name FROM part"
_USED = "SELECT concat('m', p_partkey) AS file, CASE WHEN p_size % 4 = 0 THEN 'default' WHEN p_size % 2 = 0 THEN concat('f', p_size % 3) ELSE concat('g', p_size % 5) END AS name FROM part"


@query(f"""WITH RECURSIVE b AS (SELECT DISTINCT * FROM ({_BINDINGS})), d AS (SELECT DISTINCT * FROM ({_DEFINED})), u AS (SELECT DISTINCT * FROM ({_USED})), e AS (SELECT * FROM b ANTI JOIN d USING (file, name) WHERE name <> '*'), s AS (SELECT file, source_file FROM b WHERE name = '*'),
  w AS (SELECT file, name, file AS f, name AS n FROM u UNION (SELECT w.file, w.name, e.source_file, e.source_name FROM w JOIN e ON e.file = w.f AND e.name = w.n
    UNION ALL SELECT w.file, w.name, s.source_file, w.n FROM w JOIN s ON s.file = w.f WHERE w.n NOT IN ('default', '*') AND (w.f, w.n) NOT IN (SELECT (file, name) FROM d) AND (w.f, w.n) NOT IN (SELECT (file, name) FROM e))),
  x AS (SELECT w.file, w.name, w.f, w.n FROM w WHERE n = '*' OR (f, n) IN (SELECT (file, name) FROM d))
  SELECT u.file, u.name, count(f) AS n_ends, min(f || ':' || n) AS first_end FROM u LEFT JOIN x ON x.file = u.file AND x.name = u.name GROUP BY u.file, u.name""")
def names_across_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each used name is defined: how many ends it has, and the first."""
    part = table(spark, sf_dir, "part")
    rows = lambda sql: spark.sql(sql.replace("FROM part", "FROM {part}"), part=part)
    starts = rows(_USED).distinct()
    ends, _ = modules.resolve_names(starts, rows(_BINDINGS), rows(_DEFINED))
    counted = ends.groupBy("file", "name").agg(F.count("*").alias("n_ends"), F.min(F.concat_ws(":", "target_file", "target_name")).alias("first_end"))
    return starts.join(counted, ["file", "name"], "left").select("file", "name", F.coalesce("n_ends", F.lit(0)).cast("bigint").alias("n_ends"), "first_end")


#: Rounds in which the SQL hands on the smallest node seen; the tables' graphs are less wide than that.
_WIDTH = 12
_SPREAD = ", ".join(f"r{k + 1} AS (SELECT r{k}.node, least(any_value(r{k}.root), coalesce(min(n.root), any_value(r{k}.root))) AS root FROM r{k} LEFT JOIN s ON s.a = r{k}.node LEFT JOIN r{k} n ON n.node = s.b GROUP BY r{k}.node)" for k in range(_WIDTH))


@query(f"WITH {EDGES_SQL}, s AS (SELECT src AS a, dst AS b FROM edges_v UNION SELECT dst, src FROM edges_v), r0 AS (SELECT DISTINCT a AS node, a AS root FROM s), {_SPREAD} SELECT node, root FROM r{_WIDTH}")
def connected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, i AS (SELECT src, dst FROM edges_v WHERE kind = 'import'), b AS (SELECT src AS a, dst AS b, 'forward' AS direction FROM i UNION ALL SELECT dst, src, 'reverse' FROM i),
  seeds AS (SELECT DISTINCT src AS seed FROM edges_v WHERE {SEEDS}), one AS (SELECT seed, b AS node, direction, 1 AS hop FROM seeds JOIN b ON a = seed), two AS (SELECT o.seed, b.b AS node, o.direction, 2 AS hop FROM one o JOIN b ON b.a = o.node AND b.direction = o.direction)
  SELECT seed, node, direction, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE seed <> node GROUP BY seed, node, direction""")
def import_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.written(edges(spark, sf_dir), "edges")
    return graph.neighbours(e, _seeds(spark, sf_dir, e))


_PATH = r"regexp_replace(url, '^https?://', '')"


@query(f"""WITH f AS (SELECT DISTINCT {_PATH} AS path FROM pages), s AS (SELECT page_id AS spec_id, concat(split_part(url, '/', -2), '/', split_part(url, '/', -1)) AS spec FROM pages),
  m AS (SELECT spec_id, path FROM s JOIN f ON path = spec OR path LIKE concat('%/', spec)) SELECT spec_id, count(*) AS n_files, min(path) AS path, CASE WHEN count(*) = 1 THEN 'exact' ELSE 'ambiguous' END AS resolution FROM m GROUP BY spec_id""")
def suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.expr(_PATH).alias("path")).distinct()
    specs = pages.select(F.col("page_id").alias("spec_id"), F.substring_index("url", "/", -2).alias("spec"))
    return graph.suffix_resolution(specs, files)


@query(f"""WITH {view_sql("files_v")}, n AS (SELECT split_part(path, '/', -1) AS name, count(*) AS c, min(path) AS path FROM files_v GROUP BY 1) SELECT doc_id AS want_id, n.path FROM labels JOIN n ON n.name = concat('f', doc_id, '.py') WHERE c = 1""")
def unique_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("want_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("name"))
    return graph.unique_basename(wanted, view(spark, sf_dir, "files_v"))


@query("""WITH owned AS (SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id) SELECT lang, count(*) AS n_files, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM owned)) AS n_uncovered,
  min(CASE WHEN doc_id NOT IN (SELECT doc_id FROM owned) THEN doc_id END) AS first_uncovered FROM documents GROUP BY lang""")
def unit_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("owned", F.lit(True))
    rows = documents.join(labels, "doc_id", "left")
    open_ = F.col("owned").isNull()
    return rows.groupBy("lang").agg(F.count("*").alias("n_files"), F.count_if(open_).alias("n_uncovered"), F.min(F.when(open_, F.col("doc_id"))).alias("first_uncovered"))


@query("""WITH r AS (SELECT DISTINCT o_orderkey AS source, o_custkey // 5 AS name FROM orders), d AS (SELECT DISTINCT c_custkey AS target, c_custkey // 5 AS name FROM customer),
  m AS (SELECT DISTINCT source, name, target FROM r JOIN d USING (name) WHERE source <> target) SELECT source, name, target, CASE WHEN count(*) OVER (PARTITION BY source, name) = 1 THEN 'exact' ELSE 'ambiguous' END AS resolution FROM m""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS source", "o_custkey div 5 AS name").distinct()
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey AS target", "c_custkey div 5 AS name").distinct()
    return graph.resolve(r, d, "name")
