"""Queries over benchmark manifests, dimensions and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmarks, callgraph, dimensions
from ..sources.adapters import EDGES_SQL, edges, table
from .catalogue import query


@query("""WITH t AS (SELECT s_suppkey AS id, 'r1' AS revision, unnest([0, 1]) AS ord, unnest(['diff', 'repository']) AS kind, unnest(['', concat('t', s_suppkey % 3)]) AS tid, unnest([NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'own' END]) AS own FROM supplier)
  SELECT id AS benchmark, CAST(ord AS INT) AS ord, CASE WHEN tid = '' THEN concat(kind, '-', ord + 1) ELSE tid END AS task, concat(id, ':', CASE WHEN tid = '' THEN concat(kind, '-', ord + 1) ELSE tid END) AS scope, kind, coalesce(own, revision) AS revision FROM t""")
def benchmark_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = lambda i, kind, rev: F.struct(i.alias("id"), F.lit(kind).alias("kind"), rev.cast("string").alias("revision"))
    tasks = F.array(task(F.lit(""), "diff", F.lit(None)), task(F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string")), "repository", F.when(F.col("s_suppkey") % 2 == 0, "own")))
    return benchmarks.task_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("r1").alias("revision"), tasks.alias("tasks")))


@query("""SELECT doc_id AS check_id, source AS benchmark, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 1 THEN 1 ELSE 0 END, doc_id) AS place FROM labels JOIN documents USING (doc_id)""")
def clean_checks_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("benchmark")), "doc_id")
    checks = rows.select("benchmark", F.col("doc_id").alias("ord"), F.when(F.col("quality") == 1, "finding").otherwise("clean").alias("expectation"))
    return benchmarks.clean_first(checks).select(F.col("ord").alias("check_id"), "benchmark", F.col("place").cast("bigint").alias("place"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS n_findings FROM customer), r AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS found, count(*) FILTER (o_orderstatus = 'O') AS missed, count(*) FILTER (o_orderstatus = 'P') AS false_positives, CAST(0 AS INT) AS errors FROM orders GROUP BY 1)
  SELECT id, n_findings, coalesce(found, 0) AS found, CASE WHEN found IS NULL THEN n_findings ELSE missed END AS missed, coalesce(false_positives, 0) AS false_positives, coalesce(errors, 1) AS errors FROM c LEFT JOIN r USING (id)""")
def case_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 7 AS n_findings")
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"))
    results = r.agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "found"), ("O", "missed"), ("P", "false_positives"))), F.lit(0).alias("errors"))
    return benchmarks.with_denominators(cases, results, "id")


@query("""WITH x AS (SELECT source, lang, doc_id FROM documents) SELECT lang, CAST(sum(f) AS BIGINT) AS found, CAST(sum(m) AS BIGINT) AS missed, string_agg(ids, ',' ORDER BY ids) AS found_ids FROM (SELECT lang, 1 AS f, doc_id % 4 AS m, concat(source, ':', doc_id) AS ids FROM x) GROUP BY lang""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("scope"), F.array(F.col("doc_id").cast("string")).alias("found_ids"), F.lit(1).alias("found"), (F.col("doc_id") % 4).alias("missed"), F.lit(0).alias("false_positives"), F.lit(0).alias("errors"))
    return benchmarks.merged(parts, ["lang"]).select("lang", "found", "missed", F.array_join("found_ids", ",").alias("found_ids"))


@query("""SELECT lang, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS clean, count(*) FILTER (doc_id % 3 = 0) AS done, count(*) AS cases FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return benchmarks.case_counts(rows.select("lang", F.when(F.col("quality") == 1, "finding").otherwise("clean").alias("expectation"), (F.col("doc_id") % 3 == 0).alias("done")), ["lang"])


@query("""SELECT event_id, '' AS path, 'not JSON' AS error FROM events WHERE event_id % 7 = 3 UNION ALL SELECT event_id, 'k', 'not string' FROM events WHERE event_id % 7 <> 3 UNION ALL SELECT event_id, 'name', 'missing' FROM events WHERE event_id % 7 <> 3""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 3, "broken {").otherwise(F.col("props")).alias("json"))
    return benchmarks.schema_errors(rows, "event_id", {"k": ("string", True), "name": ("string", True), "note": ("string", False)})


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 3 > 0 THEN 'found' ELSE 'missed' END ELSE CASE WHEN o_custkey % 3 > 0 THEN 'fp' ELSE 'quiet' END END AS outcome FROM orders""")
def expectation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    expectation = F.when(F.col("o_custkey") % 2 == 0, "finding").otherwise("clean")
    return table(spark, sf_dir, "orders").select("o_orderkey", benchmarks.expectation_outcome(expectation, F.col("o_custkey") % 3).alias("outcome"))


@query("""WITH k AS (SELECT p_partkey AS ord, p_brand AS id, unnest([p_type, concat(p_type, ' ', p_size % 3)]) AS a FROM part UNION ALL SELECT p_partkey, p_brand, p_brand FROM part), m AS (SELECT trim(regexp_replace(lower(a), '[ _]+', '-', 'g'), '-') AS alias, arg_max(id, ord) AS id FROM k GROUP BY 1) SELECT alias, id FROM m""")
def class_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("id"), F.array("p_type", F.concat("p_type", F.lit(" "), (F.col("p_size") % 3).cast("string"))).alias("aliases"))
    return dimensions.aliases(classes)


@query("""WITH a AS (SELECT unnest(['view', 'click', 'err']) AS alias, unnest(['navigation', 'navigation', 'failure']) AS id) SELECT event_id, coalesce(a.id, 'other') AS canonical FROM events LEFT JOIN a ON a.alias = lower(event_type)""")
def closed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("view", "navigation"), ("click", "navigation"), ("err", "failure")], "alias string, id string")
    return dimensions.canonical(table(spark, sf_dir, "events"), "event_type", known, closed=True).select("event_id", "canonical")


@query("""WITH x AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM x GROUP BY user_id""")
def merged_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type").alias("kinds"))
    return dimensions.merged_arrays(rows, ["user_id"], ["kinds"], "event_id").select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("""SELECT doc_id, 'vuln' AS kind, lang AS name FROM documents UNION ALL SELECT doc_id, 'guide', source FROM documents""")
def knowledge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array(F.concat(F.lit("vuln:"), "lang"), F.concat(F.lit("guide:frameworks/"), "lang", F.lit("/"), "source"))
    return dimensions.references(table(spark, sf_dir, "documents").select("doc_id", refs.alias("refs")), "doc_id")


@query(f"WITH {EDGES_SQL} SELECT dst AS callee, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS callers FROM edges_v WHERE kind = 'call' GROUP BY dst")
def caller_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = edges(spark, sf_dir).filter("kind = 'call'").groupBy(F.col("src").alias("caller")).agg(F.collect_list("dst").alias("callees"))
    return callgraph.callers(calls).select("callee", F.array_join(F.transform("callers", lambda x: x.cast("string")), ",").alias("callers"))


@query("""SELECT DISTINCT l_suppkey AS source, c.t AS target FROM lineitem JOIN (SELECT p_partkey AS t FROM part) c ON c.t = l_partkey WHERE l_suppkey <> c.t""")
def contract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS source", "l_partkey AS key").distinct()
    return callgraph.call_edges(calls, table(spark, sf_dir, "part").selectExpr("p_partkey AS target", "p_partkey AS key"))


@query("""WITH f AS (SELECT DISTINCT source AS folder FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT concat(lang, '/', source) FROM documents)
  SELECT p_partkey AS spec_id, concat('src', p_partkey % 40) IN (SELECT folder FROM f) AS in_tree FROM part""")
def imports_in_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("path"))
    specs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), F.concat(F.lit("pkg.src"), (F.col("p_partkey") % 40).cast("string")).alias("spec"))
    return callgraph.import_in_tree(specs, files)
