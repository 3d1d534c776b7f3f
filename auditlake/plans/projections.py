"""Queries over projections, and over the small functions that findings and reports are made with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs, dimensions, facts, projections, replies, reports, rounds, table_functions
from ..sources.adapters import table, view, view_sql
from .catalogue import query
from .patches import NUMBERED
from .patches import _diffs as document_diffs

_IDS = "regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')"


@query(f"SELECT doc_id, CAST(len(list_distinct({_IDS})) AS BIGINT) AS n_names, CAST(len(list_distinct(regexp_extract_all(substr(text, 11, 40), '[A-Za-z_$][A-Za-z0-9_$]*'))) AS BIGINT) AS n_slice FROM documents")
def identifier_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda names: F.size(names).cast("bigint")
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", count(projections.identifiers(F.col("text"))).alias("n_names"), count(projections.identifiers(F.col("text"), F.lit(10), F.lit(50))).alias("n_slice"))


@query("""WITH d AS (SELECT c_custkey % 10 AS file, c_custkey AS k FROM customer), one AS (SELECT s.k AS seed, d.file, d.k FROM d s JOIN d ON d.k = s.k + 10), two AS (SELECT DISTINCT o.seed, d.file, d.k FROM one o JOIN d ON d.k IN (o.k + 10, o.k + 20) AND d.file = o.file)
  SELECT seed, file, concat('d', k) AS name, 1 AS round FROM one UNION ALL SELECT seed, file, concat('d', k), 2 FROM two WHERE (seed, k) NOT IN (SELECT (seed, k) FROM one)""")
def mentioned_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.lit("d"), (F.col("c_custkey") + n).cast("string"))
    definitions = c.select((F.col("c_custkey") % 10).alias("file"), name(0).alias("name"), F.concat_ws(" ", name(10), name(1), name(20), F.lit("x_y")).alias("text"))
    seeds = c.select(F.col("c_custkey").alias("seed"), (F.col("c_custkey") % 10).alias("file"), F.concat(F.lit("call("), name(10), F.lit(");"), name(3)).alias("text"))
    return projections.mentioned_definitions(definitions, seeds)


@query("""SELECT doc_id AS diff_id, CASE doc_id % 3 WHEN 0 THEN '<unknown>' WHEN 1 THEN concat('src/a', doc_id, '.py') ELSE concat('src/b', doc_id, '.py,lib/c.js') END AS paths FROM documents""")
def diff_path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda path: F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/"), path, F.lit("\n@@ -1,1 +1,1 @@\n-a\n+b\n"))
    name = lambda kind: F.concat(F.lit(f"src/{kind}"), F.col("doc_id").cast("string"), F.lit(".py"))
    text = F.when(F.col("doc_id") % 3 == 0, "no paths here").when(F.col("doc_id") % 3 == 1, F.concat(part(name("a")), part(name("a")))).otherwise(F.concat(part(name("b")), part(F.lit("lib/c.js")), part(name("b"))))
    return projections.diff_paths(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), text.alias("text"))).select("diff_id", F.array_join("paths", ",").alias("paths"))


@query(f"""WITH {NUMBERED}, g AS (SELECT diff_id, n AS x, n - row_number() OVER (PARTITION BY diff_id ORDER BY n) AS g FROM n WHERE mark = '+' AND diff_id % 2 = 0) SELECT diff_id, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM g GROUP BY diff_id, g""")
def changed_source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("diff_id") % 2 == 1, F.replace("text", F.lit(".py"), F.lit(".Txt"))).otherwise(F.replace("text", F.lit(".py"), F.lit(".PY")))
    rows = diffs.lines(document_diffs(spark, sf_dir).select("diff_id", odd.alias("text")))
    ranges = diffs.line_ranges(rows, diffs.chunk_text(rows).select("diff_id", "chunk", "path"))
    return projections.changed_source_ranges(ranges, [".py", ".js"]).select("diff_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS diff_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS chunk, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
  g AS (SELECT diff_id, chunk, n AS total, 1 AS unit FROM r WHERE chunk = 1 UNION ALL SELECT r.diff_id, r.chunk, CASE WHEN g.total + 1 + r.n > 60 THEN r.n ELSE g.total + 1 + r.n END, CASE WHEN g.total + 1 + r.n > 60 THEN g.unit + 1 ELSE g.unit END FROM g JOIN r ON r.diff_id = g.diff_id AND r.chunk = g.chunk + 1)
  SELECT diff_id, chunk, CAST(unit AS BIGINT) AS unit, CAST(max(unit) OVER (PARTITION BY diff_id) AS BIGINT) AS total FROM g""")
def diff_worklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff_id"), place.alias("chunk"), F.col("l_quantity").cast("bigint").alias("n_chars"))
    return projections.diff_worklist(chunks, 60)


@query("""WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS language, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 10 = 0 THEN concat('*', p_size) END AS glob FROM part) SELECT g.id, coalesce(g.glob, b.glob, '') AS globs FROM g LEFT JOIN g b ON b.id = g.language AND b.language IS NULL""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    own = F.when((key % 3 == 0) | (key % 10 == 0), F.array(F.concat(F.lit("*"), F.col("p_size").cast("string")))).otherwise(none)
    guides = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 10 != 0, key - key % 10).alias("language"), own.alias("globs"))
    return projections.inherited_attributes(guides, ["globs"]).select("id", F.array_join("globs", ",").alias("globs"))


@query("""WITH e AS (SELECT o_custkey AS file, CASE o_orderstatus WHEN 'F' THEN 'skip_dirs' WHEN 'O' THEN 'manifests' ELSE 'colour' END AS key, o_orderkey % 4 <> 0 AS is_list FROM orders), h AS (SELECT file, list(key) AS ks FROM e GROUP BY file)
  SELECT file, key, CASE WHEN key = 'colour' THEN 'unknown key' ELSE 'not a list of strings' END AS problem FROM e WHERE key = 'colour' OR NOT is_list UNION ALL SELECT file, 'skip_dirs', 'missing key' FROM h WHERE NOT list_contains(ks, 'skip_dirs')""")
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderstatus") == "F", "skip_dirs").when(F.col("o_orderstatus") == "O", "manifests").otherwise("colour")
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), key.alias("key"), (F.col("o_orderkey") % 4 != 0).alias("is_list"))
    return projections.config_problems(entries, ["skip_dirs", "manifests"], ["skip_dirs"])


@query("""WITH f AS (SELECT DISTINCT concat('vuln:', c_custkey // 2) AS ref, 'vulnerability' AS kind, concat('p', c_nationkey % 3, '/', c_custkey // 2, '.md') AS path FROM customer) SELECT ref, kind, path, CASE WHEN count(*) OVER (PARTITION BY ref) > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM f""")
def knowledge_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").selectExpr("concat('vuln:', c_custkey div 2) AS ref", "'vulnerability' AS kind", "concat('p', c_nationkey % 3, '/', c_custkey div 2, '.md') AS path")
    return projections.inventory(files)


@query("""SELECT doc_id AS name, unnest(CASE WHEN doc_id % 3 = 0 THEN [concat('guide:', lang), concat('vuln:', source)] WHEN doc_id % 3 = 1 THEN [concat('vuln:', source)] ELSE [] END) AS ref FROM documents""")
def case_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("guide:"), "lang"), F.concat(F.lit("vuln:"), "source"))).otherwise(F.array().cast("array<string>"))
    category = F.when(F.col("doc_id") % 3 == 1, F.col("source")).when(F.col("doc_id") % 3 == 2, "")
    return projections.case_references(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), refs.alias("refs"), category.alias("category")))


_SPANS = """d AS (SELECT DISTINCT l_partkey AS file, concat('Fn', l_suppkey % 5) AS name, CAST(l_quantity AS BIGINT) AS lo, CAST(l_quantity AS BIGINT) + l_linenumber AS hi FROM lineitem),
  w AS (SELECT DISTINCT o_custkey AS check_id, o_custkey % 200 AS file, concat('fN', o_custkey % 5) AS symbol FROM orders), s AS (SELECT DISTINCT w.*, d.lo, d.hi FROM w JOIN d ON d.file = w.file AND lower(d.name) = lower(w.symbol))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS file", "concat('Fn', l_suppkey % 5) AS name", "CAST(l_quantity AS BIGINT) AS lo", "CAST(l_quantity AS BIGINT) + l_linenumber AS hi")
    return projections.symbol_spans(table(spark, sf_dir, "orders").selectExpr("o_custkey AS check_id", "o_custkey % 200 AS file", "concat('fN', o_custkey % 5) AS symbol").distinct(), definitions)


@query(f"WITH {_SPANS} SELECT * FROM s")
def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"WITH {_SPANS} SELECT DISTINCT o_custkey AS check_id, o_orderkey AS report FROM orders JOIN s ON s.check_id = o_custkey AND s.file = o_custkey % 200 AND o_orderkey % 60 BETWEEN s.lo AND s.hi")
def reports_in_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").selectExpr("o_custkey AS check_id", "o_orderkey AS report", "o_custkey % 200 AS file", "o_orderkey % 60 AS line")
    return projections.reports_in_symbols(found, _spans(spark, sf_dir), "check_id")


_FINDINGS = "event_id AS ord, concat('src/m', user_id % 20, '.py') AS file, CASE WHEN event_id % 5 > 0 THEN event_id % 90 END AS line, event_type AS category, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('seen ', event_id) END AS description, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'run it' END AS exploit_scenario, concat('fix ', event_type) AS recommendation, CASE WHEN value > 40 THEN 'HIGH' ELSE 'LOW' END AS severity, concat('model-', event_id % 3) AS found_by"
_TEXT = "trim(concat_ws(' ', NULLIF(description, ''), exploit_scenario, recommendation))"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.adapters import split_expressions

    return table(spark, sf_dir, "events").selectExpr(*split_expressions(_FINDINGS))


@query(f"WITH f AS (SELECT {_FINDINGS} FROM events) SELECT ord, concat(file, ':', coalesce(line, 0), ':', ord) AS name, category, file, {_TEXT} AS text, CAST(CASE WHEN line > 0 THEN 1 ELSE 0 END AS INT) AS n_lines FROM f")
def scorer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.scorer_reports(_findings(spark, sf_dir)).select("ord", "name", "category", "file", "text", F.size("lines").alias("n_lines"))


@query(f"""WITH f AS (SELECT {_FINDINGS} FROM events), p AS (SELECT file, line, category, concat('role-', count(*)) AS who FROM f WHERE ord % 2 = 0 GROUP BY file, line, category)
  SELECT f.ord, f.file, f.line, f.category, severity, CASE WHEN description <> '' THEN description ELSE f.category END AS title, {_TEXT} AS evidence, coalesce(p.who, found_by) AS found_by FROM f LEFT JOIN p ON p.file = f.file AND p.line IS NOT DISTINCT FROM f.line AND p.category = f.category""")
def verification_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    who = _findings(spark, sf_dir).filter("ord % 2 = 0").groupBy("file", "line", "category").agg(F.concat(F.lit("role-"), F.count("*").cast("string")).alias("found_by"))
    return projections.verification_inputs(f, who)


_VERDICT = "CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted' WHEN 2 THEN 'unclear' END"


@query(f"""SELECT event_id AS ord, CASE {_VERDICT} WHEN 'confirmed' THEN 'kept' WHEN 'refuted' THEN 'dropped' ELSE 'incomplete' END AS state, CASE WHEN event_id % 4 = 1 THEN concat('verified false positive: ', event_type) END AS reason FROM events""")
def verification_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "events").filter("event_id % 4 <> 3").selectExpr("event_id AS ord", f"{_VERDICT} AS verdict", "event_type AS reason")
    return projections.verification_results(_findings(spark, sf_dir).select("ord"), verdicts)


@query(f"""WITH {view_sql("candidates_v")} SELECT ord, CASE WHEN ord % 6 > 0 THEN concat(category, ' in ', file) END AS title, CASE WHEN ord % 6 > 0 THEN file END AS file, CASE WHEN ord % 6 > 0 THEN line END AS line,
  CASE WHEN ord % 6 > 0 THEN CASE WHEN ord % 5 = 0 THEN 'MEDIUM' ELSE severity END END AS severity, CASE WHEN ord % 6 > 0 THEN 'confirmed' END AS status, CASE WHEN ord % 6 > 0 THEN CASE WHEN ord % 5 = 0 THEN 0 ELSE 1 END END AS n_found_by FROM candidates_v""")
def candidate_wire_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "candidates_v").withColumn("title", F.concat("category", F.lit(" in "), "file")).withColumn("found_by", F.array("label"))
    wire = F.when(F.col("ord") % 6 == 0, "[1]").when(F.col("ord") % 5 == 0, projections.to_wire(["title", "file", "line"])).otherwise(projections.to_wire(["title", "category", "file", "line", "severity", "found_by"]))
    back = c.select("ord", projections.from_wire(wire).alias("c"))
    return back.select("ord", "c.title", "c.file", F.col("c.line").cast("bigint").alias("line"), "c.severity", "c.status", F.when(F.col("c").isNotNull(), F.size("c.found_by")).alias("n_found_by"))


@query("""SELECT page_id, CASE WHEN page_id % 4 > 0 THEN concat('app/v', page_id, CASE page_id % 4 WHEN 1 THEN '.tsx' WHEN 2 THEN '.ts' ELSE '.py' END) END AS file, CASE WHEN page_id % 4 > 1 THEN CAST(page_id AS INT) END AS line FROM pages""")
def cited_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("app/v"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".tsx"), F.lit(".ts"), F.lit(".py"), F.lit(".md")), F.when(F.col("page_id") % 4 == 0, 4).otherwise((F.col("page_id") % 4).cast("int"))))
    text = F.concat(F.lit("see `"), path, F.when(F.col("page_id") % 4 > 1, F.concat(F.lit(":"), F.col("page_id").cast("string"))).otherwise(""), F.lit("` and more"))
    return table(spark, sf_dir, "pages").select("page_id", projections.location(text, [".ts", ".tsx", ".py"]).alias("at")).select("page_id", "at.file", "at.line")


@query("""WITH d AS (SELECT o_custkey AS file, concat('f', o_orderkey % 3) AS name, o_orderkey AS lo FROM orders), e AS (SELECT file, name, string_agg(concat('{"range":[', lo, ',', lo + 5, '],"calls":["a","g', lo % 4, '"]}'), ',' ORDER BY lo) AS es FROM d GROUP BY file, name)
  SELECT file, concat('{', string_agg(concat('"', name, '":[', es, ']'), ',' ORDER BY name), '}') AS payload FROM e GROUP BY file""")
def call_graph_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.array(F.lit("a"), F.concat(F.lit("g"), (F.col("o_orderkey") % 4).cast("string")), F.lit("a"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 5).alias("hi"), calls.alias("calls"))
    return projections.call_graph_payload(rows)


@query("""SELECT event_id, event_id % 4 IN (1, 2) AS usable, event_id % 4 = 1 AS has_findings FROM events""")
def usable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(F.lit("{}"), F.lit('{"findings": []}'), F.lit('here: {"other": 1,} done'), F.lit("nothing")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = replies.reply_objects(table(spark, sf_dir, "events").select("event_id", text.alias("text")))
    return rows.select("event_id", projections.usable(F.col("object")).alias("usable"), projections.usable(F.col("object"), "findings").alias("has_findings"))


def _judged(unit: dict) -> list[dict]:
    """A canned judgment: some units fail, some find nothing, the others find one thing a tenth."""
    if unit["unit"] % 7 == 0:
        raise ValueError(f"no reply for {unit['unit']}")
    return [{"finding": f"f{k}"} for k in range(unit["unit"] % 4)]


@query("""SELECT c_custkey AS unit, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE unnest(CASE WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 0 THEN [NULL] ELSE list_transform(range(0, c_custkey % 4), lambda k: concat('f', k)) END) END AS finding, CASE WHEN c_custkey % 7 = 0 THEN concat('ValueError: no reply for ', c_custkey) END AS error FROM customer""")
def unit_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.fan_out(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")), _judged, "finding string")


@query(f"""WITH f AS (SELECT {_FINDINGS} FROM events), b AS (SELECT DISTINCT concat('src/m', s_suppkey % 20, '.py') AS file, s_suppkey % 90 AS line FROM supplier) SELECT ord, CASE WHEN b.file IS NULL THEN '' WHEN f.line % 2 = 0 THEN concat('dev', f.line, ' <d', f.line, '@x.org>') ELSE concat('dev', f.line) END AS owner FROM f LEFT JOIN b ON b.file = f.file AND b.line = f.line""")
def finding_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").selectExpr("concat('src/m', s_suppkey % 20, '.py') AS file", "s_suppkey % 90 AS line").distinct()
    blame = lines.selectExpr("file", "line", "concat('dev', line) AS author", "CASE WHEN line % 2 = 0 THEN concat('d', line, '@x.org') END AS mail")
    return projections.with_owner(_findings(spark, sf_dir).select("ord", "file", "line"), blame).select("ord", "owner")


@query("""SELECT user_id AS run, count(*) AS calls, CAST(sum(CASE WHEN event_id % 5 > 0 THEN event_id % 100 ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(sum(event_id % 11) AS BIGINT) AS output_tokens FROM events GROUP BY user_id""")
def metered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").selectExpr("user_id AS run", "CASE WHEN event_id % 5 > 0 THEN event_id % 100 END AS input_tokens", "event_id % 7 AS cache_read", "CAST(NULL AS BIGINT) AS cache_write", "event_id % 11 AS output_tokens")
    return projections.metered(calls, "run")


@query(f"""WITH {view_sql("files_v")}, r AS (SELECT DISTINCT lang AS root FROM documents UNION SELECT 'vendor' UNION SELECT DISTINCT concat('vendor/', lang) FROM documents WHERE lang <> 'en') SELECT path, (SELECT arg_max(root, length(root)) FROM r WHERE starts_with(path, concat(root, '/'))) AS root FROM files_v""")
def compile_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "documents").select("lang").distinct()
    roots = lang.select(F.col("lang").alias("root")).unionByName(lang.filter("lang <> 'en'").select(F.concat(F.lit("vendor/"), "lang").alias("root"))).unionByName(spark.createDataFrame([("vendor",)], "root string"))
    return projections.nearest_root(view(spark, sf_dir, "files_v").select("path"), roots)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('case-', p_partkey) ELSE trim(regexp_replace(lower(p_type), '[^0-9a-z]+', '-', 'g'), '-') END AS name, CASE WHEN p_size BETWEEN 0 AND 1 THEN CAST(p_size AS DOUBLE) ELSE 0.5 END AS confidence, CASE WHEN p_size - 3 >= 1 THEN p_size - 3 END AS line,
  trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) AS words, regexp_matches(p_name, '(^|[^\\w])ring($|[^\\w])') AS ring FROM part""".replace("\\\\", "\\"))
def coerced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("poc/Test_Case "), F.col("p_partkey").cast("string"), F.lit(".t.sol"))).otherwise(F.concat(F.lit("poc/"), "p_type", F.lit(".py")))
    name = projections.proof_name(F.regexp_replace(proof, r"\.t\.sol$", ".sol"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), T.probability(F.col("p_size").cast("string"), 0.5).alias("confidence"), T.line_number((F.col("p_size") - 3).cast("string")).cast("bigint").alias("line"), T.evidence_words(F.col("p_name")).alias("words"), T.whole_token(F.col("p_name"), "ring").alias("ring"))


@query("""WITH b AS (SELECT o_orderkey, lower(o_orderstatus) AS base FROM orders) SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN base ELSE concat(base, '-', row_number() OVER w) END AS name FROM b WINDOW w AS (PARTITION BY base ORDER BY o_orderkey)""")
def unique_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unique_names(table(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("base")), F.col("base"), [F.col("o_orderkey")]).select("o_orderkey", "name")


@query(f"""WITH {view_sql("candidates_v")}, r AS (SELECT *, CASE WHEN contains(upper(severity), 'CRITICAL') THEN 0 WHEN contains(upper(severity), 'HIGH') THEN 1 WHEN contains(upper(severity), 'LOW') THEN 3 ELSE 2 END AS k FROM candidates_v)
  SELECT ord, row_number() OVER (PARTITION BY label ORDER BY k, file, coalesce(line, 0), ord) AS place FROM r""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy(*reports.report_order(), "ord"))
    return view(spark, sf_dir, "candidates_v").select("ord", place.cast("bigint").alias("place"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN concat('f', l_suppkey) ELSE concat('lib/', 'f', l_suppkey) END AS path, CASE WHEN l_linenumber > 1 AND l_returnflag <> 'N' AND NOT (l_linenumber = 2 AND l_returnflag = 'A') THEN concat('f', l_suppkey, ':', l_linenumber - 1, ' (', CASE l_returnflag WHEN 'A' THEN 'new' ELSE 'old' END, ')') END AS shown FROM lineitem""")
def change_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors on a finding's own line 1 of the new side aren't shown; invalid lines and sides give none."""
    file = F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))
    side = F.when(F.col("l_returnflag") == "A", "new").when(F.col("l_returnflag") == "R", "old").otherwise("both")
    anchor = dimensions.anchor(file, F.col("l_linenumber") - 1, side)
    path = dimensions.prefixed(file, F.when(F.col("l_partkey") % 3 == 0, "").otherwise("lib/"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"), dimensions.shown_anchor(file, F.lit(1), anchor).alias("shown"))


@query("""SELECT event_id, event_id % 3 = 0 AS ok FROM events""")
def reply_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(F.lit('{"findings": [], "notes": [1]}'), F.lit('{"findings": {}}'), F.lit('{"findings": [], "notes": 3}')), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", replies.contract_ok(text, ["findings"], ["notes"]).alias("ok"))


@query("""WITH i AS (SELECT DISTINCT concat('pkg', c_nationkey % 4, '/a', c_custkey % 50, '.py') AS source, unnest([concat('./b', c_custkey % 30), concat('../lib/c', c_custkey % 30), concat('ext', c_custkey % 9)]) AS spec FROM customer),
  t AS (SELECT source, spec, CASE WHEN starts_with(spec, './') THEN concat(split_part(source, '/', 1), '/', substr(spec, 3)) WHEN starts_with(spec, '../') THEN substr(spec, 4) ELSE spec END AS base FROM i), f AS (SELECT DISTINCT unnest([concat('pkg', p_partkey % 4, '/b', p_partkey % 20, '.py'), concat('lib/c', p_partkey % 25, '.ts')]) AS path FROM part)
  SELECT source, spec, path AS target FROM t JOIN f ON path IN (concat(base, '.py'), concat(base, '.ts'))""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    specs = F.explode(F.array(F.concat(F.lit("./b"), (F.col("c_custkey") % 30).cast("string")), F.concat(F.lit("../lib/c"), (F.col("c_custkey") % 30).cast("string")), F.concat(F.lit("ext"), (F.col("c_custkey") % 9).cast("string"))))
    imports = c.select(F.expr("concat('pkg', c_nationkey % 4, '/a', c_custkey % 50, '.py')").alias("source"), specs.alias("spec")).distinct()
    files = table(spark, sf_dir, "part").select(F.explode(F.expr("array(concat('pkg', p_partkey % 4, '/b', p_partkey % 20, '.py'), concat('lib/c', p_partkey % 25, '.ts'))")).alias("path"))
    return facts.import_targets(imports, files)


@query("""WITH r AS (SELECT o_custkey AS run, o_orderkey AS round, o_orderkey % 3 AS errors, o_orderkey % 5 = 0 AS pending FROM orders), a AS (SELECT run, CAST(sum(errors) AS BIGINT) AS errors, arg_max(pending, round) AS pending, max(round) AS rounds FROM r GROUP BY run),
  l AS (SELECT run, round % 2 AS i, concat('reason ', arg_max(round, round) % 4) AS reason FROM r WHERE errors > 0 GROUP BY 1, 2), j AS (SELECT run, count(*) AS failures, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM l GROUP BY run)
  SELECT run, errors, pending, rounds, coalesce(failures, 0) AS failures, coalesce(reasons, '') AS reasons, errors = 0 AND failures IS NULL AND NOT pending AS complete FROM a LEFT JOIN j USING (run)""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "o_orderkey AS round", "o_orderkey % 3 AS errors", "o_orderkey % 5 = 0 AS pending")
    failures = r.filter("errors > 0").selectExpr("run", "round", "round % 2 AS index", "2 AS total", "'p' AS paths", "concat('reason ', round % 4) AS reason")
    return rounds.outcome(r, failures, "run")


_JUDGED = "SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{7,}')) AS words, doc_id % 17 = 5 AS fails FROM documents"


@query(f"""WITH j AS ({_JUDGED}), x AS (SELECT doc_id, unnest(words) AS word, NULL AS error FROM j WHERE NOT fails UNION ALL SELECT doc_id, NULL, 'ValueError: no judgment' FROM j WHERE fails)
  SELECT doc_id, count(word) AS n_rows, min(word) AS first, max(error) AS error FROM x GROUP BY doc_id""")
def judged_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge as a table function: rows for each document, an error row where it fails."""

    def judge(doc_id: int, text: str | None):
        if doc_id % 17 == 5:
            raise ValueError("no judgment")
        yield from ((w,) for w in dict.fromkeys(re.findall("[A-Z][a-z]{7,}", text or "")))

    table_functions.register(spark, "judge_document", judge, "word string")
    sql = "SELECT d.doc_id, j.* FROM {documents} d, LATERAL judge_document(d.doc_id, d.text) j"
    return spark.sql(sql, documents=table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("word").alias("n_rows"), F.min("word").alias("first"), F.max("error").alias("error"))


@query("""WITH j AS (SELECT conv_id AS unit, turn + 1 AS place, role AS label, CASE WHEN length(text) % 4 = 0 THEN concat('failed of ', length(text) % 3) END AS error FROM conversations), n AS (SELECT unit, count(*) AS n, count(error) AS failed FROM j GROUP BY unit)
  SELECT unit, n AS judgments, failed, failed = 0 AS clean, coalesce((SELECT string_agg(concat(error, ' [knowledge judgment ', place, '/', n.n, ' for ', label, ']'), '; ' ORDER BY place) FROM j WHERE j.unit = n.unit AND error IS NOT NULL), '') AS failures FROM n""")
def sibling_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a unit, its turns are judgments."""
    error = F.when(F.length("text") % 4 == 0, F.concat(F.lit("failed of "), (F.length("text") % 3).cast("string")))
    j = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), (F.col("turn") + 1).alias("place"), F.col("role").alias("label"), error.alias("error"))
    return rounds.sibling_outcomes(j, "unit").withColumn("failures", F.array_join("failures", "; "))
