"""Queries over answer keys: routes that match, pairs of reports and checks, scored benchmarks. Each order is a benchmark, each line one check and one report of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring
from ..sources.adapters import table
from .catalogue import query

#: A line's number in its order may come twice, so lines are numbered anew.
_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber FROM lineitem"
#: Both engines read these. A check's kind, route, class, files and symbols, and a report's, vary with the line's keys.
_CHECK = {
    "check_id": "l_linenumber", "expectation": "CASE WHEN l_partkey % 3 = 0 THEN 'clean' ELSE 'finding' END",
    "endpoint": "CASE l_suppkey % 6 WHEN 0 THEN 'GET /items/<id>' WHEN 1 THEN 'POST /items' WHEN 2 THEN 'GET /items/{id}/parts' ELSE '' END",
    "category": "CASE l_partkey % 5 WHEN 0 THEN 'SQL injection' WHEN 1 THEN 'injection' WHEN 2 THEN 'access_control' WHEN 3 THEN '' ELSE 'xss' END",
    "files": "CASE l_suppkey % 4 WHEN 0 THEN {0}'src/a.py'{1} WHEN 1 THEN {0}'src/a.py', 'lib/b.py'{1} WHEN 2 THEN {0}'lib/b.py'{1} ELSE {0}'./src/c.py'{1} END",
    "symbols": "CASE l_partkey % 4 WHEN 0 THEN {0}'approve'{1} WHEN 1 THEN {0}'_mint', '$query'{1} ELSE CAST({0}{1} AS {2}) END",
}
_REPORT = {
    "report": "CONCAT('r', l_linenumber)", "endpoint": "CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'GET /api/items/5' WHEN 1 THEN 'POST /v1/items, GET /items/<key>' WHEN 2 THEN '`get /items/7/parts?x=1` (the handler)' WHEN 3 THEN 'PUT /items' WHEN 4 THEN 'items/<id>' ELSE '' END",
    "category": "CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 'injection' WHEN 1 THEN 'code-injection' WHEN 2 THEN 'Access Control' ELSE 'xss' END",
    "text": "CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 'It was approved() twice' WHEN 1 THEN 'calls Approve() and returns' WHEN 2 THEN 'a $query is built' WHEN 3 THEN 'see reached_mint' ELSE '' END",
    "locations": "CASE l_partkey % 6 WHEN 0 THEN {0}{3}'src/a.py', 2{4}{1} WHEN 1 THEN {0}{3}'./lib//b.py', 12{4}, {3}'src/a.py', 40{4}{1} WHEN 2 THEN {0}{3}'x/a.py', 3{4}, {3}'y/a.py', 3{4}{1} WHEN 3 THEN {0}{3}'other/b.py', 11{4}{1} WHEN 4 THEN {0}{3}'src/c.py', 1{4}{1} ELSE {0}{3}'src/a.py', CAST(NULL AS INT){4}{1} END",
}
_DEFINITIONS = "SELECT o_orderkey AS benchmark, unnest([{'file': 'src/a.py', 'name': 'Approve', 'lo': o_orderkey % 3, 'hi': o_orderkey % 3 + 2}, {'file': 'lib/b.py', 'name': '_mint', 'lo': 10, 'hi': 10 + o_orderkey % 4}], recursive := true) FROM orders"


def _columns(of: dict[str, str], *marks: str) -> list[str]:
    return [f"{sql.replace('{0}', marks[0]).replace('{1}', marks[1]).replace('{2}', marks[2]).replace('{3}', marks[3]).replace('{4}', marks[4])} AS {name}" for name, sql in of.items()]


_DUCK = ("[", "]", "VARCHAR[]", "row(", ")")
#: Normalised text, the routes in it, a route's method and segments.
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '`', ''), '\?\S*', '', 'g'), '\([^)]*\)', ' ', 'g'), '[<{{][^>}}]*[>}}]', '*', 'g'), '\s+', ' ', 'g'))"
_METHODS = "get|post|put|patch|delete|head|options"
_ROUTES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({{0}}, ' ?, ?', chr(10), 'g'), '\b({_METHODS}) ', concat(chr(10), '\1 '), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_SEGMENTS = "list_filter(string_split(regexp_replace({0}, '^[^ ]* ', ''), '/'), lambda x: x <> '')"
_METHOD = f"regexp_extract({{0}}, '^({_METHODS}) ', 1)"
#: Two routes (m, s: method and segments) with the shorter at the end of the longer.
_SAME_ROUTE = """(a.m = '' OR b.m = '' OR a.m = b.m) AND len(a.s) > 0 AND len(b.s) > 0 AND a.s[greatest(1, len(a.s) - len(b.s) + 1)] = b.s[greatest(1, len(b.s) - len(a.s) + 1)]
    AND len(list_filter(range(0, least(len(a.s), len(b.s))), lambda k: NOT (a.s[len(a.s) - k] = b.s[len(b.s) - k] OR a.s[len(a.s) - k] = '*' OR b.s[len(b.s) - k] = '*'))) = 0"""
_CLASS = r"trim(regexp_replace(lower({0}), '[\s_]+', '-', 'g'), '-')"
_PLAIN = "regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '^\\./', '')"

_PAIRS = f"""l AS ({_LINES}), k AS (SELECT l_orderkey AS benchmark, {", ".join(_columns(_CHECK, *_DUCK))} FROM l), r AS (SELECT l_orderkey AS benchmark, {", ".join(_columns(_REPORT, *_DUCK))} FROM l), d AS ({_DEFINITIONS}),
  kr AS (SELECT benchmark, check_id, {_METHOD.format("e")} AS m, {_SEGMENTS.format("e")} AS s FROM (SELECT benchmark, check_id, {_NORMAL.format("endpoint")} AS e FROM k WHERE endpoint <> '')),
  rr AS (SELECT benchmark, report, {_METHOD.format("e")} AS m, {_SEGMENTS.format("e")} AS s FROM (SELECT benchmark, report, unnest({_ROUTES.format("n")}) AS e FROM (SELECT benchmark, report, {_NORMAL.format("endpoint")} AS n FROM r WHERE endpoint <> ''))),
  route AS (SELECT DISTINCT a.benchmark, a.report, b.check_id FROM rr a JOIN kr b ON a.benchmark = b.benchmark WHERE {_SAME_ROUTE}),
  loc AS (SELECT benchmark, report, l[1] AS file, l[2] AS line, string_split(l[1], '/')[-1] AS base FROM (SELECT benchmark, report, unnest(locations) AS l FROM r)),
  once AS (SELECT benchmark, report, base FROM loc GROUP BY ALL HAVING count(DISTINCT file) = 1), kf AS (SELECT benchmark, check_id, f AS file, string_split(f, '/')[-1] AS base FROM (SELECT benchmark, check_id, unnest(files) AS f FROM k)),
  named AS (SELECT DISTINCT o.benchmark, o.report, kf.check_id FROM once o JOIN kf USING (benchmark, base)), exact AS (SELECT DISTINCT l.benchmark, l.report, kf.check_id FROM loc l JOIN kf ON kf.benchmark = l.benchmark AND {_PLAIN.format("kf.file")} = {_PLAIN.format("l.file")}),
  cited AS (SELECT DISTINCT l.benchmark, l.report, kf.check_id FROM loc l JOIN once USING (benchmark, report, base) JOIN kf ON kf.benchmark = l.benchmark AND kf.base = l.base JOIN (SELECT benchmark, check_id, unnest(symbols) AS symbol FROM k) s ON s.benchmark = kf.benchmark AND s.check_id = kf.check_id
    JOIN d ON d.benchmark = l.benchmark AND d.file = kf.file AND lower(d.name) = lower(s.symbol) WHERE l.line BETWEEN d.lo AND d.hi),
  said AS (SELECT DISTINCT r.benchmark, r.report, s.check_id FROM r JOIN (SELECT benchmark, check_id, unnest(symbols) AS symbol FROM k) s USING (benchmark)
    WHERE regexp_matches(concat(' ', lower(concat_ws(' ', text, endpoint)), ' '), concat('[^\\w]', regexp_replace(lower(symbol), '([$])', '\\\\\\1'), '[^\\w]'))),
  p AS (SELECT r.benchmark, r.report, k.check_id, k.expectation <> 'finding' AS clean, k.endpoint <> '' AS keyed, len(k.files) > 0 AS has_files, len(k.symbols) > 0 AS has_symbols, k.category = '' AS no_class,
    {_CLASS.format("k.category")} <> '' AND {_CLASS.format("r.category")} <> '' AND (list_has_all(string_split({_CLASS.format("k.category")}, '-'), string_split({_CLASS.format("r.category")}, '-')) OR list_has_all(string_split({_CLASS.format("r.category")}, '-'), string_split({_CLASS.format("k.category")}, '-'))) AS class,
    route.report IS NOT NULL AS route, named.report IS NOT NULL AS named, exact.report IS NOT NULL AS exact, cited.report IS NOT NULL OR said.report IS NOT NULL AS symbol
    FROM r JOIN k USING (benchmark) LEFT JOIN route USING (benchmark, report, check_id) LEFT JOIN named USING (benchmark, report, check_id) LEFT JOIN exact USING (benchmark, report, check_id) LEFT JOIN cited USING (benchmark, report, check_id) LEFT JOIN said USING (benchmark, report, check_id)),
  q AS (SELECT *, named AND CASE WHEN has_symbols THEN symbol ELSE class END AS anchored FROM p),
  m AS (SELECT *, CASE WHEN NOT keyed THEN anchored AND (no_class OR class) WHEN clean THEN route AND (no_class OR class) ELSE route OR (has_symbols AND has_files AND anchored AND (no_class OR class)) END AS matches FROM q),
  pairs AS (SELECT benchmark, report, check_id, clean, exact AND class AS localised, CASE WHEN NOT matches THEN 0 WHEN exact AND class THEN 4 WHEN route THEN CASE WHEN class THEN 3 ELSE 2 END WHEN class THEN 2 ELSE 1 END AS quality, named OR exact OR route AS near FROM m)"""


def _benchmarks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(order).cast("bigint").alias("l_linenumber"))
    marks = ("array(", ")", "array<string>", "", "")
    checks = lines.selectExpr("l_orderkey AS benchmark", *_columns(_CHECK, *marks))
    located = F.transform("locations", lambda x: F.struct(x["col1"].alias("file"), x["col2"].alias("line")))
    reports = lines.selectExpr("l_orderkey AS benchmark", *_columns(_REPORT, "array(", ")", "", "struct(", ")")).withColumn("locations", located)
    key = F.col("o_orderkey")
    both = F.array(
        F.struct(F.lit("src/a.py").alias("file"), F.lit("Approve").alias("name"), (key % 3).alias("lo"), (key % 3 + 2).alias("hi")),
        F.struct(F.lit("lib/b.py").alias("file"), F.lit("_mint").alias("name"), F.lit(10).cast("bigint").alias("lo"), (10 + key % 4).alias("hi")),
    )
    definitions = table(spark, sf_dir, "orders").select(key.alias("benchmark"), F.explode(both).alias("x")).select("benchmark", "x.*")
    return reports, checks, definitions


@query(f"WITH {_PAIRS} SELECT benchmark, report, check_id, clean, localised, quality FROM pairs WHERE near")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each report matches each check of its benchmark with which it shares a route or a file's name."""
    reports, checks, definitions = _benchmarks(spark, sf_dir)
    return scoring.match_pairs(reports, checks, "benchmark", definitions)


#: The most pairs, found by going through the findings in order with the set of reports taken so far.
_MOST = """f AS (SELECT benchmark, check_id, row_number() OVER (PARTITION BY benchmark ORDER BY check_id) AS i, list(CAST(1 << CAST(substr(report, 2) AS INT) AS BIGINT)) AS bits FROM pairs WHERE NOT clean AND quality > 0 GROUP BY benchmark, check_id),
  s AS (SELECT DISTINCT benchmark, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS n FROM f UNION SELECT benchmark, i, CAST(taken + b AS BIGINT), CAST(n + CASE WHEN b > 0 THEN 1 ELSE 0 END AS BIGINT) FROM (SELECT s.benchmark, f.i, s.taken, s.n, unnest(list_append(f.bits, 0)) AS b FROM s JOIN f ON f.benchmark = s.benchmark AND f.i = s.i + 1) WHERE taken & b = 0),
  best AS (SELECT benchmark, max(n) AS found FROM s GROUP BY benchmark)"""


@query(f"""WITH RECURSIVE {_PAIRS}, {_MOST}, fp AS (SELECT benchmark, count(DISTINCT report) AS n FROM pairs a WHERE clean AND quality > 0 AND NOT EXISTS (FROM pairs b WHERE b.benchmark = a.benchmark AND b.report = a.report AND NOT b.clean AND b.quality > 0) GROUP BY benchmark),
  x AS (SELECT benchmark, count(*) FILTER (expectation = 'finding') AS findings, count(*) AS reports, count(*) FILTER (expectation = 'finding' AND len(files) > 0) AS with_files FROM k GROUP BY benchmark), filed AS (SELECT benchmark, count(DISTINCT check_id) AS n FROM pairs WHERE NOT clean AND localised GROUP BY benchmark),
  t AS (SELECT benchmark, findings, coalesce(found, 0) AS found, findings - coalesce(found, 0) AS missed, coalesce(fp.n, 0) AS false_positives, reports - coalesce(found, 0) - coalesce(fp.n, 0) AS extra, coalesce(filed.n, 0) AS file_found, with_files - coalesce(filed.n, 0) AS file_missed
    FROM x LEFT JOIN best USING (benchmark) LEFT JOIN fp USING (benchmark) LEFT JOIN filed USING (benchmark))
  SELECT benchmark, found, missed, false_positives, extra, file_found, file_missed, CASE WHEN findings > 0 THEN round_even(found / findings, 4) ELSE 0.0 END AS recall, CASE WHEN found + false_positives > 0 THEN round_even(found / (found + false_positives), 4) ELSE 1.0 END AS precision,
    CASE WHEN file_found + file_missed > 0 THEN round_even(file_found / (file_found + file_missed), 4) ELSE 0.0 END AS file_recall FROM t""")
def scored_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each benchmark, with routes in many spellings, symbols in texts and by line, names that several files have, and several reports on one clean check."""
    reports, checks, definitions = _benchmarks(spark, sf_dir)
    return scoring.totals(scoring.score(reports, checks, "benchmark", definitions), "benchmark")


_PATH = "regexp_replace(url, '^https?://[^/]+', '')"
_KEY = f"concat(CASE page_id % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'POST ' ELSE '' END, regexp_replace({_PATH}, '[^/]+(/?)$', CASE page_id % 4 WHEN 0 THEN '<id>' ELSE '$0' END))"
_SAID = f"concat(CASE page_id % 2 WHEN 0 THEN 'GET /api/v1' ELSE '' END, {_PATH}, CASE page_id % 5 WHEN 0 THEN ', POST /api' || {_PATH} ELSE '' END)"


@query(f"""WITH k AS (SELECT DISTINCT {_NORMAL.format(_KEY.replace("$0", chr(92) + "0"))} AS route FROM pages), kr AS (SELECT route, {_METHOD.format("route")} AS m, {_SEGMENTS.format("route")} AS s FROM k),
  r AS (SELECT page_id, unnest({_ROUTES.format(_NORMAL.format(_SAID))}) AS e FROM pages), rr AS (SELECT page_id, e, {_METHOD.format("e")} AS m, {_SEGMENTS.format("e")} AS s FROM r),
  hit AS (SELECT DISTINCT a.e, b.route FROM (SELECT DISTINCT e, m, s FROM rr) a JOIN kr b ON {_SAME_ROUTE}), x AS (SELECT page_id, count(DISTINCT route) AS n_routes, min(route) AS first_route FROM rr JOIN hit USING (e) GROUP BY page_id)
  SELECT page_id, coalesce(n_routes, 0) AS n_routes, first_route FROM pages LEFT JOIN x USING (page_id)""")
def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page's endpoints, as a report would list them, how many of all distinct keyed routes match, and the first of them. Texts and routes are compared once each."""
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(T.endpoint_normal(F.expr(_KEY)).alias("check_id")).distinct().withColumn("route", F.col("check_id"))
    said = pages.select("page_id", F.explode(T.endpoints_named(F.expr(_SAID))).alias("report"))
    met = scoring.route_candidates(said.select("report").distinct().withColumn("route", F.col("report")), keys, [])
    counted = said.join(met, "report").groupBy("page_id").agg(F.count_distinct("check_id").alias("n_routes"), F.min("check_id").alias("first_route"))
    return pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("n_routes", F.lit(0)).cast("bigint").alias("n_routes"), "first_route")
