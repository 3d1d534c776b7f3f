"""Queries over paths, texts, endpoints and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import knowledge, packing, review, sinks
from ..sources.adapters import table, view, view_sql
from .catalogue import query

FILES = view_sql("files_v")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  g AS (SELECT source, doc_id, k, n_chars AS total, CAST(0 AS BIGINT) AS unit FROM d WHERE k = 1 UNION ALL
    SELECT d.source, d.doc_id, d.k, CASE WHEN g.total + d.n_chars > 20000 THEN d.n_chars ELSE g.total + d.n_chars END, CASE WHEN g.total + d.n_chars > 20000 THEN g.unit + 1 ELSE g.unit END FROM g JOIN d ON d.source = g.source AND d.k = g.k + 1)
  SELECT source, doc_id, unit FROM g""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return packing.greedy(rows, "source", ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "unit")


@query("""SELECT lang, doc_id, n_chars FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 100000""")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.until_full(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], "n_chars", 100_000)


HINTS = "h AS (SELECT item_id % 25 AS id, text AS hint FROM benchmark UNION ALL SELECT * FROM (VALUES (90, 'password'), (91, 'the of'), (92, 'token'), (93, 'in the')) t(id, hint))"
SELECTED = f"{HINTS}, s AS (SELECT doc_id AS text_id, id, max(length(hint)) AS longest, count(*) AS matches FROM documents, h WHERE contains(lower(text), lower(hint)) GROUP BY doc_id, id)"
IMPACT = "CASE WHEN id % 3 = 0 THEN 'CRITICAL' WHEN id % 3 = 1 THEN 'HIGH' ELSE 'LOW' END"


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(90, "password"), (91, "the of"), (92, "token"), (93, "in the")], "id bigint, hint string")
    hints = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 25).alias("id"), F.col("text").alias("hint")).unionByName(fixed)
    return knowledge.select_hints(table(spark, sf_dir, "documents"), hints, "doc_id", "text")


@query(f"WITH {SELECTED} SELECT text_id, id, longest, matches, row_number() OVER (PARTITION BY text_id ORDER BY CASE {IMPACT} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 4 END, longest DESC, matches DESC, id) AS place FROM s")
def hint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _selected(spark, sf_dir).withColumn("impact", F.expr(IMPACT))
    place = F.row_number().over(Window.partitionBy("text_id").orderBy(*knowledge.relevance())).cast("bigint")
    return rows.withColumn("place", place).drop("impact")


@query(f"""WITH RECURSIVE {SELECTED}, o AS (SELECT text_id, id, id * 40 + 200 AS size, row_number() OVER (PARTITION BY text_id ORDER BY CASE {IMPACT} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 4 END, longest DESC, matches DESC, id) AS k FROM s),
  g AS (SELECT text_id, id, k, size AS total, 1 AS n, CAST(0 AS BIGINT) AS unit FROM o WHERE k = 1 UNION ALL SELECT o.text_id, o.id, o.k, CASE WHEN g.total + 2 + o.size > 6000 OR g.n >= 4 THEN o.size ELSE g.total + 2 + o.size END,
    CASE WHEN g.total + 2 + o.size > 6000 OR g.n >= 4 THEN 1 ELSE g.n + 1 END, CASE WHEN g.total + 2 + o.size > 6000 OR g.n >= 4 THEN g.unit + 1 ELSE g.unit END FROM g JOIN o ON o.text_id = g.text_id AND o.k = g.k + 1)
  SELECT text_id, id, unit FROM g""")
def knowledge_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _selected(spark, sf_dir).withColumns({"impact": F.expr(IMPACT), "size": F.col("id") * 40 + 200})
    return knowledge.packs(rows, "text_id", "size").select("text_id", "id", "unit")


RULES = P.PathRules()
_SKIP = "(list_has_any(list_slice(string_split(path, '/'), 1, -2), ['node_modules', 'vendor', 'dist', '.git']) OR path LIKE 'build/%')"
_TEST = r"(list_has_any(list_slice(string_split(path, '/'), 1, -2), ['test', 'tests', 'spec']) OR regexp_matches(split_part(path, '/', -1), '^test_.*$|_test\.|\.spec\.'))"
_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"


@query(f"""WITH {FILES} SELECT doc_id, path, {_SKIP} AS skipped, {_TEST} AS test, ({_SKIP} OR {_TEST} OR {_EXT} IN ('md', 'rst', 'txt')) AS noise, {_EXT} IN ('py', 'js', 'ts', 'go', 'java', 'sol') AS source_file,
  (path = '' OR path LIKE '/%' OR list_contains(string_split(path, '/'), '..')) AS unsafe FROM files_v""")
def path_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return view(spark, sf_dir, "files_v").select(
        "doc_id", "path", P.is_skipped(path, RULES).alias("skipped"), P.is_test(path, RULES).alias("test"), P.is_noise(path, RULES).alias("noise"), P.is_source(path, RULES).alias("source_file"), P.is_unsafe(path).alias("unsafe")
    )


@query(f"""WITH {FILES} SELECT doc_id, path, regexp_matches(path, '/src1[^/]*/') AS globbed, contains(lower(text), 'password') OR contains(lower(text), 'http') AS marked FROM files_v
  WHERE NOT {_TEST} AND NOT {_SKIP} AND (regexp_matches(path, '/src1[^/]*/') OR ({_EXT} IN ('py', 'js', 'ts', 'go', 'java', 'sol') AND (contains(lower(text), 'password') OR contains(lower(text), 'http'))))""")
def entrypoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.entrypoints(view(spark, sf_dir, "files_v"), F.col("path").rlike("/src1[^/]*/"), ("password", "http"), RULES)
    return found.select("doc_id", "path", "globbed", "marked")


STACKS = (review.Stack("solidity", ("*.sol",), ("contract", "the ")), review.Stack("script", ("*.py",), ("und", "der ")), review.Stack("browser", ("*.js",), ("pour", "de ")), review.Stack("contracts", ("*.sol",), ()))


@query(f"""WITH {FILES}, m AS (SELECT *, (path LIKE '%.sol' OR contains(lower(text), 'contract') OR contains(lower(text), 'the ')) AS solidity, (path LIKE '%.py' OR contains(lower(text), 'und') OR contains(lower(text), 'der ')) AS script,
    (path LIKE '%.js' OR contains(lower(text), 'pour') OR contains(lower(text), 'de ')) AS browser FROM files_v)
  SELECT split_part(split_part(path, '/src', 1), '/', -1) AS root, count(*) FILTER (solidity) AS solidity, count(*) FILTER (script) AS script, count(*) FILTER (browser) AS browser, bool_or(path LIKE '%.sol') AS contracts FROM m GROUP BY 1""")
def stack_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.substring_index(F.substring_index("path", "/src", 1), "/", -1)
    return review.stacks(view(spark, sf_dir, "files_v").withColumn("root", root), STACKS, ["root"]).withColumn("contracts", F.col("contracts") > 0)


_RAW = "concat(CASE page_id % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'post ' ELSE '' END, regexp_replace(url, '^https?://[^/]+', ''), CASE page_id % 5 WHEN 0 THEN '/<id>' WHEN 1 THEN '/{key}?q=1, GET /next' WHEN 2 THEN '(the handler)' || chr(9) || '`x`' ELSE '' END)"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(raw), '`', ''), '\?\S*', '', 'g'), '\([^)]*\)', ' ', 'g'), '[<{][^>}]*[>}]', '*', 'g'), '\s+', ' ', 'g'))"
_METHODS = "get|post|put|patch|delete|head|options"


@query(rf"""WITH e AS (SELECT page_id, {_RAW} AS raw FROM pages), n AS (SELECT *, {_NORM} AS normal FROM e)
  SELECT page_id, normal, regexp_extract(normal, '^({_METHODS}) ', 1) AS http_method, len(list_filter(string_split(regexp_replace(normal, '^[^ ]* ', ''), '/'), lambda x: x <> '')) AS n_segments,
    array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(normal, ' ?, ?', chr(10), 'g'), '\b({_METHODS}) ', concat(chr(10), '\1 '), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '; ') AS routes FROM n""")
def endpoint_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = T.endpoint_normal(F.col("raw"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW).alias("raw"))
    return rows.select("page_id", normal.alias("normal"), T.endpoint_method(normal).alias("http_method"), F.size(T.endpoint_segments(normal)).cast("bigint").alias("n_segments"), F.array_join(T.endpoints_named(F.col("raw")), "; ").alias("routes"))


_CAT = "concat(CASE o_orderkey % 4 WHEN 0 THEN 'SQL_injection' WHEN 1 THEN 'code injection' WHEN 2 THEN 'Injection' ELSE 'access-control' END)"
_SPELL = "trim(regexp_replace(lower({0}), '[ _]+', '-', 'g'), '-')"


@query(f"""WITH c AS (SELECT o_orderkey, {_CAT} AS a, CASE o_custkey % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'Access_Control' ELSE '' END AS b FROM orders), s AS (SELECT *, {_SPELL.format("a")} AS x, {_SPELL.format("b")} AS y FROM c)
  SELECT o_orderkey, x AS category, CASE x WHEN 'sql-injection' THEN 'injection' WHEN 'code-injection' THEN 'injection' ELSE x END AS canonical,
    (x <> '' AND y <> '' AND (list_has_all(string_split(y, '-'), string_split(x, '-')) OR list_has_all(string_split(x, '-'), string_split(y, '-')))) AS matches FROM s""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CAT} AS a", "CASE o_custkey % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'Access_Control' ELSE '' END AS b")
    aliases = F.create_map(F.lit("sql-injection"), F.lit("injection"), F.lit("code-injection"), F.lit("injection"))
    category = T.category_spelling(F.col("a"))
    return rows.select("o_orderkey", category.alias("category"), F.coalesce(F.element_at(aliases, category), category).alias("canonical"), T.category_match(F.col("a"), F.col("b")).alias("matches"))


@query(r"""WITH t AS (SELECT *, concat('src\', lang, '/', source, ' ', doc_id, '.PY') AS path, substr(coalesce(text, ''), 1, 100) AS title FROM documents), u AS (SELECT *, replace(path, '\', '/') AS whole, trim(regexp_replace(title, '[^\p{L}\p{N}]', '-', 'g'), '-') AS plain FROM t)
  SELECT doc_id, concat('ev-', substr(sha256(concat(source, chr(31), lang)), 1, 12)) AS evidence_id, concat('finding-', substr(sha256(concat(lang, chr(31), source, chr(31), doc_id)), 1, 16)) AS finding_id,
    concat(substr(trim(regexp_replace(lower(whole), '[^0-9a-z]+', '-', 'g'), '-'), 1, 64), '-', substr(sha256(whole), 1, 16)) AS unit_slug, substr(CASE WHEN plain = '' THEN 'finding' ELSE lower(plain) END, 1, 80) AS finding_slug, sha256(text) AS content FROM u""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of files and findings; the beginning of a text stands for a finding's title."""
    path = F.concat(F.lit("src\\"), "lang", F.lit("/"), "source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".PY"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.short_hash("ev-", 12, F.col("source"), F.col("lang")).alias("evidence_id"), T.short_hash("finding-", 16, F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("finding_id"),
        T.unit_slug(path).alias("unit_slug"), T.finding_slug(F.substring("text", 1, 100)).alias("finding_slug"), F.sha2("text", 256).alias("content"),
    )


@query("""WITH f AS (SELECT source, CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents), n AS (SELECT source, CAST(ceil(count(*) / 16) AS BIGINT) AS n FROM f GROUP BY source),
  l AS (SELECT source, CAST(concat('0x', substr(sha256(path), 1, 8)) AS BIGINT) % n AS s, path, concat(path, ':', sha256(text)) AS line FROM f JOIN n USING (source)), p AS (SELECT source, s, sha256(string_agg(line, chr(10) ORDER BY path)) AS h, count(*) AS n FROM l GROUP BY source, s)
  SELECT source, sha256(concat('1', chr(10), 'web', chr(10), string_agg(h, chr(10) ORDER BY s))) AS fingerprint, CAST(sum(n) AS BIGINT) AS files FROM p GROUP BY source""")
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a tree; stretches are short here, so that every tree has several."""
    return sinks.fingerprints(table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "text"), ["source"], "web", stretch=16)


@query(r"""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')) + 1 AS line_at_200,
  CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), chr(10), '[truncated]') ELSE text END AS shown FROM documents""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.line_of(text, F.length(text)).cast("bigint").alias("n_lines"), T.line_of(text, F.lit(200)).cast("bigint").alias("line_at_200"), T.truncated(text, 100).alias("shown"))
