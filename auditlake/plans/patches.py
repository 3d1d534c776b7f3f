"""Queries over diffs, replies, citations and source windows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, diffs, lexis, replies
from ..sources.adapters import table
from .catalogue import query

#: Diff texts built from documents: a header, one hunk, and all of the document's lines with marks by position.
_LINES = "list_transform(string_split(text, chr(10)), lambda x, i: concat(CASE i % 4 WHEN 1 THEN ' ' WHEN 2 THEN '+' WHEN 3 THEN '-' ELSE '+' END, x))"
DIFFS = f"d AS (SELECT doc_id AS diff_id, {_LINES} AS ls FROM documents)"


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(F.array(F.lit(" "), F.lit("+"), F.lit("-"), F.lit("+")), i % 4), x))
    header = F.concat(F.lit("diff --git a/src/f"), F.col("doc_id").cast("string"), F.lit(".py b/src/f"), F.col("doc_id").cast("string"), F.lit(".py\n--- a/src/f"), F.col("doc_id").cast("string"), F.lit(".py\n+++ b/src/f"), F.col("doc_id").cast("string"), F.lit(".py\n@@ -10,9 +20,9 @@\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.concat(header, F.array_join(marked, "\n")).alias("text"))


NUMBERED = f"""{DIFFS}, l AS (SELECT diff_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d), m AS (SELECT *, substr(line, 1, 1) AS mark FROM l),
  n AS (SELECT diff_id, i, mark, 9 + count(*) FILTER (mark IN (' ', '-')) OVER w AS o, 19 + count(*) FILTER (mark IN (' ', '+')) OVER w AS n FROM m WINDOW w AS (PARTITION BY diff_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {NUMBERED} SELECT diff_id, CAST(i + 3 AS INT) AS pos, mark, CAST(CASE WHEN mark <> '+' THEN o END AS INT) AS old_line, CAST(CASE WHEN mark <> '-' THEN n END AS INT) AS new_line FROM n")
def diff_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = diffs.numbered(diffs.lines(_diffs(spark, sf_dir)))
    return n.select("diff_id", "pos", "mark", F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"))


@query(f"""WITH {NUMBERED}, s AS (SELECT diff_id, 'current' AS side, n AS x FROM n WHERE mark <> '-' UNION ALL SELECT diff_id, 'new', n FROM n WHERE mark = '+' UNION ALL SELECT diff_id, 'old', o FROM n WHERE mark = '-'),
  g AS (SELECT *, x - row_number() OVER (PARTITION BY diff_id, side ORDER BY x) AS g FROM s) SELECT diff_id, concat('src/f', diff_id, '.py') AS path, side, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM g GROUP BY diff_id, side, g""")
def diff_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs.lines(_diffs(spark, sf_dir))
    return diffs.line_ranges(rows, diffs.chunk_text(rows).select("diff_id", "chunk", "path")).select("diff_id", "path", "side", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


#: A document defines its capitalised words and calls its other ones.
_DEFINED, _CALLED = "^[A-Z][a-z][a-z][a-z]+$", "^[a-z][a-z][a-z][a-z]+$"
_WORDS = "unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: regexp_matches(x, '{0}')))"


@query(rf"""WITH d AS (SELECT DISTINCT doc_id AS path, lower({_WORDS.format(_DEFINED)}) AS name FROM documents), c AS (SELECT DISTINCT doc_id AS caller, {_WORDS.format(_CALLED)} AS name FROM documents),
  n AS (SELECT name, count(*) AS n FROM d GROUP BY name), o AS (SELECT caller, name, n, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.path = caller AND d.name = c.name) THEN 1 ELSE 0 END AS own FROM c JOIN n USING (name)), f AS (SELECT name, list_sort(list(path)) AS ps FROM d GROUP BY name)
  SELECT caller, name, n - own AS n_callees, CASE WHEN f.ps[1] = caller THEN f.ps[2] ELSE f.ps[1] END AS callee FROM o JOIN f USING (name) WHERE n - own > 0""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with the number of files that define its name, and the first of them."""
    lower = lambda words: F.array_distinct(F.transform(words, lambda x: F.lower(x)))
    words = lambda p: F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: x.rlike(p))
    symbols = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), lower(words(_DEFINED)).alias("defines"), F.array_distinct(words(_CALLED)).alias("calls"))
    return diffs.call_links(symbols)


#: Sources made of the documents' lines: a word's place tells whether it is defined, called, imported, or only stands in a comment or a string.
_SHAPES = (
    "concat('function ', a, '(x) {{ return ', b, '(x); }}')", "concat('// ', a, '(x) ', b, '(y)')", "concat('const ', a, ' = async (x, y) => ', b, '(x, \"', c, '(z)\");')", "concat('v = \"', a, '(\" + ', b, '(1) /* ', c, '(2) */')",
    "concat('event ', a, '(uint x);')", "concat('import ', a, ' from \"', b, '/', c, '\"')", "concat('  ', a, ' (x) {{ if (', b, '(x)) {{ ', c, '.run(x) }} }}')", "concat('function ', a, '(x) external returns (', b, '(y));')",
)


@query(rf"""WITH l AS (SELECT doc_id, i, regexp_extract_all(x, '[A-Za-z]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
  n AS (SELECT doc_id, i % 8 AS k, concat(coalesce(w[1], 'none'), '_') AS a, concat(coalesce(w[2], 'none'), '_') AS b, concat(coalesce(w[3], 'none'), '_') AS c FROM l),
  s AS (SELECT doc_id, 'definition' AS kind, a AS name FROM n WHERE k IN (0, 2, 6, 7) UNION SELECT doc_id, 'call', b FROM n WHERE k IN (0, 2, 3, 6) AND length(b) >= 5 UNION SELECT doc_id, 'assignment', a FROM n WHERE k = 2 AND length(a) >= 5 UNION SELECT doc_id, 'import', concat(b, '/', c) FROM n WHERE k = 5)
  SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'definition'), '') AS defined, coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'call'), '') AS called, coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = 'import'), '') AS imported,
    count(DISTINCT name) FILTER (kind <> 'import' AND length(name) >= 5) AS n_changed FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""")
def called_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources made of whole documents define, call and import, with names in strings, comments and declarations among them that count for nothing."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(*(F.concat(F.coalesce(F.get(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)), F.lit(k)), F.lit("none")), F.lit("_")).alias(n) for k, n in enumerate("abc")), (i % 8).alias("k")))
    shaped = "transform(parts, p -> element_at(array(" + ", ".join(re.sub(r"(?<![\w'])([abc])(?![\w'])", r"p.\1", s.replace("{{", "{").replace("}}", "}")) for s in _SHAPES) + "), p.k + 1))"
    sources = table(spark, sf_dir, "documents").select("doc_id", line.alias("parts")).select("doc_id", F.array_join(F.expr(shaped), "\n").alias("text"))
    s = lexis.with_symbols(sources).select("doc_id", "symbols")
    joined = lambda kind: F.array_join(lexis.names(F.col("symbols"), kind), ",")
    return s.select("doc_id", joined("definition").alias("defined"), joined("call").alias("called"), joined("import").alias("imported"), F.size(lexis.changed_names(F.col("symbols"))).cast("bigint").alias("n_changed"))


_CODE = "concat('def f', o_orderkey, '(a): g', o_custkey, '(a)', chr(10), 'const h', o_custkey, ' = async x => call', o_orderkey, '(x)', chr(10), 'let k', o_custkey, ' = (a, b) => a', chr(10), '  run', o_orderkey, '(a) {', chr(10), 'modifier m', o_orderkey, '(x) {', chr(10), '// gone', o_orderkey, '(x)', chr(10), 'func (s *T) go', o_orderkey, '(x)', chr(10), 'if (ok) send', o_custkey, '(x)', chr(10), 'function js$', o_orderkey, '(y) {')"


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct([concat('f', o_orderkey), concat('h', o_custkey), concat('k', o_custkey), concat('run', o_orderkey), concat('m', o_orderkey), concat('go', o_orderkey), concat('js$', o_orderkey)])), ',') AS defined,
  array_to_string(list_sort(list_distinct(list_filter([concat('g', o_custkey), concat('call', o_orderkey), concat('send', o_custkey)], lambda x: length(x) >= 5))), ',') AS called FROM orders""")
def extracted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and calls of sources in several languages, made of the orders."""
    s = lexis.with_symbols(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CODE).alias("text")))
    return s.select("o_orderkey", F.array_join(lexis.definitions(F.col("symbols")), ",").alias("defined"), F.array_join(lexis.calls(F.col("symbols")), ",").alias("called"))


_REPLY = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'none' ELSE '[1, 2]' END"


@query(f"""SELECT event_id AS reply_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 3 = 0 AS ok FROM events""")
def json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replies.reply_objects(table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), F.expr(_REPLY).alias("text")))
    return rows.select("reply_id", F.try_variant_get(F.try_parse_json("object"), "$.k", "bigint").alias("k"), F.col("object").isNotNull().alias("ok"))


_CITED = "concat('see ', replace(url, ':', ' '), '/f.html:', page_id, ' and src/a.py:', page_id + 1, ' on 2024-01-01:3')"


@query(rf"""WITH t AS (SELECT page_id, {_CITED} AS text FROM pages), c AS (SELECT page_id, unnest(regexp_extract_all(text, '([A-Za-z_][\w./-]*\.[A-Za-z]\w*):(\d+)', 1)) AS path, unnest(regexp_extract_all(text, '([A-Za-z_][\w./-]*\.[A-Za-z]\w*):(\d+)', 2)) AS line FROM t)
  SELECT page_id, path, CAST(line AS INT) AS line FROM c""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_CITED).alias("text"))
    return rows.select("page_id", F.inline(replies.citations(F.col("text"))))


#: Up to the last line feed before a line that begins without white space.
_LAST_LINE = r"length(regexp_extract(substr(text, {0} + 1, 2001), '(?s)^(.*\n)[^\t-\r \x1c-\x1f\x{85}\x{a0}]', 1))"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS start, length(text) AS n, {_LAST_LINE.replace("{0}", "0")} AS cut FROM t
    UNION ALL SELECT m.doc_id, k + 1, nx, n, {_LAST_LINE.replace("{0}", "nx")} FROM (SELECT *, CASE WHEN cut > 0 THEN start + cut ELSE greatest(start + 1, start + 1800) END AS nx FROM s WHERE n - start > 2000) m JOIN t USING (doc_id))
  SELECT doc_id, CAST(k AS INT) AS "window", CAST(start AS INT) AS "start", CAST(CASE WHEN n - start <= 2000 THEN n WHEN cut > 0 THEN start + cut ELSE start + 2000 END AS INT) AS "end" FROM s""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.text_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200)


@query()
def fuzzy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as blocks of one finding's evidence."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("evidence"))
    return replies.fuzzy_evidence(rows, "evidence").select("conv_id", F.size("blocks").alias("n_blocks"), F.col("joined").alias("evidence"))


_PROSE = "concat('Seen in `src/mod ', page_id % 7, '/a b.py`:', page_id, ' and lib/x.ts:', page_id + 1, ', ./lib//x.ts:4, `y.go`:', page_id % 5, ', on 2024-01-01/z.py:3, src/mod ', page_id % 7, '/a b.py:9; ', url)"


@query(f"""WITH p AS (SELECT page_id, concat('src/mod ', page_id % 7, '/a b.py') AS spaced, page_id % 2 = 0 AS two FROM pages), l AS (SELECT page_id, spaced AS file, page_id AS line FROM p UNION SELECT page_id, spaced, 9 FROM p
    UNION SELECT page_id, 'lib/x.ts', page_id + 1 FROM p UNION SELECT page_id, 'lib/x.ts', 4 FROM p UNION SELECT page_id, 'cmd/y.go', CASE WHEN two THEN NULL ELSE page_id % 5 END FROM p UNION SELECT page_id, 'other/y.go', NULL FROM p WHERE two)
  SELECT page_id, file, CAST(line AS INT) AS line FROM l""")
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in prose, held against each page's files: blanks in paths, odd spellings, and a name that two files have on every other page."""
    files = F.array(F.concat(F.lit("src/mod "), (F.col("page_id") % 7).cast("string"), F.lit("/a b.py")), F.lit("lib/x.ts"), F.lit("cmd/y.go"))
    files = F.when(F.col("page_id") % 2 == 0, F.concat(files, F.array(F.lit("other/y.go")))).otherwise(files)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.expr(_PROSE), r"https?://\S+", "").alias("text"), files.alias("files"))
    return rows.select("page_id", F.inline(replies.cited_locations(F.col("text"), F.col("files"))))


@query(f"""WITH {NUMBERED}, g AS (SELECT n.diff_id, n.i, CASE WHEN n.mark <> '+' THEN n.o END AS o, CASE WHEN n.mark <> '-' THEN n.n END AS n, l.line FROM n JOIN l ON l.diff_id = n.diff_id AND l.i = n.i), w AS (SELECT diff_id, coalesce(max(length(CAST(o AS VARCHAR))), 0) AS wo, coalesce(max(length(CAST(n AS VARCHAR))), 0) AS wn FROM g GROUP BY diff_id)
  SELECT diff_id, string_agg(concat(lpad(coalesce(CAST(o AS VARCHAR), ''), CAST(wo AS INT), ' '), ':', lpad(coalesce(CAST(n AS VARCHAR), ''), CAST(wn AS INT), ' '), ' | ', line), chr(10) ORDER BY i) AS text FROM g JOIN w USING (diff_id) GROUP BY diff_id""")
def patch_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of whole documents with the numbers of both sides before their lines."""
    return context.patch_gutter(diffs.numbered(diffs.lines(_diffs(spark, sf_dir))), ["diff_id"])
