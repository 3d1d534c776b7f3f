"""Queries over findings and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings, intervals
from ..sources.adapters import table, view, view_sql
from .catalogue import query

RANK = """CASE WHEN contains(upper({0}), 'CRITICAL') THEN 0 WHEN contains(upper({0}), 'HIGH') THEN 1 WHEN contains(upper({0}), 'MEDIUM') THEN 2 WHEN contains(upper({0}), 'LOW') THEN 3 ELSE 2 END"""
NAME = "CASE {0} WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(endpoint), '\?[^ ,]*', '', 'g'), '<[^>]*>|\{[^}]*\}', '*', 'g'), '\s+', ' ', 'g'))"
KEYED = f"""{view_sql("candidates_v")}, keyed AS (SELECT *, {RANK.format("severity")} AS rank,
  CASE WHEN symbol <> '' THEN concat('sym|', lower(file), '|', lower(category), '|', regexp_replace(lower(split_part(symbol, '.', -1)), '[^a-z0-9_]', '', 'g'))
    WHEN endpoint <> '' THEN concat('ep|', {NORMAL}, '|', lower(category)) ELSE concat('fc|', lower(file), '|', lower(category)) END AS key FROM candidates_v)"""


def _union(spark: SparkSession, sf_dir: str, with_evidence: bool = True) -> DataFrame:
    return findings.union_findings(view(spark, sf_dir, "candidates_v"), findings.candidate_key(), with_evidence).withColumn("key", F.array_join("key", "|"))


@query(f"""WITH {KEYED}, u AS (SELECT key, min(ord) AS ord, arg_min(title, ord) AS title, max(CASE WHEN status = 'confirmed' THEN 1 ELSE 0 END) AS c, quantile_disc(rank, 0.5) AS median,
    count(DISTINCT label) AS consensus, string_agg(DISTINCT label, ',' ORDER BY label) AS found_by, count(*) AS n_rows FROM (SELECT *, concat(category, ' in ', file) AS title FROM keyed) GROUP BY key)
  SELECT key, title, CASE WHEN c = 1 THEN 'confirmed' ELSE 'blocked' END AS status, {NAME.format("median")} AS severity, found_by, CAST(consensus AS INT) AS consensus, n_rows,
    row_number() OVER (ORDER BY consensus DESC, median, ord) AS position FROM u""")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = findings.rank_findings(_union(spark, sf_dir, with_evidence=False))
    return ranked.select("key", F.concat("category", F.lit(" in "), "file").alias("title"), "status", "severity", F.array_join("found_by", ",").alias("found_by"), "consensus", "n_rows", "position")


@query(f"""WITH {view_sql("candidates_v")} SELECT ord, file, line, category FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(file), line, lower(category) ORDER BY ord) AS rn FROM candidates_v) WHERE rn = 1 OR line IS NULL""")
def colocated_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.collapse_colocated(view(spark, sf_dir, "candidates_v")).select("ord", "file", "line", "category")


@query(f"""SELECT o_orderstatus AS status, count(*) FILTER (r = 0) AS n_critical, count(*) FILTER (r = 1) AS n_high, count(*) FILTER (r = 2) AS n_medium, count(*) FILTER (r = 3) AS n_low, count(*) AS n_all
  FROM (SELECT o_orderstatus, {RANK.format("o_orderpriority")} AS r FROM orders) GROUP BY o_orderstatus""")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_breakdown(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), ["status"], F.col("o_orderpriority"))


@query(f"""WITH RECURSIVE {KEYED}, d AS (SELECT key, evidence, min(ord) AS pos FROM keyed GROUP BY key, evidence), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM d),
  f AS (SELECT key, k, evidence AS folded FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, CASE WHEN contains(f.folded, o.evidence) THEN f.folded ELSE concat(f.folded, '; ', o.evidence) END FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
  SELECT key, arg_max(folded, k) AS evidence FROM f GROUP BY key""")
def evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir).select("key", "evidence")


@query(f"""WITH {KEYED}, pool AS (SELECT DISTINCT key FROM keyed WHERE ord % 2 = 0) SELECT DISTINCT key FROM keyed WHERE ord % 2 = 1 AND key NOT IN (SELECT key FROM pool)""")
def new_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates_v")
    pool = rows.filter("ord % 2 = 0").select(findings.candidate_key().alias("key"))
    return findings.new_identities(pool, rows.filter("ord % 2 = 1"), findings.candidate_key()).select(F.array_join("key", "|").alias("key"))


INTERVALS = view_sql("intervals_v")


@query(f"""WITH {INTERVALS}, d AS (SELECT DISTINCT file, lo, hi FROM intervals_v), m AS (SELECT *, max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
  i AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT file, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY file, island""")
def merged_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(view(spark, sf_dir, "intervals_v"), ["file"])


@query(f"""WITH {INTERVALS}, p AS (SELECT DISTINCT file, unnest(range(lo, hi)) AS x FROM intervals_v) SELECT file, count(*) AS covered FROM p GROUP BY file""")
def interval_union_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_length(view(spark, sf_dir, "intervals_v"), ["file"])


@query(f"""WITH {INTERVALS}, d AS (SELECT DISTINCT file, lo, hi FROM intervals_v WHERE o % 2 = 0), c AS (SELECT DISTINCT file, unnest(range(lo, hi + 1)) AS line FROM intervals_v WHERE o % 2 = 1),
  hit AS (SELECT DISTINCT d.file, d.lo, d.hi FROM d JOIN c ON c.file = d.file AND c.line BETWEEN d.lo AND d.hi)
  SELECT DISTINCT d.file, d.lo, d.hi FROM hit d JOIN c ON c.file = d.file AND c.line BETWEEN d.lo AND d.hi
  WHERE NOT EXISTS (SELECT 1 FROM hit n WHERE n.file = d.file AND n.lo >= d.lo AND n.hi <= d.hi AND n.hi - n.lo < d.hi - d.lo AND c.line BETWEEN n.lo AND n.hi)""")
def changed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "intervals_v")
    definitions = rows.filter("o % 2 = 0").select("file", "lo", "hi").distinct()
    ranges = intervals.merge(rows.filter("o % 2 = 1"), ["file"])
    lines = ranges.select("file", F.explode(F.sequence("lo", "hi")).alias("line"))
    hit = intervals.overlap(definitions, ranges.select("file", F.col("lo").alias("lo_r"), F.col("hi").alias("hi_r")), "file", "left_semi")
    return intervals.not_only_nested(hit, hit, lines, "file")


#: Even orders hold the findings, odd ones the ranges: every line has one role.
POINTS = "points AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS file, l_suppkey AS s, CAST(floor(l_extendedprice) AS BIGINT) % 160 AS line FROM lineitem WHERE l_orderkey % 2 = 0)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_partkey AS file", "l_suppkey AS s", "CAST(floor(l_extendedprice) AS BIGINT) % 160 AS line")


def _in(kind: str) -> str:
    return f"WITH {INTERVALS}, {POINTS} SELECT o, n, p.file, s, line FROM points p WHERE {kind} EXISTS (SELECT 1 FROM intervals_v r WHERE r.o % 2 = 1 AND r.file = p.file AND p.line BETWEEN r.lo AND r.hi)"


@query(_in(""))
def findings_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.members(_points(spark, sf_dir), view(spark, sf_dir, "intervals_v").filter("o % 2 = 1"), "file", "line")


@query(_in("NOT"))
def findings_outside_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.members(_points(spark, sf_dir), view(spark, sf_dir, "intervals_v").filter("o % 2 = 1"), "file", "line", inside=False)


@query(f"""WITH {INTERVALS}, d AS (SELECT file, lo, hi, min(o) AS o FROM intervals_v GROUP BY file, lo, hi)
  SELECT file, lo, hi, o FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.file = a.file AND b.lo <= a.lo AND b.hi >= a.hi AND b.hi - b.lo > a.hi - a.lo)""")
def outer_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.outermost(view(spark, sf_dir, "intervals_v").groupBy("file", "lo", "hi").agg(F.min("o").alias("o")), "file", "o")


@query(f"""WITH {INTERVALS}, d AS (SELECT DISTINCT file, lo, hi FROM intervals_v), p AS (SELECT a.file, a.lo, a.hi, b.lo AS lo_r, b.hi AS hi_r, row_number() OVER (PARTITION BY a.file, a.lo, a.hi ORDER BY b.hi - b.lo, b.lo, b.hi) AS rn
  FROM d a JOIN d b ON b.file = a.file AND b.lo <= a.lo AND b.hi >= a.hi AND b.hi - b.lo > a.hi - a.lo) SELECT file, lo, hi, lo_r, hi_r FROM p WHERE rn = 1""")
def nearest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "intervals_v").select("file", "lo", "hi").distinct()
    return intervals.nearest_enclosing(d, d.select("file", F.col("lo").alias("lo_r"), F.col("hi").alias("hi_r")), "file")


@query(f"""WITH {KEYED} SELECT ord, {NAME.format("rank")} AS severity, CASE WHEN rank <= 1 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'note' END AS level,
    dense_rank() OVER (ORDER BY f, category) - 1 AS rule_index, category AS rule_id, file AS uri, coalesce(line, 1) AS start_line
  FROM (SELECT *, min(ord) OVER (PARTITION BY category) AS f FROM keyed WHERE file <> '')""")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reports

    return reports.sarif_results(view(spark, sf_dir, "candidates_v"))


VOTE_SQL = f"WITH {KEYED} SELECT lower(category) AS category, file, {NAME.format('quantile_disc(rank, 0.5)')} AS severity, count(*) AS votes FROM keyed GROUP BY lower(category), file"


@query(VOTE_SQL)
def severity_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates_v").select(F.lower("category").alias("category"), "file", T.severity_rank(F.col("severity")).alias("rank"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)").cast("int")
    return rows.groupBy("category", "file").agg(T.severity_of_rank(median).alias("severity"), F.count("*").alias("votes"))


