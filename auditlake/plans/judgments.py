"""Queries over votes, rounds, scores, arms, gates and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import backtest, contracts, rounds, scoring, verification
from ..sources.adapters import table, view, view_sql
from .catalogue import query

VOTES = view_sql("votes_v")
VERDICTS = f"""{VOTES}, v AS (SELECT candidate, count(*) AS n_votes, count(*) FILTER (failed) AS nf, count(*) FILTER (NOT failed AND NOT refuted) AS nr FROM votes_v GROUP BY candidate),
  fb AS (SELECT candidate, arg_min(label, vote * 1000000 + tie) AS label FROM votes_v GROUP BY candidate), c AS (SELECT v.candidate, count(*) AS nc, count(*) FILTER (v.failed) AS cf, count(*) FILTER (NOT v.failed AND NOT v.upheld) AS ca
    FROM votes_v v JOIN fb USING (candidate) WHERE v.label <> fb.label GROUP BY v.candidate),
  verdicts AS (SELECT candidate, CASE WHEN nf > 0 THEN 'incomplete' WHEN nr > 0 THEN 'kept' WHEN coalesce(nc, 0) = 0 THEN 'kept' WHEN coalesce(cf, 0) > 0 THEN 'incomplete' WHEN coalesce(ca, 0) > 0 THEN 'kept' ELSE 'dropped' END AS verdict,
    n_votes, nf + coalesce(cf, 0) AS n_errors FROM v LEFT JOIN c USING (candidate))"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = view(spark, sf_dir, "votes_v")
    found_by = votes.groupBy("candidate").agg(F.array(F.min_by("label", F.col("vote") * 1_000_000 + F.col("tie"))).alias("labels"))
    return verification.verdicts(votes, votes.select("candidate", "label", "upheld", "failed"), found_by)


@query(f"WITH {VERDICTS} SELECT candidate, verdict, n_votes, n_errors FROM verdicts")
def verification_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"""WITH {VERDICTS}, done AS (SELECT candidate, verdict FROM verdicts WHERE candidate % 3 <> 0 AND verdict <> 'incomplete')
  SELECT o_orderkey AS candidate, coalesce(done.verdict, 'open') AS state FROM orders LEFT JOIN done ON done.candidate = o_orderkey""")
def verification_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate"))
    open_, done = verification.resume(findings, _verdicts(spark, sf_dir).filter("candidate % 3 <> 0").select("candidate", "verdict"), "candidate")
    return open_.withColumn("state", F.lit("open")).unionByName(done.withColumnRenamed("verdict", "state"))


@query("""WITH r AS (SELECT conv_id AS unit, turn // 2 AS round, role, turn AS ord, text FROM conversations), w AS (SELECT unit, round, arg_min(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN ord END) AS f,
    arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN ord END) AS c, arg_min(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN ord END) AS j FROM r GROUP BY unit, round)
  SELECT unit, round, coalesce(j, c, f) AS text, CASE WHEN j IS NOT NULL THEN 'assistant' WHEN c IS NOT NULL THEN 'user' WHEN f IS NOT NULL THEN 'system' END AS role, j IS NULL AS fallback FROM w""")
def role_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id AS unit", "turn div 2 AS round", "role", "turn AS ord", "text")
    return rounds.role_fallback(rows, ["unit", "round"], ["system", "user", "assistant"])


@query("""WITH r AS (SELECT conv_id AS unit, substr(sha256(text), 1, 8) AS key, length(text) % 50 AS title, role AS label FROM conversations), j AS (SELECT DISTINCT unit, key, title FROM r WHERE label = 'assistant'),
  m AS (SELECT j.unit, j.key, j.title, r.label FROM j JOIN r ON r.unit = j.unit AND (r.key = j.key OR r.title = j.title) WHERE r.label <> 'assistant')
  SELECT j.unit, j.key, j.title, coalesce((SELECT string_agg(DISTINCT m.label, ',' ORDER BY m.label) FROM m WHERE m.unit = j.unit AND m.key = j.key), '') AS found_by FROM j""")
def role_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), F.substring(F.sha2("text", 256), 1, 8).alias("key"), (F.length("text") % 50).cast("bigint").alias("title"), F.col("role").alias("label"))
    judged = r.filter("label = 'assistant'").select("unit", "key", "title").distinct()
    return verification.attribute_roles(judged, r.filter("label <> 'assistant'")).select("unit", "key", "title", F.array_join("found_by", ",").alias("found_by"))


_ROUNDS = "user_id % 10 AS unit, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (event_type = 'signup' AND value > 60) AS new_findings, count(*) FILTER (event_type = 'error' AND value > 60) = 0 AS clean, count(*) FILTER (event_type = 'view' AND value > 98) > 0 AS pending"


@query(f"""WITH r AS (SELECT {_ROUNDS} FROM events GROUP BY 1, 2) SELECT unit, CAST(day AS VARCHAR) AS day, new_findings, coalesce(min(CASE WHEN new_findings = 0 AND clean AND NOT pending THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = 2, FALSE) AS converged
  FROM r WINDOW w AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def convergence_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("unit"), F.to_date("ts").alias("day"))
    r = e.agg(
        F.count_if((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("new_findings"), (F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)) == 0).alias("clean"),
        (F.count_if((F.col("event_type") == "view") & (F.col("value") > 98)) > 0).alias("pending"),
    )
    return rounds.converged(r, ["unit"], "day", 2).select("unit", F.col("day").cast("string").alias("day"), "new_findings", "converged")


USAGE = view_sql("usage_v")


@query(f"""WITH {USAGE}, c AS (SELECT unit, pass, ts, sum(used) OVER (PARTITION BY unit ORDER BY ts, pass) AS total FROM usage_v) SELECT unit, pass, CAST(total AS BIGINT) AS total, CAST(total - lag(total, 1, 0) OVER (PARTITION BY unit ORDER BY ts, pass) AS BIGINT) AS delta FROM c""")
def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    u = view(spark, sf_dir, "usage_v").withColumn("total", F.sum("used").over(Window.partitionBy("unit").orderBy("ts", "pass")))
    return rounds.usage_delta(u, "unit", ["ts", "pass"], "total").select("unit", "pass", "total", "delta")


@query(f"WITH {USAGE} SELECT stage, CAST(sum(CAST(round_even(seconds * 10, 0) AS BIGINT)) AS BIGINT) / 10 AS seconds, count(*) AS n FROM usage_v GROUP BY stage")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.stage_seconds(view(spark, sf_dir, "usage_v"), ["stage"])


@query(f"WITH {USAGE} SELECT unit, CAST(sum(CAST(round_even(seconds * 10, 0) AS BIGINT)) AS BIGINT) / 10 AS seconds, count(*) AS n FROM usage_v GROUP BY unit")
def unit_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.stage_seconds(view(spark, sf_dir, "usage_v"), ["unit"])


_CHECKS = "SELECT l.doc_id AS check_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'finding' ELSE 'clean' END AS expectation, {0} AS hit FROM labels l JOIN documents d ON d.doc_id = l.doc_id"
_RESULT = """SELECT lang, found, missed, false_positives, n_findings, CASE WHEN n_findings > 0 THEN round_even(found / n_findings, 4) ELSE 0.0 END AS recall, CASE WHEN found + false_positives > 0 THEN round_even(found / (found + false_positives), 4) ELSE 1.0 END AS precision
  FROM (SELECT lang, count(*) FILTER (expectation = 'finding' AND hit) AS found, count(*) FILTER (expectation = 'finding' AND NOT hit) AS missed, count(*) FILTER (expectation <> 'finding' AND hit) AS false_positives, count(*) FILTER (expectation = 'finding') AS n_findings FROM ({0}) GROUP BY lang)"""


def _checks(spark: SparkSession, sf_dir: str, hit: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return rows.select(F.col("doc_id").alias("check_id"), "lang", "source", F.when(F.col("quality") == 1, "finding").otherwise("clean").alias("expectation"), F.expr(hit).alias("hit"))


@query(_RESULT.format(_CHECKS.format("l.doc_id % 3 <> 0")))
def score_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.result(_checks(spark, sf_dir, "doc_id % 3 <> 0"), ["lang"])


@query("""SELECT l_suppkey AS report, min(l_partkey) AS check_id FROM lineitem GROUP BY l_suppkey""")
def clean_check_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.claims(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("report"), F.col("l_partkey").alias("check_id")))


_PAIRS = "l_suppkey AS benchmark, l_orderkey % 6 AS row_id, l_partkey % 5 AS col_id, (l_orderkey + l_partkey) % 5 AS weight"


@query()
def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.optimal_assignment(table(spark, sf_dir, "lineitem").selectExpr(*_PAIRS.split(", ")), "benchmark")


_RUNS = "SELECT l.doc_id AS check_id, r.run, (l.doc_id * (r.run + {0})) % 5 < 3 AS hit FROM labels l, (SELECT unnest(range(0, 3)) AS run) r"
_REPEATED = "SELECT check_id, freq, freq * 2 > 3 AS majority, freq > 0 AND freq < 3 AS flaky, round_even(freq / 3, 3) AS catch_rate FROM (SELECT check_id, count(*) FILTER (hit) AS freq FROM ({0}) GROUP BY check_id)"


def _repeated(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    hits = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("check_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return scoring.repeated(hits.withColumn("hit", (F.col("check_id") * (F.col("run") + shift)) % 5 < 3), ["check_id"], 3)


@query(_REPEATED.format(_RUNS.format(1)))
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, 1)


_FLIPS = f"""a AS (SELECT check_id, majority AS hit, catch_rate FROM ({_REPEATED.format(_RUNS.format(1))}) WHERE check_id % 7 <> 0), b AS (SELECT check_id, majority AS hit, catch_rate FROM ({_REPEATED.format(_RUNS.format(4))}) WHERE check_id % 11 <> 0),
  flips AS (SELECT check_id, CASE WHEN NOT coalesce(a.hit, FALSE) AND coalesce(b.hit, FALSE) THEN 'newly_found' WHEN coalesce(a.hit, FALSE) AND NOT coalesce(b.hit, FALSE) THEN 'newly_missed' WHEN coalesce(a.hit, FALSE) THEN 'still_found' ELSE 'still_missed' END AS flip,
    round_even(coalesce(b.catch_rate, 0) - coalesce(a.catch_rate, 0), 3) AS rate_move FROM a FULL JOIN b USING (check_id))"""


def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = lambda shift: _repeated(spark, sf_dir, shift).select("check_id", F.col("majority").alias("hit"), "catch_rate")
    return backtest.compare(arm(1).filter("check_id % 7 <> 0"), arm(4).filter("check_id % 11 <> 0"), "check_id")


@query(f"WITH {_FLIPS} SELECT * FROM flips")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flips(spark, sf_dir)


@query(f"WITH {_FLIPS}, x AS (SELECT f.check_id, f.flip, unnest(CASE WHEN d.doc_id % 4 = 0 THEN ['unattributed'] ELSE [d.lang, d.source] END) AS label FROM flips f JOIN documents d ON d.doc_id = f.check_id) SELECT label, flip, count(*) AS n FROM x GROUP BY label, flip")
def compare_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = table(spark, sf_dir, "documents").filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("check_id"), F.array("lang", "source").alias("labels"))
    return backtest.by_axis(_flips(spark, sf_dir), axes, "check_id")


@query("""SELECT arm, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(requests) AS BIGINT) AS requests, arg_max(incomplete, event_id) AS incomplete, count(*) AS records, sum(errors) = 0 AND arg_max(incomplete, event_id) = 0 AS comparable
  FROM (SELECT user_id AS arm, event_id, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS errors, event_id % 90 AS requests, event_id % 2 AS incomplete FROM events) GROUP BY arm""")
def arm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id AS arm", "event_id", "CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS errors", "event_id % 90 AS requests", "event_id % 2 AS incomplete")
    totals = backtest.arm_totals(e, "arm", ["errors", "requests"], ["incomplete"], F.col("event_id"))
    return totals.join(backtest.comparable(totals, "arm", ["errors", "incomplete"]).select("arm", "comparable"), "arm")


@query("""WITH f AS (SELECT d.source AS ref, CASE WHEN l.quality = 1 THEN 'finding' ELSE 'clean' END AS expectation, CASE WHEN d.doc_id % 2 = 0 THEN 'diff' ELSE 'repository' END AS path FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  dims AS (SELECT DISTINCT source AS ref FROM documents UNION ALL SELECT 'unused'), a AS (SELECT ref, count(*) FILTER (expectation = 'finding') AS positive, count(*) FILTER (expectation = 'clean') AS clean, count(*) FILTER (path = 'diff') AS diff, count(*) FILTER (path = 'repository') AS repository FROM f GROUP BY ref)
  SELECT ref, coalesce(positive, 0) AS positive, coalesce(clean, 0) AS clean, coalesce(diff, 0) AS diff, coalesce(repository, 0) AS repository, CASE WHEN coalesce(positive, 0) = 0 THEN 'no positive evidence' WHEN coalesce(clean, 0) = 0 THEN 'no clean evidence' END AS problem FROM dims LEFT JOIN a USING (ref)""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ref"))
    facts = table(spark, sf_dir, "labels").join(documents, "doc_id").select("ref", F.when(F.col("quality") == 1, "finding").otherwise("clean").alias("expectation"), F.when(F.col("doc_id") % 2 == 0, "diff").otherwise("repository").alias("path"))
    dims = documents.select("ref").distinct().unionByName(spark.createDataFrame([("unused",)], "ref string"))
    return backtest.coverage(facts, dims, "ref")


_GATES = {"newly_missed": "flip = 'newly_missed'", "newly_false_positive": "flip = 'newly_found' AND check_id % 5 = 0", "large_moves": "abs(rate_move) > 0.9", "impossible": "abs(rate_move) > 1"}


@query(f"WITH {_FLIPS} " + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) = 0 AS passed, count(*) AS failures, min(check_id) AS first_failure FROM flips WHERE {v}" for k, v in _GATES.items()))
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flips = _flips(spark, sf_dir)
    return backtest.gate({k: flips.filter(v) for k, v in _GATES.items()}, "check_id")


_COMPLETE = {
    "surface": ("documents", "text = ''", "doc_id"), "open units": ("conversations", "role = 'assistant' AND length(text) < 10", "conv_id"), "ungraded": ("labels", "quality IS NULL", "doc_id"), "errors": ("events", "event_type = 'error' AND value > 95", "event_id"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) = 0 AS passed, count(*) AS failures, min({d}) AS first_failure FROM {t} WHERE {w}" for k, (t, w, d) in _COMPLETE.items()))
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.gate({k: table(spark, sf_dir, t).filter(w).select(F.col(d).alias("detail")) for k, (t, w, d) in _COMPLETE.items()})


@query("""SELECT 'duplicate line' AS violation, concat(l_orderkey, '/', l_linenumber) AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'unknown order', CAST(k AS VARCHAR) FROM (SELECT DISTINCT l_orderkey * 2 AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'out of sequence', CAST(conv_id AS VARCHAR) FROM (SELECT DISTINCT conv_id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE (conv_id + turn) % 9 <> 0) WHERE k <> turn)""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return contracts.violations(
        contracts.duplicates(lines, ["l_orderkey", "l_linenumber"], "duplicate line"),
        contracts.orphans(lines.select((F.col("l_orderkey") * 2).alias("k")), "k", orders, "o_orderkey", "unknown order"),
        contracts.out_of_sequence(table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 9 <> 0"), "conv_id", "turn", "out of sequence"),
    )
