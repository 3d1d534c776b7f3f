"""Scores of small answer keys, one situation each."""

from __future__ import annotations

import pytest

from auditlake.operators import scoring

CHECK = "b int, check_id string, expectation string, files array<string>, symbols array<string>, endpoint string, category string"
REPORT = "b int, report string, endpoint string, category string, text string, locations array<struct<file:string,line:int>>"


def check(name, expectation="finding", files=(), symbols=(), endpoint="", category=""):
    return (1, name, expectation, list(files), list(symbols), endpoint, category)


def report(name, endpoint="", category="", text="", at=()):
    return (1, name, endpoint, category, text, [x if isinstance(x, tuple) else (x, None) for x in at])


def outcomes(spark, checks, reports, definitions=None, endpoint_required=True):
    known = spark.createDataFrame([(1, *d) for d in definitions], "b int, file string, name string, lo int, hi int") if definitions else None
    rows = scoring.score(spark.createDataFrame(reports, REPORT), spark.createDataFrame(checks, CHECK), "b", known, endpoint_required)
    return {(r.id, r.outcome, r.report if r.outcome in ("found", "fp") else None) for r in rows.collect()}


SITUATIONS = {
    "a file of another class finds nothing": ([check("k", files=["a.py"], category="xss")], [report("r", category="sqli", at=["a.py"])], {("k", "missed", None), ("r", "extra", None)}),
    "a file of the class is found": ([check("k", files=["a.py"], category="xss")], [report("r", category="stored-xss", at=["./a.py"])], {("k", "found", "r")}),
    "an unknown class on the report's side finds nothing": ([check("k", files=["a.py"], category="xss")], [report("r", at=["a.py"])], {("k", "missed", None), ("r", "extra", None)}),
    "any of several files will do": ([check("k", files=["x.py", "lib/a.py"], category="xss")], [report("r", category="xss", at=["else/a.py"])], {("k", "found", "r")}),
    "a name that two files of the report have tells nothing": ([check("k", files=["a.py"], category="xss")], [report("r", category="xss", at=["x/a.py", "y/a.py"])], {("k", "missed", None), ("r", "extra", None)}),
    "symbols decide over the class": (
        [check("k", files=["a.py"], symbols=["Pay_Out"], category="xss")], [report("r1", category="xss", text="unlike pay_outs", at=["a.py"]), report("r2", category="xss", text="in pay_out()", at=["a.py"])], {("k", "found", "r2"), ("r1", "extra", None)},
    ),
    "symbols don't cross classes": ([check("k", files=["a.py"], symbols=["pay"], category="xss")], [report("r", category="sqli", text="pay", at=["a.py"])], {("k", "missed", None), ("r", "extra", None)}),
    "without a class a symbol is enough": ([check("k", files=["a.py"], symbols=["$q"])], [report("r", category="sqli", text="a $q here", at=["a.py"])], {("k", "found", "r")}),
    "the endpoint's text counts for symbols": ([check("k", files=["a.py"], symbols=["pay"])], [report("r", endpoint="pay handler", at=["a.py"])], {("k", "found", "r")}),
    "an endpoint is enough for a finding": ([check("k", endpoint="GET /a/<x>", category="xss")], [report("r", endpoint="GET /v1/a/3", category="sqli")], {("k", "found", "r")}),
    "a keyed endpoint isn't found by the file": ([check("k", files=["a.py"], endpoint="GET /a", category="xss")], [report("r", endpoint="GET /b", category="xss", at=["a.py"])], {("k", "missed", None), ("r", "extra", None)}),
    "but by file and symbol": ([check("k", files=["a.py"], symbols=["pay"], endpoint="GET /a", category="xss")], [report("r", category="xss", text="pay", at=["a.py"])], {("k", "found", "r")}),
    "a clean endpoint wants the class": (
        [check("c", "clean", endpoint="GET /a", category="xss")], [report("r1", endpoint="GET /a", category="sqli"), report("r2", endpoint="GET /a", category="xss")], {("c", "fp", "r2"), ("r1", "extra", None)},
    ),
    "a clean endpoint isn't claimed by file and symbol": ([check("c", "clean", files=["a.py"], symbols=["pay"], endpoint="GET /a", category="xss")], [report("r", category="xss", text="pay", at=["a.py"])], {("c", "quiet", None), ("r", "extra", None)}),
    "each report on a clean check counts": ([check("c", "clean", files=["a.py"], category="xss")], [report("r1", category="xss", at=["a.py"]), report("r2", category="xss", at=["a.py"])], {("c", "fp", "r1"), ("c", "fp", "r2")}),
    "a report counts on one clean check": ([check("c1", "clean", files=["a.py"], category="xss"), check("c2", "clean", files=["a.py"], category="xss")], [report("r", category="xss", at=["a.py"])], {("c1", "fp", "r"), ("c2", "quiet", None)}),
    "a second report of a found bug is no false positive": (
        [check("k", files=["a.py"], category="xss"), check("c", "clean", files=["a.py"], category="xss")], [report("r1", category="xss", at=["a.py"]), report("r2", category="xss", at=["a.py"])], {("k", "found", "r1"), ("c", "quiet", None), ("r2", "extra", None)},
    ),
    "one report satisfies one finding": ([check("k1", files=["a.py"], category="xss"), check("k2", files=["a.py"], category="xss")], [report("r", category="xss", at=["a.py"])], {("k1", "found", "r"), ("k2", "missed", None)}),
    "as many as possible are found": (
        [check("k1", endpoint="GET /a"), check("k2", files=["a.py"], category="xss")], [report("r1", endpoint="GET /a", category="xss", at=["a.py"]), report("r2", endpoint="GET /a")], {("k1", "found", "r2"), ("k2", "found", "r1")},
    ),
    "the exact file goes before the endpoint": (
        [check("k", files=["a.py"], endpoint="GET /a", category="xss")], [report("r1", endpoint="GET /a", category="xss"), report("r2", endpoint="GET /a", category="xss", at=["a.py"])], {("k", "found", "r2"), ("r1", "extra", None)},
    ),
    "a check without anchors matches nothing": ([check("k", category="xss")], [report("r", category="xss")], {("k", "missed", None), ("r", "extra", None)}),
    "no reports": ([check("k", files=["a.py"]), check("c", "clean")], [], {("k", "missed", None), ("c", "quiet", None)}),
}


@pytest.mark.parametrize("name", SITUATIONS)
def test_situations(spark, name):
    checks, reports, want = SITUATIONS[name]
    assert outcomes(spark, checks, reports) == want


def test_lines_inside_a_definition_stand_for_its_name(spark):
    checks, at = [check("k", files=["lib/a.py"], symbols=["Pay"], category="xss")], lambda line, file="lib/a.py": [report("r", category="xss", at=[(file, line)])]
    found, missed = {("k", "found", "r")}, {("k", "missed", None), ("r", "extra", None)}
    spans = [("lib/a.py", "pay", 10, 20), ("lib/b.py", "pay", 1, 5)]
    assert outcomes(spark, checks, at(20), spans) == found and outcomes(spark, checks, at(12, "moved/a.py"), spans) == found
    assert outcomes(spark, checks, at(21), spans) == missed and outcomes(spark, checks, at(3), spans) == missed and outcomes(spark, checks, at(12)) == missed


def test_files_stand_for_endpoints_where_these_arent_required(spark):
    checks = [check("k", files=["a.py"], endpoint="GET /a", category="xss"), check("c", "clean", files=["b.py"], symbols=["pay"], endpoint="GET /b", category="xss")]
    reports = [report("r1", category="xss", at=["a.py"]), report("r2", category="xss", text="pay", at=["b.py"]), report("r3", category="sqli", at=["a.py"])]
    assert outcomes(spark, checks, reports, endpoint_required=False) == {("k", "found", "r1"), ("c", "fp", "r2"), ("r3", "extra", None)}
    assert outcomes(spark, checks, reports) == {("k", "missed", None), ("c", "quiet", None), ("r1", "extra", None), ("r2", "extra", None), ("r3", "extra", None)}


def test_totals_and_degraded_runs(spark):
    checks = [check("k1", files=["a.py"], category="xss"), check("k2", files=["b.py"], endpoint="GET /b", category="xss"), check("k3", endpoint="GET /c"), check("c", "clean", files=["z.py"], category="xss")]
    reports = [report("r1", category="xss", at=["a.py"]), report("r2", category="xss", at=["b.py"]), report("r3", category="xss", at=["z.py"]), report("r4", category="xss", at=["z.py"])]
    t = scoring.totals(scoring.score(spark.createDataFrame(reports, REPORT), spark.createDataFrame(checks, CHECK), "b"), "b")
    r = t.first()
    assert (r.found, r.missed, r.false_positives, r.extra, r.file_found, r.file_missed) == (1, 2, 2, 1, 2, 0)
    assert (r.recall, r.precision, r.file_recall) == (0.3333, 0.3333, 1.0)
    states = spark.createDataFrame([(1, 2, "timeout"), (7, 1, "lost")], "b int, errors int, reason string")
    got = {x.b: (x.found, x.errors, x.recall, x.precision, x.reason) for x in scoring.without_degraded(t, states, "b").collect()}
    assert got == {1: (1, 2, None, None, "timeout"), 7: (None, 1, None, None, "lost")}
    assert scoring.without_degraded(t, states.filter("b = 9"), "b").first().recall == 0.3333


def test_assignment_of_many_takes_edges_alone(spark):
    """A thousand checks and reports in one group, each with two neighbours: the product of both sides would be a million cells."""
    n = 1000
    pairs = spark.range(n).selectExpr("1 AS g", "id AS row_id", "explode(array(id, (id + 1) % 1000)) AS col_id").selectExpr("g", "row_id", "col_id", "CASE WHEN row_id = col_id THEN 1 ELSE 2 END AS weight")
    rows = scoring.optimal_assignment(pairs, "g").collect()
    assert len(rows) == n and len({r.col_id for r in rows}) == n


def test_routes_meet_on_all_segments(spark):
    """Twenty thousand routes below one segment: if they met on that segment alone, there would be 400 million pairs."""
    routes = spark.range(20_000).selectExpr("id", "concat('get /en/', id) AS route")
    reports = routes.selectExpr("id AS report", "concat('get /api/en/', id) AS route")
    keys = routes.selectExpr("id AS check_id", "route").unionByName(spark.createDataFrame([(-1, "post /en/*"), (-2, "/en/*")], "check_id long, route string"))
    met = scoring.route_candidates(reports, keys, [])
    assert {(r.kind, r.n) for r in met.selectExpr("CASE WHEN check_id = report THEN 0 ELSE check_id END AS kind").groupBy("kind").count().withColumnRenamed("count", "n").collect()} == {(0, 20_000), (-2, 20_000)}


def test_routes_meet_as_all_pairs_do(spark):
    from itertools import product

    from auditlake.functions import text as T

    routes = [m + "/".join(("", *x)) for m in ("", "get ", "post ") for n in range(4) for x in product(("a", "b", "*"), repeat=n)]
    rows = spark.createDataFrame([(r,) for r in routes], "route string")
    r, c = rows.selectExpr("route AS report", "route"), rows.selectExpr("route AS check_id", "route")
    got = [tuple(x) for x in scoring.route_candidates(r, c, []).collect()]
    want = r.select("report").crossJoin(c.select("check_id")).filter(T.route_match(r["report"], c["check_id"])).collect()
    assert len(got) == len(set(got)) and set(got) == {tuple(x) for x in want}


def _mixed(spark):
    """Groups of 1 to 40 reports and checks with all kinds of anchors, and definitions."""
    reports = spark.range(400).selectExpr(
        "CAST(sqrt(id * 4) AS INT) AS b", "concat('r', id) AS report", "element_at(array('GET /a/<x>', 'POST /v1/b, GET /a/7', '`put /a`', '', NULL, '/c/d?x=1', ','), CAST(id % 7 + 1 AS INT)) AS endpoint",
        "element_at(array('xss', 'stored xss', '', NULL, 'sqli'), CAST(id % 5 + 1 AS INT)) AS category", "element_at(array('pay() is open', 'repay', ''), CAST(id % 3 + 1 AS INT)) AS text",
        "element_at(array(array(struct('src/a.py' AS file, 3 AS line)), array(struct('./src//a.py' AS file, 12 AS line), struct('y/a.py' AS file, 1 AS line)), array(struct('x/b.py' AS file, CAST(NULL AS INT) AS line), struct('src/a.py' AS file, 5 AS line)), array(), NULL), CAST(id % 11 % 5 + 1 AS INT)) AS locations",
    )
    checks = spark.range(400).selectExpr(
        "CAST(sqrt(id * 4) AS INT) AS b", "concat('k', id) AS check_id", "IF(id % 3 = 0, 'clean', 'finding') AS expectation", "element_at(array(array('src/a.py'), array('lib/b.py', 'src//a.py'), array(), NULL), CAST(id % 4 + 1 AS INT)) AS files",
        "element_at(array(array('Pay'), array('_x', '$q'), array(), NULL), CAST(id % 5 % 4 + 1 AS INT)) AS symbols", "element_at(array('GET /a/<id>', '/a', '', NULL, '/c/<k>'), CAST(id % 7 % 5 + 1 AS INT)) AS endpoint", "element_at(array('xss', '', NULL, 'XSS'), CAST(id % 13 % 4 + 1 AS INT)) AS category",
    )
    definitions = spark.range(40).selectExpr("CAST(id AS INT) AS b", "IF(id % 4 = 0, 'lib/b.py', 'src/a.py') AS file", "IF(id % 3 = 0, '_X', 'pay') AS name", "id % 5 AS lo", "id % 5 + 2 AS hi")
    return reports, checks, definitions


@pytest.mark.parametrize("endpoint_required", [True, False])
@pytest.mark.parametrize("known", [True, False])
def test_large_groups_give_the_rows_of_small_ones(spark, monkeypatch, known, endpoint_required):
    reports, checks, definitions = _mixed(spark)

    def pairs(most):
        monkeypatch.setattr(scoring, "SMALL", dict.fromkeys(scoring.SMALL, most))
        return sorted(tuple(x) for x in scoring.match_pairs(reports, checks, "b", definitions if known else None, endpoint_required).collect())

    small = pairs(1000)
    assert len(small) > 1000 and {x[-1] for x in small} == {0, 1, 2, 3, 4}
    assert pairs(0) == small and pairs(10) == small


def test_small_groups_are_dealt_out_once(spark):
    """Reports, checks and definitions go to their group; nothing that grows with routes, names or pairs is shuffled."""
    reports, checks, definitions = _mixed(spark)
    plan = scoring.match_pairs(reports, checks, "b", definitions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
