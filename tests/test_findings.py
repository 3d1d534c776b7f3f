from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditlake.operators import findings, intervals, packing, reports

SCHEMA = "ord bigint, title string, category string, endpoint string, symbol string, file string, line int, severity string, evidence string, status string, label string"


def rows(spark, *items):
    base = {"title": "", "category": "", "endpoint": "", "symbol": "", "file": "", "line": None, "severity": "", "evidence": "", "status": "blocked", "label": "m"}
    return spark.createDataFrame([tuple((base | {"ord": i} | x)[k.split()[0]] for k in SCHEMA.split(", ")) for i, x in enumerate(items)], SCHEMA)


def keys(spark, by_file, *items):
    return rows(spark, *items).select(findings.candidate_key(by_file).alias("k")).distinct().count()


def test_keys(spark):
    assert keys(spark, False, {"endpoint": "GET /withdrawals/<wid>"}, {"endpoint": "get /withdrawals/{id}"}) == 1
    assert keys(spark, False, {"file": "app/log.py", "category": "data-exposure"}, {"file": "app/log.py", "category": "data-exposure"}, {"file": "app/log.py", "category": "idor"}) == 2
    assert keys(spark, True, {"file": "V", "category": "r", "endpoint": "_cleanupLoan"}, {"file": "V", "category": "r", "endpoint": "transform"}) == 2
    assert keys(spark, True, {"file": "T", "category": "a", "line": 120}, {"file": "T", "category": "a", "line": 88}) == 2
    assert keys(spark, True, {"file": "T", "category": "a", "line": 88}, {"file": "T", "category": "a", "line": 88}) == 1
    assert keys(spark, True, {"file": "V", "symbol": "liquidate", "line": 10}, {"file": "V", "symbol": "Vault.liquidate", "line": 20}) == 1
    assert keys(spark, False, {"file": "db.js", "symbol": "index"}, {"file": "collection.js", "symbol": "index"}) == 2
    assert keys(spark, True, {"file": "Vault.sol", "endpoint": "execute"}, {"file": "Router.sol", "endpoint": "execute"}) == 2


def test_fold(spark):
    r = rows(
        spark,
        {"symbol": "f", "evidence": "no guard at f:10", "severity": "low", "label": "b"},
        {"symbol": "f", "evidence": "also reverts at f:20", "severity": "high", "status": "confirmed", "label": "a"},
        {"symbol": "f", "evidence": "guard", "severity": "medium", "label": "a"},
    )
    u = findings.union_findings(r, findings.candidate_key()).collect()
    assert len(u) == 1
    assert (u[0].status, u[0].found_by, u[0].severity, u[0].n_rows, u[0].consensus) == ("confirmed", ["a", "b"], "MEDIUM", 3, 2)
    assert u[0].evidence == "no guard at f:10; also reverts at f:20"


def test_medians_take_the_graver_middle(spark):
    for votes, want in ((["LOW", "HIGH", "MEDIUM"], "MEDIUM"), (["CRITICAL", "CRITICAL", "MEDIUM"], "CRITICAL"), (["MEDIUM", "HIGH"], "HIGH"), (["LOW", "MEDIUM"], "MEDIUM")):
        u = findings.union_findings(rows(spark, *({"symbol": "f", "severity": v} for v in votes)), findings.candidate_key())
        assert u.first().severity == want


def test_collapse(spark):
    place = {"file": "a.py", "line": 58}
    r = rows(spark, {**place, "category": "replay", "endpoint": "a"}, {**place, "category": "Replay", "endpoint": "b"}, {"file": "a.py", "category": "replay"}, {"file": "a.py", "category": "replay"})
    assert [x.ord for x in findings.collapse_colocated(r).orderBy("ord").collect()] == [0, 2, 3]


def test_new_identities(spark):
    first = rows(spark, {"symbol": "a"}, {"symbol": "b"})
    pool = first.select(findings.candidate_key().alias("key"))
    assert findings.new_identities(pool, rows(spark, {"symbol": "b"}, {"symbol": "c"}), findings.candidate_key()).count() == 1
    assert findings.new_identities(pool, first, findings.candidate_key()).count() == 0


def test_breakdown_and_reports(spark):
    r = rows(spark, {"file": "app/payment.py", "line": 42, "severity": "CRITICAL", "category": "x"}, {"file": "app/views.py", "line": 10, "severity": "MEDIUM", "category": "y"}, {"file": "", "severity": "LOW", "category": "z"})
    b = findings.severity_breakdown(r.filter("file <> ''").withColumn("g", F.lit(1)), ["g"], F.col("severity")).first()
    assert (b.n_critical, b.n_high, b.n_medium, b.n_low) == (1, 0, 1, 0)
    assert [x.ord for x in r.orderBy(*reports.report_order()).collect()][0] == 0
    s = reports.sarif_results(r).orderBy("ord").collect()
    assert [(x.level, x.rule_index, x.start_line) for x in s] == [("error", 0, 42), ("warning", 1, 10)]
    named = reports.unique_names(r.withColumn("base", F.lit("n")), F.col("base"), [F.col("ord")])
    assert [x.name for x in named.orderBy("ord").collect()] == ["n", "n-2", "n-3"]


def free_names(bases):
    """Brute force: the least free number for each base in turn."""
    used, out = set(), []
    for b in bases:
        name, k = b, 2
        while name in used:
            name, k = f"{b}-{k}", k + 1
        used.add(name)
        out.append(name)
    return out


def test_names_are_free_where_bases_look_like_them(spark):
    rng = random.Random(4)
    for bases in (["a", "a", "a-2"], ["a-2", "a", "a", "a"], ["a", "a-2", "a-2", "a", "a-2-2", "b"], [rng.choice(["x", "x-2", "x-3", "x-2-2", "y", "z-9"]) for _ in range(60)]):
        rows = spark.createDataFrame(list(enumerate(bases)), "ord bigint, base string")
        got = [x.name for x in reports.unique_names(rows, F.col("base"), [F.col("ord")]).orderBy("ord").collect()]
        assert got == free_names(bases) and len(set(got)) == len(got)


def test_intervals(spark):
    d = spark.createDataFrame([("f", 0, 100), ("f", 20, 60), ("f", 101, 110), ("g", 5, 5)], "file string, lo int, hi int")
    assert sorted(map(tuple, intervals.merge(d, ["file"]).collect())) == [("f", 0, 110), ("g", 5, 5)]
    assert {x.file: x.covered for x in intervals.union_length(d, ["file"]).collect()} == {"f": 109}
    assert intervals.outermost(d.withColumn("ord", F.lit(1)), "file", "ord").count() == 3
    inner = intervals.nearest_enclosing(d, d.selectExpr("file", "lo AS lo_r", "hi AS hi_r"), "file").collect()
    assert [tuple(x) for x in inner] == [("f", 20, 60, 0, 100)]
    p = spark.createDataFrame([("f", 1), ("f", 200), ("g", None)], "file string, line int")
    assert [x.line for x in intervals.members(p, d, "file", "line").collect()] == [1]
    assert intervals.members(p, d, "file", "line", inside=False).count() == 2


def test_overlap_reports_a_pair_once(spark):
    a = spark.createDataFrame([("f", 0, 1000)], "file string, lo int, hi int")
    assert intervals.overlap(a, a.selectExpr("file", "lo AS lo_r", "hi AS hi_r"), "file").count() == 1


def test_greedy(spark):
    def units(sizes, cap, most=None, joint=0):
        d = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int")
        return [x.unit for x in packing.greedy(d, "g", ["i"], "s", cap, most, joint).orderBy("i").collect()]

    assert units([3, 4], 7) == [0, 0] and units([3, 4], 3) == [0, 1]
    assert units([3, 9, 2], 5) == [0, 1, 2]
    assert units([1] * 9, 100, most=4) == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert units([3, 3], 7, joint=2) == [0, 1]
    assert packing.equal_budget(100, 10, 3) == 26 and packing.equal_budget(5, 10, 3) == 0


def test_ranks_do_not_depend_on_the_stretch(spark, monkeypatch):
    union = spark.createDataFrame([(o, o % 3 + 1, ["LOW", "HIGH"][o % 2]) for o in (9, 4, 30, 0, 17, 5, 1 << 40, 22)], "ord bigint, consensus int, severity string")
    want = [r.ord for r in sorted(union.collect(), key=lambda r: (-r.consensus, r.severity == "LOW", r.ord))]
    for stretch in (1, 5, findings.STRETCH):
        monkeypatch.setattr(findings, "STRETCH", stretch)
        assert [r.ord for r in findings.rank_findings(union).orderBy("position").collect()] == want


def test_nested_changes_across_bins(spark):
    spans = [(1, 500), (60, 70), (63, 200), (128, 130), (300, 310), (400, 480), (410, 470)]
    lines = [64, 65, 129, 305, 450, 415]
    d = spark.createDataFrame([("f", lo, hi) for lo, hi in spans], "file string, lo int, hi int")
    changed = spark.createDataFrame([("f", x) for x in lines], "file string, line int")
    inside = lambda x, lo, hi: any(lo <= a and b <= hi and b - a < hi - lo and a <= x <= b for a, b in spans)
    want = {(lo, hi) for lo, hi in spans if any(lo <= x <= hi and not inside(x, lo, hi) for x in lines)}
    assert {(r.lo, r.hi) for r in intervals.not_only_nested(d, d, changed, "file").collect()} == want
