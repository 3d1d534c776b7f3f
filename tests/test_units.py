from __future__ import annotations

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators import context, diffs, facts, findings, graph, grounding, review, scoring, sinks, units
from tests.conftest import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_union_size_and_plans():
    assert units.union_size({("v", 0, 100), ("v", 20, 60), ("o", 0, 80)}) == 180
    assert units.pack_plans([{("v", 0, 100)}, {("v", 20, 60)}, {("o", 0, 80)}], 180) == [[0, 1, 2]]
    assert units.pack_plans([{("v", 0, 100)}, {("o", 0, 200)}, {("o", 0, 5)}], 150) == [[0], [1], [2]]


def test_evidence_passes_over_what_does_not_fit():
    edges = [(1, 1, ("b", 0, 10)), (1, 0, ("c", 0, 90)), (2, 0, ("d", 0, 15))]
    assert units.choose_evidence([("a", 0, 10)], edges, 40) == [("a", 0, 10), ("b", 0, 10), ("d", 0, 15)]


def test_dominance(spark):
    d = spark.createDataFrame([("g", 1, [1, 2]), ("g", 2, [1, 2, 3]), ("g", 3, [1, 2, 3]), ("g", 4, [9]), ("h", 5, [1])], "g string, k int, items array<int>")
    assert sorted(r.k for r in units.undominated(d, "g", "k", "items").collect()) == [2, 4, 5]
    assert [r.k for r in units.not_covered(d, d.filter("k = 2"), "k", "items").collect()] == [4]


def test_neighbours_in_budget(spark):
    d = spark.createDataFrame([("g", i, s) for i, s in enumerate([50, 10, 200, 5])], "g string, i int, s int")
    assert [r.taken for r in units.within_budget(d, "g", ["i"], "s", 40).orderBy("i").collect()] == [True, False, False, False]
    assert [r.taken for r in units.within_budget(d, "g", ["i"], "s", 65).orderBy("i").collect()] == [True, True, False, True]


def test_owner_trees(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "node string, owner string")
    got = {(r.node, r.ancestor): r.steps for r in units.ancestors(t).collect()}
    assert got[("e", "a")] == 4 and got[("c", "a")] == 2 and len(got) == 10
    with pytest.raises(ValueError):
        units.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, owner string"))
    with pytest.raises(ValueError):
        units.ancestors(spark.createDataFrame([("a", "x")], "node string, owner string"))


def test_rounds_until_converged(spark):
    seen = [["a", "b"], ["b", "c"], ["c"], ["a"], ["z"]]
    judge = lambda n: spark.createDataFrame([(x,) for x in seen[n]], "k string")
    pool, new, done = units.run_until_converged(judge, F.col("k"), 2, 5)
    assert (pool.count(), new, done) == (3, [2, 1, 0, 0], True)
    assert units.run_until_converged(judge, F.col("k"), 2, 2)[2] is False


def test_receipts_and_reasons(spark):
    d = spark.createDataFrame([("u", "a", "required"), ("u", "b", "required"), ("u", "a", "included"), ("u", "c", "omitted"), ("v", "a", "included")], "unit string, identity string, state string")
    got = {r.unit: (r.missing, r.complete) for r in units.receipts(d, "unit").collect()}
    assert got == {"u": (["b", "c"], False), "v": ([], True)}
    r = spark.createDataFrame([("u", x) for x in "edcba"], "unit string, reason string")
    assert units.reason_summary(r, "unit", "reason").first().summary == "a; b; c; +2 more"


def test_worklist(spark):
    s = "slug string, status string"
    old, wanted = spark.createDataFrame([("a", "reviewed"), ("gone", "open")], s), spark.createDataFrame([("a", ""), ("n", "")], s)
    merged = units.merge_worklist(old, wanted)
    assert {r.slug: r.status for r in merged.collect()} == {"a": "reviewed", "n": "open"}
    assert {r.slug: r.status for r in units.mark_reviewed(merged, spark.createDataFrame([("n", "")], s)).collect()} == {"a": "reviewed", "n": "reviewed"}


def test_texts(spark):
    assert value(spark, context.numbered_lines(F.lit("a\nb"), 9)) == " 9 | a\n10 | b"
    assert value(spark, context.preview(F.lit("\nfn x(\n  a\n) {\n body"))) == "fn x( a )"
    assert value(spark, context.characters_before(F.lit("é\r\nb"), F.lit(4))) == 2
    t = spark.createDataFrame([(1, "| a | b |\n|---|:-:|\n| 1 | 2 |\ntext")], "id int, t string")
    assert [r.cells for r in context.table_rows(t, "id", "t").orderBy("pos").collect()] == [["a", "b"], ["1", "2"]]
    assert value(spark, sinks.markdown_row(F.lit("a|b"), F.lit(1))) == "| a\\|b | 1 |"


def test_malformed_item_fails_the_reply(spark):
    d = spark.createDataFrame([(1, '{"findings": [{"file": "f", "severity": "LOW"}, {"file": ""}]}'), (2, "x"), (3, '{"findings": []}'), (4, '{"findings": [{"file": "f", "line": "x", "severity": "LOW"}]}')], "id int, t string")
    got = {r.id: (r.ok, r.file, r.line) for r in context.reply_rows(d, "id", "t").collect()}
    assert got == {1: (False, None, None), 2: (False, None, None), 3: (True, None, None), 4: (True, "f", None)}


def test_scores(spark):
    reports = spark.createDataFrame([("b", "r1", "", "GET /x/9", ""), ("b", "r2", "", "GET /safe/9", ""), ("b", "r3", "", "GET /unknown/thing", "")], "b string, report string, file string, endpoint string, category string")
    checks = spark.createDataFrame([("b", "hit", "finding", "", "GET /x/<id>", ""), ("b", "miss", "finding", "", "POST /t", ""), ("b", "lookalike", "clean", "", "GET /safe/<id>", "")], "b string, check_id string, expectation string, file string, endpoint string, category string")
    got = {r.id: r.outcome for r in scoring.score(reports, checks, "b").collect()}
    assert got == {"hit": "found", "miss": "missed", "lookalike": "fp", "r3": "extra"}
    twice = spark.createDataFrame([("b", "r1", "", "GET /x/9", ""), ("b", "r4", "", "GET /x/8", "")], reports.schema)
    got = scoring.score(twice, checks, "b").collect()
    assert sorted(r.outcome for r in got) == ["extra", "found", "missed", "quiet"]


def test_dependency_pipeline(spark):
    d = spark.createDataFrame([("b.py", "load"), ("c.py", "load"), ("c.py", "save")], "target string, name string")
    c = spark.createDataFrame([("a.py", "load"), ("a.py", "save"), ("a.py", "gone")], "source string, name string")
    i = spark.createDataFrame([("pkg/a.py", "./b"), ("pkg/a.py", "../c.py"), ("pkg/a.py", "nope")], "source string, spec string")
    files = spark.createDataFrame([("pkg/b.py",), ("c.py",)], "path string")
    edges, gaps = facts.dependency_edges(d, c, i, files)
    assert {(r.source, r.target, r.kind, r.resolution) for r in edges.collect()} == {
        ("a.py", "b.py", "call", "ambiguous"), ("a.py", "c.py", "call", "ambiguous"), ("a.py", "c.py", "call", "exact"), ("pkg/a.py", "pkg/b.py", "import", "exact"), ("pkg/a.py", "c.py", "import", "exact"),
    }
    assert {(r.kind, r.reference) for r in gaps.collect()} == {("call", "gone"), ("import", "nope")}


def test_focused_units(spark):
    f = spark.createDataFrame([("f", "a", 10, True), ("f", "b", 10, False), ("f", "c", 100, False), ("f", "d", 10, True)], "file string, name string, size int, risky boolean")
    calls = spark.createDataFrame([("f", "a", "b"), ("f", "c", "a"), ("f", "a", "d")], "file string, caller string, callee string")
    got = {r.unit: r.members for r in facts.focused_units(f, calls, F.col("risky"), 40).collect()}
    assert got == {"a": ["a", "b", "d"]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "x", "b.py", 3, "LOW"), (1, "y", "a.py", None, "CRITICAL")], "ord bigint, category string, file string, line int, severity string")
    sinks.write_text(rows, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["[CRITICAL] a.py y", "[LOW] b.py:3 x"]
    whole = lambda name: json.loads("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
    sinks.write_json(rows, str(tmp_path / "j"), {"name": "x"})
    report = whole("j")
    assert [f["file"] for f in report["findings"]] == ["a.py", "b.py"] and report["findings"][0]["line"] is None
    assert report["summary"] == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 1} and report["target"] == {"name": "x"}
    rows = rows.unionByName(spark.createDataFrame([(2, "", "c.py", 7, "HIGH"), (3, "x", "d.py", 0, "low"), (4, "z", "", 1, "LOW")], rows.schema))
    sinks.write_sarif(rows, str(tmp_path / "s"), "tool")
    log = whole("s")
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["y", "security", "x"]
    assert [(r["ruleId"], r["ruleIndex"], r["level"], r["message"]["text"]) for r in run["results"]] == [("y", 0, "error", "y"), ("security", 1, "error", "security finding"), ("x", 2, "note", "x"), ("x", 2, "note", "x")]
    places = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    assert [p.get("region") for p in places] == [None, {"startLine": 7}, {"startLine": 3}, None] and places[0]["artifactLocation"] == {"uri": "a.py"}
    sinks.write_json(rows.filter("false"), str(tmp_path / "j0"))
    assert whole("j0") == {"findings": [], "summary": {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 0}}
    sinks.write_sarif(rows.filter("false"), str(tmp_path / "s0"))
    assert whole("s0")["runs"][0]["results"] == []
    sinks.write_markdown(rows, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert "1 critical, 1 high, 0 medium, 3 low." in text and text.index("### CRITICAL y `a.py`") < text.index("### HIGH `c.py:7`") < text.index("### LOW z ``" if "### LOW z ``" in text else "### LOW")
    rows = rows.filter("ord < 2")
    sinks.append_log(rows, str(tmp_path / "l"))
    sinks.append_log(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4


def test_checkpoints_are_whole(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "unit string, n int"
    assert sinks.read_checkpoint(spark, path, schema) is None
    first = spark.createDataFrame([("a", 1)], schema)
    sinks.write_checkpoint(first, path)
    reader = sinks.read_checkpoint(spark, path, schema)
    fails = F.udf(lambda n: 1 // (n - 2), "int")
    with pytest.raises(Exception, match="division"):
        sinks.write_checkpoint(spark.createDataFrame([("b", 2)], schema).withColumn("n", fails("n")), path)
    assert [tuple(r) for r in sinks.read_checkpoint(spark, path, schema).collect()] == [("a", 1)]  # a failed write leaves the old state
    sinks.write_checkpoint(spark.createDataFrame([("c", 3)], schema), path)
    assert [tuple(r) for r in reader.collect()] == [("a", 1)]  # a reader that has begun sees its own
    assert [tuple(r) for r in sinks.read_checkpoint(spark, path, schema).collect()] == [("c", 3)]
    for k in range(4, 7):
        sinks.write_checkpoint(spark.createDataFrame([("d", k)], schema), path)
    assert len(list((tmp_path / "state").glob("version=*"))) == 2 and sinks.read_checkpoint(spark, path, schema).first().n == 6


def test_missing_sizes_count_as_none(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, None), ("g", 3, 5), ("g", 4, 1)], "g string, o int, size int")
    assert [r.taken for r in units.within_budget(rows, "g", ["o"], "size", 6).orderBy("o").collect()] == [True, True, False, True]
    assert [r.share for r in grounding.shares(rows, "g", ["o"], "size", 8).orderBy("o").collect()] == [2, 0, 3, 1]


def test_facts_cache(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "path string, text string")
    key = sinks.fingerprint(files, "web")
    assert key != sinks.fingerprint(files, "evm") and key == sinks.fingerprint(files.orderBy(F.desc("path")), "web")
    cache = sinks.FactsCache(spark, str(tmp_path), ("edges",))
    assert cache.get(key) is None
    cache.put(key, {"edges": files})
    assert cache.get(key)["edges"].count() == 2


def test_finding_identity(spark):
    s = "file string, line int, category string, description string, change_anchor struct<file:string,line:int,side:string>"
    d = spark.createDataFrame([("f", 1, "c", "d", None), ("f", 1, "c", "d", ("f", 1, "new")), ("f", 1, "c", "d", ("f", 1, "old"))], s)
    assert d.select(findings.finding_key().alias("k")).distinct().count() == 2


def test_unfiltered_queries_work_on_all_rows(spark):
    from itertools import permutations

    from auditlake.plans import judgments
    from auditlake.plans import units as plans
    from auditlake.sources.adapters import view

    rows = view(spark, DATA, "intervals_v")
    assert {r.plan for r in plans.packed_plans(spark, DATA).collect()} == {r.o for r in rows.select("o").distinct().collect()}
    assert {r.unit for r in plans.chosen_evidence(spark, DATA).collect()} == {r.o for r in rows.select("o").distinct().collect()}
    best: dict[int, dict] = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_suppkey AS s", "l_orderkey % 6 AS i", "l_partkey % 5 AS j", "(l_orderkey + l_partkey) % 5 AS w").collect():
        best.setdefault(r.s, {})[r.i, r.j] = max(r.w, best.get(r.s, {}).get((r.i, r.j), 0))
    want = {s: max(sum(w.get((i, j), 0) for j, i in enumerate(p)) for p in permutations(range(6), 5)) for s, w in best.items()}
    got = dict.fromkeys(want, 0)
    for r in judgments.optimal_assignment(spark, DATA).collect():
        got[r.benchmark] += r.weight
    assert got == want


def covered_places(ranges):
    return {(f, k) for f, lo, hi in ranges for k in range(lo, hi)}


def test_packed_plans_query(spark):
    """Against sets of single places, plan by plan."""
    from auditlake.plans import units as queries

    plans = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        lo = int(r.l_quantity * 3)
        plans[r.l_suppkey][r.l_orderkey].add((str(r.l_partkey % 4), lo, lo + r.l_linenumber))
    want = {}
    for run, own in plans.items():
        unit, held = 0, set()
        for k, plan in enumerate(sorted(own)):
            both = held | covered_places(own[plan])
            if k and len(both) > 300:
                unit, both = unit + 1, covered_places(own[plan])
            held = both
            want[run, plan] = unit
    assert {(r.run, r.plan): r.unit for r in queries.packed_plans(spark, DATA).collect()} == want


def test_chosen_evidence_query(spark):
    from auditlake.plans import units as queries

    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        lo = int(r.l_quantity * 3)
        rows[r.l_orderkey].append((r.l_linenumber % 3, r.l_suppkey % 2, (str(r.l_partkey), lo, lo + r.l_linenumber)))
    want = set()
    for unit, edges in rows.items():
        chosen = {e for hop, _, e in edges if not hop}
        for hop, _, e in sorted(edges):
            if hop and len(covered_places(chosen | {e})) <= 20:
                chosen.add(e)
        want |= {(unit, *e) for e in chosen}
    assert {(r.unit, r.file, r.lo, r.hi) for r in queries.chosen_evidence(spark, DATA).collect()} == want


def test_assembled_context_query(spark):
    from auditlake.plans import grounding as queries

    parts = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        if r.text is not None:
            parts[r.source].append((r.doc_id % 5 != 0, r.doc_id, r.text))
    for row in queries.assembled_context(spark, DATA).collect():
        taken, total, omitted = [], 0, 0
        for k, (_, _, text) in enumerate(sorted(parts[row.source])):
            if not k or total + len(text) + 2 <= 6000:
                taken.append(text)
                total += len(text) + 2
            else:
                omitted += 1
        assert row.text == "\n\n".join(taken) and row.n_omitted == omitted


def test_links_of_calls(spark):
    symbols = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, ["b", "b"], ["a", "zz"]), (3, ["b", "c"], ["b"]), (4, [], ["b", "b"])], "path int, defines array<string>, calls array<string>")
    pairs = diffs.call_edges(symbols).groupBy("caller", "name").agg(F.count("*").alias("n"), F.min("callee").alias("first")).collect()
    assert {(r.caller, r.name): (r.n_callees, r.callee) for r in diffs.call_links(symbols).collect()} == {(r.caller, r.name): (r.n, r.first) for r in pairs}


def test_components_of_all_edges(spark):
    edges = spark.read.parquet(f"{DATA}/lineitem.parquet").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 1000 + 7).alias("dst")).distinct()
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in edges.collect():
        a, b = sorted((find(r.src), find(r.dst)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: find(i) for i in root}


def test_covers_grow_as_unions_do():
    rng = random.Random(3)
    for _ in range(500):
        cover, ranges = units.Cover(), set()
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(40)
            r = (rng.choice("fg"), a, a + rng.randrange(-1, 9))
            assert cover.growth(*r) == units.union_size(ranges | {r}) - units.union_size(ranges)
            cover.add(*r)
            ranges.add(r)
            assert cover.size == units.union_size(ranges) == units.union_size(set(cover.pieces()))


def test_what_a_review_looks_at(spark):
    files = spark.createDataFrame([("a.sol", "Contract X"), ("b.py", None), ("c.py", "uses PASSWORD"), ("tests/test_d.py", "password"), ("node_modules/e.py", "password"), ("urls.txt", "x")], "path string, text string")
    flags = review.stacks(files.withColumn("root", F.lit("r")), (review.Stack("evm", ("*.sol",), ("contract",)), review.Stack("web", (), ("password",))), ["root"]).first()
    assert (flags.evm, flags.web) == (1, 3)
    found = review.entrypoints(files, review.named(F.col("path"), ("urls*",)), ("password",), P.PathRules())
    assert {r.path: (r.globbed, r.marked) for r in found.collect()} == {"c.py": (False, True), "urls.txt": (True, False)}
    assert [r.path for r in review.exporting(files, ("^Contract", "PASS")).orderBy("path").collect()] == ["a.sol", "c.py"]
    value_of = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [value_of(review.provenance_value(F.lit(v), k)) for v, k in (("7", "bigint"), ("x", "bigint"), ("True", "boolean"), (" ", "string"), (" a ", "string"))] == [7, None, True, None, "a"]
    states = [("running", False, 0), ("complete", True, 2), ("complete", False, 0), ("complete", True, 0)]
    assert [value_of(review.run_consistency(F.lit(s), F.lit(c), F.lit(e))) for s, c, e in states] == ["still running", "complete with errors", "state without completion", "consistent"]


def made_ranges(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(60), rng.randrange(9), rng.randrange(3), rng.randrange(2), rng.choice("abc"), lo := rng.randrange(60), lo + rng.randrange(-2, 25)) for _ in range(n)]


def test_evidence_and_plans_stream_through_their_groups(spark):
    """Against brute force, batches ending anywhere; no group is a call of its own."""
    rows = made_ranges(5, 1500)
    table = spark.createDataFrame(rows, "g int, plan int, hop int, ambiguous int, file string, lo int, hi int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        chosen, packed = units.evidence_units(table, "g", 40), units.plan_units(table, "g", 60)
        got = sorted(map(tuple, chosen.collect())), sorted(map(tuple, packed.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = sorted({r[0] for r in rows})
    want = []
    for g in groups:
        taken, all_ = {r[4:] for r in rows if r[0] == g and r[2] == 0}, sorted((r[2], r[3], r[4:]) for r in rows if r[0] == g and r[2])
        for *_, end in all_:
            if units.union_size({*taken, end}) <= 40:
                taken.add(end)
        want += [(g, *r) for r in taken]
    assert got[0] == sorted(want)
    want = []
    for g in groups:
        unit, held = -1, set()
        for plan in sorted({r[1] for r in rows if r[0] == g}):
            own = {r[4:] for r in rows if r[:2] == (g, plan)}
            joins = unit >= 0 and units.union_size(held | own) <= 60
            unit, held = (unit, held | own) if joins else (unit + 1, own)
            want.append((g, plan, unit))
    assert got[1] == want
    assert not any("FlatMapGroups" in x._jdf.queryExecution().toString() for x in (chosen, packed))
