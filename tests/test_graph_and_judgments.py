from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import backtest, contracts, diffs, graph, modules, replies, rounds, scoring, verification


def edges(spark, *pairs, kind="call"):
    return spark.createDataFrame([(*p, kind) if len(p) == 2 else p for p in pairs], "src string, dst string, kind string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_hops_and_paths(spark):
    e = edges(spark, ("handle", "load"), ("load", "read"), ("read", "deep"), ("admin", "wipe"))
    h = {(x.src, x.dst): x.hop for x in graph.hops(e, nodes(spark, "handle"), 2).collect()}
    assert h == {("handle", "load"): 1, ("load", "read"): 2}
    paths = [x.path for x in graph.simple_paths(e, nodes(spark, "handle"), 2).collect()]
    assert paths == [["handle", "load", "read"]]
    assert graph.closure(graph.simple_paths(e, nodes(spark, "handle"), 2)).count() == 2
    cycle = edges(spark, ("a", "b"), ("b", "a"))
    assert graph.hops(cycle, nodes(spark, "a"), 5).count() == 2
    assert [x.path for x in graph.simple_paths(cycle, nodes(spark, "a"), 5).collect()] == [["a", "b"]]


def test_components_and_fixpoint(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")]
    random.Random(1).shuffle(chain)
    c = {x.node: x.root for x in graph.components(edges(spark, *chain)).collect()}
    assert set(c.values()) == {"n000", "x"} and len(c) == 43
    b = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "node string, target string")
    assert [tuple(x) for x in graph.fixpoint(b, nodes(spark, "a")).collect()] == [("a", "d")]
    assert graph.components(edges(spark, ("a", "a"))).count() == 0


def test_resolution(spark):
    files = spark.createDataFrame([("src/app/db.py",), ("lib/app/db.py",), ("src/x.py",)], "path string")
    specs = spark.createDataFrame([(1, "app/db.py"), (2, "x.py"), (3, "b.py")], "spec_id int, spec string")
    got = {x.spec_id: (x.n_files, x.resolution) for x in graph.suffix_resolution(specs, files).collect()}
    assert got == {1: (2, "ambiguous"), 2: (1, "exact")}


def verdict(spark, votes, confirmers, labels):
    v = spark.createDataFrame([("c", *x) for x in votes], "candidate string, refuted boolean, failed boolean")
    c = spark.createDataFrame([("c", *x) for x in confirmers], "candidate string, label string, upheld boolean, failed boolean")
    f = spark.createDataFrame([("c", labels)], "candidate string, labels array<string>")
    return verification.verdicts(v, c, f).first().verdict


def test_votes(spark):
    no, yes, bad = (True, False), (False, False), (True, True)
    assert verdict(spark, [no], [], []) == "kept"
    assert verdict(spark, [no], [("c1", True, False), ("c2", False, False)], []) == "kept"
    assert verdict(spark, [no], [("c1", True, False)], ["c1"]) == "kept"
    assert verdict(spark, [no], [("c1", True, False), ("c2", True, False)], ["c1"]) == "dropped"
    assert verdict(spark, [no] * 3, [("", True, False)], ["c1"]) == "dropped"
    assert verdict(spark, [no, no, yes], [("", True, False)], []) == "kept"
    assert verdict(spark, [no, bad], [("", True, False)], []) == "incomplete"
    assert verdict(spark, [no], [("", True, True)], []) == "incomplete"


@pytest.mark.parametrize("seq,k,want", [([(1, True), (0, True), (0, True)], 2, [False, False, True]), ([(0, True), (1, True)], 2, [False, False]), ([(1, True), (0, False), (0, False), (0, True), (0, True)], 2, [False, False, False, False, True])])
def test_convergence(spark, seq, k, want):
    d = spark.createDataFrame([("u", i, n, c, False) for i, (n, c) in enumerate(seq)], "unit string, round int, new_findings int, clean boolean, pending boolean")
    assert [x.converged for x in rounds.converged(d, ["unit"], "round", k).orderBy("round").collect()] == want


def test_outcome_and_replay(spark):
    r = spark.createDataFrame([("u", 1, 1, True), ("u", 2, 0, False)], "unit string, round int, errors int, pending boolean")
    f = spark.createDataFrame([("u", 1, 1, "p", "old", 1), ("u", 1, 1, "p", "new", 2)], "unit string, index int, total int, paths string, reason string, round int")
    o = rounds.outcome(r, f, "unit").first()
    assert (o.errors, o.pending, o.failures, o.reasons, o.complete) == (1, False, 1, "new", False)
    p = spark.createDataFrame([(1,), (2,)], "id int")
    got = rounds.replay(p, spark.createDataFrame([(1, "x")], "id int, text string"), ["id"])
    assert {x.id: x.error for x in got.collect()} == {1: None, 2: "no reply"}


def test_assignment_against_brute_force():
    assert scoring.assign([(9, 1), (8, 0)]) == [1, 0]
    assert scoring.assign([(4, 3), (4, 0)]) == [1, 0]
    with pytest.raises(ValueError):
        scoring.assign([(1, 2), (1,)])
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [tuple(rng.choice([0, 0, 1, 2, 3, 4]) for _ in range(m)) for _ in range(n)]
        best = (0, 0)
        for columns in itertools.product([None, *range(m)], repeat=n):
            used = [c for c in columns if c is not None]
            if len(used) == len(set(used)) and all(c is None or w[i][c] for i, c in enumerate(columns)):
                best = max(best, (len(used), sum(w[i][c] for i, c in enumerate(columns) if c is not None)))
        got = scoring.assign(w)
        assert (sum(c is not None for c in got), sum(w[i][c] for i, c in enumerate(got) if c is not None)) == best
        used = [c for c in got if c is not None]
        assert len(used) == len(set(used))


def test_results_and_repeats(spark):
    c = spark.createDataFrame([("b", "finding", True), ("b", "finding", False), ("b", "clean", True)], "b string, expectation string, hit boolean")
    r = scoring.result(c, ["b"]).first()
    assert (r.found, r.missed, r.false_positives, r.recall, r.precision) == (1, 1, 1, 0.5, 0.5)
    h = spark.createDataFrame([("a", True)] * 3 + [("b", True), ("b", True), ("b", False)] + [("c", True), ("c", False), ("c", False)], "id string, hit boolean")
    got = {x.id: (x.freq, x.majority, x.flaky) for x in scoring.repeated(h, ["id"], 3).collect()}
    assert got == {"a": (3, True, False), "b": (2, True, True), "c": (1, False, True)}


def test_compare_and_gates(spark):
    s = "id string, hit boolean, catch_rate double"
    flips = backtest.compare(spark.createDataFrame([("a", True, 1.0), ("m", True, 1.0)], s), spark.createDataFrame([("a", True, 0.667), ("b", True, 1.0)], s), "id")
    assert {x.id: (x.flip, x.rate_move) for x in flips.collect()} == {"a": ("still_found", -0.333), "b": ("newly_found", 1.0), "m": ("newly_missed", -1.0)}
    g = {x.check_name: (x.passed, x.failures) for x in backtest.gate({"missed": flips.filter("flip = 'newly_missed'").withColumnRenamed("id", "detail"), "none": flips.filter("false").withColumnRenamed("id", "detail")}).collect()}
    assert g == {"missed": (False, 1), "none": (True, 0)}
    a = spark.createDataFrame([("x", 1, 2, 1), ("x", 2, 2, 1)], "arm string, ord int, verify_errors int, incomplete int")
    t = backtest.arm_totals(a, "arm", ["verify_errors"], ["incomplete"], F.col("ord"))
    assert (t.first().verify_errors, t.first().incomplete) == (4, 1)
    c = backtest.comparable(t, "arm", ["verify_errors", "incomplete"]).first()
    assert (c.comparable, c.reason) == (False, "verify_errors=4, incomplete=1")


def test_contracts(spark):
    d = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 3, ["y", "x"]), ("b", 1, ["y"])], "task string, n int, refs array<string>")
    v = contracts.violations(
        contracts.duplicates(d, ["task"], "dup"), contracts.out_of_sequence(d, "task", "n", "seq"), contracts.unsorted(d, "task", "refs", "sort"), contracts.overlapping_scopes(d, "task", "refs", "scope"),
        contracts.orphans(d, "task", spark.createDataFrame([("a",)], "id string"), "id", "fk"),
    )
    assert sorted(map(tuple, v.collect())) == [("dup", "a"), ("fk", "b"), ("scope", "x"), ("scope", "y"), ("seq", "a"), ("sort", "a")]


DIFF = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -10,3 +10,3 @@
 keep
-old
+new
 end"""


def test_diff_ranges(spark):
    d = spark.createDataFrame([("d", DIFF)], "diff_id string, text string")
    rows = diffs.lines(d)
    paths = diffs.chunk_text(rows).select("diff_id", "chunk", "path")
    got = {(x.side, x.lo, x.hi) for x in diffs.line_ranges(rows, paths).collect()}
    assert got == {("current", 10, 12), ("new", 11, 11), ("old", 11, 11)}


@pytest.mark.parametrize(
    "text,path",
    [
        ("diff --git a/README.md b/README.md\n--- a/README.md\n+++ /dev/null", "README.md"),
        ("diff --git a/app/x.py b/app/x.py\nBinary files differ", "app/x.py"),
        ('diff --git "a/app icon.png" "b/app icon.png"', "app icon.png"),
        ('--- "a/caf\\303\\251.py"\n+++ "b/caf\\303\\251.py"', "café.py"),
        ("no header", None),
    ],
)
def test_diff_paths(spark, text, path):
    assert spark.createDataFrame([(text,)], "t string").select(diffs.path_of(F.col("t")).alias("p")).first().p == path


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 2}\n``` y', {"a": 2}), ('see {"a": {"b": 3}} ok', {"a": {"b": 3}}), ('note {not: json} then {"findings": []}', {"findings": []}),
        ('{"a": "}{"}', {"a": "}{"}), ("", None), ("prose", None), ("{not valid}", None), ("[1, 2]", None), ('{"a": [1, 2,],}', {"a": [1, 2]}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": 1}' + " noise" * 300_000, {"a": 1}),
    ],
)
def test_replies(text, want):
    assert replies.parse_object(text) == want


def test_reply_contract(spark):
    d = spark.createDataFrame([('{"findings": []}',), ('{"findings": 1}',), ("{}",), ('{"findings": [], "notes": 3}',)], "o string")
    assert [x.ok for x in d.select(replies.contract_ok(F.col("o"), ["findings"], ["notes"]).alias("ok")).collect()] == [True, False, False, False]


LONG = "word " * 60


@pytest.mark.parametrize(
    "text,blocks,joint",
    [
        ("first; part\n\nsecond block", ["first; part", "second block"], "\n\n"),  # blank lines go before "; "
        ("one; two; ONE!; two", ["one", "two"], "; "),
        ("one", ["one"], ""), (None, [], ""), ("  ", [], ""),
        ("a\n \nb", ["a\n \nb"], ""),  # a line of blanks parts nothing
        ("# Cause\nthe same\n\nthe same\n\n# Cause\nthe same", ["# Cause\nthe same", "# Cause\nthe same"], "\n\n"),  # headings stay and count
        ("# Only\n\n# Only\n\nonly", ["# Only", "# Only"], "\n\n"),
        ("---\n\nx\n\n!!!", ["x"], "\n\n"),  # blocks without words
        (f"{LONG}end\n\n{LONG.upper()}End\n\n{LONG}and", [f"{LONG}end"], "\n\n"),
        ("short words\n\nshort word", ["short words", "short word"], "\n\n"),
        (f"{LONG}\n\n{'other ' * 15}", [LONG.strip(), ("other " * 15).strip()], "\n\n"),
    ],
)
def test_distinct_blocks(text, blocks, joint):
    assert replies.distinct_blocks(text) == (blocks, joint)


def slow_windows(text, cap, overlap):
    starts = [i for i, c in enumerate(text) if not c.isspace() and (i == 0 or text[i - 1] == "\n")]
    out, at = [], 0
    while at + cap < len(text):
        inside = [b for b in starts if at < b <= at + cap]
        out.append((at, inside[-1] if inside else at + cap))
        at = inside[-1] if inside else at + cap - overlap
    return [*out, (at, len(text))]


def test_windows_end_at_lines():
    assert replies.windows_of("a" * 9 + "\n" + "b" * 5, 10, 2) == [(0, 10), (10, 15)]  # a line that begins at the cap
    assert replies.windows_of("", 8, 2) == [(0, 0)] and replies.windows_of("a" * 8, 8, 2) == [(0, 8)]
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("ab\n\n \t") for _ in range(rng.randrange(90)))
        assert replies.windows_of(text, 12, 3) == slow_windows(text, 12, 3)


def test_cut_replies_say_so(spark, monkeypatch):
    rows = spark.createDataFrame([(1, '{"a": 1}' + " " * 50), (2, "x" * 30 + '{"b": 2}'), (3, 'x {"c": 3}'), (4, None)], "id int, text string")
    monkeypatch.setattr(replies, "SEARCHED", 20)
    got = {r.id: (r.object, r.cut) for r in replies.reply_objects(rows).collect()}
    assert got[1] == ('{"a":1}', False) and got[2][1] and got[3][1] is False and got[4] == (None, False)


def test_long_chains_and_cycles_end(spark):
    n = 300
    chain = spark.range(n).selectExpr("concat('n', id) AS node", "concat('n', id + 1) AS target")
    loop = spark.createDataFrame([("p", "q"), ("q", "p"), ("q", "out"), ("r", "r"), ("s", "p"), ("s", "end")], "node string, target string")
    got = {(r.start, r.node) for r in graph.fixpoint(chain.union(loop), nodes(spark, "n0", "n299", "p", "r", "s", "free")).collect()}
    assert got == {("n0", "n300"), ("n299", "n300"), ("p", "out"), ("s", "out"), ("s", "end"), ("free", "free")}


def test_names_across_modules(spark):
    s = "file string, name string, source_file string, source_name string"
    chain = [(f"m{k}", "x", f"m{k + 1}", "x") for k in range(200)]
    bindings = [
        *chain, ("bar", "*", "a", "*"), ("bar", "*", "b", "*"), ("top", "*", "bar", "*"), ("bar", "shadow", "c", "deep"), ("a", "default", "a", "main"), ("use", "Main", "a", "default"), ("use", "ns", "b", "*"),
        ("l1", "*", "l2", "*"), ("l2", "*", "l1", "*"), ("e1", "y", "e2", "y"), ("e2", "y", "e1", "y"), ("l2", "*", "b", "*"), ("c", "own", "b", "own"),
    ]
    definitions = [("m200", "x"), ("a", "main"), ("a", "both"), ("b", "both"), ("b", "own"), ("c", "own"), ("c", "deep"), ("a", "shadow"), ("b", "only")]
    starts = [("m0", "x"), ("top", "both"), ("top", "shadow"), ("top", "default"), ("use", "Main"), ("use", "ns"), ("l1", "only"), ("e1", "y"), ("c", "own"), ("top", "none"), ("a", "main")]
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    ends, gaps = modules.resolve_names(rows(starts, "file string, name string"), rows(bindings, s), rows(definitions, "file string, name string"))
    got = {tuple(r) for r in ends.collect()}
    assert got == {
        ("m0", "x", "m200", "x"), ("top", "both", "a", "both"), ("top", "both", "b", "both"), ("top", "shadow", "c", "deep"), ("use", "Main", "a", "main"), ("use", "ns", "b", "*"), ("l1", "only", "b", "only"), ("c", "own", "c", "own"), ("a", "main", "a", "main"),
    }
    assert {tuple(r) for r in gaps.collect()} == {("top", "default"), ("e1", "y"), ("top", "none")}


@pytest.mark.parametrize(
    "text,paths",
    [
        ("in `my app/main file.py` and lib/a.ts:12, again lib/a.ts:13; not b.py alone", ["lib/a.ts", "my app/main file.py"]),
        ("on 2024-05-06/c.py:3 and 17/d.py:4 but v2/e.py:5", ["v2/e.py"]),
        ("`src/x.py`:4 and `no path`, my app/main file.py:7 with `my app/main file.py`", ["my app/main file.py", "src/x.py"]),
        ("", []),
    ],
)
def test_source_paths(spark, text, paths):
    assert spark.createDataFrame([(text,)], "t string").select(replies.source_paths(F.col("t")).alias("p")).first().p == paths


def test_cited_locations(spark):
    text = "at `src/a b.py`:3, src/a b.py:4, ./src//c.py:5, c.py:6, d.py:7, e.go:8 and `gone.rs`:9"
    files = ["src/a b.py", "src/c.py", "x/d.py", "y/d.py", "z/e.go", "never.md"]
    got = spark.createDataFrame([(text, files)], "t string, f array<string>").select(replies.cited_locations(F.col("t"), F.col("f")).alias("l")).first().l
    assert [tuple(x) for x in got] == [("never.md", None), ("src/a b.py", 3), ("src/a b.py", 4), ("src/c.py", 5), ("src/c.py", 6), ("x/d.py", None), ("y/d.py", None), ("z/e.go", 8)]
