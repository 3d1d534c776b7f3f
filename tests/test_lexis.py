"""The scan of tokens: what counts as defined, called, bound, imported and exported."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditlake.operators import diffs, lexis


def found(text, *kinds):
    return sorted({name for kind, name, _ in lexis.Scan(text).symbols() if kind in kinds})


@pytest.mark.parametrize(
    "text,defined,called",
    [
        ("def handler(x):\n    return loader(x)\n# comment call_me()\nclass Thing:\n    pass\nshort()\n", ["handler"], ["loader", "short"]),
        ("async def poll (x): fetch_all(x)", ["poll"], ["fetch_all"]),
        ("func (s *Store[K]) Save(k int) { write_to(k) }", ["Save"], ["write_to"]),
        ("const pick = async (a, b = other(1)) => chosen(a)", ["pick"], ["chosen", "other"]),
        ("let plain = value(3)", [], ["value"]),
        ("  step(a, b) {\n    if (checked(a)) { again(b) }\n  }", ["step"], ["again", "checked"]),
        ("run(a); {}", [], []),
        ("while (ready(x)) {\n}", [], ["ready"]),
        ("function f(uint a) external onlyOwner(role) returns (bool) { inner(a); }", ["f"], ["inner", "onlyOwner"]),
        ("function f(uint a, g.second(b)) external returns (bool);\nafter(1)", ["f"], ["after"]),
        ("constructor(address a) { setup(a); }\nfallback() external {}\nreceive() external payable {}", ["constructor"], ["setup"]),
        ("event Moved(uint a);\nerror NoFunds(uint b);\nevent.dispatchNow(x)", [], ["dispatchNow"]),
        ("'quoted(1)' + \"also(2)\" + `tick(3)` + real_one(4)", [], ["real_one"]),
        ('"""doc\nhidden(1)\n""" + shown(2)', [], ["shown"]),
        ("/* many\n * lines(1) */ code_1(2) // tail(3)\n * star(4)\n x * times(5)", [], ["code_1", "times"]),
        ("it's fine(1)", [], []),
        ("it's called(1)", [], ["called"]),
        ("\"open string(1)\nnext_line(2)", [], ["next_line", "string"]),
        ("if(x) {} return(y) abcd(z) abcde (z)", [], ["abcde"]),
        ("", [], []),
        ("((((", [], []),
        (")}] call_1(", [], ["call_1"]),
    ],
)
def test_names(text, defined, called):
    assert found(text, "definition") == defined and found(text, "call") == called


@pytest.mark.parametrize(
    "text,imported,exported",
    [
        ('import {A, b as c} from "./lib.sol";', ["./lib.sol"], []),
        ("from ..pkg.mod import thing\nimport os.path\nimport a.b as c", ["..pkg.mod", "a.b", "os.path"], []),
        ("const x = require('fs')\nimport 'side'", ["fs", "side"], []),
        ("export default class A {}\nexport { one, two as deux }\nexport async function go() {}\nexport * from './all'", ["./all"], ["*", "default", "deux", "go", "one"]),
        ("// import a from 'b'\ns = \"export const q = 1\"", [], []),
    ],
)
def test_modules(text, imported, exported):
    assert found(text, "import") == imported and found(text, "export") == exported


def test_callable_assignments_count_among_changed_names(spark):
    rows = spark.createDataFrame([("handle = async (req) => go12(req)\nflag == (value)\nobj.method_1 = (x)\ny = (z)",), (None,)], "text string")
    got = [r.n for r in lexis.with_symbols(rows).select(lexis.changed_names(F.col("symbols")).alias("n")).collect()]
    assert got == [["handle", "method_1"], []]


def test_hunk_lines_are_read_together(spark):
    text = "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1,4 +1,4 @@\n /* starts\n+hidden_1(x) */ shown_1(x)\n-gone_1(x)\n+const bound_1 = (y) => y"
    rows = diffs.lines(spark.createDataFrame([("d", text)], "diff_id string, text string"))
    hunks = diffs.numbered(rows).join(diffs.chunk_text(rows).select("diff_id", "chunk", "path"), ["diff_id", "chunk"])
    assert lexis.hunk_names(hunks, ["diff_id", "path"]).first().names == ["bound_1", "gone_1", "shown_1"]


def test_edges_name_the_file_that_defines_what_another_calls(spark):
    texts = [("pool.sol", "function drain() { return vault.moveAll(); }"), ("vault.sol", "function moveAll() { return drainer(); } // drain()"), ("other.sol", "function moveAll() { moveAll(); }")]
    got = {tuple(r) for r in lexis.call_edges_of(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {("pool.sol", "moveAll", 2, "other.sol"), ("other.sol", "moveAll", 1, "vault.sol")}
