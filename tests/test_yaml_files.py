from __future__ import annotations

import json

import pytest

from auditlake.sources import yaml_files as Y

pytest.importorskip("yaml")

MANIFEST = """schema_version: 1
benchmark_id: {0}
profile: web
source:
  kind: {1}
  identity:
    url: https://example.org/x
    commit: abc
    address: "0x1"
    chain: main
  path: server
stack:
  languages: [go, "c++"]
  frameworks: []
tasks:
  - id: whole
    kind: repository
  - id: one
    kind: diff
    expectation: clean
    revision: {{base_commit: b0, commit: c1}}
"""
KEY = """benchmark_id: shop
checks:
  - id: k1
    applies_to:
      - whole
      - one
    expectation: findings
    severity: HIGH
    knowledge: {vulnerabilities: [xss], guides: [languages/go]}
    locations:
      files: [a.go]
      symbols: [Render, "$Raw"]
  - id: k2
    applies_to: [one]
    expectation: clean
    knowledge: {}
    locations: {endpoints: ["GET /a"]}
  - id: k3
    expectation: maybe
"""


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_front_matter(spark, tmp_path):
    root = tree(tmp_path, {
        "a.md": "---\ntitle: One\ntags: [x, 'y z']\nnested:\n  keys:\n    - deep\n  when: 2024-01-02\n---\n\n# Body\n--- not a header\n", "sub/b.md": "no header", "sub/index.md": "---\ntitle: index\n---\n", "c.md": "---\nonly: open", "d.md": "---\n- a list\n---\nrest", "e.md": "---\nbad: [1\n---\nx", "f.md": "", "g.txt": "x",
    })
    got = {r.path.rsplit("/", 1)[1]: r for r in Y.front_matter(spark, root).collect()}
    assert sorted(got) == ["a.md", "b.md", "c.md", "d.md", "e.md"]
    assert json.loads(got["a.md"].meta) == {"title": "One", "tags": ["x", "y z"], "nested": {"keys": ["deep"], "when": "2024-01-02"}} and got["a.md"].body == "# Body\n--- not a header"
    assert (got["b.md"].meta, got["b.md"].body) == ("{}", "no header") and got["c.md"].body == "---\nonly: open" and (got["d.md"].meta, got["d.md"].body) == ("{}", "rest")
    assert got["e.md"].meta is None and "flow sequence" in got["e.md"].error


def test_manifests_and_targets(spark, tmp_path):
    root = tree(tmp_path, {"a/benchmark.yaml": MANIFEST.format("shop", "git"), "b/benchmark.yaml": MANIFEST.format("chain", "explorer"), "c/benchmark.yaml": "benchmark_id: odd\nsource: {kind: ftp}\ntasks: [{id: t}]", "d/benchmark.yaml": "- 1", "e/benchmark.yaml": "a: {", "f/other.yaml": "benchmark_id: no"})
    rows = Y.manifests(spark, root)
    got = {r.path.rsplit("/", 2)[1]: r for r in rows.collect()}
    assert got["a"].stack.languages == ["go", "c++"] and got["a"].stack.protocols is None and got["a"].error is None
    assert got["d"].error == "no mapping at the top" and got["e"].error and sorted(got) == list("abcde")
    targets = {(r.benchmark_id, r.task): (r.type, r.url, r.address, r.ref, r.base, r.path, r.error) for r in Y.target_of(rows.filter("error IS NULL")).collect()}
    assert targets == {
        ("shop", "whole"): ("git", "https://example.org/x", None, "abc", None, "server", None), ("shop", "one"): ("git", "https://example.org/x", None, "c1", "b0", "server", None),
        ("chain", "whole"): ("explorer", None, "0x1", None, None, "server", None), ("chain", "one"): ("explorer", None, "0x1", None, None, "server", None), ("odd", "t"): ("ftp", None, None, None, None, ".", "unsupported kind"),
    }


def test_answer_keys(spark, tmp_path):
    root = tree(tmp_path, {"a/answer-key.yaml": KEY, "b/answer-key.yaml": "benchmark_id: none\nchecks: []", "c/answer-key.yaml": ": :"})
    got = {(r.benchmark_id, r.check_id): r for r in Y.answer_keys(spark, root).collect()}
    k1 = got["shop", "k1"]
    assert (k1.expectation, k1.applies_to, k1.severity, k1.files, k1.symbols, k1.endpoints, k1.refs, k1.error) == ("finding", ["whole", "one"], "HIGH", ["a.go"], ["render", "$raw"], [], ["guides:languages/go", "vulnerabilities:xss"], None)
    assert got["shop", "k2"].endpoints == ["GET /a"] and got["shop", "k3"].error == "a check without id or expectation" and got["none", None].error == "no checks" and got[None, None].error


def test_catalogue(spark, tmp_path):
    m = lambda name: MANIFEST.format(name, "git")
    public = tree(tmp_path / "public", {f"{k}/{f}": t for k, n in (("a", "one"), ("b", "two"), ("c", "twice"), ("d", "twice"), ("e", "keyless")) for f, t in (("benchmark.yaml", m(n)), ("answer-key.yaml", KEY)) if (k, f) != ("e", "answer-key.yaml")})
    private = tree(tmp_path / "private", {"x/benchmark.yaml": m("two"), "x/answer-key.yaml": KEY, "y/benchmark.yaml": m("own"), "y/answer-key.yaml": KEY})
    for override in (True, False):
        projects, problems = Y.catalogue(spark, {"public": (public, False), "private": (private, override)})
        got = {r.benchmark_id: r.provenance for r in projects.collect()}
        assert got == {"one": "public", "own": "private", **({"two": "private"} if override else {})}
        found = sorted((r.benchmark_id, r.problem) for r in problems.collect())
        assert found == sorted([("keyless", "no answer key"), ("twice", "twice in a root"), ("twice", "twice in a root"), *([] if override else [("two", "in two roots")] * 2)])
