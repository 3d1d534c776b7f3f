"""Readers and small helpers on files of their own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators import benchmarks, dimensions, sinks
from auditlake.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_source_sample_keeps_the_file_that_crosses_the_total(spark, monkeypatch):
    monkeypatch.setattr(readers, "SAMPLE_CHARS", 10)
    monkeypatch.setattr(readers, "SAMPLE_TOTAL", 15)
    files = spark.createDataFrame([("r", "a", "x" * 50), ("r", "b", "y" * 8), ("r", "c", "z"), ("q", "d", "")], "root string, path string, text string")
    got = {r.path: r.text for r in readers.source_sample(files, "root").collect()}
    assert got == {"a": "x" * 10, "b": "y" * 8, "d": ""}


def test_header_list(spark):
    assert value(spark, readers.header_list(F.lit("[a, 'b c', \"d\", ]"))) == ["a", "b c", "d"] and value(spark, readers.header_list(F.lit("one"))) == ["one"]


def test_diff_files(spark, tmp_path):
    (tmp_path / "x.diff").write_text("diff --git a/x b/x\n+new\n")
    row = readers.diff_files(spark, str(tmp_path)).first()
    assert row.diff_id.endswith("/x.diff") and row.text == "diff --git a/x b/x\n+new\n"


def test_findings_of_an_object_or_a_list(spark, tmp_path):
    one = {"file": "a.py", "line": 3, "severity": "HIGH", "found_by": ["x"]}
    (tmp_path / "a.json").write_text(json.dumps({"findings": [one, {"file": "b.py"}], "other": 1}))
    (tmp_path / "b.json").write_text(json.dumps([{"file": "c.py", "change_anchor": {"file": "c.py", "line": 1, "side": "new"}}]))
    (tmp_path / "c.json").write_text("{}")
    got = {(r.report.rsplit("/", 1)[1], r.ord): (r.file, r.line, r.found_by, r.change_anchor and r.change_anchor.side) for r in readers.findings_json(spark, str(tmp_path)).collect()}
    assert got == {("a.json", 0): ("a.py", 3, ["x"], None), ("a.json", 1): ("b.py", None, None, None), ("b.json", 0): ("c.py", None, None, "new")}


def test_candidates_in_documents(spark):
    text = "# A title \n\n- Severity: high\n- Category: SQL_injection\n- Location: src/a.py:12\n- Status: {0}\n"
    docs = spark.createDataFrame([("a.md", text.format("Confirmed")), ("b.md", text.format("REFUTED")), ("c.md", text.format("cleared")), ("d.md", "no fields")], "path string, body string")
    got = {r.path: (r.title, r.severity, r.category, r.file, r.line, r.status) for r in readers.candidate_documents(docs).collect()}
    assert got == {"a.md": ("A title", "HIGH", "sql-injection", "src/a.py", 12, "confirmed"), "d.md": ("", "MEDIUM", "", "", None, "")}


def test_arm_artifacts_and_checkpoints(spark, tmp_path):
    for arm, lines in (("one", ['{"n": 1}', "broken"]), ("two", ['{"n": 2}', '{"n": 3}'])):
        (tmp_path / "arms" / arm / "deep").mkdir(parents=True)
        (tmp_path / "arms" / arm / "deep" / "run.json").write_text("\n".join(lines))
        (tmp_path / "arms" / arm / "other.json").write_text('{"n": 9}')
    got = sorted((r.arm, r.n) for r in readers.arm_artifacts(spark, str(tmp_path / "arms"), "run.json", "n int").collect())
    assert got == [("one", 1), ("two", 2), ("two", 3)]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.checkpoint(spark, str(tmp_path / "arms" / "one" / "deep"), "n int").collect()
    assert readers.timeline(spark, str(tmp_path / "arms" / "one" / "deep")).count() == 1


def test_scoped_checks_and_registry(spark):
    checks = spark.createDataFrame([("k1", ["t1", "t2"]), ("k2", ["t2"]), ("k3", [])], "id string, applies_to array<string>")
    assert sorted(r.id for r in readers.scoped(checks, "t2").collect()) == ["k1", "k2"]
    s = "id string, path string"
    public, private = spark.createDataFrame([("a", "pub"), ("b", "pub")], s), spark.createDataFrame([("b", "priv")], s)
    for override, paths, twice in ((True, {"a": "pub", "b": "priv"}, []), (False, {"a": "pub", "b": "priv"}, ["b"])):
        rows, clashes = readers.registry(public, private, override)
        assert {r.id: r.path for r in rows.collect()} == paths and [r.id for r in clashes.collect()] == twice


def test_small_helpers(spark):
    assert value(spark, sinks.summary_line(F.lit(3), F.lit(4), "recall")) == "recall 3/4 (0.75)"
    assert value(spark, P.relative(F.lit("./a/b.py"))) == "a/b.py" and value(spark, P.relative(F.lit("b/x.py"), True)) == "x.py"
    files = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "a")], "ref string, path string")
    assert [tuple(r) for r in dimensions.repeated_references(files).collect()] == [("r1", 2)]
    part = spark.createDataFrame([(1,)], "n int")
    assert benchmarks.all_results(part, part.withColumn("n", F.lit(2)), part).count() == 3
