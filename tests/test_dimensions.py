from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators import benchmarks, callgraph, dimensions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_aliases(spark):
    c = spark.createDataFrame([(1, "oracle-price-manipulation", ["Oracle Manipulation", "shared"]), (2, "reentrancy", ["shared"])], "ord int, id string, aliases array<string>")
    known = dimensions.aliases(c)
    assert {r.alias: r.id for r in known.collect()} == {"oracle-manipulation": "oracle-price-manipulation", "oracle-price-manipulation": "oracle-price-manipulation", "reentrancy": "reentrancy", "shared": "reentrancy"}
    rows = spark.createDataFrame([("Oracle Manipulation",), ("Unknown Class",)], "category string")
    assert [r.canonical for r in dimensions.canonical(rows, "category", known, False).orderBy("category").collect()] == ["oracle-price-manipulation", "unknown-class"]
    assert [r.canonical for r in dimensions.canonical(rows, "category", known, True).orderBy("category").collect()] == ["oracle-price-manipulation", "other"]


def test_anchors(spark):
    assert value(spark, dimensions.anchor(F.lit("f"), F.lit("3"), F.lit("old"))) == ("f", 3, "old")
    for bad in (("", "3", "old"), ("f", "0", "old"), ("f", "x", "old"), ("f", "3", "left")):
        assert value(spark, dimensions.anchor(*map(F.lit, bad))) is None
    a = F.struct(F.lit("f").alias("file"), F.lit(3).alias("line"), F.lit("new").alias("side"))
    assert value(spark, dimensions.shown_anchor(F.lit("f"), F.lit(3), a)) is None
    assert value(spark, dimensions.shown_anchor(F.lit("f"), F.lit(4), a)) == "f:3 (new)"
    assert value(spark, dimensions.prefixed(F.lit("x.py"), F.lit("a/"))) == "a/x.py"


def test_schema_errors(spark):
    d = spark.createDataFrame([(1, '{"id": "a", "n": 1}'), (2, '{"n": "x", "more": 1}'), (3, "[")], "id int, json string")
    got = [tuple(r) for r in benchmarks.schema_errors(d, "id", {"id": ("string", True), "n": ("integer", False)}).orderBy("id", "path").collect()]
    assert got == [(2, "id", "missing"), (2, "more", "unknown field"), (2, "n", "not integer"), (3, "", "not JSON")]


def test_comparison_lines(spark):
    d = spark.createDataFrame([("a", 100, 700, 0, 0)], "arm string, before_requests int, after_requests int, before_errors int, after_errors int")
    assert benchmarks.comparison_lines(d, "arm", ["requests", "errors"]).first().line == "requests 100 -> 700 (x7.0); errors 0 -> 0"
    assert value(spark, benchmarks.headline(F.lit(1), F.lit(1), F.lit(1))) == "recall 0.5, precision 0.5"


def test_scope(spark):
    r = P.PathRules()
    for path, interface, want in (("src/A.sol", False, True), ("lib/A.sol", False, False), (None, False, True), ("src/A.sol", True, False), ("src/test/A.sol", False, False)):
        assert value(spark, callgraph.in_scope(F.lit(path).cast("string"), "src", F.lit(interface), r)) is want


def test_functions_normalised(spark):
    d = spark.createDataFrame([("A", "f", ["y", "x"]), ("A", "f", ["x"])], "contract string, name string, writes array<string>")
    assert callgraph.normalised(d, ["contract", "name"], ["writes"]).first().writes == ["x", "y"]
