from __future__ import annotations

import json

from auditlake.sources import readers
from auditlake.streaming import logs


def test_tree_and_manifests(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("no")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("é")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "package.json").write_text("{}")
    files = readers.source_tree(spark, str(tmp_path))
    assert {x.path: x.text for x in files.collect()} == {"src/a.py": "é", "src/b.bin": "", "package.json": "{}"}
    assert readers.manifests(files).first().text == "{}"


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: x\nhints: [a, 'b']\n---\nbody\n")
    (tmp_path / "index.md").write_text("skip")
    r = readers.markdown(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].header == {"id": "x", "hints": "[a, 'b']"} and r[0].body == "body\n"


def test_explorer_forms(spark):
    two = json.dumps({"a.sol": {"content": "A"}, "../b.sol": {"content": "B"}})
    three = "{" + json.dumps({"sources": {"c.sol": {"content": "C"}}}) + "}"
    d = spark.createDataFrame([(1, "contract X {}"), (2, two), (3, three)], "address int, source string")
    assert sorted(map(tuple, readers.explorer_sources(d).collect())) == [(1, "contract.sol", "contract X {}"), (2, "a.sol", "A"), (3, "c.sol", "C")]


def test_findings_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"findings": [{"file": "f", "line": 3}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"file": "g"}, {"file": "h"}]))
    r = readers.findings_json(spark, str(tmp_path))
    assert sorted((x.ord, x.file, x.line) for x in r.collect()) == [(0, "f", 3), (0, "g", None), (1, "h", None)]


def test_registry(spark):
    a, b = spark.createDataFrame([("x", 1)], "id string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "id string, v int")
    assert readers.registry(a, b)[1].count() == 1
    chosen, twice = readers.registry(a, b, override=True)
    assert {x.id: x.v for x in chosen.collect()} == {"x": 2, "y": 3} and twice.count() == 0


def test_timeline(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"stage": "a", "seconds": 1.5}\nbroken\n')
    assert [x.stage for x in readers.timeline(spark, str(tmp_path)).collect() if x.stage] == ["a"]


def test_pool_grows_over_batches(spark, tmp_path):
    schema = "ord bigint, category string, endpoint string, symbol string, file string, line int"
    for n, symbols in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(n * 10 + i, "x", "", s, "f", 1) for i, s in enumerate(symbols)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = logs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        logs.grow_pool(spark, stream, str(tmp_path / "pool"), str(tmp_path / "state"))
    got = {x.key.rpartition("|")[2]: (x.n, x.new_in) for x in logs.read_pool(spark, str(tmp_path / "pool")).collect()}
    assert got == {"a": (1, 0), "b": (2, 0), "c": (1, 1)}
