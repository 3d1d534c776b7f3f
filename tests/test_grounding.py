from __future__ import annotations

from auditlake.operators import grounding, knowledge


def test_catalogue(spark):
    e = spark.createDataFrame([("f", 0, 5, "a"), ("f", 0, 5, "b"), ("f", 6, 99, "a"), ("f", 1, 2, "a"), ("gone", 0, 1, "a")], "file string, lo int, hi int, source string")
    got = {r.label: (r.text, r.state) for r in grounding.catalogue(e, e.filter("hi = 2"), spark.createDataFrame([("f", "hello world")], "file string, text string")).collect()}
    assert got == {"a, b -> f:0:5": ("hello", "valid"), "a -> f:6:99": (None, "invalid"), "a -> gone:0:1": (None, "invalid")}


def test_shares(spark):
    d = spark.createDataFrame([("g", i, s) for i, s in enumerate([10, 100, 100])], "g string, i int, s int")
    assert [r.share for r in grounding.shares(d, "g", ["i"], "s", 90).orderBy("i").collect()] == [10, 40, 40]


def test_assembly_names_what_it_omits(spark):
    p = spark.createDataFrame([("u", "a", False, "x" * 10), ("u", "b", True, "y" * 10), ("u", "c", False, "z" * 50)], "u string, path string, changed boolean, text string")
    r = grounding.assemble(p, "u", 30).first()
    assert r.text == "y" * 10 + "\n\n" + "x" * 10 and r.omitted == ["c"]
    assert grounding.assemble(p, "u", 12, changed_first=False).first().text == "x" * 10


def test_shared_context_leaves_templates_out(spark):
    s = "ord int, name string, text string"
    d, t = spark.createDataFrame([(1, "a", "same"), (2, "b", "own"), (3, "c", "more")], s), spark.createDataFrame([(1, "a", "same"), (2, "b", "old")], s)
    assert grounding.shared_context(d, t, 100).first().text == "own\n\nmore"


def test_shared_context_is_cut_like_the_whole(spark):
    s = "ord int, name string, text string"
    texts = ["ab", "", None, "cdefg", "h", "", "", "ijklmnop", "q"]
    d, none = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], s), spark.createDataFrame([], s)
    whole = "\n\n".join(t for t in texts if t is not None)
    for cap in range(len(whole) + 3):
        assert grounding.shared_context(d, none, cap).first().text == (whole if len(whole) <= cap else whole[:cap] + "\n[truncated]")


def test_wire_entries(spark):
    f = spark.createDataFrame([(1, "k", "SQL injection!", "HIGH", 2, "f", 3)], "position int, key string, title string, severity string, consensus int, file string, line int")
    r = grounding.wire_entries(f, proofs=spark.createDataFrame([("k", "p.md")], "key string, proof string")).first()
    assert (r.name, r.owner, r.proof) == ("001-sql-injection", None, "p.md")


def test_contexts_are_filled_from_whole_texts(spark):
    from auditlake.plans import grounding as plans
    from tests.conftest import DATA

    long = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) BETWEEN 800 AND 3000").select("text").collect()]
    assert any(t.strip() in r.text for r in plans.assembled_context(spark, DATA).collect() for t in long)


def test_hints_in_any_number_of_passes(spark):
    hints = [(1, "Raw SQL"), (1, "sql"), (1, "sql"), (2, "é("), (2, ""), (2, None), (3, "a.b"), (4, "zzz"), (5, " ")]
    texts = [(1, "uses RAW sql twice: sql"), (2, "É(x) a.b acb"), (3, None), (4, ""), (5, "x" * 50_000 + "zzz"), (6, "again zzz")]
    want = sorted((i, c, max(map(len, m)), len(m)) for i, t in texts for c in {c for c, _ in hints} if (m := [h for d, h in hints if d == c and h and h.lower() in (t or "").lower()]))
    t, h = spark.createDataFrame(texts, "doc int, body string"), spark.createDataFrame(hints, "id int, hint string")
    for per_pass in (1, 3, 100):
        got = sorted((r.text_id, r.id, r.longest, r.matches) for r in knowledge.select_hints(t, h, "doc", "body", per_pass).collect())
        assert got == want
    assert knowledge.select_hints(t, h.filter("false"), "doc", "body").count() == 0
