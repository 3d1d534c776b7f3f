"""Plans that merge, siblings that fail, figures of a pass, units that converge as a stream, table functions."""

from __future__ import annotations

import datetime

import random



from auditlake.operators import rounds, table_functions, trace, units
from auditlake.streaming import convergence, logs


def merged(plans, edges):
    """Brute force. plans: seeds in order; edges by plan: (kind, source, target, resolution)."""
    parent = list(range(len(plans)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    owners = {}
    for i, seeds in enumerate(plans):
        for s in seeds:
            owners.setdefault(s, []).append(i)
    for i, kind, source, target, resolution in edges:
        outside = kind == "call" and source is not None and source not in owners and target in plans[i]
        if resolution != "exact" or outside or target not in owners:
            continue
        for a in [i] if source in plans[i] else owners.get(source, [i]):
            x, y = sorted((root(a), root(min(owners[target]))))
            parent[y] = x
    return {i: root(i) for i in range(len(plans))}


def test_connected_plans_merge_but_not_for_outside_callers(spark):
    plans = [["a"], ["b"], ["c"], ["d", "e"], ["e"], ["f"], ["g"]]
    edges = [
        (0, "call", "a", "b", "exact"), (2, "call", "outside", "c", "exact"), (1, "call", "outside", "c", "exact"), (3, "import", "outside", "a", "ambiguous"), (5, "call", "e", "f", "exact"), (6, "import", None, "g", "exact"), (2, "import", "outside", "c", "exact"),
    ]
    rng = random.Random(1)
    for p, e in ((plans, edges), ([[rng.randrange(14) for _ in range(2)] for _ in range(20)], [(rng.randrange(20), rng.choice(["call", "import"]), rng.choice([None, *range(20)]), rng.randrange(20), rng.choice(["exact", "exact", "ambiguous"])) for _ in range(14)])):
        seeds = spark.createDataFrame([(i, str(s)) for i, x in enumerate(p) for s in x], "plan int, seed string")
        rows = spark.createDataFrame([(i, k, None if s is None else str(s), str(t), r) for i, k, s, t, r in e], "plan int, kind string, source string, target string, resolution string")
        want = merged([[str(s) for s in x] for x in p], [(i, k, None if s is None else str(s), str(t), r) for i, k, s, t, r in e])
        assert {r.plan: r.unit for r in units.merge_connected_plans(seeds, rows).collect()} == want


def test_failed_siblings_are_told_apart(spark):
    j = spark.createDataFrame([("u", 1, "a", None), ("u", 2, "b", "timeout"), ("u", 3, "c", "lost"), ("v", 1, "a", None)], "unit string, place int, label string, error string")
    got = {r.unit: (r.judgments, r.failed, r.clean, r.failures) for r in rounds.sibling_outcomes(j, "unit").collect()}
    assert got == {"u": (3, 2, False, ["timeout [knowledge judgment 2/3 for b]", "lost [knowledge judgment 3/3 for c]"]), "v": (1, 0, True, [])}
    f = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("v", 1, "z")], "unit string, place int, finding string")
    assert sorted(r.finding for r in rounds.standing_findings(f, j, "unit").collect()) == ["x", "z"]


CALLS = "unit string, error string, input_tokens int, output_tokens int, seconds double"


def test_figures_are_taken_in_passing(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 10, 2, 0.5), ("b", "lost", None, None, None), ("a", None, 5, 1, 1.0)], CALLS)
    seen_rows, seen = trace.observed(rows, "calls")
    seen_rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"calls": 3, "failed": 1, "input_tokens": 15, "output_tokens": 3, "seconds": 1.5}


def test_a_stream_is_metered_batch_by_batch(spark, tmp_path):
    for k, n in enumerate((3, 1)):
        spark.createDataFrame([("a", None if i else "lost", i, 1, 0.0) for i in range(n)], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = trace.PassListener("calls", lambda line: told.append(line) or 1 / 0)  # a sink that fails harms nothing
    spark.streams.addListener(listener)
    try:
        stream = logs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        stream.observe("calls", *trace.figures()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if sum(b["calls"] for b in listener.batches) == 4:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(b["calls"] for b in listener.batches) == spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sum(b["failed"] for b in listener.batches) == 2 and len(told) == 1


ROUNDS = "unit string, round bigint, at timestamp, new_findings int, clean boolean, pending boolean"


def test_convergence_as_a_stream(spark, tmp_path):
    rng, start = random.Random(7), datetime.datetime(2024, 1, 1)
    rows = [(u, r, start + datetime.timedelta(hours=r), rng.choice([0, 0, 1]), rng.random() < 0.9, rng.random() < 0.1) for u in "abc" for r in range(12)]
    for lo in range(0, 12, 3):
        spark.createDataFrame([x for x in rows if lo <= x[1] < lo + 3], ROUNDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [("a", -500, start - datetime.timedelta(days=30), 0, True, False)]  # older than the watermark
    spark.createDataFrame(late, ROUNDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = logs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    convergence.converged_stream(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.unit, r.round): r.converged for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.unit, r.round): r.converged for r in rounds.converged(spark.createDataFrame(rows, ROUNDS), ["unit"], "round", 3).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_days_close_with_their_watermark(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    for batch in ([(day(1, 5), "x"), (day(2), "x")], [(day(1, 9), "x"), (day(9), "y")], [(day(9, 5), "y")], [(day(1, 10), "x")], [(day(20), "z")]):  # the fourth batch is late
        spark.createDataFrame(batch, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = logs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = logs.rounds_by_day(stream, "2 days")
    out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.window.start.day, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "x"): 2, (2, "x"): 1, (9, "y"): 2}


def test_table_functions(spark):
    def judge(key, n):
        for i in range(n):
            if key == "bad" and i == 1:
                raise ValueError("broken")
            yield key, i

    table_functions.register(spark, "judge_rows", judge, "name string, i int")
    rows = spark.createDataFrame([("a", 2), ("bad", 3), ("none", 0), ("null", None)], "key string, n int")
    got = sorted(map(tuple, spark.sql("SELECT r.key, j.name, j.i, j.error FROM {r} r, LATERAL judge_rows(r.key, r.n) j", r=rows).collect()), key=repr)
    assert [g for g in got if g[0] != "null"] == [("a", "a", 0, None), ("a", "a", 1, None), ("bad", "bad", 0, None), ("bad", None, None, "ValueError: broken")]
    assert [g for g in got if g[0] == "null"][0][3].startswith("TypeError")


def test_folds_over_partitions(spark):
    def running(state, row):
        state[row["key"]] = state.get(row["key"], 0) + row["n"]
        if row["n"] < 0:
            raise ValueError("negative")
        yield row["key"], state[row["key"]]

    table_functions.register_fold(spark, "running_total", running, "name string, total int", dict)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", -1), ("c", 3)], "key string, n int")
    rows.createOrReplaceTempView("fold_rows")
    got = sorted(map(tuple, spark.sql("SELECT name, total, error FROM running_total(TABLE(fold_rows) PARTITION BY key ORDER BY n)").collect()), key=repr)
    assert got == [("a", 1, None), ("a", 3, None), ("b", 5, None), (None, None, "ValueError: negative")]
