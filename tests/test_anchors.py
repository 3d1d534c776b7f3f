"""Units around anchors against brute force on a made graph."""

from __future__ import annotations

import random

from auditlake.operators import anchors, units

F_ = anchors.FRAGMENT
EDGE = f"source {F_}, target {F_}, kind string, resolution string"


def plans_of(seeds, edges, depth, budget, with_seeds=True):
    """Brute force: {(anchor, caller): fragments taken in order}."""
    everything = {s for x in seeds.values() for s in x}
    out = {}
    for anchor, own in seeds.items():
        hops, frontier = {}, [e for e in edges if e[0] in own]
        for hop in range(1, depth + 1):
            fresh = [e for e in dict.fromkeys(frontier) if e not in hops]
            hops.update(dict.fromkeys(fresh, hop))
            frontier = [e for f in fresh if f[2] == "call" for e in edges if e[0] == f[1]]
        callers = {}
        for e in edges:
            if e[2] == "call" and e[1] in own and e[0] is not None and e[0] not in everything:
                callers.setdefault(e[0], []).append(e)
        for caller, inbound in (callers or {None: []}).items():
            order = sorted({**hops, **dict.fromkeys(inbound, 0)}.items(), key=lambda x: (x[1], x[0][3] == "ambiguous", x[0][0], x[0][1]))
            taken = sorted(own) + ([caller] if caller else [])
            for (source, target, _, _), _ in order:
                for end in (source, target):
                    counted = {*taken, end} if with_seeds else {*taken, end} - set(own)
                    if end not in taken and units.union_size(counted) <= budget:
                        taken.append(end)
            out[anchor, caller] = taken
    return out


def made_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    fragments = sorted({(f"f{rng.randrange(9)}", a := rng.randrange(60), a + rng.randrange(1, 25)) for _ in range(n)})
    edges = {(rng.choice([None, *fragments * 3]), rng.choice(fragments), rng.choice(["call", "call", "import"]), rng.choice(["exact", "exact", "ambiguous"])) for _ in range(m)}
    seeds = {}
    for f in fragments[::5]:
        seeds.setdefault(f[0], []).append(f)
    return seeds, sorted(edges, key=repr)


def frames(spark, seeds, edges):
    return spark.createDataFrame([(a, s) for a, x in seeds.items() for s in x], f"anchor string, seed {F_}"), spark.createDataFrame(edges, EDGE)


def test_plans_around_anchors(spark):
    for k, (depth, budget, with_seeds) in enumerate([(2, 90, True), (3, 40, False)]):
        seeds, edges = made_graph(k)
        rows = anchors.plan_anchors(*frames(spark, seeds, edges), depth, budget, with_seeds).orderBy("place").collect()
        got = {}
        for r in rows:
            if r.taken:
                got.setdefault((r.anchor, r.caller and tuple(r.caller)), []).append(tuple(r.fragment))
        assert got == plans_of(seeds, edges, depth, budget, with_seeds)
        assert {r.role for r in rows if not r.taken} == {"evidence"}


def test_all_units_of_a_review(spark):
    a, b, c = ("p/a.py", 0, 10), ("p/b.py", 5, 9), ("q/c.py", 0, 4)
    plans = anchors.plan_anchors(*frames(spark, {"p/a.py": [a]}, [(a, b, "call", "exact"), (c, a, "call", "exact"), (b, a, "call", "exact")]), 2, 100)
    files = spark.createDataFrame([("p/a.py", "x" * 8), ("q/long.py", "line\n" * 5), ("z/null.py", None)], "path string, text string")
    specs = spark.createDataFrame([("inside", a), ("inside", b), ("outside", a), ("outside", ("q/d.py", 0, 1))], f"spec string, fragment {F_}")
    targets = spark.createDataFrame([("p/t1.py",), ("p/t2.py",), ("p/t3.py",), ("q/t.py",)], "path string")
    rows = anchors.build_units(files, plans, specs, targets, cap=12, overlap=2, related=2).collect()
    got = {}
    for r in rows:
        got.setdefault((r.kind, r.unit), set()).add((r.file, r.start, r.end))
    assert got == {
        ("file", "p/a.py"): {("p/a.py", None, None), ("p/t1.py", None, None), ("p/t2.py", None, None)}, ("file", "z/null.py"): {("z/null.py", None, None)},
        ("window", "q/long.py#1"): {("q/long.py", 0, 10), ("q/t.py", None, None)}, ("window", "q/long.py#2"): {("q/long.py", 10, 20), ("q/t.py", None, None)}, ("window", "q/long.py#3"): {("q/long.py", 20, 25), ("q/t.py", None, None)},
        ("plan", "dependencies:p/a.py#1"): {a, b}, ("plan", "dependencies:p/a.py#2"): {a, b, c}, ("fact", "outside"): {a, ("q/d.py", 0, 1)},
    }


def test_sizes_of_plans_are_those_of_their_rows(spark):
    """Also with several groups an anchor, seeds that exceed the budget, and callers that are evidence."""
    from pyspark.sql import functions as F

    for k, (depth, budget, with_seeds) in enumerate([(2, 90, True), (3, 40, False), (2, 15, True)]):
        given = frames(spark, *made_graph(k, 40, 140))
        rows = anchors.plan_anchors(*given, depth, budget, with_seeds).groupBy("anchor", "caller").agg(F.count_if("taken").alias("n"), F.count_if(~F.col("taken")).alias("m"))
        got = anchors.plan_sizes(*given, depth, budget, with_seeds, together=2)
        assert sorted(map(repr, got.collect())) == sorted(repr(r).replace(" n=", " n_taken=").replace(" m=", " n_left_out=") for r in rows.collect())


def test_evidence_is_not_listed_again_for_each_caller(spark):
    """300 callers of an anchor with 300 fragments of evidence: 90,000 rows, if each plan had its own."""
    a = ("f", 0, 10)
    edges = [(a, ("e", k, k + 1), "import", "exact") for k in range(300)] + [(("c", k, k + 1), a, "call", "exact") for k in range(300)]
    sizes = anchors.plan_sizes(*frames(spark, {"f": [a]}, edges), 2, 20)
    assert [(r.n_taken, r.n_left_out) for r in sizes.collect()] == [(11, 291)] * 300
    assert spark.read.parquet(*{f.rpartition("/")[0] for f in sizes.inputFiles() if "/evidence-" in f}).count() == 300
