"""Units of a review grown around anchors: the definitions of a file, what they depend on, and who calls them, within a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import written
from .replies import text_windows
from .units import Cover, not_covered

FRAGMENT = "struct<file:string,start:bigint,end:bigint>"


def reached_edges(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """anchor, source, target, kind, resolution, hop: edges that leave an anchor's seeds, and those that leave what these call, at most `depth` steps away, each at its nearest.

    seeds: anchor, seed. edges: source, target (fragments), kind, resolution. One written round a step.
    """
    known = written(edges.select("source", "target", "kind", "resolution").filter("source IS NOT NULL").distinct(), "edges")
    frontier = seeds.select("anchor", F.col("seed").alias("source")).distinct()
    reached = None
    for hop in range(1, depth + 1):
        step = frontier.join(known, "source").withColumn("hop", F.lit(hop))
        if reached is not None:
            step = step.join(reached.select("anchor", "source", "target", "kind", "resolution"), ["anchor", "source", "target", "kind", "resolution"], "left_anti")
        step = written(step.select("anchor", "source", "target", "kind", "resolution", "hop"), "reached")
        reached = step if reached is None else reached.unionByName(step)
        if step.isEmpty():
            break
        frontier = step.filter("kind = 'call'").select("anchor", F.col("target").alias("source")).distinct()
    return reached


def surfaces_and_edges(seeds: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written: own (anchor, seed), surfaces (anchor, caller; null where nobody calls), outbound edges of each anchor as reached_edges gives them, inbound ones (with caller and hop 0)."""
    own = written(seeds.select("anchor", "seed").distinct(), "seeds")
    outbound = reached_edges(own, edges, depth)
    calls = edges.filter("kind = 'call' AND source IS NOT NULL").select("source", "target", "kind", "resolution").distinct()
    inbound = own.join(calls, F.col("seed") == F.col("target")).join(own.select(F.col("seed").alias("source")).distinct(), "source", "left_anti")
    inbound = written(inbound.select("anchor", F.col("source").alias("caller"), "source", "target", "kind", "resolution", F.lit(0).alias("hop")), "inbound")
    surfaces = written(own.select("anchor").distinct().join(inbound.select("anchor", "caller").distinct(), "anchor", "left"), "surfaces")
    return own, surfaces, outbound, inbound


def evidence_ends(reached: DataFrame, *by: str) -> DataFrame:
    """by, fragment, at (its place in the order of evidence) of each end of the edges: nearest and exact ones first, the source before the target."""
    late = (F.col("resolution") == "ambiguous").cast("int")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("fragment")), F.struct(F.lit(1).alias("side"), F.col("target").alias("fragment")))
    rows = reached.select(*by, F.explode(ends).alias("e"), F.struct(F.lit(2).alias("rank"), "hop", late.alias("late"), F.struct("source", "target").alias("edge")).alias("at"))
    return rows.select(*by, "e.fragment", F.struct("at.rank", "at.hop", "at.late", "at.edge", "e.side").alias("at"))


def plan_sizes(seeds: DataFrame, edges: DataFrame, depth: int, budget: int, with_seeds: bool = True, together: int = 256) -> DataFrame:
    """anchor, caller, n_taken, n_left_out: how many fragments each plan of plan_anchors takes and leaves out, without its rows.

    Plans of an anchor differ in their caller alone, since a call's ends are the caller and a seed, which are in anyway. So the evidence of an anchor is listed once. Plans whose seeds alone
    exceed the budget take no evidence, which is counted; the others go through it side by side, at most `together` to a task's group, each with the ranges that it has.
    """
    own, surfaces, outbound, _ = surfaces_and_edges(seeds, edges, depth)
    shared = evidence_ends(outbound, "anchor").groupBy("anchor", "fragment").agg(F.min("at").alias("at"))
    shared = written(shared.join(own.withColumnRenamed("seed", "fragment"), ["anchor", "fragment"], "left_anti"), "evidence")
    # Places that an anchor's seeds cover: each range from the farthest end before it.
    before = Window.partitionBy("anchor", "seed.file").orderBy("seed.start", "seed.end").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("seed.start", F.coalesce(F.max("seed.end").over(before), F.col("seed.start")))
    fresh = F.greatest(F.lit(0), F.col("seed.end") - begin)
    sizes = own.select("anchor", fresh.alias("fresh")).groupBy("anchor").agg(F.sum("fresh").alias("base"), F.count("*").alias("n_seeds"))
    caller = surfaces.filter("caller IS NOT NULL")
    listed = shared.groupBy("anchor").agg(F.count("*").alias("n_evidence"))
    named = caller.join(shared.select("anchor", F.col("fragment").alias("caller")), ["anchor", "caller"]).select("anchor", F.col("caller").alias("_c"), F.lit(1).alias("among"))
    plans = surfaces.join(sizes, "anchor").join(listed, "anchor", "left").withColumnRenamed("anchor", "_a")
    plans = plans.join(named, (F.col("_a") == F.col("anchor")) & (F.col("caller") == F.col("_c")), "left").drop("anchor", "_c").withColumnRenamed("_a", "anchor")
    fixed = F.col("n_seeds") + F.col("caller").isNotNull().cast("int")
    n_evidence = F.coalesce("n_evidence", F.lit(0)) - F.coalesce("among", F.lit(0))
    plans = written(plans.select("anchor", "caller", "base", fixed.alias("fixed"), n_evidence.alias("n_evidence")), "plans")
    # A cover only grows.
    full = (F.col("base") > budget) if with_seeds else F.lit(False)
    closed = plans.filter(full).select("anchor", "caller", F.col("fixed").alias("n_taken"), F.col("n_evidence").alias("n_left_out"))
    open_ = plans.filter(~full)
    return closed.unionByName(_open_plans(open_, own, shared, budget, with_seeds, together))


def _open_plans(plans: DataFrame, own: DataFrame, shared: DataFrame, budget: int, with_seeds: bool, together: int) -> DataFrame:
    """plan_sizes of plans (anchor, caller, fixed, n_evidence) that may take evidence. Rows of a group: its seeds, its callers, then the anchor's evidence in order."""
    schema = StructType.fromDDL(f"anchor string, caller {FRAGMENT}, n_taken bigint, n_left_out bigint")
    arrow = to_arrow_schema(schema)
    numbered = plans.withColumn("block", F.pmod(F.hash("caller"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("anchor")) / together))))
    numbered = written(numbered.select("anchor", "block", "caller", "fixed", "n_evidence"), "open")
    groups = numbered.select("anchor", "block").distinct()
    none, zero = F.lit(None).cast(dict(shared.dtypes)["at"]).alias("at"), F.lit(0).cast("bigint")
    first = groups.join(own, "anchor").select("anchor", "block", F.lit(0).alias("rank"), none, F.col("seed").alias("fragment"), zero.alias("fixed"), zero.alias("n"))
    callers = numbered.select("anchor", "block", F.lit(1).alias("rank"), none, F.col("caller").alias("fragment"), F.col("fixed").cast("bigint").alias("fixed"), F.col("n_evidence").cast("bigint").alias("n"))
    later = groups.join(shared, "anchor").select("anchor", "block", F.lit(2).alias("rank"), "at", "fragment", zero.alias("fixed"), zero.alias("n"))
    rows = first.unionByName(callers).unionByName(later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seeds, held = object(), [], []

        def told() -> pa.RecordBatch:
            columns = [group[0]] * len(held), [c for c, *_ in held], [fixed + taken for _, _, fixed, _, taken in held], [n - taken for _, _, _, n, taken in held]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for anchor, block, rank, fragment, fixed, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (anchor, block) != group:
                    if held:
                        yield told()
                    group, seeds, held = (anchor, block), [], []
                r = fragment and (fragment["file"], fragment["start"], fragment["end"])
                if rank == 0:
                    if with_seeds:
                        seeds.append(r)
                elif rank == 1:
                    cover = Cover.of(seeds + [r] * (fragment is not None))
                    held.append([fragment, cover, fixed, n, 0])
                else:
                    for plan in held:
                        if plan[0] != fragment and plan[1].add(*r, budget):
                            plan[4] += 1
        if held:
            yield told()

    dealt = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "rank", "at").select("anchor", "block", "rank", "fragment", "fixed", "n")
    return dealt.mapInArrow(run, schema)


def plan_anchors(seeds: DataFrame, edges: DataFrame, depth: int, budget: int, with_seeds: bool = True) -> DataFrame:
    """anchor, caller, place, fragment, role (seed, caller, evidence), taken: the fragments of each plan in order. An anchor has a plan for each definition that calls into its seeds from outside all seeds; without callers one, whose caller is null.

    Seeds and the caller are always in. Then, nearest and exact edges first, each edge's ends come in while the union of all ranges stays within the budget (without
    with_seeds the seeds' places aren't counted); what doesn't fit is passed over. A task holds the ranges of one plan. The rows are each anchor's fragments times its callers; plan_sizes counts them without making them.
    """
    own, surfaces, outbound, inbound = surfaces_and_edges(seeds, edges, depth)
    reached = outbound.join(surfaces, "anchor").select(*inbound.columns).unionByName(inbound)
    evidence = evidence_ends(reached, "anchor", "caller")
    fixed = lambda rank: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("hop"), F.lit(0).alias("late"), F.struct("fragment", "fragment").cast(f"struct<source:{FRAGMENT},target:{FRAGMENT}>").alias("edge"), F.lit(0).alias("side")).alias("at")
    first = surfaces.join(own, "anchor").select("anchor", "caller", F.col("seed").alias("fragment")).select("anchor", "caller", "fragment", fixed(0))
    forced = surfaces.filter("caller IS NOT NULL").select("anchor", "caller", F.col("caller").alias("fragment")).select("anchor", "caller", "fragment", fixed(1))
    rows = first.unionByName(forced).unionByName(evidence).groupBy("anchor", "caller", "fragment").agg(F.min("at").alias("at"))
    schema = StructType.fromDDL(f"anchor string, caller {FRAGMENT}, place bigint, fragment {FRAGMENT}, role string, taken boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, cover, place = None, Cover(), 0
        for batch in batches:
            places, taken = [], []
            for anchor, caller, f, rank in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (anchor, caller) != plan:
                    plan, cover, place = (anchor, caller), Cover(), 0
                r = f["file"], f["start"], f["end"]
                fits = rank < 2 or cover.size + cover.growth(*r) <= budget
                if fits and (rank or with_seeds):
                    cover.add(*r)
                places.append(place)
                taken.append(fits)
                place += 1
            roles = [("seed", "caller", "evidence")[k] for k in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(2), pa.array(roles, pa.string()), pa.array(taken, pa.bool_())], schema=arrow)

    keyed = rows.select("anchor", "caller", "fragment", F.col("at.rank").alias("rank"), "at")
    return keyed.repartition("anchor", "caller").sortWithinPartitions("anchor", "caller", "at").drop("at").mapInArrow(run, schema)


def build_units(candidates: DataFrame, plans: DataFrame, specs: DataFrame, targets: DataFrame, cap: int, overlap: int, related: int) -> DataFrame:
    """unit, kind (file, window, plan, fact), file, start, end: all units of a review.

    Each candidate file (path, text) is a unit, or one for each window of a long one, with the first `related` targets (path) of its first folder beside it. plans are those of plan_anchors. A fact unit (spec, fragment)
    is one of its own unless one plan holds all its fragments. Ranges of whole files are null.
    """
    windows = text_windows(candidates, "path", "text", cap, overlap).withColumn("n", F.count("*").over(Window.partitionBy("path")))
    one = F.col("n") == 1
    whole = lambda c: F.when(one, F.lit(None).cast("bigint")).otherwise(F.col(c).cast("bigint")).alias(c)
    files = windows.select(F.when(one, F.col("path")).otherwise(F.concat("path", F.lit("#"), (F.col("window") + 1).cast("string"))).alias("unit"), F.when(one, "file").otherwise("window").alias("kind"), F.col("path").alias("file"), whole("start"), whole("end"))
    package = F.substring_index("path", "/", 1)
    near = targets.select("path", package.alias("package")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy("path"))).filter(F.col("k") <= related)
    beside = files.withColumn("package", F.substring_index("file", "/", 1)).join(near, "package").select("unit", "kind", F.col("path").alias("file"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    taken = plans.filter("taken").select("anchor", "caller", "fragment")
    numbers = taken.select("anchor", "caller").distinct().withColumns({"k": F.row_number().over(Window.partitionBy("anchor").orderBy("caller")), "n": F.count("*").over(Window.partitionBy("anchor"))})
    numbers = numbers.select(F.col("anchor").alias("_a"), F.col("caller").alias("_c"), F.concat(F.lit("dependencies:"), "anchor", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")).alias("unit"))
    planned = taken.join(numbers, (F.col("anchor") == F.col("_a")) & F.col("caller").eqNullSafe(F.col("_c"))).select("unit", F.lit("plan").alias("kind"), "fragment.*")
    sets = lambda rows, by: rows.groupBy(*by).agg(F.array_sort(F.collect_set("fragment")).alias("items"))
    open_ = not_covered(sets(specs, ["spec"]), sets(taken, ["anchor", "caller"]).select("items").distinct(), "spec", "items").select("spec")
    facts = specs.join(open_, "spec").select(F.col("spec").alias("unit"), F.lit("fact").alias("kind"), "fragment.*").distinct()
    return files.unionByName(beside).unionByName(planned).unionByName(facts)
