"""Review units: bounded evidence, plans, neighbours, set dominance, naming, worklists."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from .graph import components, written

Range = tuple[str, int, int]


def within_budget(rows: DataFrame, by: str, order: list[str], size: str, cap: int) -> DataFrame:
    """A column taken: rows in order are taken while their total stays within the cap; the first always, one that doesn't fit is passed over. A null size counts as none.

    Streams each group in order and holds one total.
    """
    schema = StructType([*rows.schema.fields, StructField("taken", BooleanType())])
    arrow = to_arrow_schema(schema)
    at_key, at_size = rows.columns.index(by), rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, begun = None, 0, False
        for batch in batches:
            taken = []
            for k, s in zip(batch.column(at_key).to_pylist(), batch.column(at_size).to_pylist(), strict=True):
                first = not begun or k != key
                if first:
                    key, total, begun = k, 0, True
                s = s or 0
                fits = first or total + s <= cap
                total += s * fits
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken)], schema=arrow)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def union_size(ranges: set[Range]) -> int:
    """Places covered by half-open ranges, each once."""
    total, reach = 0, {}
    for file, start, end in sorted(ranges):
        begin = max(start, reach.get(file, start))
        total += max(0, end - begin)
        reach[file] = max(end, reach.get(file, end))
    return total


class Cover:
    """Places covered by half-open ranges: disjoint ones per file in order, so what a range adds is found by search."""

    def __init__(self):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        self.size = 0

    def _met(self, file: str, start: int, end: int) -> tuple[list[int], list[int], int, int]:
        starts, ends = self.starts.setdefault(file, []), self.ends.setdefault(file, [])
        return starts, ends, bisect_left(ends, start), bisect_right(starts, end)

    def growth(self, file: str, start: int, end: int) -> int:
        """Places of a range that aren't covered yet."""
        if end <= start:
            return 0
        starts, ends, i, j = self._met(file, start, end)
        return end - start - sum(min(end, ends[k]) - max(start, starts[k]) for k in range(i, j))

    def add(self, file: str, start: int, end: int, most: float = inf) -> bool:
        """Adds a range if the size stays within `most`; whether it does."""
        starts = self.starts.get(file)
        if starts is None or end <= start:
            if self.size + max(0, end - start) > most:
                return False
            if end > start:
                self.starts[file], self.ends[file] = [start], [end]
                self.size += end - start
            return True
        ends = self.ends[file]
        i, j = bisect_left(ends, start), bisect_right(starts, end)
        size = self.size + end - start
        for k in range(i, j):
            size -= min(end, ends[k]) - max(start, starts[k])
        if size > most:
            return False
        self.size = size
        if i < j:
            start, end = min(start, starts[i]), max(end, ends[j - 1])
        starts[i:j], ends[i:j] = [start], [end]
        return True

    def pieces(self) -> list[Range]:
        return [(f, a, b) for f in self.starts for a, b in zip(self.starts[f], self.ends[f], strict=True)]

    @classmethod
    def of(cls, ranges) -> Cover:
        out = cls()
        for r in ranges:
            out.add(*r)
        return out


def choose_evidence(seeds: list[Range], edges: list[tuple[int, int, Range]], budget: int) -> list[Range]:
    """Seeds first, then by hop and exactness every end of an edge with which the union stays within the budget."""
    chosen, cover = set(seeds), Cover.of(seeds)
    for _, _, end in sorted(edges):
        if end not in chosen and cover.add(*end, budget):
            chosen.add(end)
    return sorted(chosen)


def pack_plans(plans: list[set[Range]], budget: int) -> list[list[int]]:
    """Plans in order joined into units while the union of their ranges stays within the budget; shared ranges count once."""
    units: list[list[int]] = []
    merged = Cover()
    for k, plan in enumerate(plans):
        own = Cover.of(plan)
        if units and merged.size + sum(merged.growth(*piece) for piece in own.pieces()) <= budget:
            units[-1].append(k)
            for piece in own.pieces():
                merged.add(*piece)
        else:
            units.append([k])
            merged = own
    return units


def plan_units(plans: DataFrame, by: str, budget: int) -> DataFrame:
    """by, plan, unit from rows (by, plan, file, lo, hi). Streams a run's plans in order and holds one plan and the unit that it may join."""
    types = dict(plans.dtypes)
    schema = StructType.fromDDL(f"{by} {types[by]}, plan {types['plan']}, unit bigint")
    arrow = to_arrow_schema(schema)

    def joins(merged: Cover, own: list[Range]) -> bool:
        if len(own) == 1:
            return merged.add(*own[0], budget)
        pieces = Cover.of(own).pieces()
        fits = merged.size + sum(merged.growth(*piece) for piece in pieces) <= budget
        if fits:
            for piece in pieces:
                merged.add(*piece)
        return fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan = object()  # before the first row
        unit, own, merged, out = -1, [], Cover(), ([], [], [])

        def end() -> None:
            """The plan joins the unit, or begins the next."""
            nonlocal unit, merged
            if unit < 0 or not joins(merged, own):
                unit, merged = unit + 1, Cover.of(own)
            out[0].append(key)
            out[1].append(plan)
            out[2].append(unit)

        for batch in batches:
            for k, p, *place in zip(*map(_values, batch.columns), strict=True):
                if p != plan or k != key:
                    if own:
                        end()
                    if k != key:
                        unit = -1
                    key, plan, own = k, p, []
                own.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
            out = ([], [], [])
        if own:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    whole = lambda *names: [F.col(c).cast("bigint").alias(c) for c in names]
    rows = plans.select(by, "plan", F.col("file").cast("string").alias("file"), *whole("lo", "hi"))
    return rows.repartition(by).sortWithinPartitions(by, "plan").mapInArrow(run, schema)


def evidence_units(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """by, file, lo, hi chosen from rows (by, hop, ambiguous, file, lo, hi); hop 0 are the seeds. Streams a unit's rows in order and holds what is chosen of one unit."""
    schema = StructType.fromDDL(f"{by} {dict(rows.dtypes)[by]}, file string, lo bigint, hi bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chosen, cover = object(), set(), Cover()  # before the first row
        for batch in batches:
            taken = []
            for k, *place, seed in zip(*map(_values, batch.columns), strict=True):
                if k != key:
                    key, chosen, cover = k, set(), Cover()
                end = tuple(place)
                fits = end not in chosen and cover.add(*end, inf if seed else budget)
                if fits:
                    chosen.add(end)
                taken.append(fits)
            kept = batch.filter(pa.array(taken, pa.bool_()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns[:4], arrow, strict=True)], schema=arrow)

    whole = lambda *names: [F.col(c).cast("bigint").alias(c) for c in names]
    typed = rows.select(by, F.col("file").cast("string").alias("file"), *whole("lo", "hi", "hop", "ambiguous"), (F.col("hop") == 0).alias("seed"))
    return typed.repartition(by).sortWithinPartitions(by, F.col("seed").desc(), "hop", "ambiguous", "file", "lo", "hi").select(by, "file", "lo", "hi", "seed").mapInArrow(run, schema)


def _values(column: pa.Array) -> list:
    """A column as Python values; numbers without nulls go by numpy, which is faster."""
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def undominated(specs: DataFrame, by: str, key: str, items: str) -> DataFrame:
    """Specs (by, key, items array) whose set lies in no larger one of their group, nor in an equal one before them.

    A set can only lie in one that holds its least item, so pairs meet on that item.
    """
    a = specs.select(by, F.col(key).alias("_a"), F.array_distinct(items).alias("_x"), F.array_min(items).alias("_item"))
    b = specs.select(by, F.col(key).alias("_b"), F.array_distinct(items).alias("_y"), F.explode(F.array_distinct(items)).alias("_item"))
    larger = (F.size("_y") > F.size("_x")) | ((F.size("_y") == F.size("_x")) & (F.col("_b") < F.col("_a")))
    held = a.join(b, [by, "_item"]).filter((F.col("_a") != F.col("_b")) & larger & (F.size(F.array_except("_x", "_y")) == 0))
    return specs.join(held.select(by, F.col("_a").alias(key)).distinct(), [by, key], "left_anti")


def not_covered(facts: DataFrame, units: DataFrame, key: str, items: str) -> DataFrame:
    """Fact units (key, items) whose fragments aren't all in one of the units (items)."""
    a = facts.select(F.col(key).alias("_a"), F.array_distinct(items).alias("_x"), F.array_min(items).alias("_item"))
    b = units.select(F.array_distinct(items).alias("_y"), F.explode(F.array_distinct(items)).alias("_item"))
    held = a.join(b, "_item").filter(F.size(F.array_except("_x", "_y")) == 0).select(F.col("_a").alias(key)).distinct()
    return facts.join(held, key, "left_anti")


def numbered_names(rows: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """A column name: the base, numbered from 1 where it occurs more than once."""
    w = Window.partitionBy(base)
    return rows.withColumn("name", F.when(F.count("*").over(w) == 1, base).otherwise(F.concat(base, F.lit("-"), F.row_number().over(w.orderBy(*order)).cast("string"))))


def first_known(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, path: of each row's paths (array, in order of preference) the first that is known."""
    each = candidates.select(key, F.posexplode("paths").alias("pos", "path"))
    return each.join(known.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "pos").alias("path"))


def ancestors(owners: DataFrame, rounds: int = 64) -> DataFrame:
    """node, ancestor, steps of an owner tree (node, owner), by doubling; a cycle or a missing owner raises ValueError."""
    missing = owners.filter("owner IS NOT NULL").select(F.col("owner").alias("node")).distinct().join(owners, "node", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"owner without a row: {missing.first()[0]}")
    up = written(owners.filter("owner IS NOT NULL").select("node", F.col("owner").alias("ancestor"), F.lit(1).alias("steps")), "up")
    total, length = up, 1
    for _ in range(rounds):
        # What is `length` steps above is followed by everything known above that.
        top = up.filter(F.col("steps") == length).select("node", F.col("ancestor").alias("_mid"))
        more = top.join(total.select(F.col("node").alias("_mid"), "ancestor", (F.col("steps") + length).alias("steps")), "_mid").select("node", "ancestor", "steps")
        more = written(more, "up")
        if more.isEmpty():
            return total
        if not more.filter("node = ancestor").isEmpty():
            raise ValueError(f"owner cycle at {more.filter('node = ancestor').first()[0]}")
        total = written(total.unionByName(more), "up")
        up, length = total, length * 2
    raise ValueError("owner tree deeper than the rounds allow")


def merge_worklist(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """slug, status: wanted units keep the status they have, new ones are open, stale ones go."""
    return wanted.select("slug").distinct().join(old.groupBy("slug").agg(F.max("status").alias("status")), "slug", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def mark_reviewed(worklist: DataFrame, clean: DataFrame) -> DataFrame:
    done = clean.select("slug").distinct().withColumn("_done", F.lit(True))
    return worklist.join(done, "slug", "left").withColumn("status", F.when(F.col("_done"), "reviewed").otherwise(F.col("status"))).drop("_done")


def receipts(rows: DataFrame, by: str) -> DataFrame:
    """Required, included and missing identities of each unit: what was omitted, or required and not included. complete if none is missing."""
    sets = rows.groupBy(by).agg(*(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("identity")))).alias(s) for s in ("required", "included", "omitted")))
    missing = F.array_sort(F.array_union("omitted", F.array_except("required", "included")))
    return sets.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def reason_summary(rows: DataFrame, by: str, reason: str, shown: int = 3) -> DataFrame:
    """Distinct reasons in order, the first few joined, and how many more there are."""
    all_ = F.array_sort(F.collect_set(reason))
    out = rows.groupBy(by).agg(all_.alias("r"))
    more = F.when(F.size("r") > shown, F.concat(F.lit("; +"), (F.size("r") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(by, F.concat(F.array_join(F.slice("r", 1, shown), "; "), more).alias("summary"))


def exchange(requests: DataFrame, catalogue: DataFrame, budget: int) -> DataFrame:
    """unit, n_granted, state of evidence requests (unit, request, evidence_id): one request, known ids and the budget, or else incomplete."""
    known = catalogue.groupBy("evidence_id").agg(F.max("size").alias("size"))
    r = requests.join(known, "evidence_id", "left").groupBy("unit").agg(F.count_distinct("request").alias("n"), F.count_if(F.col("size").isNull()).alias("unknown"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("size").alias("n_granted"))
    state = F.when(F.col("n") > 1, "second request").when(F.col("unknown") > 0, "unknown evidence").when(F.col("total") > budget, "over budget").otherwise("granted")
    return r.select("unit", "n_granted", state.alias("state"))


def run_until_converged(judge: Callable[[int], DataFrame], key: Column, k: int, most: int) -> tuple[DataFrame | None, list[int], bool]:
    """(pool of keys, new identities per round, converged): rounds of judge(round) until k in a row bring nothing new. The pool is written each round."""
    pool, new = None, []
    for number in range(most):
        keys = judge(number).select(key.alias("key")).distinct()
        fresh = written(keys if pool is None else keys.join(pool, "key", "left_anti"), "pool")
        new.append(fresh.count())
        pool = fresh if pool is None else pool.unionByName(fresh)
        if len(new) >= k and not any(new[-k:]):
            return pool, new, True
    return pool, new, False


def merge_connected_plans(seeds: DataFrame, dependencies: DataFrame) -> DataFrame:
    """plan, unit: plans that depend on each other's seeds become one unit, named by its first plan. seeds: plan (its place), seed. dependencies: plan, kind, source, target, resolution.

    Exact dependencies join the owners of their source (the plan itself where it has that seed, or nobody has) to the first owner of their target. A call into a plan's own seed from a
    source that no plan has is left out: whoever calls from outside doesn't bring plans together.
    """
    owners = written(seeds.select("plan", "seed").distinct(), "owners")
    first = owners.groupBy(F.col("seed").alias("target")).agg(F.min("plan").alias("owner"))
    has = lambda c, name: owners.select("plan", F.col("seed").alias(c), F.lit(True).alias(name))
    owned = owners.select(F.col("seed").alias("source")).distinct().withColumn("_owned", F.lit(True))
    d = dependencies.filter("resolution = 'exact'").select("plan", "kind", "source", "target").distinct()
    d = d.join(has("source", "_own_source"), ["plan", "source"], "left").join(has("target", "_own_target"), ["plan", "target"], "left").join(owned, "source", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    inbound = (F.col("kind") == "call") & F.col("source").isNotNull() & ~is_("_owned") & is_("_own_target")
    d = written(d.filter(~F.coalesce(inbound, F.lit(False))).join(first, "target"), "joined")
    own = is_("_own_source") | ~is_("_owned")
    others = d.filter(~own).select("source", "owner").distinct().join(owners.select(F.col("seed").alias("source"), "plan"), "source")
    edges = d.filter(own).select(F.col("plan").alias("src"), F.col("owner").alias("dst")).unionByName(others.select(F.col("plan").alias("src"), F.col("owner").alias("dst"))).distinct()
    roots = components(edges)
    return owners.select("plan").distinct().join(roots, F.col("plan") == F.col("node"), "left").select("plan", F.coalesce("root", "plan").alias("unit"))


def related_order() -> list[Column]:
    """Order of related files: required targets, preferred ones, those that share most names with changed peers, direct targets, most required, most names of the seed's text, path."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [~F.col("required"), ~F.col("preferred"), -none("peer_names"), ~F.col("direct"), -none("target_score"), -none("name_hits"), F.col("path")]
