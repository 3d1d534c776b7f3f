"""Scoring reports against answer keys: routes, files and symbols that match, optimal assignment, recall and precision, repeated runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from .graph import written

#: Groups with at most so many rows on each side are compared pair by pair.
SMALL = {"reports": 64, "checks": 64, "definitions": 1024}


def match_weight(endpoint: Column, category: Column, file: Column) -> Column:
    """4 for file and category, 3 for endpoint and category, 2 for endpoint or category, 1 for a match by file alone, 0 for none."""
    return F.when(file & category, 4).when(endpoint & category, 3).when(endpoint | (category & file), 2).when(file, 1).otherwise(0)


def assign_edges(edges: list[dict[int, int]], m: int) -> list[int | None]:
    """Column of each row, from the rows' columns with positive weights: as many pairs as possible, then the greatest weight.

    Augmenting paths of greatest gain, over the edges alone. Rows and columns are taken in the order given, which decides between equal optima.
    """
    n = len(edges)
    row_of: list[int | None] = [None] * m
    column_of: list[int | None] = [None] * n
    ordered = [sorted(e.items()) for e in edges]
    while True:
        # Longest gains from any free row; a cell is left by its column's present row.
        gain: list[float] = [0.0 if column_of[i] is None else float("-inf") for i in range(n)]
        came: list[tuple[int, int] | None] = [None] * n
        queue, best, end = deque(i for i in range(n) if column_of[i] is None), float("-inf"), None
        waiting = set(queue)
        while queue:
            i = queue.popleft()
            waiting.discard(i)
            for j, w in ordered[i]:
                if column_of[i] == j:
                    continue
                other = row_of[j]
                if other is None:
                    if gain[i] + w > best:
                        best, end = gain[i] + w, (i, j)
                elif gain[i] + w - edges[other][j] > gain[other]:
                    gain[other], came[other] = gain[i] + w - edges[other][j], (i, j)
                    if other not in waiting:
                        queue.append(other)
                        waiting.add(other)
        if end is None:
            return column_of
        i, j = end
        while True:
            before = column_of[i]
            column_of[i], row_of[j] = j, i
            if came[i] is None or before is None:
                break
            i, j = came[i]


def assign(weights: list[tuple[int, ...]]) -> list[int | None]:
    """The same for a table of weights, where 0 means no match."""
    m = len(weights[0]) if weights else 0
    if any(len(w) != m for w in weights):
        raise ValueError("ragged weights")
    return assign_edges([{j: w for j, w in enumerate(row) if w > 0} for row in weights], m)


def optimal_assignment(pairs: DataFrame, by: str) -> DataFrame:
    """Chosen pairs (row_id, col_id, weight) of each group from its weighted pairs. Groups go through a task one after the other, in order; it holds the edges of one group, not the product of its sides."""
    best = pairs.filter("weight > 0").groupBy(by, "row_id", "col_id").agg(F.max("weight").cast("bigint").alias("weight"))
    schema = best.schema
    arrow = to_arrow_schema(schema)

    def solve(group, rows: list[tuple]) -> list[tuple]:
        at = {r: i for i, r in enumerate(sorted({r for r, _, _ in rows}))}
        place = {c: j for j, c in enumerate(sorted({c for _, c, _ in rows}))}
        edges: list[dict[int, int]] = [{} for _ in at]
        for r, c, w in rows:
            edges[at[r]][place[c]] = w
        names, columns = list(at), list(place)
        return [(group, names[i], columns[j], edges[i][j]) for i, j in enumerate(assign_edges(edges, len(place))) if j is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, begun = None, [], False
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, arrow, strict=True)], schema=arrow)
        for batch in batches:
            out = []
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and group != now:
                    out += solve(now, held)
                    held = []
                now, begun = group, True
                held.append(tuple(row))
            yield told(out)
        if held:
            yield told(solve(now, held))

    return best.repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)


def claims(pairs: DataFrame) -> DataFrame:
    """Each report credits one clean check at most: the first in check order."""
    return pairs.groupBy("report").agg(F.min("check_id").alias("check_id"))


def result(checks: DataFrame, by: list[str]) -> DataFrame:
    """found, missed, false positives, recall and precision. checks: expectation (finding or clean) and hit."""
    finding, hit = F.col("expectation") == "finding", F.col("hit")
    counted = checks.groupBy(*by).agg(F.count_if(finding & hit).alias("found"), F.count_if(finding & ~hit).alias("missed"), F.count_if(~finding & hit).alias("false_positives"), F.count_if(finding).alias("n_findings"))
    return counted.withColumns({"recall": T.ratio(F.col("found"), F.col("n_findings"), 4, 0.0), "precision": T.ratio(F.col("found"), F.col("found") + F.col("false_positives"), 4, 1.0)})


def repeated(hits: DataFrame, by: list[str], runs: int) -> DataFrame:
    """Over runs: how often each check was hit, found by strict majority, flaky, and its catch rate."""
    f = hits.groupBy(*by).agg(F.count_if("hit").alias("freq"))
    return f.withColumns({"majority": F.col("freq") * 2 > runs, "flaky": (F.col("freq") > 0) & (F.col("freq") < runs), "catch_rate": T.ratio(F.col("freq"), F.lit(runs), 3, 0.0)})


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^\./", "")


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stars(segments: Column) -> Column:
    """Which segments are parameters: one character each."""
    return F.array_join(F.transform(segments, lambda x: F.when(x == "*", "*").otherwise("-")), "")


def _route_keys(reports: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without their route (normalised) but with method and key, one row for each key: a report and a check that share one have the same route, but for the method.

    The shorter route stands at the end of the longer. Routes with parameters in some places and those with parameters in others meet on all segments that are
    none on either side, so only routes that match meet. Which places occur is a small table: parameters' places, not routes.
    """
    ends = lambda way: F.transform("seg", lambda x, i: F.struct(way(i).alias("way"), F.slice("seg", i + 1, F.size("seg") - i).alias("tail")))
    # Way 0: the report's whole route against ends of the check's. Way 1: an end of the report's against the check's whole route.
    ways = ends(lambda i: F.when(i == 0, 0).otherwise(1)), F.concat(ends(lambda i: F.lit(0)), F.array(F.struct(F.lit(1).alias("way"), F.col("seg").alias("tail"))))
    sides = []
    for rows, own, way in zip((reports, checks), ("_rs", "_cs"), ways, strict=True):
        parts = rows.withColumns({"method": T.endpoint_method(F.col("route")), "seg": T.endpoint_segments(F.col("route"))}).filter(F.size("seg") > 0)
        sides.append(parts.select("*", F.inline(way)).withColumn(own, _stars(F.col("tail"))).drop("route", "seg"))
    r, c = sides
    fits = (F.length("_rs") == F.length("_cs")) & (F.substring("_rs", 1, 1) == F.substring("_cs", 1, 1))
    places = written(r.select("way", "_rs").distinct().join(c.select("way", "_cs").distinct(), "way").filter(fits), "places")
    fixed = F.filter("tail", lambda x, i: (F.substring("_rs", i + 1, F.lit(1)) == "-") & (F.substring("_cs", i + 1, F.lit(1)) == "-"))

    def keyed(rows: DataFrame, own: str, other: str) -> DataFrame:
        others = places.groupBy("way", own).agg(F.collect_list(other).alias("_o"))
        met = rows.join(F.broadcast(others), ["way", own]).withColumn(other, F.explode("_o"))
        return met.withColumn("key", F.concat_ws("/", "way", "_rs", "_cs", fixed)).drop("way", "_rs", "_cs", "_o", "tail")

    return keyed(r, "_rs", "_cs"), keyed(c, "_cs", "_rs")


def _one_method(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def route_candidates(reports: DataFrame, checks: DataFrame, by: list[str]) -> DataFrame:
    """The columns by, report, check_id of reports (by, report, route) and checks (by, check_id, route), normalised, that are the same route. See _route_keys."""
    r, c = _route_keys(reports.select(*by, "report", "route"), checks.select(*by, "check_id", "route"))
    met = r.join(c.withColumnRenamed("method", "_m"), [*by, "key"])
    return met.filter(_one_method(F.col("method"), F.col("_m"))).select(*by, "report", "check_id").distinct()


def _whole(rows: DataFrame) -> DataFrame:
    """Reports or checks with every column that is looked at: a single file stands for locations and files, missing texts and symbols are empty."""
    has = F.coalesce(F.col("file"), F.lit("")) != "" if "file" in rows.columns else F.lit(False)
    file = F.col("file") if "file" in rows.columns else F.lit("")
    none = {"locations": F.when(has, F.array(F.struct(file.alias("file"), F.lit(None).cast("int").alias("line")))).otherwise(F.array().cast("array<struct<file:string,line:int>>")), "text": F.lit("")}
    none |= {"files": F.when(has, F.array(file)).otherwise(F.array().cast("array<string>")), "symbols": F.array().cast("array<string>")}
    wanted = ("locations", "text") if "report" in rows.columns else ("files", "symbols")
    return rows.withColumns({c: none[c] for c in wanted if c not in rows.columns})


def _large_groups(reports: DataFrame, checks: DataFrame, definitions: DataFrame | None, by: str) -> DataFrame:
    """Groups with more rows on any side than SMALL tells."""
    sides = {"reports": reports, "checks": checks, "definitions": definitions}
    many = [rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > SMALL[name]) & F.col(by).isNotNull()).select(by) for name, rows in sides.items() if rows is not None]
    return written(reduce(DataFrame.unionByName, many).distinct(), "large")


def _looked_at(reports: DataFrame, checks: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Reports and checks with what is compared, each text and path brought into form once."""
    r = reports.select(by, "report", F.coalesce("endpoint", F.lit("")).alias("re"), T.category_spelling(F.col("category")).alias("rc"), F.lower(F.concat_ws(" ", "text", "endpoint")).alias("hay"), "locations")
    r = r.withColumns({"rfiles": F.array_distinct(F.transform(F.coalesce("locations", F.array()), lambda x: x["file"])), "rt": T.spelling_tokens(F.col("rc"))})
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    c = checks.select(
        by, "check_id", (F.col("expectation") != "finding").alias("clean"), some("files").alias("cfiles"), F.transform(some("symbols"), F.lower).alias("symbols"), F.coalesce("endpoint", F.lit("")).alias("ce"), (F.coalesce("category", F.lit("")) == "").alias("any_class"), T.category_spelling(F.col("category")).alias("cs")
    )
    c = c.withColumns({"ct": T.spelling_tokens(F.col("cs")), "keyed": F.col("ce") != "", "has_files": F.size("cfiles") > 0, "has_symbols": F.size("symbols") > 0})
    # A name counts where one file of the report has it; exact paths are looked at apart.
    bases = F.transform("rfiles", _base)
    alone = F.filter(F.array_distinct(bases), lambda x: F.size(F.filter(bases, lambda y: y == x)) == 1)
    return r.withColumn("once", F.when(F.size("rfiles") < 2, bases).otherwise(alone)).drop("rc"), c.drop("cs")


_SPANS = "array<struct<file:string,name:string,lo:bigint,hi:bigint>>"


def _span() -> Column:
    return F.struct("file", F.lower("name").alias("name"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


def _pairs_in_small_groups(r: DataFrame, c: DataFrame, definitions: DataFrame | None, by: str) -> DataFrame:
    """Reports beside the checks of their group, where route, named or exact holds. Everything meets on the group alone, so that each side is dealt out once."""
    known = F.lit(None).cast(_SPANS)
    if definitions is not None:
        all_ = definitions.groupBy(by).agg(F.collect_list(_span()).alias("defined"))
        c = c.join(all_, by, "left")
        known = F.filter("defined", lambda d: F.array_contains("cfiles", d["file"]) & F.array_contains("symbols", d["name"]))
    c = c.withColumn("spans", F.when(F.col("has_symbols"), known)).drop("defined")
    # Each step in a column of its own, so that it is evaluated once a row.
    normal = lambda name: F.when(F.col(name) != "", T.endpoint_normal(F.col(name)))
    r = r.withColumns({"normal": normal("re"), "rpaths": F.transform("rfiles", _plain_path)}).withColumn("pieces", T.route_pieces(F.col("normal")))
    r = r.withColumn("routes", T.routes_of(F.col("pieces"), F.col("normal"))).withColumn("routes", F.transform("routes", T.route_parts)).drop("re", "rfiles", "normal", "pieces")
    c = c.withColumns({"normal": normal("ce"), "cbases": F.transform("cfiles", _base), "cpaths": F.transform("cfiles", _plain_path)})
    c = c.withColumn("key", F.when(F.col("normal").isNotNull(), T.route_parts(F.col("normal")))).drop("normal", "ce", "cfiles")
    false = F.lit(False)
    named, exact = (F.coalesce(F.arrays_overlap(x, y), false) for x, y in (("once", "cbases"), ("rpaths", "cpaths")))
    route = F.when(F.col("key").isNotNull() & F.col("routes").isNotNull(), F.exists("routes", lambda x: T.parts_match(x, F.col("key")))).otherwise(false)
    return r.join(c, by).filter(named | exact | route).withColumns({"route": route, "named": named, "exact": exact}).drop("routes", "rpaths", "key", "cbases", "cpaths")


def _pairs_by_keys(r: DataFrame, c: DataFrame, definitions: DataFrame | None, by: str) -> DataFrame:
    """What _pairs_in_small_groups gives, for groups of any size: reports and checks meet on routes and on names of files; only what tells of these goes along."""
    with_name = lambda base: F.filter("rfiles", lambda f: _base(f) == base)
    names = F.transform(F.array_distinct(F.transform("rfiles", _base)), lambda x: F.struct(x.alias("base"), F.array_contains("once", x).alias("one"), F.transform(with_name(x), _plain_path).alias("paths")))
    routes = r.filter("re <> ''").select(by, "report", T.endpoint_normal(F.col("re")).alias("normal")).select(by, "report", F.explode(T.routes_in(F.col("normal"))).alias("route"))
    said, keyed = _route_keys(routes, c.filter("ce <> ''").select(by, "check_id", T.endpoint_normal(F.col("ce")).alias("route")))
    name = lambda base: F.concat(F.lit("name/"), base).alias("key")
    said = said.unionByName(r.select(by, "report", F.inline(names)).select(by, "report", name(F.col("base")), "one", "paths"), allowMissingColumns=True)
    keyed = keyed.unionByName(c.select(by, "check_id", F.explode("cfiles").alias("f")).select(by, "check_id", name(_base(F.col("f"))), _plain_path(F.col("f")).alias("path")), allowMissingColumns=True)
    met = said.join(keyed.withColumnRenamed("method", "_m"), [by, "key"])
    false = F.lit(False)
    met = met.select(by, "report", "check_id", F.coalesce(_one_method(F.col("method"), F.col("_m")), false).alias("route"), F.coalesce("one", false).alias("named"), F.coalesce(F.array_contains("paths", F.col("path")), false).alias("exact"))
    pairs = met.filter("route OR named OR exact").repartition(by, "report").groupBy(by, "report", "check_id").agg(*(F.bool_or(x).alias(x) for x in ("route", "named", "exact")))
    if definitions is not None:
        named = c.select(by, "check_id", F.explode("cfiles").alias("file"), "symbols").select(by, "check_id", "file", F.explode("symbols").alias("name"))
        spans = named.join(definitions.select(by, "file", F.lower("name").alias("name"), "lo", "hi"), [by, "file", "name"])
        spans = spans.groupBy(by, "check_id").agg(F.collect_set(_span()).alias("spans"))
        c = c.join(spans, [by, "check_id"], "left")
    else:
        c = c.withColumn("spans", F.lit(None).cast(_SPANS))
    return pairs.join(r.drop("re", "rfiles"), [by, "report"]).join(c.drop("ce", "cfiles"), [by, "check_id"])


def match_pairs(reports: DataFrame, checks: DataFrame, by: str, definitions: DataFrame | None = None, endpoint_required: bool = True) -> DataFrame:
    """by, report, check_id, localised, quality (0 for none, to 4) of reports and checks that share a route or a file name; and whether the check is clean.

    reports: by, report, endpoint, category, text, locations (array of file, line). checks: by, check_id, expectation, files, symbols, endpoint, category.
    definitions: by, file, name, lo, hi of symbols in the sources. A column file may stand for locations and files; text and symbols may be missing.
    A report is told by (by, report), a check by (by, check_id). Small groups are compared pair by pair, larger ones meet on keys (see SMALL); the rows are the same.

    A check with an endpoint is matched by a report of the same route (a clean one only of the same class); a finding's file and symbol stand in for
    the route. Without endpoint_required the file does, too. A check without endpoint takes a report that names one of its files
    (by a name that one file of the report has) and one of its symbols, as a word or by a line inside its definition; without symbols, one of its class.
    """
    reports, checks = _whole(reports), _whole(checks)
    large = _large_groups(reports, checks, definitions, by)
    if large.isEmpty():
        met = _pairs_in_small_groups(*_looked_at(reports, checks, by), definitions, by)
    else:
        sides = lambda how: [x if x is None else x.join(large, by, how) for x in (reports, checks, definitions)]
        (r, c, d), (lr, lc, ld) = sides("left_anti"), sides("left_semi")
        met = _pairs_in_small_groups(*_looked_at(r, c, by), d, by).unionByName(_pairs_by_keys(*_looked_at(lr, lc, by), ld, by))
    own = lambda x: F.exists("spans", lambda y: (_base(x["file"]) == _base(y["file"])) & x["line"].between(y["lo"], y["hi"]))
    inside = F.when(F.size("spans") > 0, F.exists("locations", lambda x: x["line"].isNotNull() & F.array_contains("once", _base(x["file"])) & own(x)))
    # Columns of their own, so that each is evaluated once a pair.
    has_symbols, has_files = F.col("has_symbols"), F.col("has_files")
    met = met.withColumns({"klass": T.tokens_match(F.col("rt"), F.col("ct")), "symbol": F.when(F.col("named") & has_symbols, T.any_token(F.col("hay"), F.col("symbols")) | F.coalesce(inside, F.lit(False)))})
    is_true = lambda name: F.coalesce(F.col(name), F.lit(False))

    klass, route, clean = F.col("klass"), F.col("route"), F.col("clean")
    class_ok = F.col("any_class") | klass
    anchored = F.col("named") & F.when(has_symbols, is_true("symbol")).otherwise(klass)
    localised = F.col("exact") & klass
    by_file = has_files & F.when(has_symbols, anchored).otherwise(localised) & class_ok
    other_anchor = by_file if not endpoint_required else ~clean & has_symbols & has_files & anchored & class_ok
    keyed = F.when(clean, (route & class_ok) | (~route & other_anchor)).otherwise(route | other_anchor)
    matches = F.when(F.col("keyed"), keyed).otherwise(anchored & class_ok)
    quality = F.when(~matches, 0).when(localised, 4).when(route, F.when(klass, 3).otherwise(2)).when(klass, 2).otherwise(1)
    return met.select(by, "report", "check_id", "clean", localised.alias("localised"), quality.alias("quality"))


def score(reports: DataFrame, checks: DataFrame, by: str, definitions: DataFrame | None = None, endpoint_required: bool = True) -> DataFrame:
    """by, id, outcome, report, localised: found or missed for each finding, fp for each report on a clean check, quiet for a clean check without one, extra for other reports (whose name is the id, too, if it fits its type).

    Findings get reports one to one, as many as possible and then the best; a report that matches any finding is on no clean check,
    others count on the first clean check (by id) that they match. localised tells of findings with files whether any report has the exact file and
    the class. See match_pairs for the columns.
    """
    reports, checks = _whole(reports), _whole(checks)
    pairs = written(match_pairs(reports, checks, by, definitions, endpoint_required), "pairs")
    findings = pairs.filter("NOT clean AND quality > 0")
    chosen = optimal_assignment(findings.select(by, F.col("check_id").alias("row_id"), F.col("report").alias("col_id"), F.col("quality").alias("weight")), by)
    chosen = chosen.select(by, F.col("row_id").alias("check_id"), F.col("col_id").alias("report"))
    claimed = pairs.filter("clean AND quality > 0").join(findings.select(by, "report").distinct(), [by, "report"], "left_anti").groupBy(by, "report").agg(F.min("check_id").alias("check_id"))
    exact = pairs.filter("NOT clean AND localised").select(by, "check_id").distinct().withColumn("exact", F.lit(True))
    finding = checks.filter("expectation = 'finding'").join(chosen, [by, "check_id"], "left").join(exact, [by, "check_id"], "left")
    clean = checks.filter("expectation <> 'finding'").join(claimed, [by, "check_id"], "left")
    extra = reports.join(chosen.select(by, "report").unionByName(claimed.select(by, "report")), [by, "report"], "left_anti")
    outcome = lambda yes, no: F.when(F.col("report").isNotNull(), yes).otherwise(no).alias("outcome")
    no_file = F.lit(None).cast("boolean").alias("localised")
    type_ = dict(checks.dtypes)["check_id"]
    return (
        finding.select(by, F.col("check_id").alias("id"), outcome("found", "missed"), "report", F.when(F.size("files") > 0, F.coalesce("exact", F.lit(False))).alias("localised"))
        .unionByName(clean.select(by, F.col("check_id").alias("id"), outcome("fp", "quiet"), "report", no_file))
        .unionByName(extra.select(by, F.col("report").try_cast(type_).alias("id"), F.lit("extra").alias("outcome"), "report", no_file))
    )


def totals(scored: DataFrame, by: str) -> DataFrame:
    """found, missed, false_positives (reports), extra, file_found, file_missed, and recall, precision and file_recall of score()'s rows."""
    count = lambda what: F.count_if(F.col("outcome") == what)
    t = scored.groupBy(by).agg(
        count("found").alias("found"), count("missed").alias("missed"), count("fp").alias("false_positives"), count("extra").alias("extra"), F.count_if("localised").alias("file_found"), F.count_if(~F.col("localised")).alias("file_missed"),
    )
    return t.withColumns({
        "recall": T.ratio(F.col("found"), F.col("found") + F.col("missed"), 4, 0.0), "precision": T.ratio(F.col("found"), F.col("found") + F.col("false_positives"), 4, 1.0),
        "file_recall": T.ratio(F.col("file_found"), F.col("file_found") + F.col("file_missed"), 4, 0.0),
    })


def without_degraded(totals_: DataFrame, states: DataFrame, by: str) -> DataFrame:
    """totals with errors and reason of the run (by, errors, reason): of a run that failed or lost a step rates are null, since a lost step is not a clean pass."""
    rows = totals_.join(states.select(by, F.coalesce("errors", F.lit(0)).alias("errors"), "reason"), by, "full").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return rows.withColumns({c: F.when(F.col("errors") == 0, F.col(c)) for c in ("recall", "precision", "file_recall")})
