"""Projections between records: source mentions, spans, wire forms, verification inputs, configs, owners, units fanned out."""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .diffs import chunk_text, lines
from .packing import greedy

IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
UNKNOWN_PATH = "<unknown>"


def identifiers(text: Column, start: Column | None = None, stop: Column | None = None) -> Column:
    """Distinct names in a text, or in its characters from start to stop (exclusive)."""
    piece = text if start is None else F.substring(text, start + 1, stop - start)
    return F.array_distinct(F.regexp_extract_all(piece, F.lit(IDENTIFIER), F.lit(0)))


def mentioned_definitions(definitions: DataFrame, seeds: DataFrame, rounds: int = 2) -> DataFrame:
    """seed, file, name, round: definitions of a seed's file that its text names, and those that their texts name in turn.

    definitions: file, name, text. seeds: seed, file, text. A name counts in the first round that reaches it.
    """
    d = definitions.select("file", "name", "text")
    frontier, found = seeds.select("seed", "file", F.explode(identifiers(F.col("text"))).alias("name")).distinct(), None
    for k in range(1, rounds + 1):
        step = frontier.join(d, ["file", "name"]).withColumn("round", F.lit(k))
        step = step if found is None else step.join(found.select("seed", "file", "name"), ["seed", "file", "name"], "left_anti")
        found = step if found is None else found.unionByName(step)
        frontier = step.select("seed", "file", F.explode(identifiers(F.col("text"))).alias("name")).distinct()
    return found.select("seed", "file", "name", "round").distinct()


def diff_paths(diffs: DataFrame) -> DataFrame:
    """diff_id, paths: every path that a diff names, in order, each once; one unknown path where it names none."""
    named = chunk_text(lines(diffs)).filter("path IS NOT NULL AND path <> ''").groupBy("diff_id", "path").agg(F.min("chunk").alias("chunk"))
    listed = named.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "path"))), lambda x: x["path"]).alias("paths"))
    return diffs.select("diff_id").distinct().join(listed, "diff_id", "left").select("diff_id", F.coalesce("paths", F.array(F.lit(UNKNOWN_PATH))).alias("paths"))


def changed_source_ranges(ranges: DataFrame, extensions: list[str]) -> DataFrame:
    """New-side ranges of files with a source extension. ranges: diff_id, path, side, lo, hi."""
    kept = (F.col("side") == "new") & F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*extensions)
    return ranges.filter(kept).select("diff_id", "path", "lo", "hi")


def diff_worklist(chunks: DataFrame, cap: int) -> DataFrame:
    """diff_id, chunk, unit, total: a diff within the cap is one unit, a larger one is packed. chunks: diff_id, chunk, n_chars."""
    packed = greedy(chunks, "diff_id", ["chunk"], "n_chars", cap, joint=1)
    totals = packed.groupBy("diff_id").agg((F.max("unit") + 1).alias("total"))
    return packed.join(totals, "diff_id").select("diff_id", "chunk", (F.col("unit") + 1).alias("unit"), "total")


def inherited_attributes(guides: DataFrame, columns: list[str]) -> DataFrame:
    """Guides (id, language and list columns) whose empty lists are taken from their language's guide."""
    base = guides.filter("language IS NULL").select(F.col("id").alias("language"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = guides.join(base, "language", "left")
    return out.select("id", *(F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in columns))


def config_problems(entries: DataFrame, allowed: list[str], required: list[str]) -> DataFrame:
    """file, key, problem of configs (file, key, is_list): unknown keys, missing ones, values that aren't lists of strings."""
    known = F.col("key").isin(*allowed)
    wrong = entries.select("file", "key", F.when(~known, "unknown key").when(~F.col("is_list"), "not a list of strings").alias("problem")).filter("problem IS NOT NULL")
    held = entries.groupBy("file").agg(F.collect_set("key").alias("keys"))
    missing = held.select("file", F.explode(F.array_except(F.array(*map(F.lit, required)), F.col("keys"))).alias("key")).withColumn("problem", F.lit("missing key"))
    return wrong.unionByName(missing)


def inventory(files: DataFrame) -> DataFrame:
    """ref, kind, path, state of knowledge files (ref, kind, path): a ref that two files define is a duplicate, and both are named."""
    each = files.distinct()
    several = each.groupBy("ref").agg(F.count_distinct("path").alias("n"))
    return each.join(several, "ref").select("ref", "kind", "path", F.when(F.col("n") > 1, "duplicate").otherwise("ok").alias("state"))


def case_references(cases: DataFrame) -> DataFrame:
    """name, ref of cases (name, refs, category): without refs a case counts for its category's class."""
    own = F.when(F.size("refs") > 0, F.col("refs")).when(F.coalesce(F.col("category"), F.lit("")) != "", F.array(F.concat(F.lit("vuln:"), "category"))).otherwise(F.array().cast("array<string>"))
    return cases.select("name", F.explode(own).alias("ref"))


def symbol_spans(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """The columns of wanted (with file and symbol) and lo, hi of each definition of that name in the file, whatever the case."""
    spans = definitions.select("file", F.lower("name").alias("_name"), "lo", "hi").distinct()
    return wanted.withColumn("_name", F.lower("symbol")).join(spans, ["file", "_name"]).drop("_name").distinct()


def reports_in_symbols(reports: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """by, report: reports (by, report, file, line) that cite a line inside a span (by, file, lo, hi) of the check they are held against."""
    inside = (F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi"))
    return reports.join(spans.select(by, "file", "lo", "hi"), [by, "file"]).filter(inside).select(by, "report").distinct()


def joined_text(*columns: str) -> Column:
    """The texts that aren't empty, with blanks between them."""
    return F.array_join(F.filter(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in columns)), lambda x: x != ""), " ")


def scorer_reports(findings: DataFrame) -> DataFrame:
    """What a scorer takes of findings (ord, file, line, category and three texts): a name by place, the category, one text, the line if there is one."""
    place = F.concat(F.col("file"), F.lit(":"), F.coalesce(F.col("line"), F.lit(0)).cast("string"), F.lit(":"), F.col("ord").cast("string"))
    return findings.select("ord", place.alias("name"), "category", "file", joined_text("description", "exploit_scenario", "recommendation").alias("text"), F.when(F.col("line") > 0, F.array("line")).otherwise(F.array().cast("array<bigint>")).alias("lines"))


def verification_inputs(findings: DataFrame, provenance: DataFrame) -> DataFrame:
    """Candidates to verify: a title, one evidence text, and who found it, by the coarse key (file, line, category) where provenance has it."""
    title = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("description", "category", "file")))
    known = provenance.select(*(F.col(c).alias(f"_{c}") for c in ("file", "line", "category")), F.col("found_by").alias("_found_by"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("file", "line", "category")]
    rows = findings.join(known, same[0] & same[1] & same[2], "left")
    return rows.select("ord", "file", "line", "category", "severity", title.alias("title"), joined_text("description", "exploit_scenario", "recommendation").alias("evidence"), F.coalesce("_found_by", "found_by").alias("found_by"))


def verification_results(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings with state (kept, dropped, incomplete) and reason, from verdicts (ord, verdict, reason); a finding without a verdict is incomplete."""
    state = F.when(F.col("verdict") == "confirmed", "kept").when(F.col("verdict") == "refuted", "dropped").otherwise("incomplete")
    return findings.join(verdicts, "ord", "left").withColumns({"state": state, "reason": F.when(F.col("verdict") == "refuted", F.concat(F.lit("verified false positive: "), F.coalesce("reason", F.lit(""))))}).drop("verdict")


#: Fields of a candidate in its stable wire form, in order, with what a missing one stands for.
WIRE = {"title": "''", "category": "''", "endpoint": "''", "symbol": "''", "file": "''", "line": "CAST(NULL AS INT)", "severity": "'MEDIUM'", "evidence": "''", "status": "'confirmed'", "source": "''"}
WIRE_TYPE = "struct<title:string,category:string,endpoint:string,symbol:string,file:string,line:int,severity:string,evidence:string,status:string,source:string,found_by:array<string>>"


def to_wire(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def from_wire(record: Column) -> Column:
    """A candidate from its wire form, with defaults for missing fields; null if it is no object."""
    c = F.from_json(record, WIRE_TYPE)
    fields = [F.coalesce(c[k], F.expr(default)).alias(k) for k, default in WIRE.items()] + [F.coalesce(c["found_by"], F.array().cast("array<string>")).alias("found_by")]
    return F.when(F.try_parse_json(record).isNotNull() & F.ltrim(record).startswith("{"), F.struct(*fields))


def location(text: Column, extensions: list[str]) -> Column:
    """The first source path in a text, and its line if one follows. Longer extensions are tried first."""
    either = "|".join(re.escape(e.lstrip(".")) for e in sorted(extensions, key=len, reverse=True))
    pattern = rf"([\w./-]+\.(?:{either}))(?::(\d+))?"
    path = F.regexp_extract(text, pattern, 1)
    return F.when(path != "", F.struct(path.alias("file"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("line")))


def call_graph_payload(definitions: DataFrame) -> DataFrame:
    """file, payload: definitions (file, name, lo, hi, calls) as one JSON object a file, repeated names as lists. Only for sinks."""
    entry = F.struct(F.array("lo", "hi").alias("range"), F.array_distinct("calls").alias("calls"))
    named = definitions.groupBy("file", "name").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return named.groupBy("file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "entries"))))).alias("payload"))


def usable(obj: Column, required: str | None = None) -> Column:
    """Whether a reply's object (JSON text or null) is one that isn't empty, and has the key that is asked for."""
    keys = F.json_object_keys(obj)
    return F.coalesce(F.size(keys) > 0, F.lit(False)) & (F.lit(True) if required is None else F.coalesce(F.array_contains(keys, required), F.lit(False)))


def fan_out(units: DataFrame, judge: Callable[[dict], list[dict]], schema: str, unit: str = "unit") -> DataFrame:
    """judge over every unit by itself: its rows, and for a unit that failed one row with the error. schema: the columns of judge's rows."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
    kind = units.schema[unit].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                try:
                    out += [{unit: record[unit], **r, "error": None} for r in judge(record)] or [{unit: record[unit], "error": None}]
                except Exception as failure:  # a failed unit is a row, whatever it failed of
                    out.append({unit: record[unit], "error": traceback.format_exception_only(failure)[-1].strip()})
            yield pd.DataFrame(out, columns=[unit, *names, "error"])

    return units.mapInPandas(run, f"{unit} {kind}, {schema}, error string")


def with_owner(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """A column owner: the last author of a finding's line (blame: file, line, author, mail), empty where none is known. Never drops a finding."""
    mail = F.coalesce(F.col("mail"), F.lit(""))
    owner = F.when(F.col("author").isNull(), "").when(mail != "", F.concat("author", F.lit(" <"), mail, F.lit(">"))).otherwise(F.col("author"))
    return findings.join(blame, ["file", "line"], "left").withColumn("owner", owner).drop("author", "mail")


def metered(calls: DataFrame, by: str) -> DataFrame:
    """Usage summed over a run's calls; a call that reports none counts with zeros."""
    figures = ("input_tokens", "cache_read", "cache_write", "output_tokens")
    return calls.groupBy(by).agg(F.count("*").alias("calls"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in figures))


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the deepest root (a folder) that a path lies below, null if there is none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = paths.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root")
    return paths.select("path").distinct().join(met.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root")), "path", "left")


def proof_name(path: Column) -> Column:
    """A finding's name from its proof's file: without folders, extension and a leading test_ or poc_."""
    return T.slug(F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), r"(?i)^(test|poc)[_-]", ""))
