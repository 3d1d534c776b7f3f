"""Grounding of review units: evidence catalogues, relationships, budgeted parts, assembled contexts, ownership."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from .context import preview
from .units import within_budget


def relationships(edges: DataFrame) -> DataFrame:
    """One line per edge: source, target and a summary, exact ones first."""
    return edges.select("source", "target", F.concat("source", F.lit(" "), "kind", F.lit("s "), "target", F.when(F.col("resolution") == "ambiguous", " (ambiguous)").otherwise("")).alias("summary"), (F.col("resolution") == "ambiguous").cast("int").alias("rank"))


def catalogue(edges: DataFrame, included: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence a reviewer may ask for: each target (file, lo, hi) not included yet, once, with id, label, exact slice and preview.

    edges: file, lo, hi, source. included: file, lo, hi. files: file, text. A range that reaches beyond its file has state invalid and no text.
    """
    open_ = edges.join(included.select("file", "lo", "hi").distinct(), ["file", "lo", "hi"], "left_anti")
    grouped = open_.groupBy("file", "lo", "hi").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    # Text is fetched last and only for the files wanted.
    held = grouped.join(files, "file", "left")
    valid = (F.col("lo") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") <= F.coalesce(F.length("text"), F.lit(0)))
    piece = F.when(valid, F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo")))
    identity = F.concat_ws(":", "file", F.col("lo").cast("string"), F.col("hi").cast("string"))
    return held.select(
        T.short_hash("ev-", 12, identity).alias("evidence_id"), "file", "lo", "hi", F.concat(F.array_join("sources", ", "), F.lit(" -> "), identity).alias("label"), piece.alias("text"), preview(piece).alias("preview"),
        F.when(valid, "valid").otherwise("invalid").alias("state"),
    )


def shares(rows: DataFrame, by: str, order: list[str], size: str, cap: int) -> DataFrame:
    """A column share: parts in order get what they need, at most what is left of the cap divided by the parts that are left. A null size counts as none."""
    counted = rows.withColumn("_parts", F.count("*").over(Window.partitionBy(by)))
    schema = StructType([*counted.schema.fields, StructField("share", LongType())])
    arrow = to_arrow_schema(schema)
    at_key, at_size, at_parts = counted.columns.index(by), counted.columns.index(size), len(counted.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, parts, begun = None, cap, 0, False
        for batch in batches:
            out = []
            for k, s, n in zip(batch.column(at_key).to_pylist(), batch.column(at_size).to_pylist(), batch.column(at_parts).to_pylist(), strict=True):
                if not begun or k != key:
                    key, left, parts, begun = k, cap, n, True
                share = min(s or 0, left // parts)
                left, parts = left - share, parts - 1
                out.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=arrow)

    return counted.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema).drop("_parts")


def caller_snippets(rows: DataFrame, by: str, most: int, cap: int) -> DataFrame:
    """Snippets shown: required ones first, then the smallest, then by start; none over `most` and together within the cap. rows: by, required, size, start."""
    fit = rows.filter(F.col("size") <= most).withColumn("_late", (~F.col("required")).cast("int"))
    return within_budget(fit, by, ["_late", "size", "start"], "size", cap).filter("taken").drop("_late", "taken")


def assemble(parts: DataFrame, by: str, cap: int, changed_first: bool = True) -> DataFrame:
    """by, text, omitted: parts (path, changed, text) in order, joined while they fit; what doesn't is named, not cut."""
    first = F.when(F.col("changed"), 0).otherwise(1) if changed_first else F.when(F.col("changed"), 1).otherwise(0)
    sized = parts.withColumns({"_first": first, "_n": F.length("text") + 2})
    taken = within_budget(sized, by, ["_first", "path"], "_n", cap)
    ordered = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("_first", "path", c)))), lambda x: x[c])
    return taken.groupBy(by).agg(F.array_join(ordered("text", F.col("taken")), "\n\n").alias("text"), F.array_sort(F.collect_set(F.when(~F.col("taken"), F.col("path")))).alias("omitted"))


def changed_text(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """file, text of the lines (file, line, text) inside changed ranges (file, lo, hi), in order."""
    from .intervals import members

    inside = members(lines, ranges, "file", "line")
    return inside.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def shared_context(documents: DataFrame, templates: DataFrame, cap: int) -> DataFrame:
    """One text of documents (ord, name, text) that differ from their untouched template, cut at the cap with a marker."""
    own = documents.filter("text IS NOT NULL").join(templates.select("name", F.col("text").alias("_t")), "name", "left").filter(F.col("_t").isNull() | (F.col("_t") != F.col("text")))
    # Each document adds its separator at least, so the cap falls among the first ones; only those that begin before it are joined.
    sizes = own.select("ord", F.length("text").alias("n")).orderBy("ord").limit(cap // 2 + 2)
    before = F.coalesce(F.sum(F.col("n") + 2).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = own.join(sizes.withColumn("_before", before).filter(F.col("_before") <= cap + 2).select("ord"), "ord", "left_semi")
    joined = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.select(T.truncated(F.col("text"), cap).alias("text"))


def owned_files(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """doc, path: inventory paths named in a document's ownership fields or table cells; prose doesn't count."""
    line = F.explode(F.split("text", "\n")).alias("line")
    named = documents.select("doc", line).filter(F.trim("line").startswith("|") | F.col("line").rlike(r"(?i)^\s*-?\s*(owns|files?|owned files?)\s*:"))
    words = named.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\w./-]+\.\w+"), F.lit(0)))).alias("path"))
    return words.join(inventory.select("path").distinct(), "path").select("doc", "path").distinct()


def wire_entries(findings: DataFrame, owners: DataFrame | None = None, proofs: DataFrame | None = None) -> DataFrame:
    """Ranked findings in their wire form: position, name, severity, consensus, owner, link to the proof; unknown owners and proofs are null."""
    out = findings.withColumn("name", F.concat(F.lpad(F.col("position").cast("string"), 3, F.lit("0")), F.lit("-"), T.finding_slug(F.col("title"))))
    out = out.join(owners, ["file", "line"], "left") if owners is not None else out.withColumn("owner", F.lit(None).cast("string"))
    out = out.join(proofs, "key", "left") if proofs is not None else out.withColumn("proof", F.lit(None).cast("string"))
    return out.select("position", "name", "severity", "consensus", "owner", "proof")


def local_names(bindings: DataFrame, module_names: DataFrame) -> DataFrame:
    """source, name: what imports bind (source, target, local); * stands for every module-level name of the target."""
    star = bindings.filter("local = '*'").join(module_names.select(F.col("file").alias("target"), "name"), "target").select("source", "name")
    return bindings.filter("local <> '*'").select("source", F.col("local").alias("name")).unionByName(star).distinct()


def first_owner(plans: DataFrame) -> DataFrame:
    """fragment, plan: the earliest plan that has a fragment as a seed."""
    return plans.select("plan", F.explode("seeds").alias("fragment")).groupBy("fragment").agg(F.min("plan").alias("plan"))
