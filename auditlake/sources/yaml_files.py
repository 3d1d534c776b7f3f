"""YAML documents and front matter as tables: nested keys and lists as they are written, files that can't be read as rows with an error.

Files come through Spark's own reader, so any store that Spark reads will do and files are dealt out over tasks; each text is parsed in an Arrow batch and
handed on as JSON, which typed readers take columns from. Files without a byte give no row, as in all of Spark's readers.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.col("content").cast("string").alias("text"))


def _parsed(rows: DataFrame, front_matter: bool) -> DataFrame:
    """rows with meta (JSON), body and error in place of text."""

    @F.pandas_udf("struct<meta:string,body:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        import yaml

        out = []
        for text in texts:
            head, body = text, None
            if front_matter:
                parts = text.split("---", 2) if text.startswith("---") else []
                head, body = (parts[1], parts[2].strip()) if len(parts) == 3 else ("", text)
            try:
                found = yaml.safe_load(head) if head.strip() else {}
            except (yaml.YAMLError, ValueError) as e:
                out.append((None, body, " ".join(str(e).split())))
                continue
            if not isinstance(found, dict):
                out.append(("{}" if front_matter else None, body, None if front_matter else "no mapping at the top"))
            else:
                out.append((json.dumps(found, ensure_ascii=False, default=str), body, None))
        return pd.DataFrame(out, columns=["meta", "body", "error"])

    return rows.withColumn("_p", run(F.col("text"))).select(*(c for c in rows.columns if c != "text"), "_p.meta", "_p.body", "_p.error")


def yaml_documents(spark: SparkSession, root: str, glob: str = "*.yaml") -> DataFrame:
    """path, meta (the document as JSON), error of every file below a folder."""
    return _parsed(_texts(spark, root, glob), False).drop("body")


def front_matter(spark: SparkSession, root: str) -> DataFrame:
    """path, meta (JSON, {} without a header), body, error of markdown files but index.md."""
    return _parsed(_texts(spark, root, "*.md").filter(F.substring_index("path", "/", -1) != "index.md"), True)


#: What typed readers take; fields that a document lacks are null.
MANIFEST = "benchmark_id string, profile string, source struct<kind:string,path:string,identity:map<string,string>>, stack struct<languages:array<string>,frameworks:array<string>,protocols:array<string>>, tasks array<struct<id:string,kind:string,expectation:string,revision:map<string,string>>>"
CHECKS = "benchmark_id string, checks array<struct<id:string,expectation:string,applies_to:array<string>,severity:string,knowledge:map<string,array<string>>,locations:struct<files:array<string>,endpoints:array<string>,symbols:array<string>>>>"


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of the JSON; an error where it has no benchmark_id."""
    out = rows.withColumn("_m", F.from_json("meta", schema)).select("path", "_m.*", "error")
    return out.withColumn("error", F.when(F.col("error").isNull() & (F.coalesce("benchmark_id", F.lit("")) == ""), "no benchmark_id").otherwise(F.col("error")))


def manifests(spark: SparkSession, root: str, glob: str = "benchmark.yaml") -> DataFrame:
    """path, the fields of MANIFEST, error: one row a file."""
    return _typed(yaml_documents(spark, root, glob), MANIFEST)


def answer_keys(spark: SparkSession, root: str, glob: str = "answer-key.yaml") -> DataFrame:
    """path, benchmark_id, check_id, expectation, applies_to, severity, files, endpoints, symbols (lower case), refs (kind:name), error: one row a check, and one for each file that can't be read or has no checks."""
    rows = _typed(yaml_documents(spark, root, glob), CHECKS)
    each = rows.select("path", "benchmark_id", "error", F.explode_outer("checks").alias("c"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    refs = F.flatten(F.transform(F.map_entries(F.coalesce("c.knowledge", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(listed(e["value"]), lambda x: F.concat(e["key"], F.lit(":"), x))))
    empty = F.when(F.col("c").isNull(), "no checks").when(F.col("c.id").isNull() | ~F.coalesce("c.expectation", F.lit("")).isin("findings", "clean"), "a check without id or expectation")
    return each.select(
        "path", "benchmark_id", F.col("c.id").alias("check_id"), F.when(F.col("c.expectation") == "findings", "finding").otherwise(F.col("c.expectation")).alias("expectation"), listed(F.col("c.applies_to")).alias("applies_to"),
        F.coalesce("c.severity", F.lit("")).alias("severity"), listed(F.col("c.locations.files")).alias("files"), listed(F.col("c.locations.endpoints")).alias("endpoints"),
        F.transform(listed(F.col("c.locations.symbols")), lambda x: F.lower(x)).alias("symbols"), F.array_sort(refs).alias("refs"), F.coalesce("error", empty).alias("error"),
    )


def catalogue(spark: SparkSession, roots: dict[str, tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(projects, problems) of the roots (name to folder and whether it may replace what earlier roots have, in order).

    projects: benchmark_id, path, provenance. problems: benchmark_id, path, problem: unreadable manifests, ids that come twice in a root or in two roots without override, manifests without an answer key beside them.
    """
    rows = None
    for level, (name, (root, override)) in enumerate(roots.items()):
        found = manifests(spark, root).select("benchmark_id", "path", "error", F.lit(name).alias("provenance"), F.lit(level).alias("level"), F.lit(override).alias("override"))
        rows = found if rows is None else rows.unionByName(found)
    keys = None
    for root, _ in roots.values():
        found = _texts(spark, root, "answer-key.yaml").select(_folder("path").alias("folder"))
        keys = found if keys is None else keys.unionByName(found)
    good = rows.filter("error IS NULL")
    with_key = good.withColumn("folder", _folder("path"))
    keyless = with_key.join(keys.distinct(), "folder", "left_anti").select("benchmark_id", "path", F.lit("no answer key").alias("problem"))
    sizes = good.groupBy("benchmark_id", "level").agg(F.count("*").alias("n"), F.first("override").alias("override"))
    ids = sizes.groupBy("benchmark_id").agg(F.max("n").alias("most"), F.min("level").alias("first"), F.max(F.struct("level", "override")).alias("last"), F.count_if(~F.col("override")).alias("firm"))
    clash = ids.withColumn("problem", F.when(F.col("most") > 1, "twice in a root").when((F.col("last.level") > F.col("first")) & (F.col("firm") > 1), "in two roots")).filter("problem IS NOT NULL")
    twice = good.join(clash.select("benchmark_id", "problem"), "benchmark_id").select("benchmark_id", "path", "problem")
    broken = rows.filter("error IS NOT NULL").select("benchmark_id", "path", F.col("error").alias("problem"))
    projects = with_key.join(keys.distinct(), "folder", "left_semi").join(clash.select("benchmark_id"), "benchmark_id", "left_anti").groupBy("benchmark_id").agg(F.max_by(F.struct("path", "provenance"), "level").alias("m"))
    return projects.select("benchmark_id", "m.path", "m.provenance"), keyless.unionByName(twice).unionByName(broken)


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def target_of(manifests_: DataFrame) -> DataFrame:
    """benchmark_id, task, type, url, address, chain, ref, base, path: each task as a runner takes it. Kinds other than git and explorer give an error."""
    t = manifests_.select("benchmark_id", "source", F.explode("tasks").alias("t"))
    identity, revision = F.col("source.identity"), F.col("t.revision")
    git, explorer = F.col("source.kind") == "git", F.col("source.kind") == "explorer"
    return t.select(
        "benchmark_id", F.col("t.id").alias("task"), F.col("source.kind").alias("type"), F.when(git, identity["url"]).alias("url"), F.when(explorer, identity["address"]).alias("address"), F.when(explorer, identity["chain"]).alias("chain"),
        F.when(git, F.coalesce(revision["commit"], identity["commit"])).alias("ref"), F.when(git & (F.col("t.kind") == "diff"), revision["base_commit"]).alias("base"), F.coalesce("source.path", F.lit(".")).alias("path"),
        F.when(~F.coalesce(git | explorer, F.lit(False)), "unsupported kind").alias("error"),
    )
