"""Readers for source trees, markdown, findings, benchmarks, checkpoints and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import PathRules, is_skipped, is_unsafe

#: Bytes from which a file isn't read, and the sample's bounds.
MOST_BYTES, SAMPLE_CHARS, SAMPLE_TOTAL = 2_000_000, 16_000, 8_000_000
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "pom.xml", "foundry.toml")

CANDIDATE = "ord bigint, title string, category string, endpoint string, symbol string, file string, line int, severity string, evidence string, status string, source string, found_by array<string>"
FINDING = "file string, line int, severity string, category string, description string, exploit_scenario string, recommendation string, confidence double, change_anchor struct<file:string,line:int,side:string>, found_by array<string>"
TIMELINE = "stage string, started_at string, seconds double, ok boolean"


def source_tree(spark: SparkSession, root: str, rules: PathRules = PathRules()) -> DataFrame:
    """path (below root), text, n_bytes of every file outside skipped folders. Large and undecodable files have empty text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rpartition("://")[2].lstrip("/")
    path = F.regexp_replace(F.col("path"), rf"^.*?{_quoted(base)}/", "")
    small = (F.col("length") <= MOST_BYTES) & F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select(path.alias("path"), F.when(small, F.col("content").cast("string")).otherwise("").alias("text"), F.col("length").alias("n_bytes"))
    return rows.filter(~is_skipped(F.col("path"), rules))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def manifests(files: DataFrame) -> DataFrame:
    """The known dependency manifests' texts, joined in order of path."""
    known = files.filter(F.substring_index("path", "/", -1).isin(*MANIFESTS))
    return known.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("text"))


def source_sample(files: DataFrame, by: str) -> DataFrame:
    """The first characters of each file until a group's total is reached; the file that crosses it is kept."""
    from ..operators.packing import until_full

    cut = files.withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).withColumn("_n", F.length("text"))
    return until_full(cut, [by], ["path"], "_n", SAMPLE_TOTAL).drop("_n")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, header (key to value), body of markdown files but index.md; the header stands between the first two --- lines."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[\w-]+:")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[\w-]+:\s*", ""))))
    body = F.when(F.col("text").startswith("---\n"), F.regexp_replace("text", r"(?s)^---\n.*?\n---\n?", "")).otherwise(F.col("text"))
    return rows.filter(~F.col("path").endswith("/index.md")).select("path", F.map_from_entries(pairs).alias("header"), body.alias("body"))


def header_list(value: Column) -> Column:
    """A header's [a, b] as an array."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(F.trim(x), F.lit("\"'"))), lambda x: x != "")


def diff_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("text"))


def explorer_sources(payloads: DataFrame, id_col: str = "address", text_col: str = "source") -> DataFrame:
    """address, path, content from an explorer's three forms: plain text, a JSON map of files, or the same in doubled braces. Unsafe paths go."""
    raw = F.trim(text_col)
    inner = F.when(raw.startswith("{{"), F.expr(f"substring(trim({text_col}), 2, length(trim({text_col})) - 2)")).otherwise(raw)
    files = F.from_json(F.coalesce(F.get_json_object(inner, "$.sources"), inner), "map<string,struct<content:string>>")
    named = F.map_entries(F.when(raw.startswith("{"), files).otherwise(F.create_map(F.lit("contract.sol"), F.struct(raw.alias("content")))))
    rows = payloads.select(id_col, F.inline(F.transform(named, lambda e: F.struct(e["key"].alias("path"), e["value"]["content"].alias("content")))))
    return rows.filter(~is_unsafe(F.col("path")) & F.col("content").isNotNull())


def findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of reports that are an object with findings or a bare list."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.col("value"))
    listed = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.findings"))
    return whole.select("report", F.posexplode(F.from_json(listed, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in FINDING.split(', '))}>>")).alias("ord", "f")).select("report", "ord", "f.*")


def candidate_documents(rows: DataFrame, text_col: str = "body") -> DataFrame:
    """Candidates from documents with title, severity, location and status fields; refuted and cleared ones give no row."""
    text = F.col(text_col)
    place = T.field(text, "location")
    out = rows.select(
        "path", F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1).alias("title"), T.severity(T.field(text, "severity")).alias("severity"), T.category_spelling(T.field(text, "category")).alias("category"),
        F.substring_index(place, ":", 1).alias("file"), F.regexp_extract(place, r":(\d+)", 1).try_cast("int").alias("line"), F.lower(T.field(text, "status")).alias("status"),
    )
    return out.filter(~F.col("status").rlike("refuted|cleared"))


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written state; a malformed record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline records; unreadable lines are left out, since the log is best effort."""
    return spark.read.schema(TIMELINE).option("mode", "DROPMALFORMED").json(path)


def arm_artifacts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Records of one name in all folders below root, with their arm (the folder below root)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mode", "DROPMALFORMED").json(root)
    base = root.rstrip("/").rpartition("://")[2].lstrip("/")
    return rows.withColumn("arm", F.regexp_extract(F.col("_metadata.file_path"), rf"{_quoted(base)}/([^/]+)/", 1))


def registry(public: DataFrame, private: DataFrame | None = None, override: bool = False) -> tuple[DataFrame, DataFrame]:
    """(manifests, duplicates): one row an id. With override a private one replaces a public one; else both count as duplicates."""
    rows = public.withColumn("_level", F.lit(0))
    if private is not None:
        rows = rows.unionByName(private.withColumn("_level", F.lit(1)))
    chosen = rows.groupBy("id").agg(F.max_by(F.struct(*public.columns), "_level").alias("m"), F.count("*").alias("n"))
    twice = chosen.filter("n > 1").select("id") if not override else chosen.filter("false").select("id")
    return chosen.select("m.*"), twice


def scoped(checks: DataFrame, task: str) -> DataFrame:
    """Checks that apply to a task."""
    return checks.filter(F.array_contains("applies_to", task))
