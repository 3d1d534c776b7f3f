"""Written outputs: reports, ledgers, checkpoints, append logs, and the content-addressed facts cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import json_document, markdown_document, report_order, sarif_document, text_line


def write_json(rows: DataFrame, path: str, target: dict | None = None) -> None:
    """The whole report as one JSON document: findings in report order, the counts of severities, the target. Its files in order are the document."""
    _write_document(json_document(rows, target), path)


def write_sarif(rows: DataFrame, path: str, tool: str = "auditlake", target: dict | None = None) -> None:
    """A SARIF 2.1.0 document. Its files in order are the document."""
    _write_document(sarif_document(rows, tool, target), path)


def write_text(rows: DataFrame, path: str) -> None:
    rows.orderBy(*report_order()).select(text_line()).write.mode("overwrite").text(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    _write_document(markdown_document(rows), path)


def _write_document(parts: DataFrame, path: str) -> None:
    parts.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("text").write.mode("overwrite").text(path)


def markdown_row(*cells: Column) -> Column:
    """Cells as a markdown table row; bars within them are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))


def write_checkpoint(rows: DataFrame, path: str, keep: int = 2) -> str:
    """A state written whole, as a version of its own beside earlier ones; its folder.

    A version counts once the marker of the writer's commit is in it. Readers take the newest that counts (see read_checkpoint), so they see the old state or the new
    one, and a write that fails leaves the old. The last `keep` versions stay for readers that have begun.
    """
    spark = rows.sparkSession
    known = _versions(spark, path)
    folder = f"{path.rstrip('/')}/version={(known[-1] if known else 0) + 1:012d}"
    rows.write.mode("overwrite").json(folder)
    fs, root = _filesystem(spark, path)
    for old in _versions(spark, path)[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"version={old:012d}"), True)
    return folder


def _filesystem(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, root = _filesystem(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(done(p, "_SUCCESS")))


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The newest whole state, none if there is none. A malformed record fails the read."""
    known = _versions(spark, path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/version={known[-1]:012d}") if known else None


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def reconcile(findings: DataFrame, proofs: DataFrame, key: str) -> DataFrame:
    """key, state: findings without a proof, proofs without a finding, and those that have each other."""
    a, b = findings.select(key).distinct().withColumn("_f", F.lit(True)), proofs.select(key).distinct().withColumn("_p", F.lit(True))
    state = F.when(F.col("_p").isNull(), "finding without proof").when(F.col("_f").isNull(), "proof without finding").otherwise("both")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def enrich(findings: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Findings with their proof's outcome appended to the evidence; none is dropped."""
    return findings.join(outcomes.groupBy(key).agg(F.min("outcome").alias("_o")), key, "left").withColumn("evidence", F.concat("evidence", F.coalesce(F.concat(F.lit("; proof: "), "_o"), F.lit("")))).drop("_o")


#: Files whose hashes are hashed together in one stretch of a fingerprint.
STRETCH = 4096


def fingerprints(files: DataFrame, by: list[str], profile: str = "", schema: int = 1, stretch: int = STRETCH) -> DataFrame:
    """by, fingerprint, files: key of each tree's source state, from schema, profile and every (path, content hash) in order of path.

    Paths are dealt out by hash into stretches that are hashed apart, so no task holds a whole tree; the stretches' hashes, one for some thousand files, are hashed again. Null texts count as empty.
    """
    line = files.select(*by, "path", F.concat("path", F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"))
    sized = files.groupBy(*by).agg(F.ceil(F.count("*") / stretch).alias("_n"))
    placed = line.join(sized, by).withColumn("_s", F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("bigint") % F.col("_n"))
    joined = lambda c, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, c))), lambda x: x[c]), "\n")
    parts = placed.groupBy(*by, "_s").agg(F.sha2(joined("line", "path"), 256).alias("h"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.sha2(F.concat(F.lit(f"{schema}\n{profile}\n"), joined("h", "_s")), 256).alias("fingerprint"), F.sum("n").alias("files"))


def fingerprint(files: DataFrame, profile: str, schema: int = 1) -> str:
    """The same for one tree."""
    return fingerprints(files.withColumn("_tree", F.lit(1)), ["_tree"], profile, schema).first()["fingerprint"]


class FactsCache:
    """Facts tables by source fingerprint; an entry counts once all its parts are written."""

    def __init__(self, spark: SparkSession, root: str, parts: tuple[str, ...]):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _complete(self, key: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}/_complete")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def get(self, key: str) -> dict[str, DataFrame] | None:
        return {p: self.spark.read.parquet(f"{self.root}/{key}/{p}") for p in self.parts} if self._complete(key) else None

    def put(self, key: str, tables: dict[str, DataFrame]) -> None:
        for p in self.parts:
            tables[p].write.mode("overwrite").parquet(f"{self.root}/{key}/{p}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/{key}/_complete")


def summary_line(found: Column, total: Column, name: str) -> Column:
    """recall 3/4 (0.75)."""
    return F.concat(F.lit(f"{name} "), found.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), T.ratio(found, total, 4, 0.0).cast("string"), F.lit(")"))
