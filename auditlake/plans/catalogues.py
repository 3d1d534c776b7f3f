"""Queries over catalogues in YAML files, which are written of the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_path
from ..sources import yaml_files
from ..sources.adapters import table
from .catalogue import query


@query("""WITH c AS (SELECT source, l.doc_id, l.quality, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT source AS benchmark_id, concat('check-', doc_id) AS check_id, CASE WHEN quality = 1 THEN 'finding' ELSE 'clean' END AS expectation,
  concat('repository-', lang, ',diff-', doc_id) AS applies_to, concat('src/', lang, '/f', doc_id, '.py') AS files, concat('handle_', doc_id) AS symbols, concat('guides:languages/', lang, ',vulnerabilities:class-', doc_id % 9) AS refs, CAST(NULL AS VARCHAR) AS error FROM c
  UNION ALL SELECT NULL, NULL, NULL, '', '', '', '', 'no benchmark_id' FROM (SELECT count(*) AS n FROM documents) WHERE n > 0""")
def answer_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of answer keys, one file a source with a check for each label, and one file that names no benchmark."""
    checks = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    doc, lines = F.col("doc_id").cast("string"), (
        "  - id: check-{0}", "    applies_to: [repository-{1}, 'diff-{0}']", "    expectation: {2}", "    knowledge:", "      vulnerabilities:", "        - class-{3}", "      guides:", "        - languages/{1}", "    locations:", "      files:",
        "        - src/{1}/f{0}.py  # the source", "      symbols: [\"Handle_{0}\"]",
    )
    fill = lambda line: F.replace(F.replace(F.replace(F.replace(F.lit(line), F.lit("{0}"), doc), F.lit("{1}"), F.col("lang")), F.lit("{2}"), F.when(F.col("quality") == 1, "findings").otherwise("clean")), F.lit("{3}"), (F.col("doc_id") % 9).cast("string"))
    body = checks.select("source", F.col("doc_id").alias("ord"), F.concat_ws("\n", *map(fill, lines)).alias("value"))
    head = checks.select("source").distinct().select("source", F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("schema_version: 1\nbenchmark_id: "), "source", F.lit("\nchecks:")).alias("value"))
    nameless = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("none").alias("source"), F.lit(0).cast("bigint").alias("ord"), F.lit("schema_version: 1").alias("value"))
    root = shared_path(spark, "keys")
    rows = head.unionByName(body).unionByName(nameless)
    rows.repartition("source").sortWithinPartitions("source", "ord").select("source", "value").write.partitionBy("source").text(root)
    found = yaml_files.answer_keys(spark, root, "part-*.txt")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("benchmark_id", "check_id", "expectation", joined("applies_to"), joined("files"), joined("symbols"), joined("refs"), "error")
