"""Report sinks: ordered rows, JSON, SARIF, text and markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .graph import written


def report_order() -> list[Column]:
    """Severity, file, line (none as 0)."""
    return [T.severity_rank(F.col("severity")), F.col("file"), F.coalesce("line", F.lit(0))]


def sarif_results(rows: DataFrame) -> DataFrame:
    """One result per finding with a file: level, place and the index of its rule, rules in order of first appearance."""
    placed = rows.filter("file <> ''")
    rules = placed.groupBy("category").agg(F.min("ord").alias("first"))
    rules = rules.withColumn("rule_index", F.row_number().over(Window.orderBy("first")) - 1)  # as many rows as there are categories
    return placed.join(rules, "category").select(
        "ord", T.severity(F.col("severity")).alias("severity"), T.sarif_level(F.col("severity")).alias("level"), F.col("rule_index").cast("bigint").alias("rule_index"), F.col("category").alias("rule_id"),
        F.col("file").alias("uri"), F.coalesce("line", F.lit(1)).cast("bigint").alias("start_line"),
    )


def text_line() -> Column:
    """[SEVERITY] file:line category."""
    return F.concat(F.lit("["), T.severity(F.col("severity")), F.lit("] "), F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(" "), F.col("category"))


def _ordered(rows: DataFrame) -> DataFrame:
    """A column place: the order of a report. Counted by stretches: rows are sorted by range, and each partition's places follow those before it."""
    part = rows.repartitionByRange(*report_order(), "ord").sortWithinPartitions(*report_order(), "ord")
    return part.withColumn("place", F.monotonically_increasing_id())


def _document(rows: DataFrame, head: list[str], body: Column, between: str, tail: list[str]) -> DataFrame:
    """section, place, text: a document's lines; every row's text but the last ends with `between`."""
    spark = rows.sparkSession
    lines = rows.select(F.lit(1).alias("section"), "place", body.alias("text"))
    last = F.col("place") == F.lit(rows.agg(F.max("place")).first()[0])
    lines = lines.withColumn("text", F.when(last, F.col("text")).otherwise(F.concat("text", F.lit(between)))) if between else lines
    around = [(0, k, t) for k, t in enumerate(head)] + [(2, k, t) for k, t in enumerate(tail)]
    return spark.createDataFrame(around, "section int, place bigint, text string").unionByName(lines)


def _breakdown(rows: DataFrame) -> dict[str, int]:
    found = {r["s"]: r["n"] for r in rows.groupBy(T.severity(F.col("severity")).alias("s")).agg(F.count("*").alias("n")).collect()}
    return {level: found.get(level, 0) for level in T.LEVELS}


def json_document(rows: DataFrame, target: dict | None = None) -> DataFrame:
    """section, place, text of a report: findings in order, summary by severity, and the target if there is one."""
    placed = written(_ordered(rows), "report")
    fields = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "ord")), {"ignoreNullFields": "false"})
    tail = ["],", f'"summary": {json.dumps(_breakdown(rows))}' + ("," if target else ""), *([f'"target": {json.dumps(target, ensure_ascii=False)}'] if target else []), "}"]
    return _document(placed, ["{", '"findings": ['], fields, ",", tail)


def sarif_document(rows: DataFrame, tool: str, target: dict | None = None) -> DataFrame:
    """section, place, text of a SARIF 2.1.0 log with one run: a rule for each category in order of appearance, a result for each finding that has a file. Optional columns: description, exploit_scenario, confidence."""
    placed = written(_ordered(rows.filter("file <> ''").withColumn("rule_id", F.when(F.coalesce("category", F.lit("")) == "", "security").otherwise(F.col("category")))), "report")
    names = [r["rule_id"] for r in placed.groupBy("rule_id").agg(F.min("place").alias("p")).orderBy("p").limit(MOST_RULES + 1).collect()]
    if len(names) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    rules = [{"id": n, "name": n, "shortDescription": {"text": f"{tool}: {n}"}} for n in names]
    of = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k))) if names else F.create_map().cast("map<string,int>")
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    text = lambda *cs: F.coalesce(*(F.when(c != "", c) for c in cs), F.lit("security finding"))
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    physical = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    properties = F.struct(T.severity(F.col("severity")).alias("severity"), "category", has("confidence").alias("confidence"), has("exploit_scenario").alias("exploitScenario"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.element_at(of, F.col("rule_id")).alias("ruleIndex"), T.sarif_level(F.col("severity")).alias("level"), F.struct(text(has("description"), F.col("category")).alias("text")).alias("message"),
        F.array(physical).alias("locations"), properties.alias("properties"),
    )
    driver = json.dumps({"driver": {"name": tool, "rules": rules}}, ensure_ascii=False)
    head = ["{", '"$schema": "https://json.schemastore.org/sarif-2.1.0.json",', '"version": "2.1.0",', '"runs": [{', f'"tool": {driver},', '"results": [']
    tail = ["]" + ("," if target else ""), *([f'"properties": {json.dumps({"target": target}, ensure_ascii=False)}'] if target else []), "}]", "}"]
    return _document(placed, head, F.to_json(result), ",", tail)


def markdown_document(rows: DataFrame) -> DataFrame:
    """section, place, text of a report for people: counts by severity, then each finding with what is known of it."""
    b = _breakdown(rows)
    head = ["## Security review", "", f"{b['CRITICAL']} critical, {b['HIGH']} high, {b['MEDIUM']} medium, {b['LOW']} low." if any(b.values()) else "No findings.", ""]
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    part = lambda mark, c: F.when(F.coalesce(has(c), F.lit("")) != "", F.concat(F.lit(mark), has(c), F.lit("\n")))
    kind = F.when(F.coalesce("category", F.lit("")) != "", F.concat(F.lit(" "), "category")).otherwise("")
    place = F.concat("file", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    title = F.concat(F.lit("### "), T.severity(F.col("severity")), kind, F.lit(" `"), place, F.lit("`\n"))
    return _document(written(_ordered(rows), "report"), head, F.concat_ws("\n", title, part("", "description"), part("**Exploit:** ", "exploit_scenario"), part("**Fix:** ", "recommendation")), "", [])


#: Categories of one report, which become rules of its run.
MOST_RULES = 10_000


def unique_names(rows: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """A column name: in order, each row gets its base or, where that is taken, the base with the least number from 2 on that is free.

    Bases that differ in numbers at their ends (a, a-2) can take each other's names: only these go through a fold, which holds the names of one family. All others are numbered.
    """
    based = written(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), base.alias("_base"), F.struct(*order).alias("_at")).withColumn("_family", F.regexp_replace("_base", r"(-\d+)+$", "")), "names")
    mixed = based.groupBy("_family").agg(F.min("_base").alias("a"), F.max("_base").alias("b")).filter("a <> b").select("_family")
    n = F.row_number().over(Window.partitionBy("_base").orderBy("_at"))
    plain = based.join(mixed, "_family", "left_anti").select("_row", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string"))).alias("name"))
    clashing = based.join(mixed, "_family")
    schema = StructType([clashing.schema["_row"], StructField("name", StringType())])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for f, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if f != family:
                    family, taken, following = f, set(), {}
                name, k = b, following.get(b, 2)
                while name in taken:
                    name, k = f"{b}-{k}", k + 1
                following[b] = max(2, k)
                taken.add(name)
                out.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=arrow)

    folded = clashing.select("_row", "_family", "_base", "_at").repartition("_family").sortWithinPartitions("_family", "_at").mapInArrow(fold, schema)
    return plain.unionByName(folded).select("_row.*", "name")
