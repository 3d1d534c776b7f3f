"""Secret scans with an incremental blob ledger, in DataFrame functions throughout.

A blob is the SHA-256 of a text. The ledger holds, for each blob and rule version that was scanned, the spans found.
Only pairs of blob and rule version that it lacks are scanned, each blob once however many rows carry it; findings are
then joined back to all rows (paths). Spans are in code points, end exclusive.

Defined cases: null texts count as empty; repeated rows each get their row; a null id stays null; an empty table gives an
empty result; matches that fail a rule's length are dropped after matching, so what they cover isn't matched again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: The group whose length counts, and its least length.
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which kinds are listed. A run of too few characters can be left out of the access
#: and hex patterns themselves, since such a run holds no other match; the assign rule checks its value afterwards.
BASE = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: What the operator finds besides.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def find(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches: what lies between matches and the matches themselves, summed up."""
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    valued = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(found, valued, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("value")))
    parts = F.zip_with(between, sizes, lambda gap, s: F.struct(gap.alias("gap"), s["size"].alias("size"), s["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        kept = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.when(x["size"].isNull(), state).otherwise(F.struct(end.alias("at"), F.when(x["value"] >= rule.least, kept).otherwise(state["spans"]).alias("spans")))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], "blob string, rule string, kind string, spans array<struct<start:int,end:int>>")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: the blobs and rule versions that it lacks, scanned. Write them and add them to the ledger."""
    text = text_of(text_col)
    # Equal blobs meet in a task's partial aggregation, so each is moved and scanned once.
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    names = [r.name for r in rules]
    if ledger is None:
        seen = F.array().cast("array<string>")
    else:
        blobs = blobs.join(ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen")), "blob", "left").filter(F.size(F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))) > 0)
        seen = F.coalesce("seen", F.array().cast("array<string>"))
    scanned = blobs.select("blob", *(F.when(~F.array_contains(seen, r.name) if ledger is not None else F.lit(True), find(F.col("text"), r)).alias(f"f{k}") for k, r in enumerate(rules)))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"f{k}").alias("spans")) for k, r in enumerate(rules)))
    return scanned.select("blob", F.inline(F.filter(each, lambda x: x["spans"].isNotNull())))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, ledger): a struct of each row's columns (keep) with its findings, and the grown ledger.

    found: kind, start, end, by start, then kind as listed.
    """
    new = materialise(scan_unseen(docs, ledger, rules, text_col), "ledger")
    grown = new if ledger is None else ledger.unionByName(new)
    order = {r.kind: k for k, r in reversed(list(enumerate(rules)))}
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("kind"))
    current = grown.filter(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
    flat = current.select("blob", F.inline(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))))
    # Written, so that the join below reads two plain sides and a blob that many rows carry can be split among tasks.
    by_blob = materialise(flat.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found")), "findings")
    keys = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.sha2(text_of(text_col), 256).alias("blob"))
    rows = keys.join(by_blob.hint("merge"), "blob", "left")
    return rows.select("row", "blob", F.coalesce("found", F.array().cast(by_blob.schema["found"].dataType)).alias("found")), grown


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows with every span, overlapping ones merged, replaced by [secret]; size_col follows. Other columns stay as they are."""
    rows, _ = find_secrets(docs, rules=rules, text_col=text_col)
    span = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    merged = F.aggregate(
        "found", F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), span(F.get(a, F.size(a) - 1)["start"], F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]))),
        ).otherwise(F.concat(a, span(x["start"], x["end"]))),
    )
    text = F.col("row")[text_col]

    def between(m: Column, k: Column) -> Column:
        after = F.coalesce(F.get(m, k - 1)["end"], F.lit(0))
        return F.substring(text, after + 1, F.coalesce(F.get(m, k)["start"], F.length(text)) - after)

    # One-element arrays bind a value, so that it is computed once.
    cut = F.get(F.transform(F.array(merged), lambda m: F.concat_ws("[secret]", F.transform(F.sequence(F.lit(0), F.size(m)), lambda k: between(m, k)))), F.lit(0))
    rows = rows.select("row", F.size("found").alias("n"), F.when(F.size("found") > 0, cut).otherwise(text).alias("text"))
    now = {text_col: F.col("text")}
    if size_col and size_col in docs.columns:
        now[size_col] = F.when(F.col("n") > 0, F.length("text")).otherwise(F.col("row")[size_col]).cast(docs.schema[size_col].dataType)
    return rows.select(*(now.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
