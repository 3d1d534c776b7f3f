"""Text pieces for review contexts: numbered lines, previews, tables, offsets, usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW_LINES, PREVIEW_CHARS = 3, 240


def numbered_lines(text: Column, first: int = 1) -> Column:
    """Every line behind its number, right-aligned to the last one's width."""
    lines = F.split(text, "\n")
    width = F.length((F.size(lines) + first - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")


def patch_gutter(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, text: shown lines of patches (by, pos, old_line, new_line, line) behind a gutter old:new, a side that a line isn't on left blank; widths are those of each patch's longest number."""
    width = lambda c: F.max(F.length(F.col(c).cast("string")))
    sized = lines.groupBy(*by).agg(F.coalesce(width("old_line"), F.lit(0)).alias("_o"), F.coalesce(width("new_line"), F.lit(0)).alias("_n"), F.array_sort(F.collect_list(F.struct("pos", "old_line", "new_line", "line"))).alias("_l"))
    number = lambda c, w: F.lpad(F.coalesce(c.cast("string"), F.lit("")), w, F.lit(" "))
    shown = F.transform("_l", lambda x: F.concat(number(x["old_line"], F.col("_o")), F.lit(":"), number(x["new_line"], F.col("_n")), F.lit(" | "), x["line"]))
    return sized.select(*by, F.array_join(shown, "\n").alias("text"))


def preview(text: Column) -> Column:
    """A declaration: its first nonblank lines, trimmed and joined, up to an opening brace."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, PREVIEW_LINES)
    joined = F.array_join(lines, " ")
    return F.substring(F.trim(F.when(joined.contains("{"), F.substring_index(joined, "{", 1)).otherwise(joined)), 1, PREVIEW_CHARS)


def table_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, cells of a markdown text's table lines; separator lines are left out."""
    lines = rows.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    table = lines.filter(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return table.select(id_col, "pos", cells.alias("cells"))


def characters_before(text: Column, n_bytes: Column) -> Column:
    """How many characters the first bytes of a text hold, a return with its line feed counted as one."""
    return F.length(F.replace(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), n_bytes), "UTF-8"), F.lit("\r\n"), F.lit("\n")))


def usage_fields(record: Column) -> list[Column]:
    """Four token counters and their total from a provider's usage record (JSON), whichever names it uses."""
    v = F.try_parse_json(record)
    get = lambda *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", "bigint") for n in names), F.lit(0).cast("bigint"))
    parts = {"input_tokens": get("input_tokens", "prompt_tokens"), "output_tokens": get("output_tokens", "completion_tokens"), "cache_read": get("cache_read_input_tokens", "cached_tokens"), "cache_write": get("cache_creation_input_tokens")}
    return [*(c.alias(n) for n, c in parts.items()), (parts["input_tokens"] + parts["cache_read"] + parts["cache_write"]).alias("total_input")]


def reply_rows(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Findings of each reply (object with findings); one malformed item fails its whole reply: ok is false and there are no rows of it."""
    shape = "struct<findings:array<struct<file:string,line:string,severity:string>>>"
    parsed = replies.select(id_col, F.from_json(text_col, shape)["findings"].alias("items"))
    valid = F.col("items").isNotNull() & F.forall(F.coalesce("items", F.array().cast("array<struct<file:string,line:string,severity:string>>")), lambda x: x["file"].isNotNull() & (x["file"] != "") & x["severity"].isNotNull())
    rows = parsed.select(id_col, F.coalesce(valid, F.lit(False)).alias("ok"), "items")
    items = F.when(F.col("ok") & (F.size("items") > 0), F.col("items")).otherwise(F.array(F.lit(None).cast("struct<file:string,line:string,severity:string>")))
    flat = rows.select(id_col, "ok", F.posexplode(items).alias("pos", "f"))
    return flat.select(id_col, "ok", "pos", "f.file", F.col("f.line").try_cast("int").alias("line"), "f.severity")


def shown_files_only(refuted: Column, cited: Column, shown: Column) -> Column:
    """A refutation that cites a file which wasn't shown is no refutation."""
    return F.when(refuted & (cited != "") & ~F.coalesce(F.exists(shown, lambda p: (p == cited) | (F.substring_index(p, "/", -1) == F.substring_index(cited, "/", -1))), F.lit(False)), F.lit(False)).otherwise(refuted)
