"""Unified diffs as rows: chunks, numbered lines, changed ranges, call links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge

def lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """diff_id, pos, line: rows of a diff's text, in order."""
    return diffs.select(F.col(id_col).alias("diff_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def chunks(rows: DataFrame) -> DataFrame:
    """A column chunk: a new one begins at each `diff --git` line; what stands before the first is chunk 0."""
    w = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chunk", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(w))


def chunk_text(rows: DataFrame) -> DataFrame:
    """diff_id, chunk, path, text of each chunk with any text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = chunks(rows).groupBy("diff_id", "chunk").agg(text.alias("text")).filter("text <> ''")
    return out.withColumn("path", path_of(F.col("text")))


def unquoted(path: Column) -> Column:
    """A path without quotes, octal bytes decoded as UTF-8, up to a tab, without its side's prefix."""
    inner = F.regexp_extract(path, r'^"(.*)"$', 1)
    # Octal bytes become hex digits, everything else too, so that one decoding restores UTF-8.
    pieces = F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    as_hex = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).when(p.startswith("\\"), F.hex(F.substring(p, 2, 1))).otherwise(F.hex(p)),
    )
    decoded = F.when(path.startswith('"'), F.decode(F.unhex(F.array_join(as_hex, "")), "UTF-8")).otherwise(F.substring_index(path, "\t", 1))
    return F.regexp_replace(decoded, "^[ab]/", "")


def path_of(text: Column) -> Column:
    """The new side's path, else the old one's, else that of the git header; null if there is none."""
    side = lambda mark: F.regexp_extract(text, rf"(?m)^{mark} (.+)$", 1)
    named = lambda p: F.when((p != "") & (p != "/dev/null"), unquoted(p))
    header = F.regexp_extract(text, r'(?m)^diff --git .* ("b/.*"|b/.*)$', 1)
    return F.coalesce(named(side(r"\+\+\+")), named(side("---")), named(header))


HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def numbered(rows: DataFrame) -> DataFrame:
    """Hunk lines with mark, old_line and new_line. A line without a known mark ends its hunk."""
    c = chunks(rows)
    by_chunk = Window.partitionBy("diff_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(HUNK)
    c = c.withColumn("hunk", F.sum(head.cast("int")).over(by_chunk)).filter("hunk > 0")
    in_hunk = Window.partitionBy("diff_id", "chunk", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.substring("line", 1, 1)
    broken = (~head & ~mark.isin(" ", "+", "-", "\\")).cast("int")
    start = lambda k: F.max(F.when(head, F.regexp_extract("line", HUNK, k).try_cast("int"))).over(in_hunk)
    c = c.withColumns({"mark": mark, "ended": F.max(broken).over(in_hunk), "o": start(1), "n": start(2), "head": head})
    count = lambda *m: F.sum((~F.col("head") & F.col("mark").isin(*m)).cast("int")).over(in_hunk)
    c = c.withColumns({"old_line": F.col("o") + count(" ", "-") - 1, "new_line": F.col("n") + count(" ", "+") - 1})
    body = c.filter(~F.col("head") & (F.col("ended") == 0) & F.col("mark").isin(" ", "+", "-"))
    return body.select("diff_id", "chunk", "hunk", "pos", "mark", F.when(F.col("mark") != "+", F.col("old_line")).alias("old_line"), F.when(F.col("mark") != "-", F.col("new_line")).alias("new_line"), "line")


def line_ranges(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """diff_id, path, side, lo, hi: current (all shown lines of the new side), new (added), old (removed). paths: diff_id, chunk, path."""
    n = numbered(rows).join(paths, ["diff_id", "chunk"])
    sides = F.array(
        F.when(F.col("mark") != "-", F.struct(F.lit("current").alias("side"), F.col("new_line").alias("lo"))), F.when(F.col("mark") == "+", F.struct(F.lit("new").alias("side"), F.col("new_line").alias("lo"))),
        F.when(F.col("mark") == "-", F.struct(F.lit("old").alias("side"), F.col("old_line").alias("lo"))),
    )
    flat = n.select("diff_id", "path", F.inline(F.filter(sides, lambda x: x.isNotNull()))).withColumn("hi", F.col("lo"))
    return merge(flat, ["diff_id", "path", "side"])


def call_edges(symbols: DataFrame) -> DataFrame:
    """caller, callee, name: files whose calls name what another file defines. symbols: path, defines, calls (arrays).

    A name that many files define and call gives all their pairs; call_links gives one row a call.
    """
    d = symbols.select(F.col("path").alias("callee"), F.explode("defines").alias("name"))
    c = symbols.select(F.col("path").alias("caller"), F.explode("calls").alias("name"))
    return c.join(d, "name").filter("caller <> callee").select("caller", "callee", "name").distinct()


def call_links(symbols: DataFrame) -> DataFrame:
    """caller, name, n_callees, callee: each call with how many other files define its name, and the first of those. Linear, however common a name is."""
    d = symbols.select("path", F.explode("defines").alias("name")).distinct()
    firsts = d.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    seconds = d.join(firsts, "name").filter("path > first").groupBy("name").agg(F.min("path").alias("second"))
    c = symbols.select(F.col("path").alias("caller"), F.explode("calls").alias("name")).distinct()
    own = d.select(F.col("path").alias("caller"), "name", F.lit(1).alias("own"))
    rows = c.join(firsts.join(seconds, "name", "left"), "name").join(own, ["caller", "name"], "left")
    rows = rows.withColumn("n_callees", F.col("n") - F.coalesce("own", F.lit(0))).filter("n_callees > 0")
    return rows.select("caller", "name", "n_callees", F.when(F.col("first") == F.col("caller"), F.col("second")).otherwise(F.col("first")).alias("callee"))
