"""Model replies: finding the JSON object in a text, its contract, its rows; citations in prose."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a reply that are searched for an object, as a bound on work.
SEARCHED = 1_000_000


def objects_in(text: str) -> Iterator[str]:
    """Balanced {...} in order, braces within strings not counted; what is left open at the end is closed."""
    start, stack, quoted, escaped = -1, [], False, False
    for i, c in enumerate(text):
        if start < 0:
            if c == "{":
                start, stack, quoted = i, ["}"], False
            continue
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            stack.pop()
            if not stack:
                yield text[start : i + 1]
                start = -1
    if start >= 0:
        yield text[start:] + '"' * quoted + "".join(reversed(stack))


def parse_object(text: str | None) -> dict | None:
    """The reply's object: the text itself, a fenced object, or the first balanced braces that parse; trailing commas are forgiven. Texts that are JSON but no object have none."""
    text = (text or "").strip()[:SEARCHED]
    try:
        found = json.loads(text)
    except ValueError:
        pass
    else:
        return found if isinstance(found, dict) else None
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    for candidate in (*([fenced[1]] if fenced else ()), *objects_in(text)):
        for attempt in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate)):
            try:
                found = json.loads(attempt)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return None


def reply_objects(replies: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns object (JSON text, null if there is none) and cut: whether only the first SEARCHED characters were searched. Texts that are JSON objects as they stand never leave the JVM and are never cut."""
    direct = F.when(F.trim(text_col).startswith("{"), F.try_parse_json(F.col(text_col)))

    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (o := parse_object(t)) is None else json.dumps(o, sort_keys=True))

    easy = replies.withColumn("_v", direct)
    found = easy.filter("_v IS NOT NULL").withColumn("object", F.to_json("_v")).drop("_v").withColumn("cut", F.lit(False))
    rest = easy.filter("_v IS NULL").drop("_v").withColumn("object", search(F.col(text_col)))
    return found.unionByName(rest.withColumn("cut", F.coalesce(F.length(F.trim(text_col)) > SEARCHED, F.lit(False))))


def contract_ok(obj: Column, required: list[str], optional: list[str] = ()) -> Column:
    """Whether a JSON object has all required keys as lists, and optional ones as lists where present."""
    value = F.try_parse_json(obj)
    is_list = lambda k: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")), F.lit("ARRAY")), F.lit(False))
    has = lambda k: F.try_variant_get(value, f"$.{k}", "variant").isNotNull()
    ok = value.isNotNull()
    for k in required:
        ok = ok & is_list(k)
    for k in optional:
        ok = ok & (~has(k) | is_list(k))
    return ok


def citations(text: Column) -> Column:
    """array<struct<path, line>>: every path:line in a text; what begins like a date is none."""
    pattern = r"([A-Za-z_][\w./-]*\.[A-Za-z]\w*):(\d+)"
    names, lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.filter(F.zip_with(names, lines, lambda p, n: F.struct(p.alias("path"), n.try_cast("int").alias("line"))), lambda x: x["line"].isNotNull())


def plain_path(path: Column) -> Column:
    """Without doubled slashes and . segments."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(?:\./)+", "$1")


# Patterns of an extension, of a path in backticks, of a bare path before a line, of a folder that is a date or a number, and of a cited line.
_EXTENSION = r"\.[A-Za-z][A-Za-z0-9]{0,15}"
_QUOTED = rf"`([\w./-][\w ./-]*{_EXTENSION})`"
_BARE = rf"(?<![\w./-])([\w./-]+{_EXTENSION})(?=:\d)"
_DATED = r"^\d+(?:-|$)"
_CITED = r"`[^`\r\n]+`:\d+|[\w./-]+\.\w+:\d+"


def source_paths(text: Column) -> Column:
    """Distinct paths that a text names, sorted: in backticks (blanks allowed), or bare before a colon and a line. Bare ones below a dated folder are none."""
    quoted = F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1))
    rest = F.regexp_replace(text, _QUOTED, " ")
    rest = F.aggregate(F.filter(quoted, lambda p: p.contains(" ")), rest, lambda t, p: F.replace(t, p, F.lit(" ")))
    plain = F.filter(F.regexp_extract_all(rest, F.lit(_BARE), F.lit(1)), lambda p: ~F.substring_index(p, "/", 1).rlike(_DATED))
    return F.array_sort(F.array_distinct(F.concat(quoted, plain)))


def file_of(cited: Column, files: Column) -> Column:
    """The file that a cited path means: the same path, else the only one of its name, else null."""
    exact = F.filter(files, lambda f: plain_path(f) == plain_path(cited))
    named = F.filter(files, lambda f: F.substring_index(f, "/", -1) == F.substring_index(plain_path(cited), "/", -1))
    return F.when(F.size(exact) > 0, F.get(exact, F.lit(0))).when(F.size(named) == 1, F.get(named, F.lit(0)))


def cited_locations(text: Column, files: Column) -> Column:
    """array<struct<file, line>>, sorted: lines that a text cites of the files (an array), as `path`:line or path:line, bare paths with blanks too; a file that no line is cited of comes with a null line."""
    at = lambda file, line: F.struct(file.alias("file"), line.try_cast("int").alias("line"))
    found = F.regexp_extract_all(text, F.lit(_CITED), F.lit(0))
    cited = F.transform(found, lambda c: at(file_of(F.regexp_replace(F.regexp_replace(c, r":\d+$", ""), "^`|`$", ""), files), F.substring_index(c, ":", -1)))
    blank = F.filter(files, lambda f: f.contains(" "))
    spaced = F.flatten(F.transform(blank, lambda f: F.transform(F.regexp_extract_all(text, F.concat(F.lit(r"(?<![\w./-])\Q"), f, F.lit(r"\E:(\d+)")), F.lit(1)), lambda n: at(f, n))))
    lines = F.filter(F.concat(cited, spaced), lambda x: x["file"].isNotNull())
    bare = F.transform(F.array_except(files, F.transform(lines, lambda x: x["file"])), lambda f: at(f, F.lit(None).cast("string")))
    return F.array_sort(F.array_distinct(F.concat(lines, bare)))


#: The ratio from which long texts count as one, and the characters of a long one.
SIMILAR, LEAST_SIMILAR_CHARS = 0.92, 120


def compared_words(block: str) -> str:
    """What blocks are compared by: lower-case words, without the headings at the beginning unless there is nothing else."""
    lines = block.splitlines()
    start = next((k for k, line in enumerate(lines) if not line.lstrip().startswith("#")), len(lines))
    return " ".join(re.findall(r"\w+", ("\n".join(lines[start:]).strip() or block).lower()))


def alike(known: str, words: str) -> bool:
    """Equal words, or long ones that hardly differ. Cheap upper bounds of the ratio go first."""
    if words == known:
        return True
    if len(words) < LEAST_SIMILAR_CHARS:
        return False
    m = difflib.SequenceMatcher(None, words, known)
    return m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR


def distinct_blocks(evidence: str | None) -> tuple[list[str], str]:
    """Blocks of evidence without those that repeat an earlier one, and what joins them.

    Blank lines part blocks; only where there are none, "; " does. Blocks that begin with a heading stay, but count among those that others repeat. Blocks without words go.
    """
    body = (evidence or "").strip()
    joint = next((j for j in ("\n\n", "; ") if j in body), "")
    if not joint:
        return [body] * bool(body), joint
    kept, seen = [], []
    for block in filter(None, (b.strip() for b in (re.split(r"\n{2,}", body) if joint == "\n\n" else body.split(joint)))):
        words = compared_words(block)
        again = not words or any(alike(known, words) for known in seen)
        if not again:
            seen.append(words)
        if not again or block.startswith("#"):
            kept.append(block)
    return kept, joint


def fuzzy_evidence(rows: DataFrame, text_col: str) -> DataFrame:
    """Columns blocks (one row's distinct blocks of evidence) and joined. The comparison is within one finding's text."""

    @F.pandas_udf("struct<blocks:array<string>,joined:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [distinct_blocks(t) for t in texts]
        return pd.DataFrame({"blocks": [b for b, _ in found], "joined": [j.join(b) for b, j in found]})

    return rows.withColumn("_e", run(F.col(text_col))).withColumns({"blocks": F.col("_e.blocks"), "joined": F.col("_e.joined")}).drop("_e")


def windows_of(text: str, cap: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) windows of a text: each ends at the last line start without indent within the cap, else at the cap with an overlap to the next."""
    out, start = [], 0
    while len(text) - start > cap:
        cuts = [m.end() for m in re.finditer(r"\n(?=\S)", text[start : start + cap + 1])]  # a line may start right at the cap
        if cuts:
            end = start + cuts[-1]
            nxt = end
        else:
            end = start + cap
            nxt = max(start + 1, end - overlap)
        out.append((start, end))
        start = nxt
    out.append((start, len(text)))
    return out


def text_windows(rows: DataFrame, id_col: str, text_col: str, cap: int = 24_000, overlap: int = 2_000) -> DataFrame:
    """One row per window: its number, start and end."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in windows_of(t or "", cap, overlap)])

    return rows.select(id_col, F.posexplode(run(F.col(text_col))).alias("window", "w")).select(id_col, "window", "w.start", "w.end")
