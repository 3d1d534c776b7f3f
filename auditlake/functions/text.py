"""Scalar text expressions. All stay inside the JVM; lambdas are higher-order functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity levels from the worst on, and the report level of each.
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def severity(text: Column) -> Column:
    """The worst level named anywhere in the text; MEDIUM if none is."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = None
    for level in LEVELS:
        named = upper.contains(level)
        out = F.when(named, level) if out is None else out.when(named, level)
    return out.otherwise("MEDIUM")


def severity_rank(level: Column) -> Column:
    """0 for CRITICAL to 3 for LOW, of any text."""
    name = severity(level)
    return F.array_position(F.array(*map(F.lit, LEVELS)), name).cast("int") - 1


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank)


def sarif_level(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SARIF_LEVELS.items() for x in kv)), severity(level)), F.lit("warning"))


def category_spelling(text: Column) -> Column:
    """Lower case, runs of white space and underscores as one hyphen, no hyphens or white space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def slug(text: Column, length: int = 80) -> Column:
    """Lower-case ASCII letters and digits, runs of others as one hyphen, cut at a length."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+", "-"), "^-+|-+$", ""), 1, length)


def finding_slug(text: Column, length: int = 80) -> Column:
    """Lower case, every character but letters and digits (of all alphabets) a hyphen, none at the ends, cut at a length. `finding` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")
    return F.substring(F.when(plain == "", "finding").otherwise(F.lower(plain)), 1, length)


def unit_slug(path: Column, length: int = 64) -> Column:
    """Lower-case ASCII letters and digits of a path, runs of others as one hyphen, cut at a length (`unit` if nothing is left), and a short digest of the whole path."""
    whole = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.substring(F.when(plain == "", "unit").otherwise(plain), 1, length), F.substring(F.sha2(whole, 256), 1, 16))


def endpoint_normal(text: Column) -> Column:
    """Lower case without backticks, query strings and what is in parentheses; path parameters as *; single blanks."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "`", "")
    for pattern, to in ((r"(?U)\?\S*", ""), (r"\([^)]*\)", " "), (r"[<{][^>}]*[>}]", "*"), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


#: The methods that an endpoint may begin with.
METHODS = "get|post|put|patch|delete|head|options"


def endpoint_method(normal: Column) -> Column:
    """The HTTP method in front of a normalised endpoint, or the empty text."""
    return F.regexp_extract(normal, rf"^({METHODS}) ", 1)


def endpoint_segments(normal: Column) -> Column:
    """The path's segments; a path begins after the first blank, if there is one."""
    path = F.when(F.contains(normal, F.lit(" ")), F.regexp_replace(normal, "^[^ ]* ", "")).otherwise(normal)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def endpoints_named(text: Column) -> Column:
    """Every normalised route that a report's text lists: a comma or a fresh method begins the next. A text without any is one route."""
    return routes_in(endpoint_normal(text))


def routes_in(normal: Column) -> Column:
    """endpoints_named of a text that is normalised already."""
    return routes_of(route_pieces(normal), normal)


def route_pieces(normal: Column) -> Column:
    pieces = F.flatten(F.transform(F.split(normal, r" ?, ?"), lambda part: F.split(part, rf"(?=\b(?:{METHODS})\b )")))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def routes_of(pieces: Column, normal: Column) -> Column:
    """routes_in of a text whose pieces are told already."""
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(normal))


def route_match(report: Column, key: Column) -> Column:
    """Whether two normalised endpoints are the same route.

    Methods must agree where both name one. The shorter path lies at the end of the longer; its first segment is there literally (or a
    parameter on both sides), further ones agree if equal or if either is a parameter.
    """
    return parts_match(route_parts(report), route_parts(key))


def route_parts(normal: Column) -> Column:
    """Method and path, last segment first, of a normalised endpoint."""
    return F.struct(endpoint_method(normal).alias("method"), F.reverse(endpoint_segments(normal)).alias("path"))


def parts_match(x: Column, y: Column) -> Column:
    """route_match of two routes in route_parts."""
    a, b = x["path"], y["path"]
    n = F.least(F.size(a), F.size(b))
    one = lambda s, t: (s == t) | (s == "*") | (t == "*")
    # The last segments decide most pairs. The longer path's other segments stand beside nulls.
    last = (n > 0) & one(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    pairs = F.zip_with(a, b, lambda s, t: s.isNull() | t.isNull() | one(s, t))
    return last & ((x["method"] == "") | (y["method"] == "") | (x["method"] == y["method"])) & F.coalesce(F.get(a, n - 1) == F.get(b, n - 1), F.lit(False)) & F.forall(pairs, lambda same: same)


def endpoint_match(report: Column, key: Column) -> Column:
    """Whether any route that a report's text lists is the key's route."""
    normal = endpoint_normal(key)
    return F.exists(endpoints_named(report), lambda route: route_match(route, normal))


def spelling_tokens(spelling: Column) -> Column:
    """The hyphenated tokens of a category in category_spelling; none of an empty one."""
    return F.when(spelling == "", F.array().cast("array<string>")).otherwise(F.split(spelling, "-"))


def tokens_match(tx: Column, ty: Column) -> Column:
    """category_match of two categories in spelling_tokens."""
    return (F.size(tx) > 0) & (F.size(ty) > 0) & ((tx == ty) | (F.size(F.array_except(tx, ty)) == 0) | (F.size(F.array_except(ty, tx)) == 0))


def category_match(a: Column, b: Column) -> Column:
    """Equal, or the hyphenated tokens of one are among the other's; nothing matches an empty category."""
    return tokens_match(spelling_tokens(category_spelling(a)), spelling_tokens(category_spelling(b)))


def whole_token(text: Column, token: str) -> Column:
    return text.rlike(rf"(?<!\w){re.escape(token)}(?!\w)")


def any_token(text: Column, tokens: Column) -> Column:
    """Whether one of the tokens (an array) stands in the text as a whole, whatever characters it begins and ends with."""
    return F.exists(tokens, lambda t: F.contains(text, t) & F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))))


def field(text: Column, key: str) -> Column:
    """The value of a `key: value` line, whatever the case of the key."""
    return F.regexp_extract(text, rf"(?im)^[ \t]*-?[ \t]*{re.escape(key)}[ \t]*:[ \t]*(.+?)[ \t]*$", 1)


def line_of(text: Column, offset: Column) -> Column:
    """The line number, from 1, of a character offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def truncated(text: Column, most: int, marker: str = "[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n" + marker))).otherwise(text)


def short_hash(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length))


def evidence_words(text: Column) -> Column:
    """Lower-case words joined by one blank, headings' marks dropped; what evidence is compared by."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def symbol_tail(symbol: Column) -> Column:
    """The last dotted part, lower case, identifier characters only."""
    return F.regexp_replace(F.lower(F.element_at(F.split(symbol, r"\."), -1)), "[^a-z0-9_]", "")


def probability(value: Column, default: float) -> Column:
    """A number from 0 to 1, else the default."""
    x = value.try_cast("double")
    return F.when(x.between(0, 1), x).otherwise(F.lit(default))


def line_number(value: Column) -> Column:
    x = value.try_cast("int")
    return F.when(x >= 1, x)


def ratio(part: Column, whole: Column, digits: int, default: float) -> Column:
    """Rounded half to even, as all reported rates are."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(default))


def glob_regex(glob: str) -> str:
    """The anchored pattern of a file glob; * and ? cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"
