"""Symbols of source texts: what they define, call, assign, import and export, read from one scan of their tokens.

The scan knows strings, comments, names and brackets, whatever the language, so nothing is read from strings or comments and parameter lists end where they
do. It is no parser: `//` and `#` begin a comment wherever they stand outside strings, as does `*` at a line's beginning.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that only look like calls or definitions, and the least length of a called name.
CONTROL = ("catch", "else", "for", "if", "return", "switch", "while")
LEAST_NAME = 5
#: Words before a defined name, before a name bound to a value, before a declared name that is no function, and names of nameless functions.
DEFINE, BIND, DECLARE, NAMELESS = {"def", "func", "function", "modifier"}, {"const", "let", "var"}, {"event", "error"}, {"constructor", "fallback", "receive"}
OPEN = {"(": ")", "[": "]", "{": "}"}

TOKEN = re.compile(
    r"""
    (?P<comment> //[^\n]* | \#[^\n]* | /\*.*?(?:\*/|\Z) | (?m:^)[ \t]*\*[^\n]* )
    | (?P<string> \"{3}.*?\"{3} | '{3}.*?'{3} | "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' | `(?:[^`\\]|\\.)*` )
    | (?P<name> [A-Za-z_$][\w$]* )
    | (?P<number> \d\w* )
    | (?P<line> \n )
    | (?P<mark> => | [^\s\w] )
    """,
    re.X | re.S | re.A,
)


class Scan:
    """The tokens of a text without comments, which bracket closes which, and the symbols found in them."""

    def __init__(self, text: str):
        self.kind, self.text, self.at, self.first = [], [], [], []
        fresh = True
        for m in TOKEN.finditer(text):
            if m.lastgroup == "line":
                fresh = True
            elif m.lastgroup != "comment":
                self.kind.append(m.lastgroup)
                self.text.append(m[0])
                self.at.append(m.start())
                self.first.append(fresh)
                fresh = False
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.text):
            if self.kind[k] == "mark" and t in OPEN:
                stack.append(k)
            elif self.kind[k] == "mark" and t in OPEN.values() and stack and OPEN[self.text[stack[-1]]] == t:
                self.partner[k] = stack[-1]
                self.partner[stack.pop()] = k

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.text) and self.kind[k] != "string" and self.text[k] in texts

    def after(self, k: int) -> int:
        """The token after a bracket's partner, or none."""
        return self.partner.get(k, len(self.text)) + 1

    def arrow(self, k: int) -> bool:
        """Whether a function written with an arrow begins at a token: parameters in parentheses or a single name."""
        k += self.is_(k, "async")
        return self.is_(self.after(k) if self.is_(k, "(") else k + 1, "=>")

    def assigned(self, k: int) -> bool:
        return self.is_(k + 1, "=") and not self.is_(k + 2, "=")

    def defined(self, k: int) -> bool:
        """Whether the name at a token is defined there as something that can be called."""
        if self.text[k] in CONTROL:
            return False
        if self.assigned(k):
            return self.is_(k - 1, *BIND) and self.arrow(k + 2)
        if not self.is_(k + 1, "("):
            return False
        if self.is_(k - 1, *DEFINE) or (self.is_(k - 1, ")") and self.is_(self.partner.get(k - 1, 0) - 1, "func")) or self.text[k] in NAMELESS:
            return not self.is_(k - 1, ".")
        begins = self.first[k] or (self.is_(k - 1, "async") and self.first[k - 1])
        inside = range(k + 2, self.partner.get(k + 1, 0))
        return begins and self.is_(self.after(k + 1), "{") and not any(self.is_(i, ";", "{", "}") for i in inside)

    def declaration_end(self, k: int) -> int:
        """Where a function without body, whose name is at a token, ends; the token itself if it has one."""
        if self.is_(k - 1, "function", "modifier") and self.is_(k + 1, "("):
            i = self.after(k + 1)
            while i < len(self.text) and not self.is_(i, "{", "=>", ";", "}"):
                i = self.after(i) if self.is_(i, "(") else i + 1
            if self.is_(i, ";"):
                return i
        return k

    def listed(self, k: int) -> list[str]:
        """Names in braces that open at a token; of `a as b` the last."""
        out: list[str] = []
        for i in range(k + 1, self.partner.get(k, k)):
            if self.kind[i] == "name" and self.text[i] != "as":
                if self.is_(i - 1, "as"):
                    out.pop()
                out.append(self.text[i])
        return out

    def dotted(self, k: int) -> str:
        """The dotted name from a token on."""
        out = ""
        while k < len(self.text) and (self.kind[k] == "name" or self.is_(k, ".")) and (not self.first[k] or not out) and not self.is_(k, "import", "as"):
            out, k = out + self.text[k], k + 1
        return out

    def symbols(self) -> list[tuple[str, str, int]]:
        """(kind, name, offset) in order: definition, call, assignment, import, export."""
        out, k = [], 0
        while k < len(self.text):
            if self.kind[k] == "name":
                name, at = self.text[k], self.at[k]
                if self.defined(k):
                    out.append(("definition", "constructor" if name in NAMELESS and not self.is_(k - 1, *DEFINE, *BIND) else name, at))
                    end = self.declaration_end(k)
                    k = max(k, end)
                elif self.is_(k + 1, "(") and len(name) >= LEAST_NAME and name not in CONTROL and name != "returns" and not (name == "async" and self.arrow(k)) and not (self.is_(k - 1, *DECLARE) and self.first[k - 1]):
                    out.append(("call", name, at))
                if self.assigned(k) and len(name) >= LEAST_NAME and self.is_(k + 2 + self.is_(k + 2, "async"), "("):
                    out.append(("assignment", name, at))
                out += [(kind, x, at) for kind, x in self.modules(k) if x]
            k += 1
        return out

    def modules(self, k: int) -> list[tuple[str, str]]:
        """Imports and exports that begin at a name."""
        word = self.text[k]
        if word == "from" and k + 1 < len(self.text):
            if self.kind[k + 1] == "string":
                return [("import", self.text[k + 1].strip("\"'`"))]
            if self.first[k] and any(self.is_(i, "import") for i in range(k + 2, min(k + 40, len(self.text)))):
                start = k + 1
                dots = 0
                while self.is_(start + dots, "."):
                    dots += 1
                return [("import", "." * dots + self.dotted(start + dots))]
        if word == "import" and self.first[k] and k + 1 < len(self.text):
            if self.kind[k + 1] == "string":
                return [("import", self.text[k + 1].strip("\"'`"))]
            if self.kind[k + 1] == "name" and not any(self.is_(i, "from") for i in range(k + 1, min(k + 40, len(self.text))) if not any(self.first[k + 1 : i + 1])):
                return [("import", self.dotted(k + 1))]
        if word == "require" and self.is_(k + 1, "(") and k + 2 < len(self.text) and self.kind[k + 2] == "string" and self.is_(k + 3, ")"):
            return [("import", self.text[k + 2].strip("\"'`"))]
        if word == "export" and self.first[k]:
            if self.is_(k + 1, "{"):
                return [("export", x) for x in self.listed(k + 1)]
            i = k + 1
            if self.is_(i, "default"):
                return [("export", "default")]
            i += self.is_(i, "async")
            if self.is_(i, "function", "class", "const", "let", "var", "interface", "type", "enum") and i + 1 < len(self.text):
                return [("export", self.text[i + 1])]
            if self.is_(i, "*"):
                return [("export", "*")]
        return []


def with_symbols(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """A column symbols: kind, name and offset of each symbol, in order. Null texts have none."""

    @F.pandas_udf("array<struct<kind:string,name:string,at:int>>")
    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": kind, "name": name, "at": at} for kind, name, at in Scan(t or "").symbols()])

    return rows.withColumn("symbols", scanned(F.col(text_col)))


def names(symbols: Column, *kinds: str) -> Column:
    """Distinct names of some kinds, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(symbols, lambda s: s["kind"].isin(*kinds)), lambda s: s["name"])))


def definitions(symbols: Column) -> Column:
    return names(symbols, "definition")


def calls(symbols: Column) -> Column:
    return names(symbols, "call")


def changed_names(symbols: Column) -> Column:
    """What is called, defined or bound to something callable: names by which changes are brought together."""
    found = F.filter(symbols, lambda s: s["kind"].isin("call", "definition", "assignment") & (F.length(s["name"]) >= LEAST_NAME))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["name"])))


def hunk_names(hunks: DataFrame, by: list[str]) -> DataFrame:
    """by, names: what the shown lines (by, pos, line with its mark) of each changed file name. Lines are read together, so strings and comments may go over several."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.expr("substring(line, 2)").alias("line")))), lambda x: x["line"]), "\n")
    return with_symbols(hunks.groupBy(*by).agg(text.alias("text"))).select(*by, changed_names(F.col("symbols")).alias("names"))


def call_edges_of(texts: DataFrame) -> DataFrame:
    """caller, name, n_callees, callee of each call in texts (path, text) that another of them defines."""
    from .diffs import call_links
    from .graph import written

    found = written(with_symbols(texts).select("path", definitions(F.col("symbols")).alias("defines"), calls(F.col("symbols")).alias("calls")), "symbols")
    return call_links(found)
