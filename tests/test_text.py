from __future__ import annotations

import fnmatch

import pytest
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,level", [("HIGH", "HIGH"), ("critical risk", "CRITICAL"), ("", "MEDIUM"), ("nonsense", "MEDIUM"), (None, "MEDIUM"), ("low to high", "HIGH")])
def test_severity(spark, text, level):
    assert value(spark, T.severity(F.lit(text).cast("string"))) == level


ROUTES = [
    ("GET /shop/v2/carts/77/lines", "GET /carts/{cart}/lines", True),  # a mount in front, a number for a parameter
    ("PUT /shop/v2/carts/77/lines", "GET /carts/{cart}/lines", False),  # another method
    ("/carts/77", "DELETE /carts/<id>", True),  # no method on one side
    ("GET /shop/carts/5", "GET /carts/<id>", True),  # the last segment is a parameter, the paths differ in length
    ("GET /carts/<id>", "GET /carts", False),  # an item is not its collection
    ("GET /carts", "GET /carts/<id>", False),
    ("GET /x/<a>", "GET /<b>", True),  # parameters as heads on both sides
    ("GET /x/7", "GET /<b>", False),  # a head is literal otherwise
    ("POST `/login` (auth handler)?next=/home", "post /login", True),
    ("GET /find?q=<term>", "GET /find", True),
    ("GET /a/<x>, POST /b, /c", "POST /b", True),  # any listed route
    ("GET /a/<x> DELETE /b/<y>", "DELETE /b/9", True),
    ("GET /a/<x> DELETE /b/<y>", "PATCH /b/9", False),
    ("queue consumer", "queue consumer", True),
    ("", "GET /a", False),
    ("GET /", "GET /", False),
]


@pytest.mark.parametrize("report,key,same", ROUTES)
def test_endpoint_match(spark, report, key, same):
    assert value(spark, T.endpoint_match(F.lit(report), F.lit(key))) is same


def test_endpoints_named(spark):
    assert value(spark, T.endpoints_named(F.lit("GET /one/<id> , /two  PUT /three"))) == ["get /one/*", "/two", "put /three"]
    assert value(spark, T.endpoints_named(F.lit("a cron job"))) == ["a cron job"]
    assert value(spark, T.endpoints_named(F.lit(None).cast("string"))) == [""]


def test_endpoint_normal(spark):
    assert value(spark, T.endpoint_normal(F.lit(" GET\t`/A/{b}/<c>`?x=1&y (see(x) y"))) == "get /a/*/* y"
    assert value(spark, T.endpoint_normal(F.lit("/a(b)c"))) == "/a c"


@pytest.mark.parametrize("text,want", [("Ünsafe  Thing!", "ünsafe--thing"), ("--", "finding"), (None, "finding"), ("a_b", "a-b"), ("x" * 100, "x" * 80), ("日本 2", "日本-2")])
def test_finding_slug(spark, text, want):
    assert value(spark, T.finding_slug(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("path,want", [("Src\\A b.PY", "src-a-b-py"), ("///", "unit"), ("é", "unit"), ("a" * 70, "a" * 64)])
def test_unit_slug(spark, path, want):
    import hashlib

    assert value(spark, T.unit_slug(F.lit(path))) == f"{want}-{hashlib.sha256(path.replace(chr(92), '/').encode()).hexdigest()[:16]}"


@pytest.mark.parametrize("token,found", [("$raw", True), ("raw", True), ("_mint", False), ("mint", True), ("approve", False), ("a.b", True), ("a-b", False)])
def test_any_token(spark, token, found):
    assert value(spark, T.any_token(F.lit("use $raw(x), mint and approved a.b"), F.array(F.lit(token)))) is found
    assert value(spark, T.any_token(F.lit("x"), F.array().cast("array<string>"))) is False


@pytest.mark.parametrize("a,b,same", [("injection", "code-injection", True), ("code-injection", "injection", True), ("sql-injection", "code-injection", False), ("", "x", False), ("Access_Control", "access control", True), ("access\t\ncontrol", "access-control", True), ("-xss ", "xss", True)])
def test_category_match(spark, a, b, same):
    assert value(spark, T.category_match(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("glob", ["*.py", "test_*", "a?c", "[ab]*.js", "[!a]b", "x.(y)"])
def test_globs(glob):
    import re

    for name in ("a.py", "test_x", "abc", "b.js", "cb", "ab", "x.(y)", "dir/a.py"):
        assert bool(re.match(T.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_rounding_is_half_even(spark):
    assert value(spark, T.ratio(F.lit(1), F.lit(32), 4, 0.0)) == 0.0312
    assert value(spark, T.ratio(F.lit(1), F.lit(0), 4, 1.0)) == 1.0


def test_fields_and_lines(spark):
    text = F.lit("Severity: high\n- Status:  Open \nx")
    assert value(spark, T.field(text, "severity")) == "high"
    assert value(spark, T.field(text, "status")) == "Open"
    assert value(spark, T.line_of(text, F.lit(20))) == 2
    assert value(spark, T.truncated(F.lit("abcdef"), 3)) == "abc\n[truncated]"
    assert value(spark, T.symbol_tail(F.lit("Vault.liquidate()"))) == "liquidate"


def test_paths(spark):
    rules = P.PathRules()
    get = lambda c, p: value(spark, c(F.lit(p), rules))
    assert get(P.is_skipped, "a/node_modules/b.js") and get(P.is_skipped, "build/x.py") and not get(P.is_skipped, "a/build/x.py") and not get(P.is_skipped, "x.py")
    assert get(P.is_test, "tests/x.py") and get(P.is_test, "a/Test_x.py") and not get(P.is_test, "a/x.py")
    assert get(P.is_noise, "README.md") and get(P.is_noise, "package-lock.json") and not get(P.is_noise, "app/x.py")
    assert value(spark, P.is_unsafe(F.lit("../x"))) and value(spark, P.is_unsafe(F.lit("/x"))) and value(spark, P.is_unsafe(F.lit(""))) and not value(spark, P.is_unsafe(F.lit("a..b/x")))


def test_numbers(spark):
    assert value(spark, T.probability(F.lit("0.4"), 0.5)) == 0.4
    assert value(spark, T.probability(F.lit("7"), 0.5)) == 0.5
    assert value(spark, T.line_number(F.lit("0"))) is None
