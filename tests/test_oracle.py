"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import re

import pytest

import __spark_entry__
from tests.conftest import DATA

SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not re.match(r"op\d", k)}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if k not in SQL and not re.match(r"op\d", k) and k != "pipeline"))
def test_queries_without_sql_run(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0
