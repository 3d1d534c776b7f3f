"""Functions of the user's as table functions: judges, verifiers and facts backends that give any number of rows for one row, callable from SQL by LATERAL."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession, name: str, function: Callable[..., Iterator[tuple]], schema: str):
    """A table function of that name: function's rows (schema) with an error column. A call that fails gives the rows before its failure and one with the error alone, and leaves other rows' calls standing."""
    width = len([c for c in schema.split(",")])

    class Called:
        def eval(self, *arguments):
            try:
                for row in function(*arguments):
                    yield (*row, None)
            except Exception as failure:  # a failed call is a row, whatever it failed of
                yield (*[None] * width, traceback.format_exception_only(failure)[-1].strip())

    return spark.udtf.register(name, udtf(Called, returnType=f"{schema}, error string"))


def register_fold(spark: SparkSession, name: str, function: Callable[[list], Iterator[tuple]], schema: str, state: Callable[[], object]):
    """A table function over the rows of each partition of TABLE(...) PARTITION BY: function(state, row) gives rows as they come, what it keeps of a partition is its state alone."""
    width = len([c for c in schema.split(",")])

    class Folded:
        def __init__(self):
            self.state, self.failed = state(), None

        def eval(self, row):
            if self.failed is None:
                try:
                    for out in function(self.state, row):
                        yield (*out, None)
                except Exception as failure:
                    self.failed = traceback.format_exception_only(failure)[-1].strip()
                    yield (*[None] * width, self.failed)

    return spark.udtf.register(name, udtf(Folded, returnType=f"{schema}, error string"))
