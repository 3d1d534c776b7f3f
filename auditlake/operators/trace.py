"""Figures of a pass taken while it runs: batch queries by an observation, streams by a listener. Neither reads anything twice."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def figures(**more: Column) -> list[Column]:
    """Calls, failed calls, tokens and seconds of judgments; missing ones count as nothing. More aggregates by name."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return [F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), total("input_tokens"), total("output_tokens"), F.sum(F.coalesce(F.col("seconds"), F.lit(0.0))).alias("seconds"), *(c.alias(n) for n, c in more.items())]


def observed(rows: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and an observation whose get holds the aggregates once an action has run over all of them."""
    seen = Observation(name)
    return rows.observe(seen, *(aggregates or figures())), seen


class PassListener(StreamingQueryListener):
    """Keeps the observed figures of each batch of one stream, and hands each to a sink that may fail without harm to the stream."""

    def __init__(self, name: str, sink=None):
        self.name, self.sink, self.batches = name, sink, []

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        self.batches.append({"batch": event.progress.batchId, **row.asDict()})
        if self.sink:
            try:
                self.sink(json.dumps(self.batches[-1], default=str))
            except Exception:  # a trace is best effort
                self.sink = None
