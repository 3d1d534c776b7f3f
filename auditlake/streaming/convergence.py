"""Convergence of units as a stream: the last rounds of each unit are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def converged_stream(rounds: DataFrame, k: int, lateness: str = "1 day") -> DataFrame:
    """unit, round, at, converged of each round (unit, round, at, new_findings, clean, pending) as it arrives: whether the unit's last k rounds found nothing new, were clean and left nothing pending.

    A unit's state is its last k rounds, so it doesn't grow. Rounds are taken in order within a batch; one that arrives after a later round counts in its place if the k last rounds still hold it. Rounds older than the
    watermark are dropped, and a unit without rounds for that long loses its state. Null figures count as not quiet.
    """
    out = "unit string, round bigint, at timestamp, converged boolean"
    kept = "rounds array<bigint>, quiet array<boolean>, at timestamp"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("round")
        seen, quiet, newest = state.get if state.exists else ([], [], None)
        last = dict(zip(seen, quiet, strict=True))
        flags = []
        for r in rows.itertuples():
            last[int(r.round)] = bool(r.new_findings == 0 and r.clean is not None and bool(r.clean) and r.pending is not None and not bool(r.pending))
            before = sorted(x for x in last if x <= r.round)[-k:]
            flags.append(len(before) == k and all(last[x] for x in before))
            last = {x: last[x] for x in sorted(last)[-k:]}
        top = rows["at"].max()
        newest = top if newest is None or top > newest else newest
        state.update((list(last), list(last.values()), newest))
        if newest.timestamp() * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(newest.timestamp() * 1000) + 1)
        yield pd.DataFrame({"unit": key[0], "round": rows["round"].to_numpy(), "at": rows["at"].to_numpy(), "converged": flags})

    return rounds.withWatermark("at", lateness).groupBy("unit").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
