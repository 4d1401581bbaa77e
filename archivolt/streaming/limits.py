"""The limiter of ``sequences.rate_limited`` on a stream, with one small state a key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "reset long, n int"


def limited(hits: DataFrame, key: str, at: str, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, at, ok): windows start at a key's first hit. State goes once its window is past the watermark.

    Hits of a batch are taken in order of time; one that is earlier than a batch before
    counts in the window that is open by then.
    """
    kind = hits.schema[key].dataType.simpleString()

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, n = state.get if state.exists else (0, 0)
        out = []
        for t in sorted(x for f in frames for x in f[at]):
            ms = int(t.timestamp() * 1000)
            if not n or reset <= ms:
                reset, n = ms + seconds * 1000, 0
            n = min(n + 1, most + 1)
            out.append((group[0], t, n <= most))
        state.update((reset, n))
        state.setTimeoutTimestamp(max(reset, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, "ok"])

    rows = hits.select(key, at).withWatermark(at, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, ok boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout)
