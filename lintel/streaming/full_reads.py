"""Per-session state over streams: full reads with a time to live, reminders given once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import TTL_SECONDS

OUTPUT = "session string, path string, ord long, at long, known boolean"


def known_full_reads(reads: DataFrame, ttl: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """A stream of (session, path, ord, at: epoch seconds, full) with `known`, as the batch operator gives it.

    The state of a key is the second of its last full read. It expires by event time when the watermark has passed its
    time to live, so the store holds no more than the keys of that span."""
    stamped = reads.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "ord"])
        known = []
        for at, full in zip(rows["at"].tolist(), rows["full"].tolist(), strict=True):
            known.append(last is not None and at - last <= ttl)
            last = max(at, last or at) if full else last
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": rows["session"], "path": rows["path"], "ord": rows["ord"], "at": rows["at"], "known": known})

    return stamped.groupBy("session", "path").applyInPandasWithState(step, OUTPUT, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def once_a_session(reminders: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first reminder of each session within the watermark."""
    return reminders.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session"])
