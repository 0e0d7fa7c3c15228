"""State of sessions over streams, in a state store with timers: what was read in full, and how often a thing came up.

A key's rows of a batch are taken in the order of the batch operators, so a finite stream gives what they give. The store
holds what a key needs and no more: a full read until its time to live has passed in event time, a count until its reset. It
begins with a table of what an earlier store or a batch job knew, if one is given.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import TTL_SECONDS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READS = "session string, path string, ord long, at long, known boolean"
COUNTS = "key string, ord long, n long, escalates boolean"


def use_store(spark: SparkSession) -> None:
    """State with timers needs a store that holds its keys in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FullReads(StatefulProcessor):
    """By session: the second of the last full read of each path, until its time to live has passed."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "path string", "at long")

    def _keep(self, path: str, at: int, timers) -> None:
        self.last.updateValue((path,), (at,))
        self.handle.registerTimer(max((at + self.ttl + 1) * 1000, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in [initialState] if isinstance(initialState, Row) else initialState:
            self._keep(r.path, r.at, timerValues)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.ord)):
            path = r.path or ""
            got = self.last.getValue((path,))
            known = got is not None and r.at - got[0] <= self.ttl
            if r.full and (got is None or r.at >= got[0]):
                self._keep(path, r.at, timerValues)
            yield Row(session=key[0], path=r.path, ord=r.ord, at=r.at, known=known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for path, at in [(p, a) for p, a in self.last.iterator()]:
            if (at[0] + self.ttl + 1) * 1000 <= now:
                self.last.removeKey(path)
        return iter(())

    def close(self) -> None:
        pass


class Repeats(StatefulProcessor):
    """By key: how often it came up since its last reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in [initialState] if isinstance(initialState, Row) else initialState:
            self.count.update((r.n,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for r in sorted(rows, key=lambda r: r.ord):
            n = 0 if r.reset else n + 1
            if not r.reset:
                yield Row(key=key[0], ord=r.ord, n=n, escalates=n >= 3)
        if n:
            self.count.update((n,))
        else:
            self.count.clear()

    def close(self) -> None:
        pass


def known_full_reads(reads: DataFrame, ttl: int = TTL_SECONDS, delay: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """A stream of (session, path, ord, at: epoch seconds, full) with `known`, as operators.state.known_full_reads gives it.

    initial: (session, path, at) of full reads that are known before the stream begins, one row a session and path. A null
    path counts as an empty one."""
    use_store(reads.sparkSession)
    rows = reads.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    begin = None if initial is None else initial.select("session", F.coalesce("path", F.lit("")).alias("path"), "at").groupBy("session")
    return rows.groupBy("session").transformWithState(FullReads(ttl), READS, "Append", "EventTime", begin)


def repeat_counts(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """A stream of (key, ord, reset) as (key, ord, n, escalates) of the rows that are no reset, as operators.state.repeat_counts
    gives it when batches come in order. initial: (key, n)."""
    use_store(rows.sparkSession)
    return rows.groupBy("key").transformWithState(Repeats(), COUNTS, "Append", "None", None if initial is None else initial.groupBy("key"))
