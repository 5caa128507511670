"""Change streams as a stateful processor: one timer a watcher, operations merged in the state.

A watcher's batch holds each changed path with its merged operations. It is closed ``gap`` after its
last event, ``cap`` after its first at the latest, so a burst that never pauses is cut too. The state
is a row of times and a map of paths, never a list of events; a closed batch comes out as a
row for each path. Timers run on event time, so a batch that no later event closes comes out once the
watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the store of states must be for processors with timers and maps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GONE = 12
OUT = "watcher long, first long, last long, n long, path string, op int"


def merged(before: int, op: int) -> int:
    """Bits: 1 create, 2 write, 4 remove, 8 rename. A later remove or rename wins, a write after it revives, else bits add up."""
    return op if op & GONE or before & GONE else before | op


class Watcher(StatefulProcessor):
    """Batches of the events (us, seq, path, op) of a watcher, times in microseconds."""

    def __init__(self, gap_us: int, cap_us: int):
        self.gap, self.cap = gap_us, cap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "first long, last long, n long")
        self.paths = handle.getMapState("paths", "path string", "op int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, last, n = self.times.get() if self.times.exists() else (0, 0, 0)
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            if n and (r.us - last > self.gap or r.us - first > self.cap):
                yield from self._closed(key, first, last, n)
                n = 0
            first, last, n = (first if n else r.us), r.us, n + 1
            path = (r.path,)
            before = self.paths.getValue(path)[0] if self.paths.containsKey(path) else 0
            self.paths.updateValue(path, (merged(before, r.op),))
        self.times.update((first, last, n))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # the first millisecond at which no event can belong to the batch any more
        self.handle.registerTimer(min(last + self.gap, first + self.cap) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.times.exists():
            yield from self._closed(key, *self.times.get())
            self.times.clear()

    def _closed(self, key, first: int, last: int, n: int) -> list[Row]:
        out = [Row(watcher=key[0], first=first, last=last, n=n, path=p[0], op=o[0]) for p, o in self.paths.iterator()]
        self.paths.clear()
        return out

    def close(self) -> None:
        pass


def watched(events: DataFrame, gap: str = "2 seconds", cap: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """(watcher, first, last, n, path, op) of a stream (watcher, ts, seq, path, op); the session's state store must be ``PROVIDER``."""
    us = lambda d: int(float(d.split()[0]) * {"second": 1, "minute": 60, "hour": 3600}[d.split()[1].rstrip("s")] * 1_000_000)
    rows = events.withWatermark("ts", delay).select(F.col("watcher").cast("long").alias("watcher"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "path", F.col("op").cast("int").alias("op"))
    out = rows.groupBy("watcher").transformWithState(statefulProcessor=Watcher(us(gap), us(cap)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    time: Column = F.timestamp_micros("first")
    return out.select("watcher", time.alias("first"), F.timestamp_micros("last").alias("last"), "n", "path", "op")
