"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import incremental as I

STATE = "first timestamp, last timestamp, n long"
OUT = "path string, first timestamp, last timestamp, n long"


def debounced_stream(events: DataFrame, gap_s: int = 2, cap_s: int = 10, delay: str = "10 seconds", by: str = "path") -> DataFrame:
    """Batches of changes of a stream (path, ts), one timer for each ``by``, a path or the watcher of many: closed ``gap_s`` after the last event, ``cap_s`` after the first at the latest.

    Timers run on event time, so a burst that never pauses is still cut at the cap.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            out.append((key[0], first, last, n))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b.ts)
            for t in times:
                if n and ((t - last).total_seconds() > gap_s or (t - first).total_seconds() > cap_s):
                    out.append((key[0], first, last, n))
                    n = 0
                first, last, n = (first if n else t), t, n + 1
            state.update((first, last, n))
            ends = min(last + pd.Timedelta(seconds=gap_s), first + pd.Timedelta(seconds=cap_s))
            due = int(ends.tz_localize("UTC").timestamp() * 1000) if ends.tzinfo is None else int(ends.timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "first", "last", "n"])

    return events.withWatermark("ts", delay).select(F.col(by).alias("path"), "ts").groupBy("path").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout).withColumnRenamed("path", by)


class Published:
    """Versions of a chunk table in a folder, with a pointer to the current one.

    A version is written whole before the pointer names it, so readers see either the old or the new one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        fs = self._fs(f"{self.root}/versions")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        if not fs.exists(path):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(self._path(f"{s.getPath()}/_READY"))), default=-1)

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> DataFrame:
        v = self.version()
        if v < 0:
            raise FileNotFoundError(f"nothing published in {self.root}")
        return self.spark.read.parquet(f"{self.root}/versions/{v}/chunks")

    def publish(self, chunks: DataFrame, **meta) -> int:
        v = self.version() + 1
        at = f"{self.root}/versions/{v}"
        chunks.write.mode("overwrite").parquet(f"{at}/chunks")
        self.spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{at}/_meta")
        self._fs(at).create(self._path(f"{at}/_READY")).close()
        return v


def maintained(changes: DataFrame, store: Published, fresh: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Reconcile a published chunk table with a stream of changes (file, op); batches without effect publish nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        files = batch.select("file").distinct()
        if files.isEmpty():
            return
        now = store.current().select("file", "seq", "text")
        new = fresh(files)
        # files whose chunks are as they were change nothing; without others nothing is published
        print_ = lambda d, name: d.groupBy("file").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("seq", "text")))).alias(name))
        under = I.touched(now, files)
        both = print_(under, "was").join(print_(new, "is"), "file", "full_outer")
        if both.filter(~F.col("was").eqNullSafe(F.col("is"))).isEmpty():
            return
        store.publish(I.reconcile(now, files, new))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted_stream(changes: DataFrame, rules: DataFrame, **limits) -> DataFrame:
    """Changes (path, op, bytes, text) of a stream whose files would be indexed: the walk's filters and ignore rules; removals always pass."""
    from ..sources import corpus as C

    ok = C.indexable(**limits)
    out = changes.filter((F.col("op") == "remove") | F.coalesce(ok, F.lit(False)))
    hidden = C.matched(rules)
    return out.filter(~hidden(F.col("path")))


def resynced(manifest: DataFrame, listing: DataFrame, batch: DataFrame) -> DataFrame:
    """After lost events: changes (file, change) of a fresh listing against the manifest, and the batch's own files, once each."""
    lost = I.manifest_diff(manifest, listing)
    told = batch.select("file").distinct().join(listing.select("file", F.lit(1).alias("there")), "file", "left").select("file", F.when(F.col("there").isNull(), "deleted").otherwise("changed").alias("told"))
    both = lost.join(told, "file", "full_outer")
    return both.select("file", F.coalesce("change", "told").alias("change"))


def recorded(rows: DataFrame, path: str) -> None:
    """Append usage rows (ts, call, results, snippet_chars, file_chars), one JSON line each."""
    rows.select("ts", "call", "results", "snippet_chars", "file_chars").write.mode("append").json(path)


def usage_stream(lines: DataFrame) -> DataFrame:
    """Running sums of a JSON-lines usage log (value); lines that don't parse are left out."""
    row = F.from_json("value", "ts double, call string, results int, snippet_chars long, file_chars long")
    ok = lines.select(row.alias("r")).filter("r.call IS NOT NULL").select("r.*")
    saved = F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0))
    return ok.groupBy("call").agg(F.count("*").alias("n"), F.sum(saved).alias("saved"))
