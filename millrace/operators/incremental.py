"""Incremental maintenance: manifests, reconciliation, debounce, event merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import Ordered


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) between two manifests (file, mtime_ns, size)."""
    o = old.select("file", F.struct("mtime_ns", "size").alias("was"))
    n = new.select("file", F.struct("mtime_ns", "size").alias("now"))
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "changed")
    return o.join(n, "file", "full_outer").select("file", change.alias("change")).filter("change IS NOT NULL")


def reconcile(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (file, seq, text) without those of changed or deleted files and folders, plus the fresh ones, numbered anew."""
    return numbered(chunks.join(_under(chunks, changes), "file", "left_anti").unionByName(fresh))


def _under(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Files (file) of the chunks that are changed or in a changed folder."""
    whole = changes.select(F.col("file").alias("changed")).distinct()
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), 1, i), "/"))
    gone = chunks.select("file").distinct().withColumn("up", F.explode(ups))
    return gone.join(whole, F.col("up") == F.col("changed"), "left_semi").select("file").distinct()


def touched(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunks of changed files and of files in changed folders."""
    return chunks.join(_under(chunks, changes), "file", "left_semi")


def reused(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, seq, hash, tokens or null) of chunks (file, seq, text), from a cache (hash, tokens), and the cache with what still lives."""
    keyed = texts.select("file", "seq", F.sha2("text", 256).alias("hash"))
    hit = keyed.join(cache.dropDuplicates(["hash"]), "hash", "left").select("file", "seq", "hash", "tokens")
    return hit, cache.join(keyed.select("hash").distinct(), "hash", "left_semi")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_id by (file, seq), from 0: places in ranges of the order, and what lies before each range."""
    return Ordered(chunks.select("file", "seq", "text"), ["file", "seq", "text"]).numbered("chunk_id").select("chunk_id", "file", "seq", "text")


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of (ts, user_id) with gaps of up to ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("user_id", "first", "last", "n")


def debounced_capped(events: DataFrame, gap_s: int, cap_s: int) -> DataFrame:
    """As :func:`debounced`, but a session ends ``cap_s`` after its first event at the latest."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, first, last, n = [], None, None, 0
        for t in pdf.sort_values("ts").ts:
            if first is not None and ((t - last).total_seconds() > gap_s or (t - first).total_seconds() > cap_s):
                rows.append((pdf.user_id.iloc[0], first, last, n))
                first, n = None, 0
            first, last, n = first if first is not None else t, t, n + 1
        if n:
            rows.append((pdf.user_id.iloc[0], first, last, n))
        return pd.DataFrame(rows, columns=["user_id", "first", "last", "n"])

    return events.select("user_id", "ts").groupBy("user_id").applyInPandas(fold, "user_id long, first timestamp, last timestamp, n long")


def merged_ops(events: DataFrame) -> DataFrame:
    """(path, op) of (path, ts, op): a later remove or rename wins, a write after it revives, else bits add up.

    Bits: 1 create, 2 write, 4 remove, 8 rename.
    """
    ops = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "op"))), lambda e: e["op"])
    gone = lambda x: x.bitwiseAND(12) != 0
    fold = lambda acc, x: F.when(gone(x), x).when(gone(acc), x).otherwise(acc.bitwiseOR(x))
    return events.groupBy("path").agg(ops.alias("ops")).select("path", F.aggregate("ops", F.lit(0), fold).alias("op"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct hashes of (text) that the cache (hash) lacks."""
    return texts.select(F.sha2("text", 256).alias("hash")).distinct().join(cache, "hash", "left_anti")


def unioned(own: DataFrame, extra: DataFrame) -> DataFrame:
    """Chunks and extras (file, seq, text); extras replace those of the same file and come last."""
    kept = own.join(extra.select("file").distinct(), "file", "left_anti").withColumn("part", F.lit(0))
    return kept.unionByName(extra.withColumn("part", F.lit(1)))


