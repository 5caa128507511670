"""Streams that run over a given table with ``availableNow``; their SQL is that of the batch."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..sources.index import shared_dir
from ..streaming import watcher as W
from .q_search import q

OP_SQL = "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END"


@q("watched_changes", f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_type AS path, {OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, ts, ts AS started, 1 AS s FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, e.ts, CASE WHEN e.ts - r.ts > INTERVAL 12 HOUR OR e.ts - r.started > INTERVAL 24 HOUR THEN e.ts ELSE r.started END, r.s + CASE WHEN e.ts - r.ts > INTERVAL 12 HOUR OR e.ts - r.started > INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
b AS (SELECT user_id, s, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, s), p AS (SELECT r.user_id, s, path, list(op ORDER BY r.k) AS ops FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k GROUP BY ALL)
SELECT user_id AS watcher, first, last, n, path, CAST(list_reduce(list_concat([0], ops), lambda a, x: CASE WHEN (x & 12) <> 0 THEN x WHEN (a & 12) <> 0 THEN x ELSE a | x END) AS INTEGER) AS op FROM p JOIN b USING (user_id, s)""")
def watched_changes(spark, sf):
    """All events as a stream of several micro-batches, in the order of time, then one event far ahead that lets every timer run."""
    root = f"{shared_dir(spark)}/millrace-stream-{uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("watcher"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("path"), F.expr(OP_SQL).alias("op"))
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    parts = 4
    place = F.floor((F.unix_micros("ts") - low) * parts / (high - low + 1))
    for part in range(parts):
        rows.filter(place == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    ahead = e.agg((F.max("ts") + F.expr("INTERVAL 1 YEAR")).alias("ts")).select(F.lit(-1).cast("long").alias("watcher"), "ts", F.lit(0).cast("long").alias("seq"), F.lit("").alias("path"), F.lit(0).alias("op"))
    ahead.write.mode("append").parquet(f"{root}/in")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        out = W.watched(stream, "12 hours", "24 hours")
        out.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return spark.read.schema(out.schema).parquet(f"{root}/out").filter("watcher >= 0").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
