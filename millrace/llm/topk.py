"""Exact top-k inner products with MaxScore over shards.

A vector's components become whole numbers. A shard holds up to ``SHARD`` vectors as one
block; its terms are the dimensions, and a term's postings are the vectors whose component
has the query's sign, for only those add to a score. The term's bound is the query
component times the largest such component in the shard. Terms in ascending order of bound
are non-essential as long as their bounds add up to less than the k-th best score so far:
a vector in none of the essential postings cannot enter. Essential terms are summed for
the vectors in their postings, the vectors whose sum plus the rest of the bounds stays
below the k-th score are left, and the others are probed for the remaining terms.

The vectors are dealt to groups, one task each, that hold their shards as the narrowest whole
numbers, ``HELD`` bytes as float64 (a quarter of it as int16). Every block of ``QUERIES``
queries then goes through every group as one row of blobs, by a shuffle and never a
broadcast: its k best of one shard are the start for the next. A group keeps k for each
query, and a window merges the groups. So the queries are sent once for each group, and the
driver sees one row of counts.

Defined results: vectors that are null or hold null or non-finite components take no part;
missing trailing components count as 0, so vectors of any length compare; rows without an
id take no part; ties go to the smaller id; a query's own id is no candidate, so repeated
rows of one id do not find each other; scores beyond a long are held at its ends; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARD = 4096
QUERIES = 512
#: Bytes of a group's components as float64.
HELD = 128_000_000
SCALE = 1024
OUT = "query_id long, vec_id long, score long"


def _cells(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of whole numbers, missing trailing components 0."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = np.floor(flat * SCALE)
    return out


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    most = np.abs(cells).max(initial=0)
    return cells.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(width, bytes, ids, cells): the rows of each block b as blobs of up to ``QUERIES`` vectors of whole numbers."""
    most = QUERIES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                ids, vectors = batch.slice(k, most).columns
                cells = _narrow(_cells(vectors))
                yield pa.record_batch([pa.array([cells.shape[1]], pa.int32()), pa.array([cells.itemsize], pa.int32()), pa.array([ids.to_numpy().tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], ["width", "bytes", "ids", "cells"])

    return rows.repartition(blocks, F.xxhash64("vec_id", "v")).select("vec_id", "v").mapInArrow(work, "width int, bytes int, ids binary, cells binary")


def maxscore(vecs: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, query: np.ndarray, own: int, k: int, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query in one shard and ``before``, in descending order of (score, -id).

    ``high`` and ``low``: the largest and the least of each component, or 0.
    """
    n = len(ids)
    postings = np.where(query > 0, high, low) * query
    order = np.argsort(postings, kind="stable")
    bounds = np.cumsum(postings[order])  # bounds[j]: of the j + 1 weakest terms
    best_ids, best = before
    for at in range(0, n, 1024):
        part = vecs[at : at + 1024]
        theta = best[-1] if len(best) == k else None
        weak = 0 if theta is None else int(np.searchsorted(bounds, max(theta, 0), "left"))
        weak = min(weak, len(order) - 1) if theta is not None and theta > 0 else 0
        essential, others = order[weak:], order[:weak]
        # vectors in some essential posting; without a positive k-th score every vector competes
        found = np.flatnonzero((part[:, essential] * np.sign(query[essential]) > 0).any(1)) if weak else np.arange(len(part))
        score = part[np.ix_(found, essential)] @ query[essential]
        if weak:
            # the essential sum holds negative parts too, and the rest adds at most its bounds
            alive = score + bounds[weak - 1] >= theta
            found = found[alive]
            score = score[alive] + part[np.ix_(found, others)] @ query[others]
        keep = ids[at + found] != own
        best_ids, best = np.concatenate([best_ids, ids[at + found][keep]]), np.concatenate([best, score[keep]])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return best_ids, best


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, embedding); ``is_query`` picks the queries."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).withColumnRenamed("embedding", "v")
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.sum(F.size("v")).alias("cells")).first()
    shard, cores = SHARD, vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-8 * (size.cells or 0) // HELD), min(-(-size.n // shard), 2 * cores), 1)
    asked = stored(_packed(rows.filter("q"), -(-size.q // QUERIES) or 1), "queries")
    data = rows.select(F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "width", "bytes", "ids", "cells")
    met = data.unionByName(every, allowMissingColumns=True).repartitionById(groups, F.col("g")).sortWithinPartitions("kind")

    def held(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cells = _cells(part.column("v"))
        return _narrow(cells), part.column("vec_id").to_numpy(), np.maximum(cells.max(0), 0), np.minimum(cells.min(0), 0)

    def best(shards: list, ids: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        got = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for cells, names, high, low in shards:
            width = min(cells.shape[1], asks.shape[1])
            c, high, low, q = cells[:, :width].astype(np.float64), high[:width], low[:width], asks[:, :width]
            if max(high.max(initial=0), -low.min(initial=0)) * np.abs(q).max(initial=0) * max(width, 1) >= 2**52:
                c, high, low, q = (np.array([int(x) for x in v.ravel()], object).reshape(v.shape) for v in (c, high, low, q))
            got = [maxscore(c, names, high, low, v, i, k, b) for i, v, b in zip(ids.tolist(), q, got, strict=True)]
        score = [max(-(2**63), min(2**63 - 1, int(s))) for _, scores in got for s in scores]
        return pa.record_batch([pa.array(np.repeat(ids, [len(x) for x, _ in got])), pa.array(np.concatenate([x for x, _ in got]), pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list = []
        for batch in batches:
            vecs = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            shards += [held(batch.slice(at, min(shard, vecs - at))) for at in range(0, vecs, shard)]
            for r in batch.slice(vecs).select(["width", "bytes", "ids", "cells"]).to_pylist() if shards else ():
                cells = np.frombuffer(r["cells"], {2: np.int16, 4: np.int32, 8: np.float64}[r["bytes"]])
                yield best(shards, np.frombuffer(r["ids"], np.int64), cells.reshape(-1, r["width"]).astype(np.float64))

    found = met.mapInArrow(work, OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
