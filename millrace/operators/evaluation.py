"""Retrieval metrics over rankings (query_id, chunk_id, rank) and relevance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranking: DataFrame, qrels: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """NDCG@k of every query; a repeated document uses up a place but earns nothing; without relevant documents 0."""
    top = ranking.filter(F.col("rank") <= k)
    once = top.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).filter("nth = 1")
    dcg = once.join(qrels, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = qrels.filter("rel > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id"))).filter(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("place") + 1)).alias("ideal"))
    return queries.join(dcg, "query_id", "left").join(ideal, "query_id", "left").select("query_id", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def recall(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    hits = ranking.select("query_id", "chunk_id").distinct().join(qrels, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("hit"))
    return qrels.groupBy("query_id").agg(F.count("*").alias("n")).join(hits, "query_id", "left").select("query_id", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def first_relevant(ranking: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    hit = ranking.join(qrels, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.join(hit, "query_id", "left").select("query_id", F.coalesce("first", F.lit(0)).alias("first"))


def decomposition(pool: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Shares of queries whose relevant documents are not in the pool, and of those in it but below k."""
    hit = pool.join(qrels, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    x = qrels.select("query_id").distinct().join(hit, "query_id", "left")
    return x.agg(F.count("*").alias("queries"), F.avg(F.col("first").isNull().cast("int")).alias("pool_loss"), F.avg(F.coalesce(F.col("first") > k, F.lit(False)).cast("int")).alias("rank_loss"))


def tokens_at(ranking: DataFrame, cost: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Median tokens read and mean recall at each k."""
    rel = qrels.withColumn("hit", F.lit(1))
    rows = ranking.join(cost, "chunk_id").join(rel, ["query_id", "chunk_id"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    per = rows.groupBy("k", "query_id").agg(F.sum("tokens").alias("tokens"), F.count("hit").alias("hits"))
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    return per.join(n, "query_id", "left").groupBy("k").agg(F.expr("percentile(tokens, 0.5)").alias("median_tokens"), F.avg(F.col("hits") / F.col("n")).alias("recall"))
