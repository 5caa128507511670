"""Query expansion, embedded-symbol boost, adaptive re-ranking and graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.index import kept
from . import retrieval as R
from .sparse import weighted_sums

#: Fixed value: a name with capitals inside.
EMBEDDED = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"


def names_of(queries: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """(query_id, symbol, whole): the query as a name where it is ``whole``, else the cased names in it and those predicted (query_id, name)."""
    inner = F.regexp_extract_all("query", F.lit(EMBEDDED), 0)
    if predicted is not None:
        told = predicted.groupBy("query_id").agg(F.collect_list("name").alias("told"))  # of the batch
        queries, inner = queries.join(told, "query_id", "left"), F.concat(inner, F.coalesce("told", F.array().cast("array<string>")))
    own = F.when(F.col("whole"), F.array(T.symbol_name(F.trim("query")))).otherwise(F.array_distinct(inner))
    return queries.select("query_id", F.explode(own).alias("symbol"), "whole")


def boost_embedded(scores: DataFrame, chunks: DataFrame, queries: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Natural queries with cased names inside: defining candidates gain, others with a fitting stem enter."""
    return R.raised(scores, R.tiers(scores, R.definitions(chunks), names_of(queries.withColumn("whole", F.lit(False)), predicted)))


def adaptive_head(scores: DataFrame, gap: float, small: int, large: int) -> DataFrame:
    """How many candidates to re-rank: few where the first is clearly ahead of the second."""
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    t = scores.withColumn("pos", pos).groupBy("query_id").agg(F.max(F.when(F.col("pos") == 1, F.col("score"))).alias("s0"), F.max(F.when(F.col("pos") == 2, F.col("score"))).alias("s1"), F.count("*").alias("n"))
    return t.select("query_id", F.least("n", F.when((F.col("s0") > 0) & ((F.col("s0") - F.col("s1")) / F.col("s0") >= gap), small).otherwise(large)).alias("head"))


def mixed(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x.cast("double") + (1 - weight) * y.cast("double"))


def unit(v: Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    return T.let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _new_terms(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return rows.join(R.query_terms(queries).select("query_id", "term"), ["query_id", "term"], "left_anti")


def _useful(term: Column) -> Column:
    return (F.length(term) > 2) & ~term.isin(*T.STOP_WORDS)


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "term")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expand_prf(queries: DataFrame, chunks: DataFrame, top: int, k: int) -> DataFrame:
    """Terms of the first hits by score * idf * tf, without those of the query."""
    hits = kept(R.best(queries, chunks, top).select("query_id", "chunk_id", "score"), "hits")
    own = R.scanned(chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    all_ = R.scanned(chunks, own.terms.select("term"))
    gain = hits.join(own.postings, "chunk_id").join(all_.terms, "term").crossJoin(all_.stats).groupBy("query_id", "term").agg(F.round(F.sum(F.col("score") * R.idf(F.col("n"), F.col("df")) * F.col("tf")), 4).alias("g"))
    return _first(_new_terms(gain.filter(_useful(F.col("term"))), queries), "g", k).select("query_id", "rank", "term")


def centroids(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, centroid, norm): unit mean vector of the chunks with a term of middle frequency, and the mean's length."""
    post, df, stats = R.scanned(chunks)
    middle = df.crossJoin(stats).filter((F.col("df") >= 5) & (F.col("df") <= F.greatest(F.lit(50.0), F.col("n") / 100)) & _useful(F.col("term"))).select("term")
    entries = post.join(middle, "term").select(F.col("term").alias("row"), F.col("chunk_id").alias("col"), F.lit(1.0).alias("w"))
    sums = weighted_sums(entries, vectors.select(F.col("chunk_id").alias("col"), "vec"))
    rows = sums.select(F.col("row").alias("term"), T.let(F.col("total"), lambda n: F.transform("sums", lambda x: x / n)).alias("mean"))
    rows = rows.withColumn("norm", norm(F.col("mean"))).filter("norm > 0")
    return rows.select("term", F.transform("mean", lambda x: x / F.col("norm")).alias("centroid"), "norm")


def expand_centroid(qvecs: DataFrame, cents: DataFrame, k: int, least: float) -> DataFrame:
    near = R.knn(qvecs, cents.select(F.col("term").alias("chunk_id"), F.col("centroid").alias("vec")), k)
    return near.filter(F.col("score") >= least).select("query_id", "rank", F.col("chunk_id").alias("term"), F.round("score", 6).alias("score"))


def expand_oracle(queries: DataFrame, chunks: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Terms of the relevant chunks by idf: what expansion could reach at best."""
    own = R.scanned(chunks.join(qrels.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    all_ = R.scanned(chunks, own.terms.select("term"))
    terms = qrels.join(own.postings, "chunk_id").join(all_.terms, "term").crossJoin(all_.stats).select("query_id", "term", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf")).distinct()
    return _first(_new_terms(terms, queries), "idf", k).select("query_id", "rank", "term", "idf")


def graph_expand(seeds: DataFrame, calls: DataFrame, defs: DataFrame, scale: float) -> DataFrame:
    """One hop in the call graph from (query_id, file): callers of its functions and definers of its callees; hits * scale."""
    callers = seeds.join(defs, "file").select("query_id", "name", F.col("file").alias("seed")).join(calls.select(F.col("callee").alias("name"), "file"), "name")
    callees = seeds.join(calls, "file").select("query_id", F.col("callee").alias("name"), F.col("file").alias("seed")).join(defs.select("name", "file"), "name")
    hops = callers.unionByName(callees).filter("file <> seed")
    return hops.groupBy("query_id", "file").agg((F.count("*") * scale).alias("gain"))
