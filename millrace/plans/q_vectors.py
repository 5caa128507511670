"""Queries on the cache of vectors: recency over batches, and cosines of hits through it."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..sources.index import shared_dir
from ..sources.vectors import VectorCache, neural_scores, scope_key
from .q_rest import HITS, hits
from .q_search import q
from .sample import asked, table


def encoder(spark, sf):
    """In place of a model: the embedding whose number is the text's length, by remainder."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = e.agg(F.count("*").alias("n"))
    return lambda texts: texts.crossJoin(F.broadcast(n)).withColumn("vec_id", F.length("text") % F.col("n")).join(e, "vec_id").select("hash", "vec")


def emptied(spark, limit=1_000_000):
    return VectorCache(spark, f"{shared_dir(spark)}/millrace-vectors-{uuid4().hex}", scope_key("stand-in", "f32", 64), limit)


@q("vector_cache", """WITH d AS (SELECT doc_id, sha256(text) AS hash, length(text) AS chars FROM documents WHERE text IS NOT NULL),
b AS (SELECT hash, chars, 1 AS used FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT hash, chars, 2 FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT hash, chars, 3 FROM d WHERE doc_id % 4 = 0),
u AS (SELECT hash, any_value(chars) AS chars, max(used) AS used FROM b GROUP BY hash), r AS (SELECT *, row_number() OVER (ORDER BY used DESC, hash) AS n FROM u)
SELECT hash, used, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) + 0.0 AS total FROM r JOIN embeddings ON vec_id = chars % (SELECT count(*) FROM embeddings) WHERE n <= (SELECT count(*) FROM documents) // 2""")
def vector_cache(spark, sf):
    """Three batches of documents, then all but the texts used last go: half as many as there are documents stay."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    cache, encode = emptied(spark, d.count() // 2), encoder(spark, sf)
    for part in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 4 = 0"):
        cache.get(d.filter(part), encode)
    cache.evict()
    state = cache.state()
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cache.recency(state).join(cache.vectors(state), "hash").select("hash", "used", (F.round(total, 4) + 0.0).alias("total"))


@q("neural_cosine", f"""{HITS}, n AS (SELECT count(*) AS n FROM embeddings), h AS (SELECT h.*, b.text AS query FROM hits h JOIN benchmark b ON b.item_id = h.query_id WHERE rank <= 10),
v AS (SELECT h.query_id, h.rank, h.chunk_id, [x::DOUBLE FOR x IN p.embedding] AS a, [x::DOUBLE FOR x IN t.embedding] AS b FROM h, n, embeddings p, embeddings t WHERE p.vec_id = length(h.query) % n.n AND t.vec_id = length(h.text) % n.n)
SELECT query_id, rank, chunk_id, round(list_cosine_similarity(a, b), 5) + 0.0 AS neural FROM v""")
def neural_cosine(spark, sf):
    """The cosine of each query with its ten best texts, every distinct text encoded once."""
    found = hits(spark, sf, 10).join(asked(spark, sf), "query_id")
    return neural_scores(found, emptied(spark), encoder(spark, sf)).select("query_id", "rank", "chunk_id", (F.round("neural", 5) + 0.0).alias("neural"))
