"""Queries on indexes that are stored: segments with changes, block-max search, hybrid search without a scan of texts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.index import shared_dir
from ..sources.segments import Segments, config_key
from .q_search import BM25, HYBRID, POST, q, qvecs, r6, rank_sql, vectors
from .sample import CORPUS, PREDICTED, asked, asked2, corpus, corpus2

#: Changes of the corpus: one folder's files go, another's get a new text. Same text in both engines.
GONE, NEW = "file LIKE 'examples/src1%'", "file LIKE 'compat/src1%'"
CHANGED = CORPUS.replace("corpus AS", "before AS") + f", corpus AS (SELECT chunk_id, file, CASE WHEN {NEW} THEN 'fresh parcel ' || text ELSE text END AS text, deleted OR {GONE} AS deleted FROM before)"


def emptied(spark, buckets=8):
    return Segments(spark, f"{shared_dir(spark)}/millrace-segments-{uuid4().hex}", config_key("hybrid"), buckets)


def changed_index(spark, sf):
    """The corpus in one segment, then two batches of changes in segments of their own."""
    live = corpus(spark, sf).filter("NOT deleted").select("chunk_id", "file", "text")
    none = live.limit(0)
    store = emptied(spark)
    store.commit(none, live)
    store.commit(live.filter(GONE), none)
    new = live.filter(NEW)
    store.commit(new, new.withColumn("text", F.concat(F.lit("fresh parcel "), "text")))
    return store


CHANGED_TOP = f"WITH {BM25.replace(CORPUS, CHANGED)}, {rank_sql('bm25', 10, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top"


@q("search_segments", CHANGED_TOP)
def search_segments(spark, sf):
    """Search of the batch on an index that has changed; the batch is large enough to be scored whole."""
    return r6(changed_index(spark, sf).snapshot().best(asked(spark, sf), 10).select("query_id", "rank", "chunk_id", "score"), "score")


@q("search_compacted", CHANGED_TOP)
def search_compacted(spark, sf):
    """The same after all segments are one, with all postings of the batch."""
    store = changed_index(spark, sf)
    store.compact()
    return r6(R.best(asked(spark, sf), store.snapshot(), 10).select("query_id", "rank", "chunk_id", "score"), "score")


@q("segment_stats", f"WITH {POST.replace(CORPUS, CHANGED)} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM dfs, stats")
def segment_stats(spark, sf):
    """Frequencies as sums of the segments' differences, n and the average length from the manifest."""
    index = changed_index(spark, sf).snapshot()
    return r6(index.terms.crossJoin(index.stats).select("term", "df", "n", "avgdl"), "avgdl")


@q("search_hybrid_stored", HYBRID)
def search_hybrid_stored(spark, sf):
    """Hybrid search on stored segments: the postings of the batch's terms, definitions by name, and no scan of chunk texts."""
    chunks = corpus2(spark, sf)
    store = emptied(spark)
    live = chunks.filter("NOT deleted").select("chunk_id", "file", "text")
    store.commit(live.limit(0), live)
    heads = chunks.select("chunk_id", "file", "deleted")
    out = R.hybrid(asked2(spark, sf), heads, vectors(spark, sf), qvecs(spark, sf), 10, predicted=PREDICTED.df(spark), index=store.snapshot())
    return out.select("query_id", "rank", "chunk_id", "file", F.round("score", 8).alias("score"))


LISTED = """SELECT 'site/' || page_id % 10 || '/p' || page_id || '.html' AS file, CAST(coalesce(strlen(html), 0) AS BIGINT) AS bytes FROM pages
WHERE page_id % 10 <> 7 AND NOT (page_id % 10 = 3 AND starts_with(CAST(page_id AS VARCHAR), '1') AND page_id <> 13) AND NOT (page_id % 10 = 4 AND ends_with(CAST(page_id AS VARCHAR), '24')) AND NOT contains(coalesce(html, ''), chr(0))"""


@q("scan_listing", LISTED)
def scan_listing(spark, sf):
    """The pages as files of a tree with ignore files in its folders, read back by the listing source."""
    from ..sources import listing as L

    root = f"{shared_dir(spark)}/millrace-tree-{uuid4().hex}"
    html = F.concat(F.lit("site/"), (F.col("page_id") % 10).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(html.alias("file"), F.coalesce("html", F.lit("")).alias("text"))
    rules = [(".gitignore", "site/7/\n"), ("site/3/.gitignore", "p1*.html\n!p13.html\n"), ("site/4/.millraceignore", "*24.html\n"), ("site/4/.gitignore", "!p24.html\n")]
    written = pages.unionByName(spark.createDataFrame(rules, "file string, text string"))
    L.write_tree(written, root)
    return L.listed(spark, root, folders=8).filter(F.col("file").endswith(".html")).select("file", "bytes")
