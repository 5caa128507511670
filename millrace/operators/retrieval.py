"""Ranked retrieval over many queries at once: BM25, vectors, fusion, boosts, penalties, top-k.

Queries are a batch the caller states. A scan keeps only the terms of the batch before
anything is shuffled, and takes lengths from the chunk itself; a stored index reads only the
buckets of these terms. Vectors and query vectors meet as blocks, one matrix product for
each pair of blocks. All rankings break ties by id, and scores are rounded to 9 places before
ranking, since the order of float sums is not fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import postings as P

K1, B = 1.5, 0.75
RRF, FETCH = 60, 5
#: Keywords before a defined name.
KEYWORDS = "class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef"
SQL_KEYWORDS = "CREATE TABLE|CREATE VIEW|CREATE PROCEDURE|CREATE FUNCTION"
NAME = r"((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*[A-Za-z_][A-Za-z0-9_]*)"


class Index(NamedTuple):
    """postings (chunk_id, dl, term, tf), terms (term, df) and stats, one row (n, avgdl) over all live chunks, empty ones too."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def of(self, wanted: DataFrame) -> Index:
        """What concerns the terms (term) of a batch."""
        return Index(self.postings.join(wanted, "term", "left_semi"), self.terms.join(wanted, "term", "left_semi"), self.stats)


def _live(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.coalesce("deleted", F.lit(False)))


def scanned(chunks: DataFrame, wanted: DataFrame | None = None) -> Index:
    """The index of (chunk_id, text, deleted), or of the terms (term) of a batch in it; deleted chunks have no part. Texts are read once."""
    held = P.blocks(_live(chunks))
    whole = Index(P.rows(held), P.frequencies(held), P.statistics(held))
    return whole if wanted is None else whole.of(wanted.select("term").distinct())


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """(query_id, term, times) of (query_id, query): a repeated term counts each time; predicted (query_id, name) count as well."""
    bag = queries.select("query_id", "query")
    if predicted is not None:
        bag = bag.unionByName(predicted.select("query_id", F.col("name").alias("query")))
    return bag.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(queries: DataFrame, chunks: DataFrame | Index, predicted: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks with a positive score; ``chunks`` are scanned, or are a stored index."""
    wanted = query_terms(queries, predicted)
    names = wanted.select("term").distinct()
    index = chunks.of(names) if isinstance(chunks, Index) else scanned(chunks, names)
    hit = wanted.join(index.postings, "term").join(index.terms, "term").crossJoin(index.stats)  # stats is one row
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = F.sum(F.col("times") * idf(F.col("n"), F.col("df")) * part)
    return hit.groupBy("query_id", "chunk_id").agg(F.round(score, 9).alias("score")).filter("score > 0")


def best(queries: DataFrame, chunks: DataFrame | Index, k: int, predicted: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of :func:`bm25`, scored in blocks of chunks that keep k for each query."""
    wanted = query_terms(queries, predicted)
    if isinstance(chunks, Index):
        index = chunks.of(wanted.select("term").distinct())
        held, terms, stats = P.regrouped(index.postings), index.terms, index.stats
    else:
        held = P.blocks(_live(chunks))
        terms, stats = P.frequencies(held), P.statistics(held)
    weights = wanted.join(terms, "term").crossJoin(stats)  # stats is one row
    weights = weights.select("query_id", "term", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("weight"))
    return ranked(P.best(held, weights, stats, k, K1, B), k)


def ranked(scores: DataFrame, k: int, by: str = "score", id_: str = "chunk_id") -> DataFrame:
    """The k best of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), id_)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(rows: DataFrame, id_: str, vec: str, most: int, tag: str) -> DataFrame:
    """Blocks of up to ``most`` vectors of a partition: ids, width and the values in double as bytes. Null vectors have no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = b.filter(b.column(1).is_valid())
            for k in range(0, full.num_rows, most):
                part = full.slice(k, most)
                vecs = part.column(1).to_pylist()
                width = max(map(len, vecs))
                cells = np.array([[*v, *[0.0] * (width - len(v))] for v in vecs], np.float64)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([width], pa.int32()), pa.array([cells.tobytes()], pa.binary())], [f"{tag}ids", f"{tag}width", f"{tag}cells"])

    kind = rows.schema[id_].dataType.simpleString()
    return rows.select(id_, vec).mapInArrow(work, f"{tag}ids array<{kind}>, {tag}width int, {tag}cells binary")


def knn(queries: DataFrame, vectors: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k largest dot products of (query_id, qvec) with (chunk_id, vec), in double.

    Every query meets every vector, as the exact scan asks, in blocks: a pair of blocks is one
    matrix product and keeps k for each query, none for a k of 0 or less. ``itself``: a vector with the query's own id takes part.
    """
    pairs = _blocks(vectors, "chunk_id", "vec", 4096, "v").crossJoin(_blocks(queries, "query_id", "qvec", 512, "q"))
    q, c = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                vids, width, cells, qids, qwidth, qcells = (x[r].as_py() for x in b.columns)
                n = min(width, qwidth)
                x = np.frombuffer(cells).reshape(len(vids), -1)[:, :n]
                scores = np.round(np.frombuffer(qcells).reshape(len(qids), -1)[:, :n] @ x.T, 9)
                out = []
                for i, own in zip(qids, scores, strict=True):
                    most = max(1, min(k + (not itself), len(own)))
                    near = np.flatnonzero(own >= np.partition(own, len(own) - most)[len(own) - most]).tolist()
                    best = sorted((-own[j], vids[j]) for j in near if itself or vids[j] != i)[: max(k, 0)]
                    out += [(i, v, -float(s)) for s, v in best]
                yield pa.record_batch([pa.array([o[0] for o in out], b.column(3).type.value_type), pa.array([o[1] for o in out], b.column(0).type.value_type), pa.array([o[2] for o in out], pa.float64())], ["query_id", "chunk_id", "score"])

    return ranked(pairs.mapInArrow(work, f"query_id {q}, chunk_id {c}, score double"), k)


def bulk(queries: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` queries (query_id, query) of a batch by id, with the number of those that are left out."""
    first = queries.orderBy("query_id").limit(most)
    return first.crossJoin(queries.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("surplus")))


def fuse(arms: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked arms (query_id, chunk_id, rank).

    Arms are joined, not put under each other: the union of two window results was seen to be
    taken for one that is partitioned by query, which gave sums of a part of the rows.
    """
    parts = [a.select("query_id", "chunk_id", (w / (RRF + F.col("rank"))).alias(f"s{k}")) for k, (a, w) in enumerate(arms)]
    both = parts[0]
    for p in parts[1:]:
        both = both.join(p, ["query_id", "chunk_id"], "full_outer")
    score = sum((F.coalesce(f"s{k}", F.lit(0.0)) for k in range(1, len(parts))), F.coalesce("s0", F.lit(0.0)))
    return both.select("query_id", "chunk_id", F.round(score, 12).alias("score"))


def coherence(scores: DataFrame, files: DataFrame) -> DataFrame:
    """The best chunk of each file gains max * 0.2 * (file's sum / largest sum)."""
    q, f = Window.partitionBy("query_id"), Window.partitionBy("query_id", "file")
    x = scores.join(files, "chunk_id").withColumn("total", F.sum("score").over(f)).withColumn("best", F.row_number().over(f.orderBy(F.desc("score"), "chunk_id")))
    x = x.withColumn("top", F.max("score").over(q)).withColumn("most", F.max("total").over(q))
    gain = F.when((F.col("best") == 1) & (F.col("top") > 0), F.col("top") * 0.2 * F.col("total") / F.col("most")).otherwise(0.0)
    return x.select("query_id", "chunk_id", "file", F.round(F.col("score") + gain, 12).alias("score"))


def defined_names(text: Column, keywords: str = KEYWORDS, flags: str = "(?m)") -> Column:
    """Last components of the names that a text defines."""
    pattern = rf"{flags}(?:^|\s)(?:{keywords})\s+{NAME}(?:\s|[<({{:\[;]|$)"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.regexp_extract(n, "[A-Za-z0-9_]*$", 0))


def defines(text: Column, symbol: Column) -> Column:
    sql = F.transform(defined_names(text, SQL_KEYWORDS, "(?im)"), F.lower)
    return F.array_contains(defined_names(text), symbol) | F.array_contains(sql, F.lower(symbol))


def stem_matches(stem: Column, name: Column) -> Column:
    """Equal as it is, without underscores, or without the s at the end; stem and name in lower case."""
    flat = F.replace(stem, F.lit("_"), F.lit(""))
    return (stem == name) | (flat == name) | (F.rtrim(stem, F.lit("s")) == name) | (F.rtrim(flat, F.lit("s")) == name)


def definitions(chunks: DataFrame) -> DataFrame:
    """(symbol, folded, chunk_id, file) of the names that chunks define, each once; folded ones are in lower case and match in any."""
    exact = F.transform(F.array_distinct(defined_names(F.col("text"))), lambda n: F.struct(n.alias("symbol"), F.lit(False).alias("folded")))
    low = F.array_distinct(F.transform(defined_names(F.col("text"), SQL_KEYWORDS, "(?im)"), F.lower))
    both = F.concat(exact, F.transform(low, lambda n: F.struct(n.alias("symbol"), F.lit(True).alias("folded"))))
    return chunks.select("chunk_id", "file", F.inline(both)).select("symbol", "folded", "chunk_id", "file")


def defining(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, symbol, chunk_id, file) of the chunks that define a symbol (query_id, symbol), from their :func:`definitions`.

    Names meet the symbols by an equi-join in lower case.
    """
    keyed = found.select(F.lower("symbol").alias("low"), F.col("symbol").alias("name"), "folded", "chunk_id", "file")
    met = keyed.join(symbols.withColumn("low", F.lower("symbol")), "low").filter(F.col("folded") | (F.col("name") == F.col("symbol")))
    return met.select("query_id", "symbol", "chunk_id", "file").distinct()


def tiers(scores: DataFrame, defined: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tier, enters) of the chunks that define (:func:`definitions`) a name (query_id, symbol, whole) of a query.

    ``whole``: the name is the query itself; its chunks gain more, and only those with its stem enter. For a
    name inside a query or predicted, a stem that begins it lets a chunk enter as well.
    """
    top = scores.groupBy("query_id").agg(F.max("score").alias("top"))
    found = defining(defined, names.select("query_id", "symbol")).join(names, ["query_id", "symbol"]).join(top, "query_id").withColumn("stem", F.lower(T.stem(F.col("file"))))
    tier = F.col("top") * F.when(F.col("whole"), 3.0).otherwise(1.5) * F.when(stem_matches(F.col("stem"), F.lower("symbol")), 1.5).otherwise(1.0)
    best = found.groupBy("query_id", "chunk_id", "stem").agg(F.max(tier).alias("tier"))
    stem, flat, low = F.col("stem"), F.replace(F.col("stem"), F.lit("_"), F.lit("")), F.lower("symbol")
    begins = (stem == low) | (flat == low) | ((F.length(stem) >= 4) & low.startswith(stem)) | ((F.length(flat) >= 4) & low.startswith(flat))
    # any name of the query may let a defining chunk in
    enters = F.bool_or(F.when(F.col("whole"), stem_matches(stem, low)).otherwise(begins))
    return best.join(names, "query_id").groupBy("query_id", "chunk_id").agg(F.max("tier").alias("tier"), enters.alias("enters"))


def whole_names(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", T.symbol_name(F.trim("query")).alias("symbol"), F.lit(True).alias("whole"))


def raised(scores: DataFrame, tiers: DataFrame) -> DataFrame:
    """Scores (query_id, chunk_id, score) plus tiers; chunks that were no candidates enter at their tier if they may."""
    both = tiers.join(scores, ["query_id", "chunk_id"], "full_outer")
    kept = both.filter("score IS NOT NULL OR (enters AND tier > 0)")
    return kept.select("query_id", "chunk_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("tier", F.lit(0.0))).alias("score"))


def boost_definitions(scores: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbol queries: defining candidates gain the tier; other chunks with a matching stem enter at the tier."""
    return raised(scores, tiers(scores, definitions(chunks), whole_names(queries)))


def keyword_ratio(query: Column, path: Column) -> Column:
    """The share of a query's keywords that occur among the parts of a file's stem and directory."""
    words = F.filter(F.regexp_extract_all(query, F.lit(T.IDENT), 0), lambda w: F.length(w) > 2)
    words = F.array_except(F.array_distinct(F.transform(words, F.lower)), F.array(*[F.lit(w) for w in T.STOP_WORDS]))
    folder = T.basename(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    parts = F.array_distinct(F.concat(T.identifier_terms(T.stem(path)), F.when(folder != "", T.identifier_terms(folder)).otherwise(F.array().cast("array<string>"))))

    def near(a: Column, b: Column) -> Column:
        return (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a))

    def ratio(kw: Column) -> Column:
        hits = T.let(parts, lambda p: F.filter(kw, lambda w: F.array_contains(p, w) | F.exists(p, lambda x: near(w, x))))
        return F.when(F.size(kw) == 0, 0.0).otherwise(F.size(hits) / F.size(kw))

    return T.let(words, ratio)


def boost_stems(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Natural queries: scores (query_id, chunk_id, file, score) gain max * ratio where the ratio is 0.10 or more."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    x = scores.join(queries, "query_id").withColumn("top", top).withColumn("ratio", keyword_ratio(F.col("query"), F.col("file")))
    return x.select("query_id", "chunk_id", "file", F.round(F.col("score") + F.when(F.col("ratio") >= 0.1, F.col("top") * F.col("ratio")).otherwise(0.0), 12).alias("score"))


def saturated(scores: DataFrame, k: int, penalise: bool = True) -> DataFrame:
    """Top k of (query_id, chunk_id, file, score) where the n-th chunk of a file counts 0.5 ** (n - 1).

    Equal scores go by start_line, where there is one, then file and chunk_id.
    """
    line = ["start_line"] if "start_line" in scores.columns else []
    pen = F.round(F.col("score") * (T.path_penalty(F.col("file")) if penalise else F.lit(1.0)), 12)
    q = Window.partitionBy("query_id")
    x = scores.withColumn("pen", pen).withColumn("pos", F.row_number().over(q.orderBy(F.desc("pen"), *line, "file", "chunk_id")) - 1)
    nth = F.row_number().over(Window.partitionBy("query_id", "file").orderBy("pos")) - 1
    x = x.withColumn("eff", F.col("pen") * F.pow(F.lit(0.5), nth))
    x = x.withColumn("low", F.min("eff").over(q.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    stop = F.min(F.when((F.col("pos") >= k) & (F.col("pen") <= F.col("low")), F.col("pos"))).over(q)
    x = x.withColumn("stop", stop).filter("stop IS NULL OR pos < stop")
    return ranked(x.select("query_id", "chunk_id", "file", F.col("eff").alias("score")), k)


def boosted(scores: DataFrame, chunks: DataFrame, queries: DataFrame, predicted: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(query_id, chunk_id, file, score): symbol queries by definitions, natural ones by stems, then by names in them or predicted.

    An index that stores definitions gives those of the batch's names, and no text is scanned.
    """
    from .expansion import names_of

    symbol = T.query_kind(F.col("query")) == "symbol"
    # an empty query has no words that a stem could hold
    stems = boost_stems(scores, queries.select("query_id", F.when(symbol, "").otherwise(F.col("query")).alias("query"))).drop("file")
    names = names_of(queries.withColumn("whole", symbol), predicted)
    stored = getattr(index, "definitions", None)
    defined = stored(names.select("symbol")) if stored else definitions(chunks.filter(~F.coalesce("deleted", F.lit(False))))
    return raised(stems, tiers(stems, defined, names)).join(chunks.select("chunk_id", "file"), "chunk_id")


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, qvecs: DataFrame, k: int, alpha: float | None = None, predicted: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """BM25 and vector arms fused, then coherence, boosts by the kind of query, penalties and top k.

    ``alpha``, the weight of the vectors, is 0.3 for symbol queries and 0.5 for others if it is not
    given; path penalties hold below 1. Deleted chunks are in neither arm.
    """
    from ..sources.index import kept

    auto = F.when(T.query_kind(F.col("query")) == "symbol", 0.3).otherwise(0.5)
    weight = queries.select("query_id", (auto if alpha is None else F.lit(float(alpha))).alias("alpha"))
    fetch = FETCH * k
    alive = vectors.join(chunks.filter("deleted").select("chunk_id"), "chunk_id", "left_anti")
    dense = knn(qvecs, alive, fetch).join(weight, "query_id")
    if index is None:
        lexical = best(queries, chunks, fetch, predicted)
    else:
        lexical = index.best(queries, fetch, predicted) if hasattr(index, "best") else best(queries, index, fetch, predicted)
    lexical = lexical.join(weight, "query_id")
    fused = kept(fuse([(dense, F.col("alpha")), (lexical, 1 - F.col("alpha"))]), "fused")  # both arms are read again by what follows
    out = boosted(coherence(fused, chunks.select("chunk_id", "file")), chunks, queries, predicted, index)
    return saturated(out, k, alpha is None or alpha < 1)


def blend(scored: DataFrame, head: int = 50, beta: float = 0.25) -> DataFrame:
    """Blend (query_id, chunk_id, score, neural) over the first ``head``; the tail follows unscaled."""
    q = Window.partitionBy("query_id")
    x = scored.withColumn("pos", F.row_number().over(q.orderBy(F.desc("score"), "chunk_id")))
    h = Window.partitionBy("query_id", "in_head")

    def mm(c: str) -> Column:
        lo, hi = F.min(c).over(h), F.max(c).over(h)
        return F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))

    x = x.withColumn("in_head", F.col("pos") <= head).withColumn("new", beta * mm("neural") + (1 - beta) * mm("score"))
    final = F.when(F.col("in_head"), F.round("new", 9)).otherwise(F.col("score"))
    x = x.withColumn("final", final)
    return x.withColumn("rank", F.row_number().over(q.orderBy(F.desc("in_head"), F.when(F.col("in_head"), -F.col("final")).otherwise(F.col("pos")), "pos"))).select("query_id", "chunk_id", "rank", "final")
