"""Result shaping: filters, pages, token budgets, explanations, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import Ordered


SPAN = 64


def filtered(hits: DataFrame, k: int, extensions: list[str] = (), contains: str = "", without: str = "") -> DataFrame:
    """Filters on a ranking's files, after retrieval as asked; ranks are given anew."""
    ok = F.lit(True)
    if extensions:
        ok = ok & F.lower(F.substring_index("file", ".", -1)).isin(*[e.lower().lstrip(".") for e in extensions])
    if contains:
        ok = ok & F.col("file").contains(contains)
    if without:
        ok = ok & ~F.col("file").contains(without)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.filter(ok).withColumn("rank", rank).filter(F.col("rank") <= k)


def page(rows: DataFrame, order: list[str], offset: int, limit: int, most: int) -> DataFrame:
    """The rows of a page with total, truncated and overshot; only the ranges of the order that hold the page are read."""
    offset, limit = max(offset, 0), limit if 0 < limit <= most else most
    ordered = Ordered(rows, order)
    total = ordered.total
    return ordered.page(offset, limit).select("*", F.lit(total).cast("long").alias("total"), F.lit(offset + limit < total).alias("truncated"), F.lit(0 < total <= offset).alias("overshot"))


def within_budget(hits: DataFrame, most: int) -> DataFrame:
    """The first hits of each query (query_id, rank, file, text) whose tokens add up to ``most``; the first always."""
    cost = T.approx_tokens(F.col("text")) + T.approx_tokens(F.col("file")) + 8
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = hits.withColumn("cost", cost).withColumn("used", F.sum("cost").over(w))
    return x.filter((F.col("rank") == 1) | (F.col("used") <= most))


def explained(query: Column, text: Column) -> Column:
    """The query's terms that a text has, in their order; else semantic."""
    both = T.let(T.terms(text), lambda c: F.filter(F.array_distinct(T.terms(query)), lambda t: F.array_contains(c, t)))
    return F.when(F.size(both) == 0, "semantic").otherwise(F.array_join(both, ", "))


def render_markdown(hits: DataFrame) -> DataFrame:
    """(query_id, body) of (query_id, rank, file, first, last, score, text), with whole texts, trimmed."""
    item = F.format_string("## %d. %s:%d-%d [score=%.3f]\n```\n%s\n```", "rank", "file", "first", "last", "score", F.trim("text", F.lit(" \n\t\r")))
    rows = F.array_sort(F.collect_list(F.struct("rank", item.alias("s"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n").alias("body"))


def render_json(hits: DataFrame) -> DataFrame:
    """(query_id, body, hits): the hits (query_id, rank, file, score, text) of each query as a JSON array by rank."""
    # what to_json makes of {"v": text}, without {"v": and }
    text = lambda c: F.expr(f"substring(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6)")
    item = F.concat(F.lit('{"file":'), text("file"), F.lit(',"rank":'), F.col("rank"), F.lit(',"score":'), F.format_string("%.4f", "score"), F.lit(',"text":'), text("text"), F.lit("}"))
    rows = F.array_sort(F.collect_list(F.struct("rank", item.alias("s"))))
    return hits.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["s"]), ","), F.lit("]")).alias("body"), F.count("*").alias("hits"))


def cli_rows(hits: DataFrame) -> DataFrame:
    """(query_id, rank, line) of hits (query_id, rank, file, first, last, score, text): score, place and first line."""
    return hits.select("query_id", "rank", F.format_string("%.4f %s:%d-%d %s", "score", "file", "first", "last", T.preview_line(F.col("text"))).alias("line"))


def grep(texts: DataFrame, words: list[str]) -> DataFrame:
    low = F.lower("text")
    return texts.filter(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)))


def same_path(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def resolve(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk (chunk_id, file, first, last) that holds each (file, line): inside a chunk before on its last line.

    Chunks are filed under the spans of ``SPAN`` lines that they touch, so points meet those near them.
    """
    spans = F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))
    filed = chunks.withColumn("span", F.explode(spans))
    near = points.withColumn("span", F.floor(F.col("line") / SPAN)).join(filed, ["file", "span"]).filter("first <= line AND line <= last")
    w = Window.partitionBy("file", "line").orderBy(F.col("line") == F.col("last"), "chunk_id")
    return near.withColumn("n", F.row_number().over(w)).filter("n = 1").select("file", "line", "chunk_id")
