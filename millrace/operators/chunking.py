"""Chunking texts and encoding them as vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sparse import length, weighted_sums


def line_windows(docs: DataFrame, key: str, size: int = 50, overlap: int = 5) -> DataFrame:
    """(key, first, last, text): windows of lines; a tail that lies wholly in the overlap is not a window of its own."""
    x = docs.select(key, F.split("text", "\n").alias("l"))
    stop = F.when(F.size("l") <= size, F.lit(0)).otherwise(F.size("l") - overlap - 1)
    x = x.withColumn("a", F.explode(F.sequence(F.lit(0), stop, F.lit(size - overlap))))
    return x.select(key, (F.col("a") + 1).cast("long").alias("first"), F.least(F.col("a") + size, F.size("l")).cast("long").alias("last"), F.array_join(F.slice("l", F.col("a") + 1, size), "\n").alias("text"))


def heading_sections(docs: DataFrame, key: str, heading: str = "^#{1,6} ") -> DataFrame:
    """(key, sec, first, last, chars): a line that is a heading starts a section."""
    x = docs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "s"))
    sec = F.sum(F.col("s").rlike(heading).cast("int")).over(Window.partitionBy(key).orderBy("n"))
    return x.withColumn("sec", sec).groupBy(key, "sec").agg((F.min("n") + 1).alias("first"), (F.max("n") + 1).alias("last"), F.sum(F.length("s")).alias("chars"))


def lines_of(text: str) -> list[str]:
    """The lines of a text with their ends; only \\n ends a line."""
    return re.findall(r"[^\n]*\n|[^\n]+", text) or [""]


#: Lines at which a chunk of code may start, by language family.
BOUNDARY = re.compile(r"^(?:def |class |func |fn |pub |type |interface |function |export |public |private |#{1,6} |CREATE |[A-Z][A-Za-z ]+\.$)")


def pack_lines(text: str, budget: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) chunks of at most ``budget`` bytes where lines allow it; put together they are the text."""
    lines = lines_of(text)
    out: list[tuple[int, int, str]] = []
    start, size, edge = 0, 0, None
    for k, line in enumerate(lines):
        n = len(line.encode())
        if k > start and size + n > budget:
            cut = edge if edge is not None and edge > start else k
            out.append((start + 1, cut, "".join(lines[start:cut])))
            start, edge = cut, None
            size = sum(len(x.encode()) for x in lines[start:k])
        if BOUNDARY.match(line):
            edge = k
        size += n
    out.append((start + 1, len(lines), "".join(lines[start:])))
    return out


def packed_chunks(docs: DataFrame, key: str, budget: int = 1500) -> DataFrame:
    """(key, first, last, text) of each document; a document is a sequential fold, so Arrow batches go to Python."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b["text"], strict=True) for c in pack_lines(t or "", budget)]
            yield pd.DataFrame(rows, columns=[key, "first", "last", "text"])

    return docs.select(key, "text").mapInPandas(work, f"{key} string, first int, last int, text string")


def weighted_mean(weights: DataFrame, rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(chunk_id, vec, norm): unit weighted mean of the rows (vec_id, embedding) of each chunk's (vec_id, w), in double.

    Of ``chunks`` (chunk_id), those without weights get a zero vector.
    """
    entries = weights.groupBy("chunk_id", "vec_id").agg(F.sum("w").alias("w")).select(F.col("chunk_id").alias("row"), F.col("vec_id").alias("col"), "w")
    sums = weighted_sums(entries, rows.select(F.col("vec_id").alias("col"), F.col("embedding").alias("vec")))
    mean = sums.select(F.col("row").alias("chunk_id"), T.let(F.col("total"), lambda n: F.transform("sums", lambda x: x / n)).alias("mean"))
    if chunks is not None:
        width = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width"))  # one row
        mean = chunks.select("chunk_id").join(mean, "chunk_id", "left").crossJoin(width).select("chunk_id", F.coalesce("mean", F.array_repeat(F.lit(0.0), F.col("width"))).alias("mean"))
    norm = mean.withColumn("norm", length(F.col("mean")))
    return norm.select("chunk_id", F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("vec"), "norm")


def pack_markdown(text: str, budget: int) -> list[tuple[int, int, str]]:
    """As :func:`pack_lines`, for Markdown: a heading starts a chunk; front matter, fenced code, tables and lists stay whole."""
    lines = lines_of(text)
    blocks: list[list[int]] = []  # [first, end, starts a chunk]
    k = 0
    while k < len(lines):
        end, head = k + 1, bool(re.match(r"#{1,6} ", lines[k]))
        if k == 0 and lines[0].strip() == "---":
            end = next((j + 1 for j in range(1, len(lines)) if lines[j].strip() == "---"), 1)
        elif m := re.match(r"\s*(```+|~~~+)", lines[k]):
            end = next((j + 1 for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
        elif re.match(r"\s*\|", lines[k]):
            while end < len(lines) and re.match(r"\s*\|", lines[end]):
                end += 1
        elif re.match(r"\s*(?:[-*+]|\d+[.)]) ", lines[k]):
            while end < len(lines) and re.match(r"\s*(?:[-*+]|\d+[.)]) |\s+\S", lines[end]):
                end += 1
        blocks.append([k, end, head])
        k = end
    out: list[tuple[int, int, str]] = []
    start, size = 0, 0
    for a, z, head in blocks:
        n = sum(len(x.encode()) for x in lines[a:z])
        if a > start and (head or size + n > budget):
            out.append((start + 1, a, "".join(lines[start:a])))
            start, size = a, 0
        size += n
    out.append((start + 1, len(lines), "".join(lines[start:])))
    return out


def markdown_chunks(docs: DataFrame, key: str, budget: int = 1500) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b["text"], strict=True) for c in pack_markdown(t or "", budget)]
            yield pd.DataFrame(rows, columns=[key, "first", "last", "text"])

    return docs.select(key, "text").mapInPandas(work, f"{key} string, first int, last int, text string")


def routed_chunks(docs: DataFrame, budget: int = 1500, skip: DataFrame | None = None) -> DataFrame:
    """(path, first, last, text, kind) of files (path, text): Markdown by its blocks, others by lines; SQL files also by object.

    Folders (dir) in ``skip`` are migrations, whose objects come from their fold and not from each file.
    """
    from .ddl import parsed

    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    md = ext.isin("md", "markdown", "mdx")
    by_block = markdown_chunks(docs.filter(md), "path", budget).withColumn("kind", F.lit("markdown"))
    by_line = packed_chunks(docs.filter(~md), "path", budget).withColumn("kind", F.lit("lines"))
    sql = docs.filter(ext.isin("sql", "ddl"))
    if skip is not None:
        sql = sql.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(skip.select("dir").distinct(), "dir", "left_anti")
    one = F.lit(1)
    objects = parsed(sql).select("path", one.alias("first"), F.size(F.split("body", "\n")).alias("last"), F.col("body").alias("text"), F.col("kind"))
    return by_block.unionByName(by_line).unionByName(objects)


def tree_chunks(text: str, budget: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of Python source by its syntax tree: statements that fit together share a chunk,
    larger ones are cut at their own statements. Put together the chunks are the text; what does not parse goes by lines."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return pack_lines(text, budget)
    lines = lines_of(text)
    size = [len(x.encode()) for x in lines]

    def starts(body: list, lo: int, hi: int) -> list[int]:
        """Lines (from 0) in lo .. hi at which a chunk may start."""
        out = [lo]
        for node in body:
            a = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
            if lo < a < hi:
                out.append(a)
            if sum(size[a : node.end_lineno]) > budget and getattr(node, "body", None) and isinstance(node.body, list):
                out += [x for x in starts(node.body, max(a, lo), min(node.end_lineno, hi)) if x > a]
        return sorted(set(out))

    edges = [*starts(tree.body, 0, len(lines)), len(lines)]
    out, at = [], 0
    for a, b in zip(edges[:-1], edges[1:]):
        if a > at and sum(size[at:b]) > budget:
            out.append((at + 1, a, "".join(lines[at:a])))
            at = a
    out.append((at + 1, len(lines), "".join(lines[at:])))
    return out
