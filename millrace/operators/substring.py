"""Which texts hold which patterns: for one batch of patterns by a scan, for many by an inverted index of 3-grams.

:func:`holders` reads the texts once, in blocks that meet blocks of patterns. A pattern's anchor is eight of its bytes,
or all where it has fewer; a block's positions are looked up in a table of anchors, and
only where one fits is the pattern compared. So the work grows with the texts and hardly with the patterns.

``GramIndex`` is built once for many batches: a text that holds a pattern holds all its grams, so only the postings of
a pattern's rarest grams are met, and what has all of them is compared. Patterns of fewer than three characters
have no gram and are scanned for.
Null texts and null or empty patterns match nothing; texts with one id are rows of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts, characters and patterns of a block, positions looked at at a time.
MOST, CHARS, PATTERNS, STEP = 2048, 8_000_000, 4096, 2_000_000
WIDTH = 8
#: Queries that meet a block of texts at a time.
QUERIES = 1024
GRAM = 3
#: A pattern's rarest grams that are met.
PICK = 4


def grams(text: Column) -> Column:
    """The different 3-grams of a text."""

    def of(cs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(cs) - GRAM), lambda i: F.concat(*[F.get(cs, i + j) for j in range(GRAM)]))
        return F.when(F.size(cs) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return T.let(F.split(text, ""), of)


def _picked(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern_id, gram, of) of each pattern's rarest grams; a pattern with a gram that no text has is left out."""
    own = patterns.select("pattern_id", F.explode(grams(F.col("pattern"))).alias("gram")).join(counts, "gram", "left")
    w = Window.partitionBy("pattern_id")
    rare = own.withColumn("nth", F.row_number().over(w.orderBy(F.asc_nulls_first("df"), "gram"))).withColumn("all", F.count("df").over(w) == F.count("*").over(w))
    return rare.filter(F.col("all") & (F.col("nth") <= PICK)).select("pattern_id", "gram", F.count("*").over(w).alias("of"))


def _holding(met: DataFrame, patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, row, ...) of pairs that have all picked grams and hold the pattern."""
    able = met.groupBy("pattern_id", "row").agg(F.count("*").alias("has"), F.max("of").alias("of")).filter("has = of").select("pattern_id", "row")
    return able.join(patterns.select("pattern_id", "pattern"), "pattern_id").join(texts, "row").filter(F.contains("text", "pattern"))


def _anchor(pattern: bytes) -> int:
    """Where a pattern's anchor begins: at its eight bytes with the most different ones, the last of them."""
    return max(range(max(len(pattern) - WIDTH, 0) + 1), key=lambda i: (len(set(pattern[i : i + WIDTH])), i))


def _found(texts: pa.Array, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, pattern) of all pairs of places where the text holds the pattern."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = (texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    data, offsets = bytes(data) + bytes(WIDTH), offsets - offsets[0]
    keys = np.ndarray((size + 1,), "<u8", data, strides=(1,))  # the eight bytes from each position on
    pairs = [np.zeros(0, np.int64)]
    for width in sorted({min(len(p), WIDTH) for p in patterns}):
        mask, mixer = np.uint64((1 << 8 * width) - 1), np.uint64(0x9E3779B97F4A7C15)
        own = [i for i, p in enumerate(patterns) if min(len(p), WIDTH) == width]
        shift = np.array([_anchor(patterns[i]) for i in own])
        key = np.array([int.from_bytes(patterns[i][s : s + width], "little") for i, s in zip(own, shift, strict=True)], np.uint64)
        by = np.argsort(key, kind="stable")
        own, shift = np.array(own)[by], shift[by]
        lens = np.array([len(patterns[i]) for i in own])
        last = np.array([int.from_bytes(patterns[i][-WIDTH:], "little") for i in own], np.uint64)
        names, starts, reps = np.unique(key[by], return_index=True, return_counts=True)
        slot = lambda x: (x * mixer) >> np.uint64(44)  # noqa: B023, E731
        table = np.zeros(1 << 20, bool)
        table[slot(names)] = True
        for a in range(0, size, STEP):
            part = keys[a : min(a + STEP, size)] & mask
            at = np.flatnonzero(table[slot(part)])
            nth = np.minimum(np.searchsorted(names, part[at]), len(names) - 1)
            same = names[nth] == part[at]
            at, nth = at[same] + a, nth[same]
            n = reps[nth]
            which = np.repeat(starts[nth] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(at, n) - shift[which]
            text = np.searchsorted(offsets, np.repeat(at, n), "right") - 1
            inside = (start >= offsets[text]) & (start + lens[which] <= offsets[text + 1])
            start, text, which = start[inside], text[inside], which[inside]
            if width == WIDTH:
                near = keys[start + lens[which] - WIDTH] == last[which]
                start, text, which = start[near], text[near], which[near]
                whole = np.fromiter((data.startswith(patterns[own[w]], s) for s, w in zip(start.tolist(), which.tolist(), strict=True)), bool, len(start))
                text, which = text[whole], which[whole]
            pairs.append(np.unique(text * len(patterns) + own[which]))
    both = np.unique(np.concatenate(pairs))
    return both // max(len(patterns), 1), both % max(len(patterns), 1)


def text_blocks(texts: DataFrame, *more: str) -> DataFrame:
    """Blocks of (id, text, ..): each column as a list. Null texts have no part."""
    names = ["id", "text", *more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, sizes = 0, np.cumsum([len(t) for t in b.column(1).to_pylist()])
            while a < b.num_rows:
                z = min(max(int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHARS, "right")), a + 1), a + MOST)
                part = b.slice(a, z - a)
                yield pa.record_batch([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], names)
                a = z

    fields = ", ".join(f"{c} array<{texts.schema[c].dataType.simpleString()}>" for c in names)
    return texts.filter("text IS NOT NULL").select(*names).mapInArrow(work, fields)


def gathered(rows: DataFrame, most: int) -> DataFrame:
    """One row for up to ``most`` rows of a batch, each column as a list; kept, so that Spark knows its size."""
    from ..sources.index import kept

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, most):
                yield pa.record_batch([pa.array([c.to_pylist()], pa.list_(c.type)) for c in b.slice(a, most).columns], b.schema.names)

    held = kept(rows, "batch")
    n = -(-held.count() // most)
    return kept(held.repartition(max(n, 1)).mapInArrow(work, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema)), "batch")


def scan(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, id) of each text that holds a pattern, a row for each text."""
    asked = patterns.filter(F.length("pattern") > 0).select("pattern_id", "pattern")
    pairs = text_blocks(texts).crossJoin(gathered(asked, PATTERNS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, held, pids, asked = (c[r].values for c in b.columns)
                text, which = _found(held, [p.encode() for p in asked.to_pylist()])
                for a in range(0, len(text), 100_000):
                    yield pa.record_batch([pids.take(pa.array(which[a : a + 100_000])), ids.take(pa.array(text[a : a + 100_000]))], ["pattern_id", "id"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return pairs.mapInArrow(work, f"pattern_id {kind(patterns, 'pattern_id')}, id {kind(texts, 'id')}")


def holders(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern_id, id) of all pairs of (pattern_id, pattern) and (id, text) where the text holds the pattern."""
    return scan(patterns, texts).distinct()


class GramIndex:
    """Postings of 3-grams in buckets, in a folder that all machines see; a batch reads the buckets of its rarest grams."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, texts: DataFrame, path: str | None = None, buckets: int = 64) -> GramIndex:
        """Write the index of (id, text)."""
        from ..sources.index import shared_dir

        spark = texts.sparkSession
        self = cls(spark, path or f"{shared_dir(spark)}/millrace-grams-{uuid.uuid4().hex}", buckets)
        # a row's number is its place in the written table, so equal rows stay apart
        texts.select("id", "text").withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{self.path}/texts")
        # a block's rows of a gram are one row; Spark cuts buckets that are large and joins small ones
        each = _inverted(self.texts()).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        each.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        self._stored().groupBy("gram").agg(F.sum(F.size("rows")).alias("df")).write.parquet(f"{self.path}/counts")
        return self

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema("gram string, rows array<bigint>, bucket int").parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        """(row, gram, bucket), a row for each gram of a text."""
        return self._stored().select(F.explode("rows").alias("row"), "gram", "bucket")

    def holders(self, patterns: DataFrame) -> DataFrame:
        """As :func:`holders`, a row for each text."""
        long = patterns.filter(F.length("pattern") >= GRAM)
        picked = _picked(long, self.spark.read.schema("gram string, df long").parquet(f"{self.path}/counts")).withColumn("bucket", self._bucket())
        near = F.broadcast(picked.select("bucket").distinct())  # at most so many rows as there are buckets
        met = self._stored().join(near, "bucket", "left_semi").join(picked.drop("bucket"), "gram").select("pattern_id", F.explode("rows").alias("row"), "of", "gram")
        few = patterns.filter(F.length("pattern") < GRAM)
        return _holding(met, long, self.texts()).select("pattern_id", "id").unionAll(scan(few, self.texts()).select("pattern_id", "id"))


def _inverted(texts: DataFrame) -> DataFrame:
    """(gram, rows) of (row, text): the rows of a block of texts that hold a gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: dict[str, list[int]] = {}
                for row, text in zip(ids, held, strict=True):
                    for gram in {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}:
                        rows.setdefault(gram, []).append(row)
                yield pa.record_batch([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["gram", "rows"])

    return text_blocks(texts.select(F.col("row").alias("id"), "text")).mapInArrow(work, "gram string, rows array<bigint>")


def grep_cost(queries: DataFrame, texts: DataFrame, tokens: Column, relevant: DataFrame, literal: bool = False, cap: int = 20000) -> DataFrame:
    """What finding by grep costs: (query_id, tokens, matched, recall) of (query_id, query) over (id, text).

    All texts that hold a term of the query, or the whole query if ``literal``, in any case, are
    read whole, each for ``tokens`` of its text but ``cap`` at most. ``recall``: one of them is in ``relevant``
    (query_id, id). A query without terms reads nothing.
    """
    cost = texts.select("id", F.lower("text").alias("text"), F.least(tokens, F.lit(cap)).cast("long").alias("tokens"))
    if literal:
        asked = queries.select("query_id", F.array(F.lower(F.trim("query"))).alias("words"))
    else:
        asked = queries.select("query_id", F.array_distinct(T.terms(F.col("query"))).alias("words"))
    asked = asked.select("query_id", F.filter("words", lambda w: F.length(w) > 0).alias("words"))
    per = _reads(text_blocks(cost, "tokens").crossJoin(gathered(asked, QUERIES))).groupBy("query_id").agg(F.sum("tokens").alias("tokens"), F.sum("matched").alias("matched"))
    # of the relevant texts alone, those that are read
    told = relevant.select("query_id", "id").distinct().join(asked, "query_id").join(cost.select("id", "text"), "id")
    hit = told.filter(F.exists("words", lambda w: F.contains(F.col("text"), w))).select("query_id", F.lit(True).alias("recall")).distinct()
    zero = F.lit(0).cast("long")
    out = queries.select("query_id").join(per, "query_id", "left").join(hit, "query_id", "left")
    return out.select("query_id", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("matched", zero).alias("matched"), F.coalesce("recall", F.lit(False)).alias("recall"))


def _reads(pairs: DataFrame) -> DataFrame:
    """(query_id, tokens, matched): what each query reads in each block of texts that hold one of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                texts, tokens, qids, words = b.column(1)[r].as_py(), np.array(b.column(2)[r].as_py(), np.int64), b.column(3)[r].values, b.column(4)[r].as_py()
                # short words first, for most texts hold one of them
                words = [sorted(w, key=len) for w in words]
                read = np.zeros((len(words), len(texts)), bool)
                for t, text in enumerate(texts):
                    seen: dict[str, bool] = {}
                    for q, own in enumerate(words):
                        for w in own:
                            if (has := seen.get(w)) is None:
                                has = seen[w] = w in text
                            if has:
                                read[q, t] = True
                                break
                yield pa.record_batch([qids, pa.array(read @ tokens), pa.array(read.sum(1))], ["query_id", "tokens", "matched"])

    kind = pairs.schema["query_id"].dataType.elementType.simpleString()
    return pairs.mapInArrow(work, f"query_id {kind}, tokens bigint, matched bigint")
