"""Line dedup by pairwise alignment with patience diff.

Lines (trimmed of white space, blank ones left out) are known by 96-bit hashes. Two documents
overlap where they share a window: the least run of lines, from a line on or back from one,
that has ``LEAST_WORDS`` words together. Single lines are no keys, for some are in every third
document; a common line takes part through its neighbours. Each window of a document is
followed to its first holder, so a document meets the holders of its windows, at most
one for each, and a window of any frequency leads to one.

Each later document is aligned with each of these holders by patience diff over the whole line
sequences of both: lines that are once in both, in their longest common order, are anchors, and
the gaps between them are aligned in turn; where no line is once in both, the rarest common one
is the anchor. Aligned lines that follow each other in both documents are a block, and a
block with ``LEAST_WORDS`` words goes from the later document. What is left is aligned with the
holder again, until an alignment gives no block: so passages in another order and repeated ones
go too. Nothing goes that no alignment holds: a line that matches elsewhere in the holder than
its neighbours do stays, if it has not the words by itself.

Defined results: null and empty texts have no lines and stay as they are; rows without an
id are left alone; rows of equal id never lose lines to each other, and each loses its
own blocks; a document all of whose lines are deleted stays with an empty text; lines are
those between \\n; empty tables give empty results; other columns are kept by
:func:`dedup_lines`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, stored, table

LEAST_WORDS = 10


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, lo2, hi2 = todo.pop()
        while lo < hi and lo2 < hi2 and a[lo] == b[lo2]:
            out.append((lo, lo2))
            lo, lo2 = lo + 1, lo2 + 1
        while lo < hi and lo2 < hi2 and a[hi - 1] == b[hi2 - 1]:
            hi, hi2 = hi - 1, hi2 - 1
            out.append((hi, hi2))
        if lo >= hi or lo2 >= hi2:
            continue
        once = _once(b, lo2, hi2)
        anchors = [(i, once[x]) for x, i in _once(a, lo, hi).items() if x in once]
        chain = _ascending(sorted(anchors)) or _rarest(a, lo, hi, b, lo2, hi2)
        if not chain:
            continue
        at, at2 = lo, lo2
        for i, j in [*chain, (hi, hi2)]:
            todo.append((at, i, at2, j))
            at, at2 = i, j
        # the anchors themselves are found as common starts of the gaps after them
    return sorted(out)


def _once(x: list, lo: int, hi: int) -> dict:
    seen: dict = {}
    for i in range(lo, hi):
        seen[x[i]] = -1 if x[i] in seen else i
    return {k: i for k, i in seen.items() if i >= 0}


def _rarest(a: list, lo: int, hi: int, b: list, lo2: int, hi2: int) -> list[tuple[int, int]]:
    """The first places of the common line with the fewest pairs of places, the first such line of ``a``."""
    n, m = Counter(a[lo:hi]), Counter(b[lo2:hi2])
    common = [(n[x] * m[x], i) for i, x in enumerate(a[lo:hi], lo) if x in m]
    if not common:
        return []
    i = min(common)[1]
    return [(i, b.index(a[i], lo2, hi2))]


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain ascending in the second member, by patience sorting."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def windows(doc: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and lengths of the least windows; doc numbers the documents of the lines in order."""
    n = len(doc)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(words, dtype=np.int64)])
    own = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    end = np.searchsorted(sums, sums[:-1] + least, "left")
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead = np.flatnonzero(end <= own[1])
    back = np.flatnonzero(start >= own[0])
    back = back[end[start[back]] != back + 1]
    first = np.concatenate([ahead, start[back]])
    return first, np.concatenate([end[ahead], np.arange(1, n + 1)[back]]) - first


def chained(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each window's values in their order."""
    values = values.astype(np.int64).view(np.uint64)
    out = np.zeros(len(first), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        x = (out[live] ^ values[first[live] + k]) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[live] = x ^ (x >> np.uint64(31))
    return out


def aligned(own: list, holder: list, words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, end) of the blocks of ``own`` that alignments with ``holder`` hold, by place."""
    out: list[tuple[int, int]] = []
    left = list(range(len(own)))
    while left:
        blocks: list[list[int]] = []  # [first, end, end in the holder]
        for i, j in patience([own[p] for p in left], holder):
            p = left[i]
            if blocks and blocks[-1][1:] == [p, j]:
                blocks[-1][1:] = [p + 1, j + 1]
            else:
                blocks.append([p, p + 1, j + 1])
        found = [(a, b) for a, b, _ in blocks if sum(words[a:b]) >= least]
        if not found:
            break
        out += found
        gone = {p for a, b in found for p in range(a, b)}
        left = [p for p in left if p not in gone]
    return sorted(out)


def joined(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as blocks that do not meet."""
    out: list[list[int]] = []
    for a, b in sorted(blocks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, t, h, g, words, no): hashes, words and numbers of the lines that are not blank, a row for each document; t tells texts of one id apart."""
    split = docs.select("id", F.xxhash64("text").alias("t"), F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x, F.lit(SPACES)).alias("s"), i.alias("no"))).alias("lines"))
    full = split.select("id", "t", F.filter("lines", lambda x: x["s"] != "").alias("lines"))
    of = lambda f, name: F.transform("lines", f).alias(name)
    return full.select("id", "t", of(lambda x: F.xxhash64(x["s"]), "h"), of(lambda x: F.hash(x["s"]), "g"), of(lambda x: F.regexp_count(x["s"], F.lit(WORD)), "words"), of(lambda x: x["no"], "no"))


def windows_of(lines: DataFrame, least: int) -> DataFrame:
    """(h, g, id, t): the least windows of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, g, words = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h", "g", "words"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("h").offsets.to_numpy()))
            at, size = windows(doc, words, least)
            keys = chained(h, at, size).view(np.int64), (chained(g, at, size) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.record_batch([*map(pa.array, keys), *(b.column(c).take(pa.array(doc[at])) for c in ("id", "t"))], ["h", "g", "id", "t"])

    return lines.select("id", "t", "h", "g", "words").mapInArrow(work, "h long, g int, id long, t long")


def removals(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, t, gone) with gone an array of blocks (first, last, lines), for documents that lose lines."""
    lines = stored(lines_of(docs.filter("id IS NOT NULL AND text <> ''")).dropDuplicates(["id", "t"]), "lines")
    all_ = stored(windows_of(lines, least).distinct(), "windows")
    # stored, so that a window of many documents, or a holder of many, may be dealt to several tasks of a join
    shared = stored(all_.groupBy("h", "g").agg(F.min(F.struct("id", "t")).alias("at"), F.max("id").alias("other")).filter("at.id < other").select("h", "g", F.col("at.id").alias("holder"), F.col("at.t").alias("ht")), "shared")
    pairs = stored(all_.join(shared.hint("merge"), ["h", "g"]).filter("id > holder").select("id", "t", "holder", "ht").distinct(), "pairs")
    theirs = lines.select(F.col("id").alias("holder"), F.col("t").alias("ht"), F.col("h").alias("hh"), F.col("g").alias("hg"))
    met = pairs.join(lines.hint("merge"), ["id", "t"]).join(theirs.hint("merge"), ["holder", "ht"]).select("id", "t", "h", "g", "words", "hh", "hg")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in batches:
            rows = (zip(*(b.column(c).to_pylist() for c in ("h", "g", "words", "hh", "hg")), strict=True))
            found = [aligned(list(zip(h, g, strict=True)), list(zip(hh, hg, strict=True)), words, least) for h, g, words, hh, hg in rows]
            yield pa.record_batch([b.column("id"), b.column("t"), pa.array([[{"a": x, "b": y} for x, y in f] for f in found], kind)], ["id", "t", "blocks"])

    blocks = met.mapInArrow(align, "id long, t long, blocks array<struct<a: int, b: int>>").filter(F.size("blocks") > 0)
    each = blocks.groupBy("id", "t").agg(F.flatten(F.collect_list("blocks")).alias("blocks")).join(lines.select("id", "t", "no"), ["id", "t"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lines", pa.int32())]))
        for b in batches:
            gone = [[{"first": no[x], "last": no[y - 1], "lines": y - x} for x, y in joined([(r["a"], r["b"]) for r in rows])] for rows, no in zip(b.column("blocks").to_pylist(), b.column("no").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("id"), b.column("t"), pa.array(gone, kind)], ["id", "t", "gone"])

    return each.mapInArrow(merge, "id long, t long, gone array<struct<first: int, last: int, lines: int>>")


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ..) with the blocks deleted, and the column ``gone``."""
    gone = stored(removals(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), least).withColumnRenamed("id", "doc_id"), "gone")
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # always by a shuffle, so that small and large inputs behave alike
    both = inner.join(gone.hint("merge"), ["doc_id", "t"], "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.exists("gone", lambda g: i.between(g["first"], g["last"])))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return both.select("row", text.alias("text"), "gone")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate(F.col("gone"), F.lit(0).cast("long"), lambda n, g: n + g["lines"])
    spans = F.array_join(F.transform("gone", lambda g: F.concat_ws("-", g["first"], g["last"])), ",")
    return out.select(
        "row.doc_id",
        F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.lit("")).alias("removed"),
        "text",
    )
