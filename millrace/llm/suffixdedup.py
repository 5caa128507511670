"""Removal of long byte strings that an earlier document holds, by a run-length index.

A byte goes if some ``LENGTH``-byte window over it also starts in a document with a smaller
doc_id. Every window has a minimizer, the least hash of its ``GRAM``-byte grams; equal
windows have the same one, so they meet by it:

1. Documents are dealt to blocks. A block lists the minimizers of its windows, each once.
2. A bucket of minimizers (one task holds several, one at a time) finds those of two
   documents or more and tells the blocks.
3. A block cuts its texts at such minimizers into pieces: up to ``WIDE`` windows in a row
   that share one. Equal pieces are one, held by the block's least doc_id.
4. A bucket of pieces folds equal ones to their first holder and puts all the others that
   share a minimizer into an index: the Burrows-Wheeler transform of the pieces as runs,
   sampled at the ends of the runs and at the pieces' starts, and the ranks where the
   common prefix falls below ``LENGTH``. Each piece is streamed backwards through it. A
   step gives the rank of the next suffix, and so all suffixes that match it over
   ``LENGTH`` bytes or more; the least holder of these is the window's first one. A match
   is then located by the samples and compared byte by byte.
5. The blocks get the first holder of each piece and the windows that it shares with an
   earlier document, mark them and cut the texts.

Only minimizers, shared pieces and answers are sent, each once for a block, so a passage in
a third of all documents is one row a block. A minimizer that more than ``CROWD`` documents
have may stand in as many different pieces: its windows are pieces themselves, dealt by
their own hash, and equal ones are folded as before.

Defined results: null texts count as empty; a document of fewer than ``LENGTH`` bytes keeps
all; rows of one doc_id do not remove each other's bytes, nor does a document its own
repeats; a row without doc_id comes after all others and loses nothing, having no place in
the order; strings are judged on the input, so what an earlier document loses still removes
from later ones; rows equal in id and text are both returned; an empty table gives an empty
result; other columns are ignored. A text is in memory whole, its hashes in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH = 50
GRAM = 20
#: Grams of a window, and windows of a piece at most.
WIDE = LENGTH - GRAM + 1
#: Bytes of text in a block.
BLOCK = 4_000_000
#: Bytes of text for which there is one bucket, and the least number of buckets.
BUCKET, BUCKETS = 16_000_000, 256
#: Positions hashed at a time.
SLICE = 1 << 19
#: Documents with a minimizer beyond which its windows go one by one.
CROWD = 65536
#: Bytes of pieces in one index.
INDEX = 1_000_000
LAST = np.iinfo(np.int64).max

_MIX = np.random.default_rng(12).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers() -> dict[int, np.uint64]:
    return {n: np.uint64(pow(int(_BASE), n, 2**64)) for n in (1, 2, 4, 8, 16)}


def _scattered(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def minima(data: np.ndarray) -> np.ndarray:
    """The least gram hash of each window of ``data``."""
    by = {1: _MIX[data]}
    power = _powers()
    for n in (1, 2, 4, 8):
        by[2 * n] = by[n][:-n] * power[n] + by[n][n:]
    h = _scattered(by[16][: len(data) - GRAM + 1] * power[4] + by[4][16 : 16 + len(data) - GRAM + 1])
    for n in (1, 2, 4, 8):
        h = np.minimum(h[:-n], h[n:])
    return np.minimum(h[:-15], h[15:])


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer, document) of runs of windows with one minimizer; document j is data[ends[j]:ends[j + 1]]."""
    parts = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), SLICE):
        part = data[at : at + SLICE + LENGTH - 1]
        low = minima(part)
        places = np.arange(at, at + len(low))
        doc = np.searchsorted(ends, places, "right") - 1
        inside = ends[doc + 1] - places >= LENGTH
        low, places, doc = low[inside], places[inside], doc[inside]
        if not len(low):
            continue
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
        size = np.diff(np.r_[first, len(low)])
        times = -(-size // WIDE)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, size = np.repeat(first, times) + turn * WIDE, np.minimum(np.repeat(size, times) - turn * WIDE, WIDE)
        parts.append((places[first], size, low[first], doc[first]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((_scattered(h * _BASE) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


class Block:
    """The documents of a block in a fixed order: ids, whether there is one, bytes and ends."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
        self.number = rows.column("block")[0].as_py()
        ids = rows.column("doc_id").combine_chunks()
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(LAST).to_numpy()
        texts = [t or b"" for t in rows.column("text").to_pylist()]
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]

    def pieces(self, shared: np.ndarray, crowded: np.ndarray, buckets: int):
        """The block's different pieces by bucket and first place (bucket, minimizer, bytes) and their places (piece, start, windows, document)."""
        start, count, h, doc = cut(self.data, self.ends)
        order = np.argsort(shared)
        shared, crowded = shared[order], crowded[order]
        at = np.minimum(np.searchsorted(shared, h), max(len(shared) - 1, 0))
        kept = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        start, count, h, doc, alone = start[kept], count[kept], h[kept], doc[kept], crowded[at[kept]] if len(shared) else kept[:0]
        if alone.any():
            times = np.where(alone, count, 1)
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, count, h, doc, alone = np.repeat(start, times) + turn, np.repeat(np.where(alone, 1, count), times), np.repeat(h, times), np.repeat(doc, times), np.repeat(alone, times)
            h[alone] = [zlib.crc32(self.raw[a : a + LENGTH]) for a in start[alone].tolist()]
        raw, known = self.raw, {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)], np.int64)
        names, hs = list(known), np.empty(len(known), np.uint64)
        hs[number] = h
        bucket = bucket_of(hs, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        return bucket[order], hs[order], [names[i] for i in order.tolist()], place[number], start, count, doc


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of pieces.

    Suffixes are those of all pieces, ordered by their bytes up to the piece's end and then by
    the piece. ``heads`` and ``starts`` are the runs' symbols (0 for a piece's end) and first
    ranks, ``steps`` where the step backwards takes a run's first rank. ``marks`` and
    ``places`` sample the text at run ends and pieces' starts, ``breaks`` are the ranks whose
    suffix has not ``LENGTH`` symbols in common with the one before.
    """

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.sizes, self.starts_of = sizes, np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(pieces)
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts_of + sizes] = False
        symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        self.symbols = symbols
        rest = np.repeat(self.starts_of + sizes, sizes + 1) - np.arange(n)
        order, near = self._sorted(symbols, rest)
        before = symbols[order - 1]  # a piece's start has the end of the one before, or the last end
        first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.heads, self.starts = before[first], first
        length = np.diff(np.r_[first, n])
        by = np.argsort(self.heads, kind="stable")
        self.steps = np.empty(len(first), np.int64)
        self.steps[by] = np.cumsum(length[by]) - length[by]
        sampled = before == 0
        sampled[first] = sampled[first + length - 1] = True
        self.marks = np.flatnonzero(sampled)
        self.places = order[self.marks]
        a, b = order[1:], order[:-1]
        far = np.minimum(LENGTH - 28 + np.arange(n), n - 1)
        alike = (rest[a] >= LENGTH) & (rest[b] >= LENGTH) & (near[a] == near[b]) & (near[far[a]] == near[far[b]])
        self.breaks = np.flatnonzero(np.r_[True, ~alike])

    @staticmethod
    def _sorted(symbols: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and for each place a number that 28 symbols (or all up to the end) have in common."""
        n = len(symbols)
        padded = np.r_[symbols, np.zeros(7, np.int64)]
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | np.where(rest > j, padded[j : j + n], 0)
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        near, step = None, 7
        most = int(rest.max(initial=0))
        while True:
            if step == 28:
                near = rank.copy()
            if step >= most and near is not None:
                alike = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
                order[alike] = order[alike][np.argsort(rank[order[alike]] * n + order[alike])]
                return order, near
            # slots of groups of two and more, whose members differ later
            open_ = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
            members = order[open_]
            second = np.where(rest[members] > step, rank[np.minimum(members + step, n - 1)] + 1, 0)
            both = rank[members] * (n + 1) + second
            by = np.argsort(both)
            members, both = members[by], both[by]
            order[open_] = members
            new = np.r_[True, both[1:] != both[:-1]] if len(open_) else np.zeros(0, bool)
            fresh[open_] = new
            rank[members] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            step *= 2

    def back(self, ranks: np.ndarray) -> np.ndarray:
        """The ranks of the suffixes one symbol longer."""
        run = np.searchsorted(self.starts, ranks, "right") - 1
        return self.steps[run] + ranks - self.starts[run]

    def located(self, ranks: np.ndarray) -> np.ndarray:
        """The text places of suffixes: steps back to the next sample."""
        out, at, left, gone = np.full(len(ranks), -1), ranks.copy(), np.arange(len(ranks)), 0
        while len(left):
            near = np.minimum(np.searchsorted(self.marks, at), len(self.marks) - 1)
            hit = self.marks[near] == at
            out[left[hit]] = self.places[near[hit]] + gone
            left, at, gone = left[~hit], self.back(at[~hit]), gone + 1
        return out

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, window, group) of every window: windows that match over ``LENGTH`` bytes have one group.

        All pieces go backwards together, each from the rank of its end.
        """
        by = np.argsort(-self.sizes, kind="stable")
        sizes, ranks, out = self.sizes[by], by.copy(), []
        for length in range(1, int(sizes.max(initial=0)) + 1):
            ranks = self.back(ranks[: np.searchsorted(-sizes, -length, "right")])
            if length >= LENGTH:
                piece = by[: len(ranks)]
                out.append((piece, self.sizes[piece] - length, np.searchsorted(self.breaks, ranks, "right") - 1))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def earlier(pieces: list[bytes], holders: np.ndarray) -> np.ndarray:
    """For each piece the windows, as bits, that a piece with a smaller holder has too."""
    index = RunIndex(pieces)
    piece, window, group = index.matches()
    least = np.full(len(index.breaks), LAST)
    np.minimum.at(least, group, holders[piece])
    found = least[group] < holders[piece]
    piece, window, group = piece[found], window[found], group[found]
    place = index.located(index.breaks[group])
    own = index.starts_of[piece] + window
    for j in range(LENGTH):
        if not np.array_equal(index.symbols[place + j], index.symbols[own + j]):
            raise AssertionError("a located match differs from its window")
    out = np.zeros(len(pieces), np.int64)
    np.bitwise_or.at(out, piece, np.int64(1) << window)
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, from rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)


def _listed(buckets: int):
    """A block's minimizers by bucket, with the number of documents that have each."""

    def work(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        _, _, h, doc = cut(block.data, block.ends)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        h, docs = np.unique(h[new], return_counts=True)
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, h, docs = bucket[order], h[order], docs[order].astype(np.int32)
        at = _runs(bucket)
        pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.table({
            "bucket": pa.array(bucket[at[:-1]]), "block": pa.array([block.number] * len(pairs), pa.int64()),
            "grams": pa.array([h[a:b].tobytes() for a, b in pairs], pa.binary()), "docs": pa.array([docs[a:b].tobytes() for a, b in pairs], pa.binary()),
        })

    return work


def _shared(crowd: int):
    """For each block the minimizers that two documents or more have, and which are crowded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            h = np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in rows])
            docs = np.concatenate([np.frombuffer(r["docs"], np.int32) for r in rows])
            names, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, docs, len(names))[at]
            size = np.cumsum([0] + [len(r["grams"]) // 8 for r in rows])
            out = []
            for r, a, b in zip(rows, size[:-1], size[1:], strict=True):
                keep = total[a:b] > 1
                if keep.any():
                    out.append((r["block"], h[a:b][keep].tobytes(), (total[a:b][keep] > crowd).tobytes()))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "grams", "crowded"])

    return work


def _told(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All minimizers told to a block, and which are crowded."""
    grams, crowded = rows.column("grams").to_pylist(), rows.column("crowded").to_pylist()
    return np.frombuffer(b"".join(g for g in grams if g is not None), np.uint64), np.frombuffer(b"".join(c for c in crowded if c is not None), bool)


def _cut_block(buckets: int):
    """A block's pieces by bucket: minimizer, least doc_id, size and compressed bytes of each."""

    def work(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "block", "grams", "holders", "sizes", "bytes")}
        if rows.num_rows and told.num_rows:
            block = Block(rows)
            bucket, h, names, number, _, _, doc = block.pieces(*_told(told), buckets)
            holders = np.full(len(names), LAST)
            np.minimum.at(holders, number, block.ids[doc])
            sizes = np.array([len(t) for t in names], np.uint8)
            at = _runs(bucket)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for name, value in zip(out, (int(bucket[a]), block.number, h[a:b].tobytes(), holders[a:b].tobytes(), sizes[a:b].tobytes(), zstandard.compress(b"".join(names[a:b]), 1)), strict=True):
                    out[name].append(value)
        kinds = dict(zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return work


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the first holder of each of its pieces, and the windows shared with an earlier document."""
    for rows in _by_bucket(batches):
        number: dict[bytes, int] = {}
        grams: list[np.ndarray] = []
        own = []
        for r in rows:
            ends, raw = np.cumsum(np.frombuffer(r["sizes"], np.uint8), dtype=np.int64).tolist(), zstandard.decompress(r["bytes"])
            before = len(number)
            places = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
            grams.append(np.frombuffer(r["grams"], np.uint64)[places >= before])
            own.append(places)
        holders = np.full(len(number), LAST)
        for r, places in zip(rows, own, strict=True):
            np.minimum.at(holders, places, np.frombuffer(r["holders"], np.int64))
        names, h, masks = list(number), np.concatenate(grams), np.zeros(len(number), np.int64)
        # a minimizer of one piece has nothing to match
        order = np.argsort(h, kind="stable")
        at = _runs(h[order])
        groups = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1]
        held, size = [], 0
        for i, g in enumerate(groups):
            held.append(g)
            size += len(g) * LENGTH
            if size >= INDEX or i == len(groups) - 1:
                part = np.concatenate(held)
                masks[part] = earlier([names[j] for j in part.tolist()], holders[part])
                held, size = [], 0
        yield pa.record_batch(
            [
                pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()),
                pa.array([holders[p].tobytes() for p in own], pa.binary()), pa.array([masks[p].tobytes() for p in own], pa.binary()),
            ],
            ["block", "bucket", "first", "masks"],
        )


def _marked(buckets: int, kind: pa.Schema):
    """The documents of a block without the bytes of marked windows."""

    def work(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kind.empty_table()
        block = Block(rows)
        cover = np.zeros(len(block.data) + 1, np.int64)
        answers = sorted((r for r in told.select(["bucket", "first", "masks"]).to_pylist() if r["first"] is not None), key=lambda r: r["bucket"])
        if answers:
            _, _, _, number, start, count, doc = block.pieces(*_told(told), buckets)
            first = np.concatenate([np.frombuffer(r["first"], np.int64) for r in answers])[number]
            masks = np.concatenate([np.frombuffer(r["masks"], np.int64) for r in answers])[number]
            late = block.named[doc] & (block.ids[doc] > first)
            np.add.at(cover, start[late], 1)
            np.add.at(cover, start[late] + count[late] + LENGTH - 1, -1)
            some = block.named[doc] & (block.ids[doc] == first) & (masks != 0)
            start, masks = start[some], masks[some]
            for j in range(WIDE):
                at = start[masks >> j & 1 == 1] + j
                np.add.at(cover, at, 1)
                np.add.at(cover, at + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(block.ends[:-1].tolist(), block.ends[1:].tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[0, gone[a:b].astype(np.int8), 0]))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            kept.append(block.data[a:b][~gone[a:b]].tobytes() if len(edge) else block.raw[a:b])
        ids = pa.array(block.ids, mask=~block.named)
        return pa.table([ids, pa.array(np.diff(block.ends)), pa.array(spans, kind.field("spans").type), pa.array(kept, pa.binary())], schema=kind)

    return work


def remove_repeats(docs: DataFrame, crowd: int = CROWD, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for (doc_id, text): removed byte spans, end exclusive, and the remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-total // block_bytes) or 1, max(-(-total // BUCKET), BUCKETS)
    texts = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")
    listed = texts.groupBy("block").applyInArrow(_listed(buckets), "bucket long, block long, grams binary, docs binary")
    shared = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(crowd), "block long, grams binary, crowded binary")
    pieces = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_cut_block(buckets), "bucket long, block long, grams binary, holders binary, sizes binary, bytes binary")
    answers = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered, "block long, bucket long, first binary, masks binary")
    told = shared.unionByName(answers, allowMissingColumns=True)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_marked(buckets, kind), "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(i)
), f AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s
), g AS (
  SELECT r, i, coalesce(CAST(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50 AS INTEGER), 1) AS fresh FROM w JOIN f USING (s) WHERE least < doc_id
), n AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM g
), p AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, span
), e AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p
  UNION ALL
  SELECT r, length(h) // 2, length(h) // 2, coalesce((SELECT max(b) FROM p WHERE p.r = d.r), 0) FROM d
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) - 1 AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b DESC))) AS kept_sha256
FROM d JOIN e USING (r) GROUP BY r, doc_id, h
"""
