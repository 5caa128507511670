"""Best-fit packing by minimum bin slack.

Texts become token ids with a trailing 0. Only texts of more than ``capacity`` tokens are
cut, into pieces of ``capacity``; a full piece is a sequence by itself. For the rest only
the histogram of lengths matters, which has fewer than ``capacity`` entries whatever the
corpus. The driver plans on it: the longest length left opens a bin, a bitset
subset-sum program over the lengths left finds the fullest combination beside it, and the
combination is taken as often as the counts allow; so each step uses up a length.
Pieces then find their place from their rank among those of their length. Ranks come from
salted partial counts, so a length that a third of all pieces share is no hot task.

Defined results: a null or empty text is the single id 0; repeated rows are packed as
rows of their own (told apart by an arbitrary number among equals); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stored, table

CAPACITY = 2048
SALTS = 64
#: Words whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 500_000
#: Signs that end a word as a piece of their own.
SIGNS = frozenset(".,;:!?")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: white space beyond the six ASCII kinds, as str.split sees it.
_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_SPACES = regex.compile(r"[\x20\x09-\x0D]+")


class WordIds(dict):
    """Token ids of each word, as little-endian bytes. The tokenizer drops white space, so words are independent.

    A new word of Latin letters and signs is cut by the tokenizer's own pattern, and its model is asked
    for each piece that was not seen before; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize = self.tokenizer.model.tokenize
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.odd = regex.compile(r"[^\x21-\x7e\xa1-\xac\xae-\xff]").search
        self.mark = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        core = word[:-1] if word[-1:] in SIGNS else word
        if core.isalpha() and (core.isascii() or not self.odd(core)):
            low = core.lower()
            ids = self.pieces.get(low) or self.piece(low)
            if core is not word:
                ids += self.pieces.get(word[-1]) or self.piece(word[-1])
        elif self.odd(word) or self.mark in word:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b"".join([self.pieces.get(x) or self.piece(x) for x in self.find(word.lower())])
        if len(word) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(raw)]
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 100:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = data
        return data

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _SPACES.split(text) if _ODD(text) else text.split()))


_LOADED: dict[str, WordIds] = {}


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        words = _LOADED[path]
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = words.text(text.as_py() or "") + b"\0\0\0\0"
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    out.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of ``counts`` (length to number) with the largest sum up to ``room``: (length, times).

    Bit s of the set says that sum s can be made; a length of c items enters as 1, 2, 4 .. and the
    rest times itself. The sets before each entry are kept for the way back.
    """
    limit, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= reach << (length * times) & limit
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, dict[int, int]()
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + times
            total -= length * times
    return list(out.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times in each)]) that use up the histogram."""
    counts, out = dict(histogram), []
    while counts:
        first = max(counts)
        counts[first] -= 1
        rest = {k: n for k, n in counts.items() if n}
        bin_ = dict(fullest(rest, capacity - first)) if capacity > first else {}
        counts[first] += 1
        bin_[first] = bin_.get(first, 0) + 1
        bins = min(counts[length] // times for length, times in bin_.items())
        out.append((bins, sorted(bin_.items(), reverse=True)))
        for length, times in bin_.items():
            counts[length] -= bins * times
            if not counts[length]:
                del counts[length]
    return out


def segments(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple]:
    """(length, first rank, times, first sequence, offset) of each length in each kind of bin."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, parts in bins:
        offset = 0
        for length, times in parts:
            out.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to each piece (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    ranked = pieces.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    ranked = stored(ranked, "pieces")
    # at most capacity * SALTS rows, whatever the input
    counts = {(r.length, r.salt): r.n for r in ranked.groupBy("length", "salt").agg(F.max("nth").alias("n")).collect()}
    before, histogram = {}, {}
    for (length, s), n in sorted(counts.items()):
        before[length, s] = histogram.get(length, 0)
        histogram[length] = before[length, s] + n
    parts: dict[int, list[tuple]] = {}
    for length, *rest in segments(plan(histogram, capacity)):
        parts.setdefault(length, []).append(tuple(rest))
    tables = {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in parts.items()}
    shared = spark.sparkContext.broadcast((before, tables))  # bounded like the histogram
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tables = shared.value
        for b in batches:
            length, s, nth = (b.column(k).to_numpy() for k in (3, 5, 6))
            rank = nth - 1 + np.array([before[x] for x in zip(length.tolist(), s.tolist(), strict=True)], np.int64)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, times, base, off = tables[n]
                k = np.searchsorted(first, rank[at], "right") - 1
                j = rank[at] - first[k]
                sequence[at], offset[at] = base[k] + j // times[k], off[k] + j % times[k] * n
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], names)

    return ranked.select(*names[:5], "salt", "nth").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
