"""Byte-pair encoding and decoding, equal to the tokenizers library's byte-level BPE.

A text is cut at added tokens, then into pieces by the byte-level pattern. A piece's
symbols form a doubly linked list; a heap holds the merges that are possible between
neighbours by (rank, place); popped entries whose symbols have changed since are stale and
skipped. Decoding concatenates the vocabulary's byte strings.

Defined results: a null text is empty and has no tokens; texts of any length are taken
whole, in slices of about ``SLICE_CHARS`` characters or one text; merges of equal rank go
from left to right; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLICE_CHARS = 32_000_000
#: Fixed value: the byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what \s means to the library's pattern engine.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries in a generation of what a worker remembers; two generations are kept.
REMEMBERED = 350_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Unsafe(Exception):
    """A text whose words can't be cut at single spaces."""


class Remembered(dict):
    """Packed ids by text, made when missing. A full generation becomes the old one; what is found there moves on to the new one."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) >= 100:
                return ids
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()
        self[text] = ids
        return ids


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(merges):
            ranks[vocab[a]][vocab[b]] = rank
        self.rank_of = [after.get for after in ranks]
        self.made = [vocab[a + b] for a, b in merges]
        self.single = [vocab[letters[b]] for b in range(256)]
        self.first = [ranks[a].get(b, -1) for a in self.single for b in self.single]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(back[c] for c in word) for word, i in vocab.items()} | {i: word.encode() for word, i in self.added.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.large_binary())
        self.cut = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PATTERN.replace(r"\S", f"[^{BLANK}]").replace(r"[^\s", f"[^{BLANK}").replace(r"\s", f"[{BLANK}]")).findall
        self.blank = frozenset(regex.findall(f"[{BLANK}]", "".join(map(chr, range(0x3001)))))
        self.known = Remembered(lambda piece: self.pack(piece.encode()))
        self.words = Remembered(self.word)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: a heap of merges by (rank, place) over a doubly linked list of symbols."""
        single, first, rank_of, made, pop, push = self.single, self.first, self.rank_of, self.made, heapq.heappop, heapq.heappush
        ids = [single[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        # the rank of the merge of each symbol with its right neighbour, for telling stale entries
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        now.append(-1)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [rank << bits | k for k, rank in enumerate(now) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            k, rank = top & mask, top >> bits
            if now[k] != rank:
                continue  # stale: one of its symbols has been merged since
            j = after[k]
            new = ids[k] = made[rank]
            ids[j] = now[j] = -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                rank = now[k] = rank_of[new](ids[j], -1)
                if rank >= 0:
                    push(heap, rank << bits | k)
            else:
                now[k] = -1
            i = before[k]
            if i >= 0:
                rank = now[i] = rank_of[ids[i]](new, -1)
                if rank >= 0:
                    push(heap, rank << bits | i)
        return [i for i in ids if i >= 0]

    def pack(self, piece: bytes) -> bytes:
        return array("i", self.merge(piece)).tobytes()

    def word(self, word: str) -> bytes:
        """Packed ids of " " + word. The first piece holds the space and is a word by itself."""
        if word.isascii() and word.isalpha():
            return self.pack(b" " + word.encode())
        if not word or word[0] in self.blank or word[-1] in self.blank:
            raise Unsafe
        first, *rest = self.find(" " + word)
        if not rest:
            return self.pack(first.encode())
        return self.words[first[1:]] + b"".join(map(self.known.__getitem__, rest))

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without added tokens. Single spaces between other characters always start a piece."""
        words = text.split(" ")
        first = words.pop(0)
        try:
            if words and (not first or first[-1] in self.blank):
                raise Unsafe
            return self.pieces(first) + b"".join(map(self.words.__getitem__, words))
        except Unsafe:
            return self.pieces(text)

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit whole numbers end to end."""
        if self.cut is None or not any(w in text for w in self.added):
            return self.plain(text)
        return b"".join([array("i", [self.added[part]]).tobytes() if k % 2 else self.plain(part) for k, part in enumerate(self.cut.split(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The vocabulary strings of ``ids`` end to end, cut after the tokens at ``ends``."""
        strings = self.strings.take(pa.array(ids))
        at, data = np.frombuffer(strings.buffers()[1], np.int64, len(ids) + 1), strings.buffers()[2]
        data = memoryview(data) if data else memoryview(b"")
        cuts = at[np.concatenate([[0], ends])]
        return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int32), np.array([len(ids)]))[0].decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = rows.select(id_col).schema[0].dataType.simpleString()
    return rows.select(id_col, "ids").mapInArrow(work, f"`{id_col}` {kind}, text string")


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) of a batch, 256 at a time and about ``SLICE_CHARS`` characters."""
    size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
    first, n = 0, 0
    for k, x in enumerate(size):
        if k > first and (k - first == 256 or n + x > SLICE_CHARS):
            yield b.slice(first, k - first)
            first, n = k, 0
        n += x
    if len(size) > first:
        yield b.slice(first)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode: digests of both, without moving ids between processes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for part in slices(b):
                packed = [bpe.packed(t or "") for t in part.column(1).to_pylist()]
                counts = np.array([len(x) for x in packed], np.int64) // 4
                ends = np.cumsum(counts)
                ids = np.frombuffer(b"".join(packed), np.int32)
                texts = bpe.decode_all(ids, ends)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids).cast(pa.large_string())), pa.scalar(",", pa.large_string()))
                ids_sha = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in joined]
                text_sha = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in texts]
                yield pa.record_batch([part.column(0), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
