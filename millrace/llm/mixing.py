r"""Language-model scoring by online logistic context mixing.

A text is its tokens (ASCII letters lower-cased), each followed by a space, and a line end.
Each byte is a path in a fixed binary tree. For each bit, contexts give predictions from
counts of zeros and ones: the last 1, 2 and 3 bytes of the token, and up to 6 bytes of the
token or, for its first two bytes, the end of the token before. A logistic mixer adds
them with weights chosen by a gate (place in the token, depth in the tree, whether the
longest context was seen), a last stage refines the sum by a table of gate and sum, and the
weights are refined adaptively: each document has its own correction, updated after every
``STEP`` tokens by the gradient of what they cost, never ahead of them. So the bits'
probabilities multiply to the text's.

Learning. Blocks of documents, kept as token numbers, send their distinct pairs of context and byte with their counts
to the contexts' partitions, which add up the bits of all training documents and send back
the predictions for each pair, so the model grows with the input and is never in one place.
Contexts are known in full, so a count belongs to its context alone.
Counts are additive and a context lies in the token (or is the pair of an ending and a
beginning), so a block works on its distinct tokens, and repetitions only gather. One training
document in ``TUNE`` by hash is in blocks of its own, which also get the predictions
without these documents, to fit the mixer's weights and the last stage on unseen text by
averaged online descent.

The unigram base score needs exact token counts. Blocks of documents send their distinct
tokens' counts to the tokens' partitions and get the totals back, so no vocabulary is ever
in one place; tokens are known by 64-bit hashes, sums over their bytes and places.

Defined results: a null text is empty and has the one token that ends it; without training
tokens the base is 0 / 0 and base_score is null; rows without an id are training rows;
repeated rows are scored one by one; texts of any length are scored whole, a block is a text
at least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, stored_by, table
from .neardup import _runs, mixed

#: Predictions for a bit: the last 1, 2 and 3 bytes of the token, and the long context, up to LONG bytes or the token before.
K = 4
#: Kinds of pairs: contexts of 1, 2 and 3 bytes, of up to LONG bytes, the ending before.
SHORT, FAR, BEFORE = (0, 1, 2), 3, 4
#: Contexts whose bits are added at a time.
CONTEXTS = 256
#: Blocks for each partition of pairs and of tokens.
SHARE = 4
STEP = 16
TUNE = 16
BLOCK_CHARS = 5_000_000
#: A prediction is a log odds in this fraction.
UNIT = 16
PLACES, STAGES, LONG = 4, 3, 6
GATES = 2 * PLACES * STAGES
#: The mixer's sum is held within this; the last stage has so many cells of it for each gate.
MOST, CELLS = 10.0, 17
#: Texts that are scored together, and bytes whose bits are laid out together: the arrays in between stay small.
LANES, LAID = 128, 1 << 14
#: Fixed value: letters of European text by frequency.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
END = b"\n"
RAW = "part int, block int, fold int, a binary, b binary, ids array<bigint>, held array<boolean>, sizes array<int>, kind int"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _tree() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each byte's path, and the paths' nodes, bits and depths. Any byte has a path."""
    weight = [0.02 if b < 128 else 0.05 for b in range(256)]
    weight[32], weight[10] = 17.0, 0.3
    for k, c in enumerate(LETTERS):
        weight[ord(c)] = 12.0 * 0.86**k
    for c in ".,":
        weight[ord(c)] = 1.0
    for c in "0123456789-'\"!?;:()|":
        weight[ord(c)] = 0.2
    for b in (0xC2, 0xC3, 0xE2):
        weight[b] = 0.6
    heap: list = [(w, b, b) for b, w in enumerate(weight)]
    heapq.heapify(heap)
    n = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (n - 256, a[2], b[2])))
        n += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if isinstance(node, int):
            paths[node] = path
        else:
            todo += [(node[1], [*path, (node[0], 0)]), (node[2], [*path, (node[0], 1)])]
    flat = [x for b in range(256) for x in paths[b]]
    size = np.array([len(paths[b]) for b in range(256)])
    depth = np.concatenate([np.arange(len(paths[b])) for b in range(256)])
    return np.cumsum(size) - size, size, np.array([x for x, _ in flat], np.uint32), np.array([x for _, x in flat], np.int8), depth


START, SIZE, NODE, BIT, DEPTH = _tree()
#: Stage of the gate and direction of each node on the paths.
STAGE, SIGN = np.minimum((DEPTH + 1) // 2, STAGES - 1).astype(np.int8), (2 * BIT - 1).astype(np.int8)
#: A bit as the scoring wants it, turned so that its own side is up: fixed part of the sum, short and long predictions in 1 / UNIT, gate (with GATES added for a zero).
TURNED = np.dtype([("z", np.float32), ("x", np.int16), ("y", np.int8), ("gate", np.uint8)])


@cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a process, not for each text."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    return _codec()[0].compress(data)


def opened(data: bytes) -> bytes:
    return _codec()[1].decompress(data)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the upper bytes of ascending or of small ones repeat."""
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each of the ranges."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct number, ascending by number, and which of them each number is.

    Numbers that leave room for their place in 64 bits are sorted with it: plain sorting is quicker than sorting places.
    """
    shift = np.uint64(len(x).bit_length())
    if int(x.max(initial=0)).bit_length() + int(shift) > 64:
        return np.unique(x, return_index=True, return_inverse=True)[1:]
    both = x.astype(np.uint64)
    both <<= shift
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    at = (both & ((np.uint64(1) << shift) - np.uint64(1))).view(np.int64)
    both >>= shift
    new = np.ones(len(x), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    number = np.cumsum(new, dtype=np.int32 if len(x) < 2**31 else np.int64)
    number -= 1
    inverse = np.empty_like(number)
    inverse[at] = number
    return at[new], inverse


class Block:
    """The distinct tokens of some texts, where each text has them, and their pairs of context and byte.

    A pair is its kind (8 bits), the context (48 bits) and the byte (8 bits); ``pairs`` is ascending.
    """

    def __init__(self, data: np.ndarray, length: np.ndarray, seq: np.ndarray, sizes: np.ndarray):
        """``data``: the end, then the tokens, each with a space; ``length`` of each; ``seq``: the texts' tokens by number."""
        self.seq, self.sizes = seq, sizes.astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([np.zeros(1, np.int32), self.seq[:-1]])[: len(self.seq)]
        before[first] = 0
        b, n = self.bytes, self.length = data, length
        start = self.start = np.cumsum(n) - n
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        place = self.place = np.arange(len(b), dtype=np.int32) - np.repeat(start.astype(np.int32), n)
        w = b.astype(np.uint64)
        # the byte so many places before in the token, or 0
        back = [b]
        for _ in range(LONG):
            older = np.empty_like(b)
            older[1:] = back[-1][:-1]
            older[start] = 0
            back.append(older)
        own, self.at = [], []
        # three bytes before each byte, and from these pairs the shorter ones
        four = np.stack(back[:4], 1).view("<u4").ravel()
        first, inverse = distinct(four)
        u, rank, ranks = four[first], inverse, len(first)
        for k in (2, 1, 0):
            own.append(u.astype(np.uint64) | np.uint64(k << 56))
            self.at.append(inverse.astype(np.int32, copy=False))
            u, shorter = np.unique(u & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            inverse = shorter.astype(np.int32)[inverse]
        own, self.at = own[::-1], self.at[::-1]
        # up to LONG bytes before each byte
        late = np.flatnonzero(place >= 3)
        far = np.zeros((len(late), 8), np.uint8)
        for j in range(LONG + 1):
            far[:, j] = back[j][late]
        far = far.view("<u8").ravel()
        # what is further back, then the number of the last bytes, which has their order
        first, inverse = distinct(far >> np.uint64(32) << np.uint64(ranks.bit_length()) | rank[late].astype(np.uint64))
        own.append(np.uint64(FAR << 56) | far[first])
        at = np.full(len(b), -1, np.int32)
        at[late] = inverse
        self.at.append(at)
        # endings and beginnings: numbers of both, and the pairs of each combination
        last = np.maximum(start + n - 2, 0)
        ending = back[2][last].astype(np.uint64) << np.uint64(16) | back[1][last].astype(np.uint64) << np.uint64(8) | w[last]
        ending[0] = 0
        second = np.where(n > 1, w[np.minimum(start + 1, len(b) - 1)], np.uint64(256))
        ends, of_end = np.unique(ending, return_inverse=True)
        heads, of_head = np.unique(w[start] << np.uint64(16) | second, return_inverse=True)
        combo = of_end[before] * len(heads) + of_head[self.seq]
        one_of, self.combo = distinct(combo)
        combo = combo[one_of]
        e = ends[combo // len(heads)]
        h = heads[combo % len(heads)]
        one = np.uint64(BEFORE << 56) | e << np.uint64(8) | h >> np.uint64(16)
        two = np.uint64(BEFORE << 56 | 1 << 40) | (h >> np.uint64(16)) << np.uint64(32) | e << np.uint64(8) | (h & np.uint64(255))
        both = (h & np.uint64(511)) < 256
        u, inverse = np.unique(np.concatenate([one, two[both]]), return_inverse=True)
        own.append(u)
        # a token with each beginning, for what the first bytes are
        of_combo = np.zeros(len(heads), np.int64)
        of_combo[of_head] = np.arange(len(n))
        self.sample = of_combo[combo % len(heads)]
        self.first, self.second = inverse[: len(one)], np.full(len(one), -1)
        self.second[both] = inverse[len(one) :]
        self.base = np.cumsum([0, *map(len, own)])
        self.pairs = np.concatenate(own)

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        return cls.of_encoded([(t or "").encode("utf-8", "replace") for t in texts])

    @classmethod
    def of_encoded(cls, texts: list[bytes]) -> Block:
        """The tokens as :func:`tokens_of` has them."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        words, code, offset = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()
        # white space at the edges of a text gives empty words
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        kept = full[code]
        sizes = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[offset]) + 1
        code = code[kept]
        # the end stays first, the others by frequency, so that most numbers are small
        order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
        order = order[full[order]]
        number = np.zeros(len(words), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        end = np.zeros(len(code) + len(sizes), bool)
        end[np.cumsum(sizes) - 1] = True
        seq = np.zeros(len(end), np.int32)
        seq[~end] = number[code]
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(order)], words.take(pa.array(order))), pa.scalar(" ", words.type))
        data = END + (joined[0].as_buffer().to_pybytes() + b" ") * (len(order) > 0)
        return cls(*cls._tokens(data), seq, sizes)

    @staticmethod
    def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the end and the tokens, and the length of each."""
        b = np.frombuffer(data, np.uint8)
        return b, np.diff(np.concatenate([[-1, 0], np.flatnonzero(b == 32)]))

    def packed(self) -> tuple[bytes, bytes]:
        return squeezed(self.bytes.tobytes()), planes(self.seq)

    @classmethod
    def unpacked(cls, tokens: bytes, seq: bytes, sizes: list[int]) -> Block:
        return cls(*cls._tokens(opened(tokens)), from_planes(seq, np.int32), np.array(sizes))

    def counts(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair, and each token, is in the texts that are ``learned`` from."""
        occurs = np.repeat(learned, self.sizes)
        tokens = np.bincount(self.seq[occurs], minlength=len(self.length))
        at_byte = tokens[self.owner]
        out = [np.bincount(self.at[k], at_byte, self.base[k + 1] - self.base[k]) for k in SHORT]
        late = self.at[FAR] >= 0
        out.append(np.bincount(self.at[FAR][late], at_byte[late], self.base[4] - self.base[3]))
        combos = np.bincount(self.combo[occurs], minlength=len(self.first))
        n = self.base[5] - self.base[4]
        both = self.second >= 0
        out.append(np.bincount(self.first, combos, n) + np.bincount(self.second[both], combos[both], n))
        return np.concatenate(out).astype(np.int64), tokens

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' distinct hashes, ascending, and each token's number among them."""
        v = self.place.astype(np.int64) << 8 | self.bytes
        terms = TERMS.take(np.minimum(v, len(TERMS) - 1))
        late = np.flatnonzero(v >= len(TERMS))
        terms[late] = _term(v[late].astype(np.uint64))
        return np.unique(np.add.reduceat(terms, self.start), return_inverse=True)


def _term(v: np.ndarray) -> np.ndarray:
    """What a byte at its place adds to its token's hash; mixed once, the sums meet more often than by chance."""
    return mixed(mixed(v + np.uint64(1)))


#: The terms of the first 64 places.
TERMS = _term(np.arange(64 << 8, dtype=np.uint64))


def shard_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each pair's context."""
    out = np.empty(len(pairs), np.int32)
    for a in range(0, len(pairs), 1 << 18):
        out[a : a + (1 << 18)] = (mixed(pairs[a : a + (1 << 18)] >> np.uint64(8)) >> np.uint64(33)) % np.uint64(parts)
    return out


def packed_counts(n: np.ndarray) -> bytes:
    return planes(n.astype(np.int64))


def unpacked_counts(data: bytes) -> np.ndarray:
    return from_planes(data, np.int64)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition with the numbers of its members, ascending."""
    order = np.argsort(part.astype(np.uint16) if int(part.max(initial=0)) < 1 << 16 else part, kind="stable")
    names, at = np.unique(part[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, at[1:]), strict=True)


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts to the log odds of a one in 1 / UNIT; 0 where nothing was seen."""
    return np.clip(np.rint(np.log((ones + 0.3) / (zeros + 0.3)) * UNIT), -127, 127).astype(np.int8)


def coded(values: np.ndarray, first: np.ndarray, size: np.ndarray, alone: np.ndarray) -> bytes:
    """The predictions of some pairs: for those alone with their context one number, for the others one for each bit."""
    rest = ~alone
    return squeezed(np.packbits(alone).tobytes() + np.abs(values[first[alone]]).tobytes() + values[_spread(first[rest], size[rest])].tobytes())


def decoded(data: bytes, pairs: np.ndarray) -> np.ndarray:
    """The predictions along the paths of ``pairs`` as :func:`coded` wrote them."""
    raw = np.frombuffer(opened(data), np.int8)
    flags = -(-len(pairs) // 8)
    alone = np.unpackbits(raw[:flags].view(np.uint8))[: len(pairs)].astype(bool)
    sym = (pairs & np.uint64(255)).astype(np.intp)
    size = SIZE[sym]
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int8)
    n = int(alone.sum())
    sign = 2 * BIT[_spread(START[sym[alone]], size[alone])] - 1
    out[_spread(first[alone], size[alone])] = sign * np.repeat(raw[flags : flags + n], size[alone])
    out[_spread(first[~alone], size[~alone])] = raw[flags + n :]
    return out


def predicted(pairs: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Path lengths of the ascending pairs, whether each is alone with its context, and for each of ``counts`` the stretched predictions along their paths."""
    sym = (pairs & np.uint64(255)).astype(np.intp)
    context = pairs >> np.uint64(8)
    new = np.concatenate([np.ones(min(len(pairs), 1), bool), context[1:] != context[:-1]])
    size = SIZE[sym]
    first = np.cumsum(size) - size
    # a pair that is alone with its context has its own bits only
    alone = new & np.concatenate([new[1:], np.ones(min(len(pairs), 1), bool)])
    single, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
    at = _spread(first[single], size[single])
    sign = 2 * BIT[_spread(START[sym[single]], size[single])] - 1
    out = [np.empty(int(size.sum()), np.int8) for _ in counts]
    for v, n in zip(out, counts, strict=True):
        v[at] = sign * np.repeat(stretched(np.zeros(1), n[single]), size[single])
    number = np.cumsum(new[rest])
    cuts = [*np.flatnonzero(new[rest])[::CONTEXTS].tolist(), len(rest)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = rest[lo:hi]
        path = _spread(START[sym[own]], size[own])
        rep = np.repeat(np.arange(lo, hi), size[own])
        node = (number[rep] - number[lo]) * 256 + NODE[path]
        at = _spread(first[own], size[own])
        for v, n in zip(out, counts, strict=True):
            sums = np.bincount(2 * node + BIT[path], n[rest[rep]], 512 * CONTEXTS)
            v[at] = stretched(sums[2 * node], sums[2 * node + 1])
    return size, alone, out


class Inputs:
    """What the mixer needs for the bits of a block, from what its pairs' partitions sent.

    An occurrence of a token is a run of bits of its combination of ending and beginning (the
    first two bytes), and a run of its later bytes. Both are laid out once for all occurrences.
    """

    def __init__(self, block: Block, parts: int, sent: dict[int, bytes]):
        shards = list(by_part(shard_of(block.pairs, parts)))
        values = np.concatenate([decoded(sent[p], block.pairs[own]) for p, own in shards])
        order = np.concatenate([own for _, own in shards])
        size = SIZE[(block.pairs[order] & np.uint64(255)).astype(np.intp)]
        # a context that is not there has zeros behind the values
        first = np.empty(len(order) + 1, np.intp)
        first[order] = np.cumsum(size) - size
        first[-1] = len(values)
        values = np.concatenate([values, np.zeros(256, np.int8)])
        late = np.flatnonzero(block.place >= 2)
        # the first bytes of the combinations, then the later bytes of the tokens
        there = block.second >= 0
        held = np.stack([np.ones(len(there), bool), there], 1)
        early = (block.start[block.sample][:, None] + np.arange(2))[held]
        at = np.concatenate([early, late])
        sym = block.bytes[at]
        size, gate = SIZE[sym], (np.minimum(block.place[at], PLACES - 1) * STAGES).astype(np.int8)
        long = np.concatenate([block.base[BEFORE] + np.stack([block.first, block.second], 1)[held], np.where(block.at[FAR][late] >= 0, block.base[FAR] + block.at[FAR][late], -1)])
        source = [START.astype(np.intp)[sym], *(first[block.base[k] + block.at[k][at]] for k in SHORT), first[long]]
        cuts = np.concatenate([[0], np.cumsum(size)])
        self.x = [np.empty(cuts[-1], np.int8) for _ in range(K)]
        self.gate, self.sign = np.empty(cuts[-1], np.int8), np.empty(cuts[-1], np.int8)
        for a in range(0, len(sym), LAID):
            own = slice(a, a + LAID)
            bits = slice(cuts[a], cuts[min(a + LAID, len(sym))])
            n = size[own]
            within = np.arange(n.sum())
            skip = np.cumsum(n) - n
            path, *places = (np.repeat(v[own] - skip, n) + within for v in source)
            for x, v in zip(self.x, places, strict=True):
                x[bits] = values.take(v)
            self.sign[bits] = SIGN.take(path)
            self.gate[bits] = np.repeat(gate[own], n) + STAGE.take(path) + (self.x[3][bits] != 0) * np.int8(PLACES * STAGES)
        bits = np.cumsum(size)
        count = np.concatenate([1 + there.astype(np.int64), np.bincount(block.owner[late], minlength=len(block.length))])
        last = np.cumsum(count)
        self.size = np.concatenate([np.zeros(1, np.int64), bits])[last] - np.concatenate([np.zeros(1, np.int64), bits])[last - count]
        self.start = np.cumsum(self.size) - self.size


class Mixer:
    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, K), 0.3, np.float32) if weights is None else weights.reshape(GATES, K).astype(np.float32)
        self.refine = np.zeros(GATES * CELLS, np.float32) if refine is None else refine.astype(np.float32)
        self.moved: list[np.ndarray] | None = None

    def learn(self, cell: np.ndarray, gate: np.ndarray, miss: np.ndarray, x: list[np.ndarray], rate: float = 0.04) -> None:
        """A step along the gradient, each number's as long as its own steps so far allow (they add up squared)."""
        if self.moved is None:
            self.moved = [np.full_like(v, 1e-6, np.float64) for v in (self.weights, self.refine)]
        step = np.stack([np.bincount(gate, miss * v, GATES) for v in x], 1), np.bincount(cell, miss, GATES * CELLS)
        for v, g, moved in zip((self.weights, self.refine), step, self.moved, strict=True):
            moved += g * g
            v += rate * g / np.sqrt(moved)

    def turned(self) -> np.ndarray:
        """The last stage for ones, then for zeros, where sum and correction change sides."""
        cells = self.refine.reshape(GATES, CELLS)
        return np.concatenate([cells, -cells[:, ::-1]]).ravel()

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.refine])

    @classmethod
    def of(cls, flat: np.ndarray) -> Mixer:
        return cls(flat[: GATES * K], flat[GATES * K :])


def score(block: Block, given: Inputs, mixer: Mixer, learn: bool = False, own_rate: float = 0.02) -> tuple[np.ndarray, int]:
    """ln of each text's probability, and the number of bits. ``learn``: also move the mixer in place.

    ``LANES`` texts go on together, ``STEP`` tokens at a time; all of them where the mixer moves.
    A document's correction has two parts, for the three short contexts and for the long one.
    """
    unit, scaled = np.float32(1 / UNIT), np.float32(CELLS // 2 / MOST)
    bits = np.empty(len(given.gate), TURNED)
    weights = mixer.weights.T.copy()
    for a in range(0, len(bits), LAID):
        own = slice(a, a + LAID)
        gate, sign, x = given.gate[own].astype(np.intp), given.sign[own], [v[own] for v in given.x]
        z = weights[0].take(gate) * x[0]
        for k in range(1, K):
            z += weights[k].take(gate) * x[k]
        z *= unit
        bits["z"][own] = z * sign
        bits["x"][own] = (x[0].astype(np.int16) + x[1] + x[2]) * sign
        bits["y"][own] = x[3] * sign
        bits["gate"][own] = gate + GATES * (sign < 0)
    flat, refine = bits.view(np.int64), mixer.turned()
    combos = len(block.first)
    order = np.argsort(-block.sizes, kind="stable")
    every_size, every_first = block.sizes[order], (np.cumsum(block.sizes) - block.sizes)[order]
    out, total = np.zeros(len(order)), 0
    lanes = max(len(order), 1) if learn else LANES
    for group, at in ((slice(a, a + lanes), at) for a in range(0, len(order), lanes) for at in range(0, int(every_size[a]), STEP)):
        if at == 0:
            sizes, first, cost_of = every_size[group], every_first[group], out[group]
            delta = np.zeros((2, len(sizes)), np.float32)
        live = int(np.searchsorted(-sizes, -at, "left"))
        n = np.minimum(sizes[:live] - at, STEP)
        occurs = _spread(first[:live] + at, n)
        runs = np.stack([block.combo[occurs], combos + block.seq[occurs]], 1).ravel()
        size = given.size[runs]
        place = _spread(given.start[runs], size)
        lane = np.add.reduceat(size, 2 * (np.cumsum(n) - n))
        start = np.cumsum(lane) - lane
        rows = flat.take(place).view(TURNED)
        x = rows["x"].astype(np.float32), rows["y"].astype(np.float32)
        if learn:
            gate, each, sign = given.gate.take(place), [v.take(place) * unit for v in given.x], given.sign.take(place)
            z = sum(mixer.weights[:, k].take(gate) * each[k] for k in range(K)) * sign
            refine = mixer.turned()
        else:
            z = rows["z"].copy()
        if at:
            for j in (0, 1):
                change = np.repeat(delta[j, :live] * unit, lane)
                change *= x[j]
                z += change
        np.clip(z, -MOST, MOST, out=z)
        cell = np.multiply(rows["gate"], CELLS, dtype=np.intp)
        near = z * scaled
        np.rint(near, out=near)
        cell += near.astype(np.int8)
        cell += CELLS // 2
        z += refine.take(cell)
        # of the bit as it is, ln(1 + exp(-z))
        np.negative(z, out=z)
        odds = np.exp(z, out=z)
        odds += 1
        cost_of[:live] -= np.add.reduceat(np.log(odds), start)
        total += len(place)
        miss = np.subtract(1, np.reciprocal(odds, out=odds), out=odds)
        scale = own_rate / np.sqrt(lane).astype(np.float32)
        for j in (0, 1):
            x[j][:] *= miss
            delta[j, :live] += scale * (np.add.reduceat(x[j], start) * unit)
        if learn:
            mixer.learn(gate.astype(np.intp) * CELLS + CELLS // 2 + (near * sign).astype(np.int8), gate, miss * sign, each)
    back = np.empty(len(order))
    back[order] = out
    return back, total


def _row(kind: int, part: int, block: int, fold: int, a: bytes, b: bytes, ids: list | None = None, held: list | None = None, sizes: list | None = None) -> pa.RecordBatch:
    values = {"part": part, "block": block, "fold": fold, "a": a, "b": b, "ids": ids, "held": held, "sizes": sizes, "kind": kind}
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32()]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values.values(), kinds, strict=True)], list(values))


def _small(rows: DataFrame) -> DataFrame:
    """The rows with the text compressed, for the shuffle to the blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [squeezed((t or "").encode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.binary()), *part.columns[2:]], part.schema.names)

    return rows.mapInArrow(work, "doc_id long, text binary, held boolean, fold int, block int")


def _gather(rows: DataFrame, parts: int) -> DataFrame:
    """For each block of (doc_id, text, held, fold, block): kind 0 pairs with counts, kind 1 tokens with counts, kind 2 the texts as tokens."""

    def done(number: int, fold: int, texts: list[bytes], ids: list, held: list) -> Iterator[pa.RecordBatch]:
        block = Block.of_encoded(texts)
        pairs, tokens = block.counts(np.array([not h for h in held]))
        for p, own in by_part(shard_of(block.pairs, parts)):
            yield _row(0, p, number, fold, planes(block.pairs[own]), packed_counts(pairs[own]))
        h, at = block.hashes()
        n = np.bincount(at, tokens, len(h)).astype(np.int64)
        for p, own in by_part((h >> np.uint64(40)) % np.uint64(parts)):
            yield _row(1, p, number, fold, planes(h[own]), packed_counts(n[own]))
        yield _row(2, 0, number, fold, *block.packed(), ids, held, block.sizes.tolist())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold, texts, ids, held = None, 0, [], [], []
        for b in batches:
            where = b.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if last is not None and where[a] != last:
                    yield from done(last, fold, texts, ids, held)
                    texts, ids, held = [], [], []
                part = b.slice(a, z - a)
                last, fold = int(where[a]), part.column(3)[0].as_py()
                texts += [opened(x) for x in part.column(1).to_pylist()]
                ids += part.column(0).to_pylist()
                held += part.column(2).to_pylist()
        if last is not None:
            yield from done(last, fold, texts, ids, held)

    return rows.mapInArrow(work, RAW)


def _add_pairs(raw: DataFrame) -> DataFrame:
    """(block, part, rest, full): predictions for each block's pairs, with and, for tuning blocks, without the tuning documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parts in _runs(batches):
            blocks, folds, a, b = ([x for p in parts for x in p.column(j).to_pylist()] for j in (1, 2, 3, 4))
            own = [from_planes(x, np.uint64) for x in a]
            n = np.concatenate([unpacked_counts(x) for x in b])
            u, inverse = np.unique(np.concatenate(own), return_inverse=True)
            tuning = np.repeat(folds, [len(x) for x in own]) == 1
            size, alone, (rest, full) = predicted(u, [np.bincount(inverse, n * ~tuning, len(u)), np.bincount(inverse, n, len(u))])
            first, at = np.cumsum(size) - size, 0
            for block, fold, x in zip(blocks, folds, own, strict=True):
                mine = inverse[at : at + len(x)]
                at += len(x)
                sent = [coded(v, first[mine], size[mine], alone[mine]) if want else None for v, want in ((rest, fold), (full, True))]
                yield pa.record_batch([pa.array([v], t) for v, t in zip((block, int(part), *sent), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "part", "rest", "full"])

    n = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = raw.select("part", "block", "fold", "a", "b").repartition(n, "part").sortWithinPartitions("part", "block")
    return own.mapInArrow(work, "block int, part int, rest binary, full binary")


def _add_tokens(raw: DataFrame) -> DataFrame:
    """(block, part, n, known, total): the counts of each block's tokens, in their order, in all training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parts in _runs(batches):
            blocks = [x for p in parts for x in p.column(1).to_pylist()]
            h = [from_planes(x, np.uint64) for p in parts for x in p.column(2).to_pylist()]
            n = np.concatenate([unpacked_counts(x) for p in parts for x in p.column(3).to_pylist()])
            u, inverse = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(inverse, n, len(u)).astype(np.int64)
            back, at = total[inverse], 0
            for k, (block, own) in enumerate(zip(blocks, h, strict=True)):
                stats = (int((total > 0).sum()), int(total.sum())) if k == 0 else (0, 0)
                yield pa.record_batch([pa.array([v], t) for v, t in zip((block, int(part), packed_counts(back[at : at + len(own)]), *stats), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["block", "part", "n", "known", "total"])
                at += len(own)

    n = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = raw.select("part", "block", "a", "b").repartition(n, "part").sortWithinPartitions("part", "block")
    return own.mapInArrow(work, "block int, part int, n binary, known long, total long")


def _met(rows: pa.Table) -> tuple[Block, pa.Table, dict[int, dict[int, bytes]]]:
    """The block of some rows (kind, part, a, ..), the row of its texts, and by kind what the partitions sent."""
    sent: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for kind, part, a in zip(*(rows.column(c).to_pylist() for c in ("kind", "part", "a")), strict=True):
        if kind < 2:
            sent[kind][part] = a
    own = rows.filter(pc.equal(rows.column("kind"), 2))
    block = Block.unpacked(own.column("a")[0].as_py(), own.column("b")[0].as_py(), own.column("sizes")[0].as_py())
    return block, own, sent


def _tuned(texts: DataFrame, answers: DataFrame, parts: int) -> np.ndarray:
    """The mixer fitted online on the tuning documents of each block, averaged by bits, as one array."""
    size = len(Mixer().flat())

    def work(rows: pa.Table) -> pa.Table:
        block, _, sent = _met(rows)
        mixer = Mixer()
        bits = score(block, Inputs(block, parts, sent[0]), mixer, learn=True)[1]
        return pa.table({"i": pa.array(range(size), pa.int32()), "w": pa.array(mixer.flat().astype(float) * bits), "n": pa.array([float(bits)] * size)})

    rest = answers.filter("rest IS NOT NULL").select(F.lit(0).alias("kind"), "block", "part", F.col("rest").alias("a"))
    rows = texts.filter("fold = 1").drop("fold").unionByName(rest, allowMissingColumns=True)
    got = rows.groupBy("block").applyInArrow(work, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()  # size rows
    flat = Mixer().flat()
    for r in got:
        if r.w is not None:
            flat[r.i] = r.w
    return flat


def score_texts(docs: DataFrame, held: Column) -> DataFrame:
    """The contract's columns and bits_per_byte for (doc_id, text); rows for which ``held`` holds are not learned from."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    chars = given.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    tuning, parts = -(-blocks // TUNE), -(-blocks // SHARE)
    folds = given.select("*", ((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(TUNE)) == 0) & ~F.col("held")).cast("int").alias("fold"), F.xxhash64("doc_id", F.md5("text")).alias("hash"))
    rows = folds.select("doc_id", "text", "held", "fold", F.when(F.col("fold") == 1, blocks + F.pmod("hash", F.lit(tuning))).otherwise(F.pmod("hash", F.lit(blocks))).cast("int").alias("block"))
    raw = _gather(_small(rows).repartition(blocks + tuning, "block").sortWithinPartitions("block"), parts)
    asked, words, texts = stored_by(raw, "kind", (0, 1, 2), "gathered")
    answers = stored(_add_pairs(asked), "answers")
    vocab = stored(_add_tokens(words), "tokens")
    dropped(asked)
    dropped(words)
    texts = texts.select(F.lit(2).alias("kind"), "block", "fold", "a", "b", "ids", "held", "sizes")
    mixed_by = _tuned(texts, answers, parts)
    stats = vocab.agg(F.sum("known").alias("known"), F.sum("total").alias("total")).first()
    known, total = stats.known or 0, stats.total or 0

    def work(rows: pa.Table) -> pa.Table:
        block, own, sent = _met(rows)
        h, at = block.hashes()
        n = np.empty(len(h), np.int64)
        for p, mine in by_part((h >> np.uint64(40)) % np.uint64(parts)):
            n[mine] = unpacked_counts(sent[1][p])
        n = n[at]
        ln = np.log10((n + 0.1) / (total + 0.1 * (known + 1))) if total else np.full(len(n), np.nan)
        first = np.cumsum(block.sizes) - block.sizes
        base = np.add.reduceat(ln[block.seq], first)
        got = score(block, Inputs(block, parts, sent[0]), Mixer.of(mixed_by))[0]
        chars = np.add.reduceat(block.length[block.seq], first)
        return pa.table({
            "doc_id": pa.array(own.column("ids")[0].as_py(), pa.int64()), "held_out": pa.array(own.column("held")[0].as_py(), pa.bool_()), "n_tokens": pa.array(block.sizes), "n_known": pa.array(np.add.reduceat((n > 0)[block.seq].astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(first), total), pa.int64()), "base_score": pa.array(base, pa.float64(), mask=np.full(len(first), not total)), "score": pa.array(got / np.log(10)), "bits_per_byte": pa.array(-got / np.log(2) / chars),
        })

    full = answers.select(F.lit(0).alias("kind"), "block", "part", F.col("full").alias("a"))
    counts = vocab.select(F.lit(1).alias("kind"), "block", "part", F.col("n").alias("a"))
    return texts.drop("fold").unionByName(full, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True).groupBy("block").applyInArrow(work, SCORED)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), held)
