"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct word shingles as 64-bit hashes. Its signature has
``CHUNKS * WIDTH`` MinHash values of 16 bits. Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` places differ in at most ``ERRORS`` places of some chunk
(pigeonhole), so each document is filed under every choice of ``WIDTH - ERRORS`` places of
each chunk: all pairs within the distance meet under some key. With 48 places and a
distance of 23, a pair of similarity 0.8 (9.6 differing places on average) is beyond it with
a probability of about 1e-6.

Only connectivity is asked for, so links inside a component need not be looked at.
Documents with equal sets are one node. Each bucket has a centre, the member that lies
nearest to the others or, in large buckets, to the most frequent signature. First every node is compared with the
centres of its buckets. Then all buckets whose centres are in one component form a family,
and each stray of it (a node of another component) is compared with all nodes of the family.
Every pair that shares a bucket is in a family, so nothing is dropped, and one pass ends it.

Comparisons are exact and inside the task: a family's nodes are known by their differences
from what most of them hold, and the postings of these differences give a stray's
intersections with all nodes at once. Only links between components leave the task, at most
one for each node. A family of more than ``SLICE`` shingles is dealt to several tasks by
node, each with all strays.

Components come from alternating large-star and small-star steps on the links. Node lists,
links and labels stay in tables; the driver only sees counts.

Defined results: null texts and texts without words have empty sets and are linked with
nothing; a text of fewer words than a shingle is one shingle; texts of any length are read
whole; rows without an id are linked with nothing and returned with component null and kept
true; repeated rows of an id are one document, and each is returned; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

CHUNKS, WIDTH, ERRORS = 12, 4, 1
PLACES, DISTANCE = CHUNKS * WIDTH, CHUNKS * (ERRORS + 1) - 1
#: Shingles of a family that one task compares at a time, besides those of the strays.
SLICE = 4_000_000
#: Buckets up to this size are searched for nodes without a partner in reach, which leave; larger ones keep all.
SMALL = 64
#: Words of a Python worker whose hashes are kept; every worker of an executor has its own.
REMEMBERED = 50_000
_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PLACES, np.uint64)
_PLACE = _rng.integers(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _masks() -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(WIDTH), WIDTH - ERRORS))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 7)
        if len(word) < 100:
            self[word] = h
        return h


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PLACES values for each nonempty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PLACES), np.uint16)
    for k in range(PLACES):
        low = np.minimum.reduceat(mixed_once(flat, k), starts)
        out[:, k] = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def mixed_once(x: np.ndarray, k: int) -> np.ndarray:
    y = x * _MULT[k] + _ADD[k]
    return (y ^ (y >> np.uint64(32))) * _MULT[(k + 1) % PLACES]


def keys(sig: np.ndarray) -> np.ndarray:
    """n rows of the keys under which signatures are filed."""
    masks, out = _masks(), []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            part = mixed(sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64) + np.uint64(1) + np.arange(WIDTH, dtype=np.uint64) * np.uint64(1 << 16)) * _PLACE
            for m, mask in enumerate(masks):
                out.append(mixed(part[:, mask].sum(1, dtype=np.uint64) + np.uint64(c * len(masks) + m)))
    return np.stack(out, 1)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, print, sig): set size, 128-bit digest of the set, signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                full = [x for x in sets if len(x)]
                rows = iter(signature(full)) if full else iter(())
                sigs = [next(rows).tobytes() if len(x) else None for x in sets]
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "print", "sig"])

    return docs.mapInArrow(work, "id long, n long, print binary, sig binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of each key together, from batches sorted by their first column."""
    last, held = None, []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and key[a] != last:
                yield last, held
                held = []
            last = key[a]
            held.append(b.slice(a, z - a))
    if held:
        yield last, held


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool, bool]]:
    """Key, rows, and whether they are the first and the last of the key, from batches sorted by their first column."""
    held = None
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            first = held is None or held[0] != key[a]
            if held:
                yield (*held, first)
            held = (key[a], b.slice(a, z - a), first)
    if held:
        yield (*held, True)


def _by_key(df: DataFrame, *order: str) -> DataFrame:
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(n, order[0]).sortWithinPartitions(*order)


def _filed(nodes: DataFrame) -> DataFrame:
    """(key, id) of every key that two or more nodes share."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, PLACES)
                own = keys(sig).view(np.int64)
                yield pa.record_batch([pa.array(own.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), own.shape[1]))], ["key", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, id, was it sent) of the row before
        for b in batches:
            key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            before = np.concatenate([[last is not None and key[0] == last[0]], same])
            keep = before | np.concatenate([same, [False]])
            k, i = key[keep], ids[keep]
            if before[0] and not last[2]:
                k, i = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], i])
            last = (key[-1], ids[-1], bool(keep[-1]))
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(i, pa.int64())], ["key", "id"])

    return _by_key(nodes.select("id", "sig").mapInArrow(file, "key long, id long"), "key", "id").mapInArrow(shared, "key long, id long")


def _stars(buckets: DataFrame) -> DataFrame:
    """(centre, id, near) of each bucket's nodes; near: within the distance of the centre."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = None
        for _, part, first, last in _slices(batches):
            ids = part.column(1).to_numpy()
            sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, PLACES)
            whole = first and last and len(ids) <= SMALL
            far = (sig[:, None, :] != sig[None, :, :]).sum(2) if whole else None
            if first:  # a bucket may go on in further batches
                at = int(far.sum(1).argmin()) if whole else _middle(sig)
                middle = ids[at], sig[at]
            near = far[at] <= DISTANCE if whole else (sig != middle[1]).sum(1) <= DISTANCE
            keep = np.ones(len(ids), bool)
            if whole:
                keep = (far <= DISTANCE).sum(1) > 1
                keep[at] = keep.any()
            if keep.any():
                yield pa.record_batch([pa.array(np.repeat(middle[0], keep.sum())), pa.array(ids[keep]), pa.array(near[keep])], ["centre", "id", "near"])

    return _by_key(buckets.select("key", "id", "sig"), "key", "id").mapInArrow(work, "centre long, id long, near boolean")


def _middle(sig: np.ndarray) -> int:
    """The row nearest to the most frequent value of each place."""
    mode = np.empty(PLACES, np.uint16)
    for j in range(PLACES):
        values, n = np.unique(sig[:, j], return_counts=True)
        mode[j] = values[n.argmax()]
    return int((sig != mode).sum(1).argmin())


def links_within(comp: np.ndarray, asks: np.ndarray, home: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Numbers (x, y) of sets that are similar enough, x of ``asks`` and y of ``home``, that join all
    components which such pairs join. ``comp`` is changed.

    With D the difference of a set from any one base, the common part of x and y follows from
    |x|, |y|, |Dx|, |Dy| and the common part of Dx and Dy.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    most = np.bincount(code) * 2 > len(sets)
    base = np.flatnonzero(most)
    rank = np.cumsum(most) - 1
    inside = most[code]
    held = np.zeros((len(sets), len(base)), bool)
    held[owner[inside], rank[code[inside]]] = True
    lack_row, lack = np.nonzero(~held)
    row = np.concatenate([owner[~inside], lack_row])
    item = np.concatenate([code[~inside], base[lack]])
    differ = np.bincount(row, minlength=len(sets))
    by_row = item[np.argsort(row, kind="stable")]
    first = np.cumsum(differ) - differ
    by_item = row[np.argsort(item, kind="stable")]
    freq = np.bincount(item, minlength=len(values))
    start = np.cumsum(freq) - freq
    out = []
    for x in np.flatnonzero(asks).tolist():
        own = by_row[first[x] : first[x] + differ[x]]
        n = freq[own]
        places = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(by_item[places], minlength=len(sets))
        common = (size + size[x] - differ - differ[x] + 2 * both) // 2
        linked = home & (comp != comp[x]) & (100 * common >= percent * (size + size[x] - common))
        if linked.any():
            ys = np.flatnonzero(linked)
            names, at = np.unique(comp[ys], return_index=True)
            out += [(x, y) for y in ys[at].tolist()]
            comp[np.isin(comp, names)] = comp[x]
    return out


def _compared(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of families' rows (c, id, comp, n, asks): those that ask against all of the family.

    Rows of a large family have homes by id; rows that ask go to all of them.
    """
    large = rows.groupBy("c").agg(F.ceil(F.sum("n") / F.lit(SLICE)).cast("int").alias("slices")).filter("slices > 1")
    placed = rows.join(large, "c", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    home = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    dealt = placed.select("c", "id", "comp", "asks", home.alias("home"), F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(home))).alias("part"))
    texts = docs.select(F.col("id").cast("long"), "text")
    # by a shuffle at every size, so that small and large inputs behave alike
    full = dealt.join(texts.hint("merge"), "id").select(F.xxhash64("c", "part").alias("group"), "c", "part", "id", "comp", "asks", (F.col("home") == F.col("part")).alias("home"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches):
            t = pa.Table.from_batches(parts)
            ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy().copy()
            asks, home = t.column("asks").to_numpy(), t.column("home").to_numpy()
            if not asks.any() or (comp == comp[0]).all():
                continue
            sets = [shingles(x, words) for b in parts for x in b.column("text").to_pylist()]
            one = list({(i, x.tobytes()): k for k, (i, x) in enumerate(zip(ids.tolist(), sets, strict=True))}.values())  # repeated rows
            ids, comp, asks, home, sets = ids[one], comp[one], asks[one], home[one], [sets[k] for k in one]
            found = links_within(comp, asks, home, sets, percent)
            if found:
                a, b = ids[[x for x, _ in found]], ids[[y for _, y in found]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return full.repartition(n, "group").sortWithinPartitions("group", "c", "part").drop("group").mapInArrow(work, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of each (first, second column) together, from batches sorted by them."""
    last, held = None, []
    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and (x[a], y[a]) != last:
                yield held
                held = []
            last = (x[a], y[a])
            held.append(b.slice(a, z - a))
    if held:
        yield held


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of the links (a, b) reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(after, "edges")
        # done when every node but the roots has one edge, to a root
        roots = new.select(F.col("v").alias("u")).distinct()
        loose = new.groupBy("u").count().filter("count > 1").select("u").unionByName(new.join(roots, "u", "left_semi").select("u"))
        done = loose.isEmpty()
        dropped(edges)
        edges = new
        if done:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def linked(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, comp) of each (id, text): set size and the smallest id of the component."""
    signs = stored(signed(docs.select(F.col("id").cast("long"), "text"), shingle_words), "signs")
    groups = signs.filter("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = stored(groups, "nodes")
    filed = stored(_filed(nodes), "filed")
    stars = stored(_stars(filed.join(nodes.select("id", "sig").hint("merge"), "id")).groupBy("centre", "id").agg(F.max("near").alias("near")), "stars")
    dropped(filed)
    sizes = nodes.select("id", "n")
    near = stars.filter("near").join(sizes, "id").select(F.col("centre").alias("c"), "id", F.col("id").alias("comp"), "n", (F.col("id") == F.col("centre")).alias("asks"))
    links = stored(_compared(near, docs, shingle_words, percent), "links")
    label = components(links)
    of = lambda name: label.select(F.col("id").alias(name), F.col("comp").alias(f"{name}_comp"))
    named = stars.select("centre", "id").join(of("centre"), "centre", "left").join(of("id"), "id", "left")
    family = named.select(F.coalesce("centre_comp", "centre").alias("c"), "id", F.coalesce("id_comp", "id").alias("comp")).distinct()
    # two rows are a centre and a node that was compared with it
    open_ = family.groupBy("c").agg(F.count("*").alias("rows"), F.max(F.col("comp") != F.col("c")).alias("strays")).filter("strays AND rows > 2").select("c")
    rest = stored(family.join(open_, "c", "left_semi").join(sizes, "id").select("c", "id", "comp", "n", (F.col("comp") != F.col("c")).alias("asks")), "families")
    more = stored(_compared(rest, docs, shingle_words, percent), "links")
    final = components(links.unionByName(more))
    node_of = nodes.join(final, "id", "left").select("print", F.coalesce("comp", "id").alias("comp"))
    comp = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")))
    return signs.join(node_of, "print", "left").select("id", "n", comp.alias("comp"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = linked(docs, shingle_words=2)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ..) with the smallest id of their component."""
    gone = linked(docs.select(F.col("doc_id").alias("id"), "text"), shingle_words, percent).filter("id <> comp").select(F.col("id").alias("doc_id"))
    return docs.join(stored(gone, "gone").hint("merge"), "doc_id", "left_anti")
