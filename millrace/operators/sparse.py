"""Sums of vectors weighted by a sparse table, as products of blocks.

Entries (row, col, w) and vectors (col, vec) meet in groups of columns. A group's entries are one sparse
block, its vectors one dense block, and their product is a partial sum for each row, sent
as one blob; the partial sums of a row are then added. So what is shuffled are entries, vectors and a blob a
row and group, never a row for each entry and dimension.

A group holds up to ``COLS`` vectors. Its entries are dealt to slices of about ``ENTRIES``, and of about ``SUMS`` cells
of partial sums if each entry had a row of its own, by their rows, each with the group's vectors, so a column that a third of all entries name is no single task.
Entries without a vector add nothing; null vectors count as missing; shorter vectors end in zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLS = 4096
ENTRIES = 1_000_000
SUMS = 8_000_000
#: Products that are in memory at a time.
CELLS = 4_000_000


def _block(entries: pa.Table, vectors: pa.Table) -> pa.Table:
    """(row, total, sums) of a sparse block times a dense one."""
    kind = entries.schema.field("row").type
    empty = pa.table({"row": pa.array([], kind), "total": pa.array([], pa.float64()), "sums": pa.array([], pa.binary())})
    if not entries.num_rows or not vectors.num_rows:
        return empty
    vecs = vectors.column("vec").combine_chunks()
    sizes = np.diff(vecs.offsets.to_numpy())
    dense = np.zeros((len(vecs), int(sizes.max(initial=0))))
    dense[np.repeat(np.arange(len(vecs)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vecs.flatten().to_numpy(zero_copy_only=False)
    names, order = np.unique(vectors.column("col").to_numpy(), return_index=True)
    dense = dense[order]
    cols = entries.column("col").to_numpy()
    at = np.minimum(np.searchsorted(names, cols), len(names) - 1)
    met = names[at] == cols
    rows = entries.column("row").combine_chunks().dictionary_encode()
    code, weight, at = rows.indices.to_numpy()[met], entries.column("w").to_numpy()[met], at[met]
    by = np.argsort(code, kind="stable")
    code, weight, at = code[by], weight[by], at[by]
    total = np.bincount(code, weight, len(rows.dictionary)).astype(np.float64)
    sums = np.zeros((len(rows.dictionary), dense.shape[1]))
    step = max(CELLS // max(dense.shape[1], 1), 1)
    for a in range(0, len(code), step):
        part = code[a : a + step]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums[part[first]] += np.add.reduceat(weight[a : a + step, None] * dense[at[a : a + step]], first)
    held = np.flatnonzero(np.bincount(code, minlength=len(rows.dictionary)))
    return pa.table({"row": rows.dictionary.take(pa.array(held)), "total": pa.array(total[held]), "sums": pa.array([sums[i].tobytes() for i in held.tolist()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial sums of each row added, from rows sorted by it."""
    held, total, sums = None, 0.0, np.zeros(0)

    def out(done: list) -> pa.RecordBatch:
        kind = batch.schema.field("row").type
        return pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.float64()), pa.array([d[2] for d in done], pa.list_(pa.float64()))], ["row", "total", "sums"])

    started = False
    for batch in batches:
        done = []
        for row, w, blob in zip(*(batch.column(c).to_pylist() for c in ("row", "total", "sums")), strict=True):
            part = np.frombuffer(blob)
            if started and row == held:
                total += w
                sums = part + np.pad(sums, (0, max(len(part) - len(sums), 0))) if len(part) >= len(sums) else sums + np.pad(part, (0, len(sums) - len(part)))
                continue
            if started:
                done.append((held, total, sums.tolist()))
            started, held, total, sums = True, row, w, part
        if done:
            yield out(done)
    if started:
        yield out([(held, total, sums.tolist())])


def weighted_sums(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(row, total, sums): the weights and the weighted vectors of each row added up, of (row, col, w) and (col, vec)."""
    vectors = vectors.filter("vec IS NOT NULL").select(F.col("col").cast("long"), F.col("vec").cast("array<double>"))
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    groups, most = max(-(-n // COLS), 1), max(min(ENTRIES, SUMS // max(width, 1)), 1)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    dealt = entries.select("row", F.col("col").cast("long"), F.col("w").cast("double")).withColumn("g", of(F.col("col")))
    slices = dealt.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("slices"))  # a row a group
    left = dealt.join(slices, "g").select("row", "col", "w", "g", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("s"))
    right = vectors.withColumn("g", of(F.col("col"))).join(slices, "g").select("col", "vec", "g", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"))
    kind = entries.schema["row"].dataType.simpleString()
    parts = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(_block, f"row {kind}, total double, sums binary")
    return parts.repartition("row").sortWithinPartitions("row").mapInArrow(_added, f"row {kind}, total double, sums array<double>")


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
