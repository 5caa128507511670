"""A stored index in immutable segments, searched with block-max pruning.

A commit writes one segment: the fresh chunks, their postings, the names they define, the
chunks of earlier segments that are gone, and the difference that both make to the
document frequencies. Nothing written before is touched, so a commit's rows follow the
changes. Frequencies are sums over segments, the number of chunks and their length are in
the commit's manifest. :meth:`Segments.merge` rewrites segments of about the same size into
one, without what is gone, and keeps the sums as they are.

A chunk is stored with its terms and their counts, so a text is cut into terms once, when it comes: what
goes and what is merged is counted from the stored ones.

Postings are blocks of one term and one range of ``SPAN`` neighbouring chunks, with the
pairs of frequency and length that bound its scores. Most blocks hold one posting, so a row has all blocks of
a term that one task made. A batch of queries adds up the bounds of
its terms' blocks for each range, scores the ranges with the best bounds and takes the k-th
score of each query. Terms whose largest bounds together stay below it let no chunk in: the
others' postings are read in the ranges whose bound reaches it, and the weak terms' blocks only
where a chunk can still reach it. A batch of more than ``FEW`` queries is scored whole instead, inside blocks of chunks: so
many queries meet each block of postings that their bounds are more rows than the postings. Chunks are neighbours by their most frequent long word and
their length, so that ranges differ.

Commits are numbered files, named only where none is there: of two writers one gets the
number, the other starts again from the new state. A manifest holds the format, the config
key and each segment's row counts and checksum, which are verified on request.

Defined results: a null text is an empty one; chunk ids are the caller's and unique among live
chunks; a file that changes loses all its chunks, and its fresh ones take their place; a
deleted chunk has no part in scores, frequencies or names; an index without chunks finds nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.ordering import Ordered
from .index import ConfigMismatch, Damaged, VersionMismatch, kept

FORMAT = 2
SPAN = 32
#: Ranges of each query that are scored before there is a threshold.
FIRST = 8
#: Queries of a batch whose bounds are looked at.
FEW = 16
#: Bytes of texts that are cut into terms at a time, postings that are made to rows of blocks at a time.
BYTES, WRITTEN = 16_000_000, 2_000_000
#: Segments of one size class that are merged.
FAN = 4
#: Scores are rounded to 9 places, so bounds within this of the threshold are read.
SLACK = 1e-8
TABLES = {
    "chunks": "chunk_id long, file string, text string, dl long, lead string, terms string, tfs array<int>",
    "blocks": "term string, n int, spans array<int>, starts array<int>, tops array<int>, peak_tfs array<int>, peak_dls array<int>, ids array<long>, tfs array<int>, dls array<int>",
    "terms": "term string, df long",
    "names": "name string, symbol string, folded boolean, chunk_id long, file string",
    "gone": "owner string, chunk_id long",
}
#: What a table is dealt to buckets by.
KEYS = {"chunks": "file", "blocks": "term", "terms": "term", "names": "name", "gone": "chunk_id"}


class Conflict(Exception):
    """Another writer took the commit's number again and again."""


def config_key(mode: str, chunker: str = "line", model: str = "bm25", enrich: bool = False, lazy: bool = False, staged: bool = False) -> str:
    """What changes an index's rows without changing its files."""
    on = lambda b: "on" if b else "off"
    return f"mode={mode}|chunker={chunker}|model={model}|enrich={on(enrich)}|lazy={on(lazy)}|staged={on(staged)}"


def _part(tf: Column, dl: Column, average: float) -> Column:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / F.lit(average)))


class Segments:
    """The index in a folder that all machines see."""

    def __init__(self, spark: SparkSession, root: str, config: str, buckets: int = 64):
        self.spark, self.root, self.config, self.buckets = spark, root.rstrip("/"), config, buckets

    # --- commits -------------------------------------------------------------------------------
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}/_commits")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def state(self) -> dict:
        """The last manifest; an empty one where nothing is committed."""
        numbers = self._numbers()
        if not numbers:
            return {"format": FORMAT, "config": self.config, "number": 0, "buckets": self.buckets, "chunks": 0, "length": 0, "segments": []}
        rows = self.spark.read.text(f"{self.root}/_commits/{numbers[-1]:012d}.json", wholetext=True).collect()
        try:
            out = json.loads(rows[0].value)
            out["segments"], out["format"], out["config"]  # noqa: B018
        except Exception as e:
            raise Damaged(f"commit {numbers[-1]} of {self.root} is not readable") from e
        if out["format"] != FORMAT:
            raise VersionMismatch(f"format {out['format']}, expected {FORMAT}")
        if out["config"] != self.config:
            raise ConfigMismatch(f"config {out['config']}, expected {self.config}")
        return out

    def _announce(self, manifest: dict) -> bool:
        """Give the manifest its number; False where another writer has it.

        The file is whole before it gets its name, and a rename does not replace one that is there.
        """
        fs, path = self._fs()
        at, draft = path(f"{self.root}/_commits/{manifest['number']:012d}.json"), path(f"{self.root}/_commits/_{uuid.uuid4().hex}")
        fs.mkdirs(at.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.exists(at) and fs.rename(draft, at):
            return True
        fs.delete(draft, False)
        return False

    def verify(self) -> None:
        """Compare every segment's rows with its manifest."""
        for s in self.state()["segments"]:
            try:
                found = self._counted(s["name"])
            except Exception as e:
                raise Damaged(f"segment {s['name']} is not readable") from e
            if any(found[k] != s[k] for k in found):
                raise Damaged(f"segment {s['name']} is {found}")

    def _counted(self, name: str) -> dict:
        read = lambda t: self._read(t, [name], TABLES[t])
        chunks = read("chunks").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.coalesce(F.expr("bit_xor(xxhash64(chunk_id, file, text, dl, lead, terms, tfs))"), F.lit(0)).alias("sum")).first()
        blocks = read("blocks").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.expr("bit_xor(xxhash64(term, spans, starts, tops, peak_tfs, peak_dls, ids, tfs, dls))"), F.lit(0))).first()
        terms = read("terms").agg(F.coalesce(F.expr("bit_xor(xxhash64(term, df))"), F.lit(0))).first()[0]
        return {"chunks": chunks.n, "length": chunks.length, "gone": read("gone").count(), "postings": blocks[0], "sum": chunks.sum ^ blocks[1] ^ terms}

    # --- tables --------------------------------------------------------------------------------
    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, names: list[str], fields: str) -> DataFrame:
        spark, base = self.spark, f"{self.root}/{table}"
        fs, path = self._fs()
        paths = [p for n in names if fs.exists(path(p := f"{base}/segment={n}"))]
        schema = f"{fields}, segment string, bucket int"
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def table(self, table: str, state: dict | None = None) -> DataFrame:
        """Rows of all live segments, with segment and bucket."""
        return self._read(table, [s["name"] for s in (state or self.state())["segments"]], TABLES[table])

    def _write(self, table: str, name: str, rows: DataFrame, sort: list[str]) -> None:
        rows = rows.withColumn("bucket", self._bucket(KEYS[table])).hint("rebalance", "bucket").sortWithinPartitions("bucket", *sort)
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{table}/segment={name}")

    def _near(self, table: str, keys: DataFrame, key: str, state: dict) -> DataFrame:
        """Rows of a table whose key is among ``keys``; only their buckets are read."""
        near = [r[0] for r in keys.select(self._bucket(key)).distinct().collect()]  # at most so many rows as there are buckets
        return self.table(table, state).filter(F.col("bucket").isin(near) if near else F.lit(False)).join(keys, key, "left_semi")

    def live(self, state: dict | None = None) -> DataFrame:
        """(segment, chunk_id, file, text, dl) of the chunks that are there."""
        state = state or self.state()
        return self._living(self.table("chunks", state), state)

    def _living(self, rows: DataFrame, state: dict) -> DataFrame:
        gone = self.table("gone", state).select(F.col("owner").alias("segment"), "chunk_id")
        return rows.join(gone, ["segment", "chunk_id"], "left_anti")

    # --- writing -------------------------------------------------------------------------------
    def commit(self, changed: DataFrame, fresh: DataFrame, tries: int = 5) -> dict:
        """One segment: chunks of the changed files (file) go, fresh ones (chunk_id, file, text) come. Returns the manifest."""
        for _ in range(tries):
            base, name = self.state(), uuid.uuid4().hex
            self.buckets = base["buckets"]
            files = changed.select("file").unionByName(fresh.select("file")).distinct()
            old = self._living(self._near("chunks", files, "file", base), base).select("segment", "chunk_id", "terms", "dl")
            self._write("gone", name, old.select(F.col("segment").alias("owner"), "chunk_id"), ["chunk_id"])
            lost = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            new = self._filled(name, _measured(fresh.select("chunk_id", "file", F.coalesce("text", F.lit("")).alias("text"))))
            minus = old.select(F.explode(F.split("terms", " ")).alias("term")).filter("term <> ''").select("term", F.lit(-1).cast("long").alias("df"))
            plus = self._read("blocks", [name], TABLES["blocks"]).select("term", F.col("n").cast("long").alias("df"))
            self._write("terms", name, _summed(plus.unionAll(minus)), ["term"])
            self._write("names", name, _names(new), ["name"])
            if self._finish(base, [s["name"] for s in base["segments"]], name, -lost.n, -lost.length):
                return self.state()
        raise Conflict(f"{tries} commits to {self.root} were overtaken")

    def _filled(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a segment's chunks and their blocks; returns the chunks as stored.

        Chunks with the same most frequent long word, then of about one length, then of one file, are neighbours; those without terms have no place.
        """
        self._write("chunks", name, rows, ["file", "chunk_id"])
        new = self._read("chunks", [name], TABLES["chunks"])
        size = F.floor(2 * F.log2(F.col("dl") + 1)).alias("size")
        full = new.filter("dl > 0").select("chunk_id", "file", "dl", "lead", size, "terms", "tfs")
        self._write("blocks", name, _blocks(Ordered(full, ["lead", "size", "file", "chunk_id"]).numbered("place")), ["term"])
        return new

    def _finish(self, base: dict, kept: list[str], name: str, chunks: int, length: int, merged: bool = False) -> bool:
        """Announce segments ``kept`` and the new one; ``chunks`` and ``length`` are what went besides what came."""
        own = {"name": name, **self._counted(name)}
        if not merged:
            chunks, length = chunks + own["chunks"], length + own["length"]
        manifest = {
            "format": FORMAT, "config": self.config, "number": base["number"] + 1, "buckets": self.buckets, "chunks": base["chunks"] + chunks, "length": base["length"] + length,
            "segments": [s for s in base["segments"] if s["name"] in kept] + [own],
        }
        return self._announce(manifest)

    def compact(self) -> None:
        """Rewrite all segments into one."""
        base = self.state()
        if base["segments"]:
            self._merged(base, [s["name"] for s in base["segments"]])

    def merge(self, fan: int = FAN) -> int:
        """Merge segments of one size class while ``fan`` of them are there. Returns the number of merges."""
        done = 0
        while True:
            base = self.state()
            classes: dict[int, list[dict]] = {}
            for s in base["segments"]:
                classes.setdefault(int(math.log(max(s["chunks"] + s["gone"], 1), fan)), []).append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= fan), None)
            if not full:
                return done
            self._merged(base, [s["name"] for s in full])
            done += 1

    def _merged(self, base: dict, names: list[str]) -> None:
        name = uuid.uuid4().hex
        self.buckets = base["buckets"]
        rows = self._living(self._read("chunks", names, TABLES["chunks"]), base)
        self._filled(name, rows.drop("segment", "bucket"))
        self._write("terms", name, _summed(self._read("terms", names, TABLES["terms"]).select("term", "df")), ["term"])
        self._write("names", name, self._living(self._read("names", names, TABLES["names"]), base).drop("segment", "bucket"), ["name"])
        left = self._read("gone", names, TABLES["gone"]).filter(~F.col("owner").isin(names)).select("owner", "chunk_id")
        self._write("gone", name, left, ["chunk_id"])
        kept = [s["name"] for s in base["segments"] if s["name"] not in names]
        self._finish(base, kept, name, 0, 0, merged=True)  # overtaken: the next round starts from the new state

    def vacuum(self, keep: int = 2) -> int:
        """Delete segments that none of the last ``keep`` manifests names, and older manifests. Returns the number of segments."""
        fs, path = self._fs()
        numbers = self._numbers()
        used: set[str] = set()
        for n in numbers[-keep:]:
            used |= {s["name"] for s in json.loads(self.spark.read.text(f"{self.root}/_commits/{n:012d}.json", wholetext=True).first().value)["segments"]}
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.root}/_commits/{n:012d}.json"), False)
        dropped: set[str] = set()
        for table in TABLES:
            at = path(f"{self.root}/{table}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                name = s.getPath().getName().removeprefix("segment=")
                if name not in used:
                    fs.delete(s.getPath(), True)
                    dropped.add(name)
        return len(dropped)

    # --- reading -------------------------------------------------------------------------------
    def snapshot(self) -> Snapshot:
        """What the last commit shows; later commits do not change it."""
        return Snapshot(self, self.state())


class Snapshot(R.Index):
    """One state of an index: exact statistics, all postings of a batch's terms, or its k best chunks with pruning."""

    def __new__(cls, store: Segments, state: dict):
        spark = store.spark
        post = _postings(store.table("blocks", state))
        average = state["length"] / state["chunks"] if state["chunks"] else 0.0
        stats = spark.createDataFrame([(state["chunks"], average)], "n long, avgdl double")
        self = super().__new__(cls, store._living(post, state).select("chunk_id", "dl", "term", "tf"), _summed(store.table("terms", state).select("term", "df")), stats)
        self.store, self.held, self.average = store, state, average
        return self

    def of(self, wanted: DataFrame) -> R.Index:
        store, names = self.store, wanted.select("term")
        post = store._living(_postings(store._near("blocks", names, "term", self.held)), self.held)
        return R.Index(post.select("chunk_id", "dl", "term", "tf"), self._dfs(names), self.stats)

    def _dfs(self, names: DataFrame) -> DataFrame:
        return _summed(self.store._near("terms", names, "term", self.held).select("term", "df"))

    def definitions(self, symbols: DataFrame) -> DataFrame:
        """(symbol, folded, chunk_id, file) rows that may define a symbol (symbol), from the buckets of these names."""
        names = symbols.select(F.lower("symbol").alias("name")).distinct()
        return self.store._living(self.store._near("names", names, "name", self.held), self.held).select("symbol", "folded", "chunk_id", "file")

    def best(self, queries: DataFrame, k: int, predicted: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks of each query, as :func:`retrieval.bm25` ranks them all."""
        if queries.count() > FEW:
            return R.best(queries, self, k, predicted)
        return R.ranked(self._pruned(queries, k, predicted)[0], k)

    def effort(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """(postings scored, postings of the batch's terms) of :meth:`best`."""
        _, read, heads = self._pruned(queries, k, None)
        n = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return sum(n(r) for r in read), n(heads)

    def _pruned(self, queries: DataFrame, k: int, predicted: DataFrame | None):
        """Scores (query_id, chunk_id, score) that hold the k best, the blocks that were scored, and all of the batch."""
        store, average = self.store, self.average or 1.0
        spark, span = store.spark, ["query_id", "segment", "span"]
        wanted = kept(R.query_terms(queries, predicted), "wanted")
        weight = F.col("times") * R.idf(F.lit(self.held["chunks"]), F.col("df"))
        weighed = kept(wanted.join(self._dfs(wanted.select("term").distinct()), "term").select("query_id", "term", weight.alias("weight")), "weights")
        blocks = store._near("blocks", weighed.select("term").distinct(), "term", self.held)
        bound = (F.col("weight") * F.array_max(F.transform("peaks", lambda x: _part(x["tf"], x["dl"], average)))).alias("bound")
        ranges = _ranges(blocks)
        heads = _heads(blocks).join(weighed, "term").select(*span, "term", "weight", "n", bound)
        heads = kept(heads.groupBy(*span, "term", "weight").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")), "heads")  # once, where a range is shared

        # a threshold from the ranges with the best bounds
        order = R.Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "span")
        first = kept(heads.groupBy(*span).agg(F.sum("bound").alias("bound")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= FIRST).select(*span), "first")
        begun = heads.join(first, span, "left_semi")
        early = kept(self._postings(ranges, begun).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score")).filter("score > 0"), "early")
        kth = kept(R.ranked(early, k).filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least")), "kth")

        # terms whose bounds together stay below it let no chunk in by themselves
        rising = R.Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(R.Window.unboundedPreceding, 0)
        terms = heads.groupBy("query_id", "term").agg(F.max("bound").alias("most")).withColumn("reach", F.sum("most").over(rising))
        terms = kept(terms.join(kth, "query_id", "left").select("query_id", "term", F.coalesce(F.col("reach") >= F.col("least"), F.lit(True)).alias("lets")), "lets")
        left = heads.join(first, span, "left_anti").join(terms, ["query_id", "term"])
        weak = F.coalesce(F.sum(F.when(~F.col("lets"), F.col("bound"))), F.lit(0.0)).alias("weak")
        spans = left.groupBy(*span).agg(F.sum("bound").alias("bound"), weak, F.bool_or("lets").alias("lets")).join(kth, "query_id", "left")
        spans = kept(spans.filter(F.col("lets") & (F.col("bound") >= F.coalesce("least", F.lit(0.0)))).select(*span, "weak", "least"), "spans")

        # chunks in these terms' postings; the best of them first, for a threshold near the last one, then those that can reach it
        strong = left.filter("lets").join(spans.select(*span), span, "left_semi").drop("lets")
        met = self._postings(ranges, strong).groupBy(*span, "chunk_id").agg(F.sum("score").alias("score")).join(spans, span)
        least = F.coalesce("least", F.lit(0.0))
        able = met.withColumn("reach", F.col("score") + F.col("weak")).filter(F.col("reach") >= least).select(*span, "chunk_id", "score", "reach")
        foremost = R.Window.partitionBy("query_id").orderBy(F.desc("reach"), "segment", "chunk_id")
        able = kept(able.withColumn("nth", F.row_number().over(foremost)), "able")
        weak_heads = left.filter("NOT lets").drop("lets")
        ahead, seen = self._completed(ranges, weak_heads, able.filter(F.col("nth") <= 2 * k))
        ahead = kept(ahead, "ahead")
        nearer = R.ranked(early.unionAll(ahead), k).filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
        later = able.filter(F.col("nth") > 2 * k).join(nearer, "query_id", "left").filter(F.col("reach") >= least)
        late, more = self._completed(ranges, weak_heads, kept(later.drop("least"), "later"))
        return early.unionAll(ahead).unionAll(kept(late, "late")), (begun, strong, seen, more), heads

    def _completed(self, ranges: DataFrame, heads: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scores (query_id, chunk_id, score) of chunks whose strong terms are scored, and the weak terms' postings that were looked up for it."""
        span = ["query_id", "segment", "span"]
        asked = heads.select(*span, "term", "weight").join(chunks.select(*span, "chunk_id"), span)
        found = ranges.join(asked, ["segment", "term", "span"]).withColumn("at", F.array_position("ids", F.col("chunk_id")).cast("int")).filter("at > 0")
        one = (F.col("weight") * _part(F.get("tfs", F.col("at") - 1), F.get("dls", F.col("at") - 1), self.average or 1.0)).alias("more")
        more = found.select(*span, "chunk_id", one).groupBy(*span, "chunk_id").agg(F.sum("more").alias("more"))
        whole = chunks.join(more, [*span, "chunk_id"], "left").select("query_id", "chunk_id", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 9).alias("score"))
        return whole.filter("score > 0"), found.select(F.lit(1).alias("n"))

    def _postings(self, ranges: DataFrame, heads: DataFrame) -> DataFrame:
        """(query_id, segment, span, chunk_id, score) of the live postings in the blocks of ``heads``."""
        met = ranges.join(heads.select("query_id", "segment", "span", "term", "weight"), ["segment", "term", "span"])
        rows = met.select("query_id", "segment", "span", "weight", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        score = (F.col("weight") * _part(F.col("tf"), F.col("dl"), self.average or 1.0)).alias("score")
        return self.store._living(rows, self.held).select("query_id", "segment", "span", "chunk_id", score)


def _measured(rows: DataFrame) -> DataFrame:
    """(chunk_id, file, text) with the length ``dl`` in terms, the most frequent of the first long words, ``lead``, and the different terms with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = T.Names()
        for whole in batches:
            for b in _cut(whole, pc.binary_length(whole.column(2)), BYTES):
                terms, tfs = T.tallies(b.column(2), names)
                dls = np.diff(np.r_[0, np.cumsum(tfs.flatten().to_numpy(), dtype=np.int64)][tfs.offsets.to_numpy()])
                # the mode of the first words is enough: it only decides who is whose neighbour
                words = [Counter([w for w in t.split() if len(w) > 2][:64]) for t in pc.utf8_slice_codeunits(b.column(2), 0, 1000).to_pylist()]
                leads = [min(c, key=lambda w: (-c[w], w), default="") for c in words]
                yield pa.record_batch([*b.columns, pa.array(dls), pa.array(leads, pa.string()), pc.binary_join(terms, " "), tfs], [*b.schema.names, "dl", "lead", "terms", "tfs"])

    return rows.select("chunk_id", "file", "text").mapInArrow(work, TABLES["chunks"])


def _cut(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' sizes come to some ``most``, or to that of one row."""
    ends = np.cumsum(sizes.to_numpy(), dtype=np.int64)
    for a, z in pairwise([0, *np.flatnonzero(np.diff(ends // most)) + 1, len(ends)]):
        if z > a:
            yield batch.slice(a, z - a)


def _blocks(placed: DataFrame) -> DataFrame:
    """Blocks of (chunk_id, dl, terms, tfs, place), a row for each term of some ``WRITTEN`` postings; a range that two tasks share has two blocks of a term."""
    rows, most = placed.select(F.floor(F.col("place") / SPAN).cast("int").alias("span"), "chunk_id", F.col("dl").cast("int").alias("dl"), "terms", "tfs"), WRITTEN

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for b in _cut(whole, pc.list_value_length(whole.column(4)), most):
                held.append(b)
                n += len(b.column(4).flatten())
                if n >= most:
                    yield _packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield _packed(pa.Table.from_batches(held))

    return rows.mapInArrow(work, TABLES["blocks"])


def _packed(chunks: pa.Table) -> pa.RecordBatch:
    """Rows of blocks of chunks (span, chunk_id, dl, terms, tfs) that all have terms.

    The peaks of a block are those postings that no other one beats in both frequency and length, so the largest score of the block is
    one of theirs, whatever the average length. ``starts`` and ``tops`` say where a block's postings and peaks begin in its row.
    """
    chunks = chunks.sort_by([("span", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
    spans, ids, dls = (chunks.column(c).to_numpy() for c in range(3))
    words = pc.split_pattern(chunks.column(3).combine_chunks(), " ").flatten().dictionary_encode()
    lists = chunks.column(4).combine_chunks()
    at = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
    code, tf = words.indices.to_numpy().astype(np.int64), lists.flatten().to_numpy()
    by = np.argsort(code * len(ids) + at)
    code, at, tf = code[by], at[by], tf[by]
    new = code[1:] != code[:-1]
    rows = np.flatnonzero(np.r_[True, new])
    first = np.flatnonzero(np.r_[True, new | (spans[at[1:]] != spans[at[:-1]])])
    dl, block = dls[at], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))

    order = np.lexsort((-tf, dl, block))
    high = block[order] * (int(tf.max()) + 1) + tf[order]  # the largest so far is one of the own block
    peak = order[np.r_[True, high[1:] > np.maximum.accumulate(high)[:-1]]]
    top = np.r_[0, np.cumsum(np.bincount(block[peak], minlength=len(first)))]

    ends = np.r_[rows, len(code)]
    edges = np.searchsorted(first, ends)  # the blocks of each row
    row = np.repeat(np.arange(len(rows)), np.diff(edges))

    def lists_of(at: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))

    each = [lists_of(edges, x) for x in (spans[at[first]], first - rows[row], top[:-1] - top[edges[row]])]
    peaks = [lists_of(top[edges], x[peak]) for x in (tf, dl)]
    postings = [lists_of(ends, ids[at], pa.int64()), lists_of(ends, tf), lists_of(ends, dl)]
    return pa.record_batch([words.dictionary.take(pa.array(code[rows])), pa.array(np.diff(ends), pa.int32()), *each, *peaks, *postings], ["term", "n", "spans", "starts", "tops", "peak_tfs", "peak_dls", "ids", "tfs", "dls"])


def _part_of(values: str, starts: str, i: Column) -> Column:
    """The values of a row's block ``i``: up to the next one's start, or all that are left."""
    start = F.get(starts, i)
    return F.slice(values, start + 1, F.coalesce(F.get(starts, i + 1), F.size(values)) - start)


def _heads(blocks: DataFrame) -> DataFrame:
    """(segment, term, span, peaks, n), a row for each block."""

    def head(span: Column, i: Column) -> Column:
        peaks = F.arrays_zip(_part_of("peak_tfs", "tops", i).alias("tf"), _part_of("peak_dls", "tops", i).alias("dl"))
        n = F.coalesce(F.get("starts", i + 1), F.col("n")) - F.get("starts", i)
        return F.struct(span.alias("span"), peaks.alias("peaks"), n.alias("n"))

    return blocks.select("segment", "term", F.inline(F.transform("spans", head)))


def _ranges(blocks: DataFrame) -> DataFrame:
    """(segment, term, span, ids, tfs, dls), a row for each block."""
    own = lambda i: [_part_of(c, "starts", i).alias(c) for c in ("ids", "tfs", "dls")]
    return blocks.select("segment", "term", F.inline(F.transform("spans", lambda span, i: F.struct(span.alias("span"), *own(i)))))


def _postings(blocks: DataFrame) -> DataFrame:
    """(segment, term, chunk_id, tf, dl) of blocks."""
    rows = blocks.select("segment", "term", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
    return rows.select("segment", "term", "chunk_id", *(F.col(c).cast("long").alias(c) for c in ("tf", "dl")))


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")


#: A text defines names only where one of these is among its terms.
DEFINE = sorted({k.split()[-1] for k in R.KEYWORDS.split("|")} | {k.split()[0].lower() for k in R.SQL_KEYWORDS.split("|")})


def _names(chunks: DataFrame) -> DataFrame:
    """(name, symbol, folded, chunk_id, file): the names that chunks define, in lower case as the key."""
    able = chunks.filter(F.arrays_overlap(F.split("terms", " "), F.array(*map(F.lit, DEFINE))))
    return R.definitions(able).select(F.lower("symbol").alias("name"), "symbol", "folded", "chunk_id", "file")
