"""A cache of texts' vectors that is kept between batches: by scope, merged on read, the least recently used go first.

A batch adds one segment: the vectors it had to encode, and the hashes it asked for. Nothing that is there
is written again; when a hash was last used is the number of the last segment that names it. Eviction writes one
new segment of what stays: recencies are cut by ranges, so only ranges that stay are read, and no
task sees all. Manifests, their numbers and two writers are those of :mod:`segments`.

Vectors of another scope (model, precision, width) are never served: a batch in a new scope starts an empty cache.
Null texts are left out. Hashes of one batch are equally recent; among them the smaller hash stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import Ordered
from .index import ConfigMismatch, Damaged, kept
from .segments import FORMAT, Conflict, Segments

VECS, USES = "hash string, vec array<float>", "hash string, used bigint"
Encode = Callable[[DataFrame], DataFrame]


def scope_key(model: str, precision: str, width: int) -> str:
    return f"{model}/{precision}/dim={width}"


class VectorCache:
    """``encode`` gives (hash, vec) for (hash, text); ``limit`` is the number of vectors that :meth:`evict` leaves."""

    def __init__(self, spark: SparkSession, root: str, scope: str, limit: int = 1_000_000):
        self.spark, self.root, self.scope, self.limit = spark, root.rstrip("/"), scope, limit
        self.log = Segments(spark, self.root, scope)

    def state(self) -> dict:
        """The last manifest; an empty one after it where that is of another scope."""
        try:
            return self.log.state()
        except ConfigMismatch:
            return {"format": FORMAT, "config": self.scope, "number": self.log._numbers()[-1], "segments": []}

    def _read(self, state: dict, part: str, fields: str) -> DataFrame:
        paths = [f"{self.root}/{part}/segment={s['name']}" for s in state["segments"]]
        schema = f"{fields}, segment string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}").parquet(*paths)

    def recency(self, state: dict | None = None) -> DataFrame:
        """(hash, used): the number of the last batch that asked for it."""
        state = state or self.state()
        number = F.lit(None).cast("long")
        for s in state["segments"]:
            number = F.when(F.col("segment") == s["name"], F.lit(s["number"])).otherwise(number)
        uses = self._read(state, "uses", USES).select("hash", F.coalesce("used", number).alias("used"))
        return uses.groupBy("hash").agg(F.max("used").alias("used"))

    def vectors(self, state: dict | None = None) -> DataFrame:
        """(hash, vec), one row a hash; two writers at a time may both have encoded it."""
        return self._read(state or self.state(), "vecs", VECS).groupBy("hash").agg(F.max_by("vec", "segment").alias("vec"))

    def _commit(self, vecs: DataFrame, uses: DataFrame, over: dict | None, tries: int = 5) -> dict:
        """Write one segment and give it a number: beside the others, or in place of those of ``over``."""
        name = uuid.uuid4().hex
        vecs.select("hash", F.col("vec").cast("array<float>").alias("vec")).write.parquet(f"{self.root}/vecs/segment={name}")
        uses.select("hash", F.col("used").cast("long").alias("used")).write.parquet(f"{self.root}/uses/segment={name}")
        own = {"name": name, **self._counted(name)}
        for _ in range(tries):
            base = self.state()
            gone = {s["name"] for s in over["segments"]} if over else set()
            if not gone <= {s["name"] for s in base["segments"]}:
                break
            number = base["number"] + 1
            manifest = {"format": FORMAT, "config": self.scope, "number": number, "segments": [s for s in base["segments"] if s["name"] not in gone] + [own | {"number": number}]}
            if self.log._announce(manifest):
                return manifest
        raise Conflict(f"other writers changed {self.root}")

    def _counted(self, name: str) -> dict:
        one = {"segments": [{"name": name}]}
        v = self._read(one, "vecs", VECS).agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(hash, vec))"), F.lit(0)).alias("sum")).first()
        u = self._read(one, "uses", USES).agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(hash, used))"), F.lit(0)).alias("sum")).first()
        return {"vecs": v.n, "uses": u.n, "sum": v.sum ^ u.sum}

    def verify(self) -> None:
        """Compare every segment with its manifest."""
        for s in self.state()["segments"]:
            try:
                found = self._counted(s["name"])
            except Exception as e:
                raise Damaged(f"segment {s['name']} is not readable") from e
            if any(found[k] != s[k] for k in found):
                raise Damaged(f"segment {s['name']} is {found}")

    def get(self, texts: DataFrame, encode: Encode) -> DataFrame:
        """(hash, vec) for each distinct text of (text): what is cached as it is, the rest encoded once and kept."""
        asked = texts.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
        known = self._read(self.state(), "vecs", VECS).select("hash")
        fresh = encode(asked.join(known, "hash", "left_anti"))
        done = self._commit(fresh, asked.select("hash", F.lit(None).alias("used")), None)
        return self.vectors(done).join(self._read({"segments": done["segments"][-1:]}, "uses", USES).select("hash"), "hash", "left_semi")

    def evict(self) -> int:
        """Leave the ``limit`` vectors used last, in one segment; returns how many went."""
        state = self.state()
        ranked = Ordered(self.recency(state), [F.desc("used"), F.asc("hash")])
        stay = ranked.page(0, self.limit)
        self._commit(self.vectors(state).join(stay.select("hash"), "hash", "left_semi"), stay, state)
        return max(ranked.total - self.limit, 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def neural_scores(hits: DataFrame, cache: VectorCache, encode: Encode) -> DataFrame:
    """Hits (query, text, ..) with the column ``neural``: the cosine of the two encodings, each text encoded once and cached."""
    hits = kept(hits, "hits")  # they are read for the texts to encode, for the cache's log and for the scores
    every = hits.select("text").unionByName(hits.select(F.col("query").alias("text")))
    vecs = cache.get(every, encode)
    of = lambda name: vecs.select(F.col("hash").alias(f"_{name}"), F.col("vec").alias(name))
    x = hits.withColumn("_qv", F.sha2("query", 256)).withColumn("_tv", F.sha2("text", 256))
    x = x.join(of("qv"), "_qv", "left").join(of("tv"), "_tv", "left")
    return x.select(*[F.col(f"`{c}`") for c in hits.columns], F.coalesce(cosine(F.col("qv"), F.col("tv")), F.lit(0.0)).alias("neural"))
