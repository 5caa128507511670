"""Stored indexes: chunks, postings, terms and vectors as Parquet, in versions with a meta row that is checked on load.

A version is written whole into a folder of its own before its meta row, so a reader meets the
last whole version or the one before, never a mixture.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R

VERSION = 2
BUCKETS = 64
MODES = ("bm25", "semantic", "hybrid", "hybrid-rerank")


class IndexError_(Exception):
    """A stored index that can't be used."""


class VersionMismatch(IndexError_):
    pass


class ConfigMismatch(IndexError_):
    pass


class Damaged(IndexError_):
    pass


def resolve_mode(mode: str, has_vectors: bool, has_scorer: bool) -> str:
    """The mode that can be served: without vectors bm25, without a scorer plain hybrid."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode != "bm25" and not has_vectors:
        return "bm25"
    return "hybrid" if mode == "hybrid-rerank" and not has_scorer else mode


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session may make its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="millrace-index-"))


def kept(rows: DataFrame, tag: str) -> DataFrame:
    """Rows that are used more than once, written to the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/millrace-{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class Stored(R.Index):
    """Postings and terms in buckets by term hash; a batch reads the buckets of its terms only."""

    buckets = BUCKETS

    def of(self, wanted: DataFrame) -> R.Index:
        names = wanted.select("term", _bucket(self.buckets).alias("bucket"))
        near = F.broadcast(names.select("bucket").distinct())  # at most so many rows as there are buckets
        meet = lambda t: t.join(near, "bucket", "left_semi").join(names.select("term"), "term", "left_semi").drop("bucket")
        return R.Index(meet(self.postings), meet(self.terms), self.stats)


def save(chunks: DataFrame, path: str, config: str, vectors: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write a new version of chunks, postings, terms, statistics and vectors; the meta row last."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    at = f"{path}/{name}"
    chunks.write.parquet(f"{at}/chunks")
    index = R.scanned(spark.read.parquet(f"{at}/chunks"))
    index.postings.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
    post = spark.read.schema(f"{_fields(index.postings)}, bucket int").parquet(f"{at}/postings")
    post.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
    index.stats.coalesce(1).write.parquet(f"{at}/stats")
    if vectors is not None:
        vectors.write.parquet(f"{at}/vectors")
    n = spark.read.parquet(f"{at}/chunks").count()
    last = max((r.number for r in _versions(spark, path)), default=0)
    row = [(VERSION, config, n, post.count(), vectors is not None, buckets, last + 1, name)]
    spark.createDataFrame(row, "version int, config string, chunks long, postings long, vectors boolean, buckets int, number int, name string").coalesce(1).write.mode("append").parquet(f"{path}/_meta")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _versions(spark: SparkSession, path: str) -> list:
    """The meta rows, one a version; none where nothing is there yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return []
    return spark.read.parquet(f"{path}/_meta").collect()


def load(spark: SparkSession, path: str, config: str) -> dict[str, DataFrame | Stored]:
    """The last version's chunks, vectors and index; a typed error where its version, config or row counts are not as written."""
    try:
        meta = max(_versions(spark, path), key=lambda r: r.number)
    except Exception as e:
        raise Damaged(f"no readable meta row in {path}") from e
    if meta.version != VERSION:
        raise VersionMismatch(f"version {meta.version}, expected {VERSION}")
    if meta.config != config:
        raise ConfigMismatch(f"config {meta.config}, expected {config}")
    try:
        read = {t: spark.read.parquet(f"{path}/{meta.name}/{t}") for t in ("chunks", "postings", "terms", "stats", *(["vectors"] if meta.vectors else []))}
        whole = read["chunks"].count() == meta.chunks and read["postings"].count() == meta.postings
    except Exception as e:
        raise Damaged(f"tables are missing in {path}") from e
    if not whole:
        raise Damaged("rows are missing")
    index = Stored(read.pop("postings"), read.pop("terms"), read.pop("stats"))
    index.buckets = meta.buckets
    return read | {"index": index}


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines usage log; lines that do not parse are skipped."""
    return spark.read.schema("ts double, call string, results int, snippet_chars long, file_chars long").json(path, mode="DROPMALFORMED")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance rows of a JSON-lines file; only positive ones."""
    return spark.read.schema("query_id string, doc_id string, score double").json(path).filter("score > 0")


def jdbc_columns(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Columns of a live database's catalogue over JDBC (needs its driver on the class path)."""
    query = "(SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable FROM information_schema.columns) AS c"
    rows = spark.read.jdbc(url, query, properties=properties or {})
    return rows.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("ordinal_position").alias("ordinal"), F.col("column_name").alias("column"), F.col("data_type").alias("type"), (F.col("is_nullable") == "NO").alias("not_null"))
