"""Language identification by nearest centroid.

A text's vector counts its hashed 1- to 3-byte grams (ASCII letters lower-cased, runs of
anything but letters as one space), dampened by log, weighted by inverse document frequency
and normalised. Each language has several centroids, from spherical k-means over its
labelled texts. The nearest centroid by cosine names the language; ``rejected`` is true
where the cosine is below the ``REJECT`` quantile of that centroid's own texts.

The model is fitted on at most ``PER_LANGUAGE`` labelled texts of each language: those with
the smallest hash of id and text, so the sample is random, repeatable and bounded. Their
whole texts are used. Every language is learned, each in a task of its own; only its
``CENTROIDS`` vectors come to the driver, so what the driver holds depends on the number of
languages and not on the rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; where
nothing is labelled, all texts are ``und``; a null or empty label is no label; rows of
equal id and text count once in the sample, and are predicted one by one; of equally near
centroids the alphabetically first language wins; texts of any length are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

DIMS = 4096
#: Labelled texts of a language that are learned from at most; up to 1000 Spark limits groups before the shuffle.
PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 8
REJECT = 0.005
_letter = regex.compile(r"\p{L}").search
_CLASS = np.array([32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 91 else b for b in range(256)], np.uint8)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-byte grams of a whole text."""
    b = _CLASS[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    out = np.bincount(b & np.uint32(255), minlength=DIMS).astype(np.int64)
    for g in (two + np.uint32(1 << 24), three):
        out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def _labelled(docs: DataFrame, learn: Column) -> DataFrame:
    """A bounded sample of labelled texts as vectors: (lang, counts of grams as bytes)."""
    rows = docs.filter(learn & F.col("text").isNotNull() & (F.coalesce("lang", F.lit("")) != "")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = rows.select("lang", "h").distinct().withColumn("n", nth).filter(F.col("n") <= PER_LANGUAGE)
    edge = first.groupBy("lang").agg(F.max("h").alias("edge"))
    # a row for each language, as the model has; so texts are not shuffled before they are picked
    picked = rows.join(F.broadcast(edge), "lang").filter(F.col("h") <= F.col("edge")).dropDuplicates(["lang", "h"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                keep = [(lang, grams(t).astype(np.float32).tobytes()) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if _letter(t)]
                yield pa.record_batch([pa.array([x for x, _ in keep], pa.string()), pa.array([x for _, x in keep], pa.binary())], ["lang", "counts"])

    return picked.select("lang", "text").mapInArrow(work, "lang string, counts binary")


def _frequencies(sample: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS, np.int64)
        for b in batches:
            n += b.num_rows
            for x in b.column(0).to_pylist():
                df += np.frombuffer(x, np.float32) > 0
        yield pa.record_batch([pa.array(range(-1, DIMS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["i", "n"])

    got = {r.i: r.n for r in sample.select("counts").mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # DIMS + 1 rows
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(DIMS)], np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def clusters(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's unit vectors and their rejection cosines, by k-means on the sphere; starts are the farthest texts, so fits repeat."""
    c = unit(own.mean(0, keepdims=True))
    while len(c) < min(CENTROIDS, len(own)):
        c = np.vstack([c, own[(own @ c.T).max(1).argmin()]])
    for _ in range(ROUNDS):
        near = (own @ c.T).argmax(1)
        c = np.vstack([unit(own[near == j].mean(0, keepdims=True)) if (near == j).any() else c[j : j + 1] for j in range(len(c))])
    cosine = own @ c.T
    keep, floor = [], []
    for j in range(len(c)):
        mine = cosine[cosine.argmax(1) == j, j]
        if len(mine) >= 3 or len(own) < 12:  # a centroid of stray texts attracts other languages
            keep.append(j)
            floor.append(float(np.quantile(mine, REJECT)) if len(mine) else 0.0)
    return c[keep].astype(np.float32), np.array(floor)


class Centroids:
    """The model: languages, the language and the rejection cosine of each centroid, and weights of the grams."""

    def __init__(self, rows: list[tuple[str, bytes, float]], idf: np.ndarray):
        rows = sorted(rows)
        self.langs, self.idf = [lang for lang, _, _ in rows], idf
        self.centres = np.array([np.frombuffer(c, np.float32) for _, c, _ in rows])
        self.floor = np.array([f for _, _, f in rows])

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = vectors(counts, self.idf) @ self.centres.T
        best = near.argmax(1)
        return best, near[np.arange(len(best)), best]


def fit(sample: DataFrame) -> Centroids | None:
    """The model of a sample (lang, counts): weights over all of it, then each language in its own task."""
    n, df = _frequencies(sample)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def work(rows: pa.Table) -> pa.Table:
        counts = np.array([np.frombuffer(x, np.float32) for x in sorted(rows.column("counts").to_pylist())])  # in an order of their own
        c, floor = clusters(vectors(counts, idf))
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(c), pa.string()), "centre": pa.array([x.tobytes() for x in c], pa.binary()), "floor": pa.array(floor, pa.float64())})

    got = sample.groupBy("lang").applyInArrow(work, "lang string, centre binary, floor double").collect()  # CENTROIDS rows a language
    return Centroids([(r.lang, r.centre, r.floor) for r in got], idf)


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each (doc_id, text, lang); ``learn`` picks the rows to learn from."""
    sample = stored(_labelled(docs, learn), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample))
    dropped(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(1).to_pylist()
                pred, score, far = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                at = [j for j, t in enumerate(texts) if t and _letter(t)] if model else []
                if at:
                    best, cosine = model.nearest(np.array([grams(texts[j]) for j in at], np.float32))
                    for j, i, c in zip(at, best.tolist(), cosine.tolist(), strict=True):
                        pred[j], score[j], far[j] = model.langs[i], min(1.0, max(0.0, c)), bool(c < model.floor[i])
                yield pa.record_batch([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    out = identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
