"""The cache of vectors: hits and misses, recency, eviction, scopes, damage and two writers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import vectors as V
from millrace.sources.index import Damaged


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def of_length(asked):
    """Encodes a text as its length, twice."""

    def encode(texts):
        n = F.length("text").cast("float")
        out = texts.select("hash", F.array(n, n * 2).alias("vec"))
        asked.append(sorted(r.vec[0] for r in out.collect()))
        return out

    return encode


def made(spark, tmp_path, limit=4, scope="m/f32/dim=2"):
    return V.VectorCache(spark, str(tmp_path / "cache"), scope, limit)


def held(cache):
    state = cache.state()
    return {r.vec[0]: r.used for r in cache.recency(state).join(cache.vectors(state), "hash").collect()}


def test_misses_are_encoded_once_and_the_oldest_go(spark, tmp_path):
    cache, asked = made(spark, tmp_path), []
    encode = of_length(asked)
    assert sorted(r.vec[0] for r in cache.get(frame(spark, ["a", "bb", "bb", None, "ccc"]), encode).collect()) == [1, 2, 3]
    assert sorted(r.vec[0] for r in cache.get(frame(spark, ["bb", "dddd", ""]), encode).collect()) == [0, 2, 4]
    assert cache.get(frame(spark, ["a"]), encode).count() == 1
    assert asked == [[1, 2, 3], [0, 4], []]
    assert held(cache) == {1: 3, 2: 2, 3: 1, 0: 2, 4: 2}
    assert cache.evict() == 1
    assert held(cache) == {1: 3, 2: 2, 0: 2, 4: 2}  # recency outlives eviction
    assert len(cache.state()["segments"]) == 1 and cache.evict() == 0
    cache.get(frame(spark, ["ccc"]), encode)
    assert asked[-1] == [3]
    cache.limit = 0
    assert cache.evict() == 5 and held(cache) == {}
    assert cache.get(frame(spark, []), encode).count() == 0


def test_ties_go_by_hash(spark, tmp_path):
    cache = made(spark, tmp_path, limit=3)
    texts = ["x" * n for n in range(1, 9)]
    hashes = sorted(r.hash for r in cache.get(frame(spark, texts), of_length([])).collect())
    cache.evict()
    assert sorted(r.hash for r in cache.recency().collect()) == hashes[:3]


def test_another_scope_starts_empty_and_is_never_mixed(spark, tmp_path):
    asked = []
    made(spark, tmp_path).get(frame(spark, ["a", "bb"]), of_length(asked))
    other = made(spark, tmp_path, scope=V.scope_key("m", "int8", 2))
    assert other.vectors().count() == 0
    other.get(frame(spark, ["a"]), of_length(asked))
    assert asked == [[1, 2], [1]] and held(other) == {1: 2}


def test_damage_is_seen(spark, tmp_path):
    cache = made(spark, tmp_path)
    cache.get(frame(spark, ["a", "bb", "ccc"]), of_length([]))
    cache.verify()
    folder = tmp_path / "cache" / "vecs" / f"segment={cache.state()['segments'][0]['name']}"
    for name in os.listdir(folder):
        os.remove(folder / name)
    with pytest.raises(Damaged):
        cache.verify()


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = made(spark, tmp_path), made(spark, tmp_path)
    whole = one.log._announce
    late = []

    def overtaken(manifest):
        if not late:  # the other writer takes the number first
            late.append(two.get(frame(spark, ["bb", "ccc"]), of_length([])).count())
        return whole(manifest)

    monkeypatch.setattr(one.log, "_announce", overtaken)
    assert one.get(frame(spark, ["a", "bb"]), of_length([])).count() == 2
    assert held(made(spark, tmp_path)) == {1: 2, 2: 2, 3: 1}


def test_neural_scores(spark, tmp_path):
    rnd = np.random.default_rng(5)
    texts = [f"t{'x' * i}" for i in range(6)]
    table = {V_hash: [float(x) for x in rnd.normal(size=2)] for V_hash in range(1, 12)}
    rows = spark.createDataFrame(list(table.items()), "n int, vec array<float>")
    hits = [(i, texts[i % 6], None if i == 11 else "q" * (i % 3 + 1), "extra") for i in range(12)]
    df = spark.createDataFrame(hits, "id int, text string, query string, qv string")
    out = V.neural_scores(df.drop("qv"), made(spark, tmp_path), lambda d: d.withColumn("n", F.length("text")).join(rows, "n").select("hash", "vec"))
    for r in out.collect():
        if r["query"] is None:
            assert r.neural == 0
        else:
            a, b = np.float32(table[len(r["query"])]).astype(float), np.float32(table[len(r.text)]).astype(float)
            assert r.neural == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
