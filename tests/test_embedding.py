"""WordPiece, static encoding, caches and Markdown chunks."""

import math

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import chunking, embedding

VOCAB = {"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "a": 4, ".": 5, "[CLS]": 6}


def test_wordpiece():
    assert embedding.wordpiece("Unaffable a. [CLS] xyz Ünaff", VOCAB) == [1, 2, 3, 4, 5, 6, 0, 1, 2]
    assert embedding.wordpiece("", VOCAB) == [] and embedding.wordpiece("a" * 101, VOCAB) == [0]


def test_encoding(spark):
    texts = spark.createDataFrame([(1, "a a un"), (2, ""), (3, "zz")], "chunk_id long, text string")
    mapping = spark.createDataFrame([(4, 0), (1, 1)], "token_id int, row_id int")
    weights = spark.createDataFrame([(4, 1.0), (1, 2.0)], "token_id int, weight double")
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row_id int, row array<double>")
    got = {r.chunk_id: r.vec for r in embedding.encoded(texts, VOCAB, mapping, weights, rows).collect()}
    assert set(got) == {1} and all(math.isclose(x, math.sqrt(0.5)) for x in got[1])


def test_cache_and_scorer(spark):
    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    cache = texts.filter("text = 'x'").distinct().select(F.sha2("text", 256).alias("hash"), F.lit(1).alias("vec"))
    out = embedding.with_cache(texts, cache, lambda d: d.select("hash", F.lit(2).alias("vec")))
    assert sorted(r.vec for r in out.collect()) == [1, 2]
    hits = spark.createDataFrame([("a", "aa"), ("b", "x")], "query string, text string")
    got = embedding.reranked(hits, lambda q, t: pd.Series([float(y.count(x)) for x, y in zip(q, t)])).collect()
    assert [r.neural for r in got] == [2.0, 0.0]


def test_markdown():
    text = "---\nt: 1\n---\n# A\ntext\n```\n# not a heading\n```\n## B\n- x\n  y\n- z\n\n|a|\n|b|\n"
    parts = chunking.pack_markdown(text, 1500)
    assert "".join(p[2] for p in parts) == text
    assert [p[2].split("\n")[0] for p in parts] == ["---", "# A", "## B"]
    assert "".join(p[2] for p in chunking.pack_markdown("word\n" * 900, 1500)) == "word\n" * 900
