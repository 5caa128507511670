"""Static embeddings: WordPiece tokens, weighted mean of model rows, caches and a pluggable scorer.

No model comes with the engine; the tables of one are inputs: ``vocab`` (token to id), ``mapping`` (id to row),
``weights`` (id to weight) and rows of floats.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking

LONGEST, UNKNOWN = 100, "[UNK]"
ADDED = ("[CLS]", "[SEP]", "[PAD]", "[MASK]", UNKNOWN)
_carve = re.compile("(" + "|".join(re.escape(a) for a in ADDED) + ")")
_words = re.compile(r"\w+|[^\w\s]")


def normalised(text: str) -> str:
    """Lower case without accents and control characters."""
    flat = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in flat if unicodedata.category(c) != "Mn" and (c.isspace() or not unicodedata.category(c).startswith("C")))


def wordpiece(text: str, vocab: dict[str, int]) -> list[int]:
    """Greedy longest match of each word from the left, ## before inner pieces; a word that can't be cut is unknown."""
    out = []
    for part in _carve.split(text):
        if part in ADDED:
            out.append(vocab.get(part, vocab[UNKNOWN]))
            continue
        for word in _words.findall(normalised(part)):
            pieces, at = [], 0
            while at < len(word) <= LONGEST:
                end = next((e for e in range(len(word), at, -1) if ("##" * (at > 0) + word[at:e]) in vocab), 0)
                if not end:
                    break
                pieces.append(vocab["##" * (at > 0) + word[at:end]])
                at = end
            out += pieces if at == len(word) and pieces else [vocab[UNKNOWN]]
    return out


def tokens(texts: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(chunk_id, token_id) of (chunk_id, text). The vocabulary is a model's, of fixed size."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t) for k, x in zip(b.chunk_id, b.text, strict=True) for t in wordpiece(x or "", shared.value)]
            yield pd.DataFrame(rows, columns=["chunk_id", "token_id"])

    return texts.select("chunk_id", "text").mapInPandas(work, "chunk_id long, token_id int")


def encoded(texts: DataFrame, vocab: dict[str, int], mapping: DataFrame, weights: DataFrame, rows: DataFrame) -> DataFrame:
    """(chunk_id, vec, norm): unit weighted mean in double; a text without tokens has no row."""
    t = tokens(texts, vocab).join(mapping, "token_id").join(weights, "token_id")
    return chunking.weighted_mean(t.select("chunk_id", F.col("row_id").alias("vec_id"), F.col("weight").alias("w")), rows.select(F.col("row_id").alias("vec_id"), F.col("row").alias("embedding")))


def with_cache(texts: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(hash, vec) of the texts: cached ones as they are, the others encoded once for each distinct text."""
    hashed = texts.select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    fresh = encode(hashed.join(cache.select("hash"), "hash", "left_anti"))
    return cache.join(hashed.select("hash"), "hash", "left_semi").select("hash", "vec").unionByName(fresh.select("hash", "vec"))


def reranked(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Hits (query, text, ..) with the column ``neural`` from a vectorised scorer of (query, text)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", neural double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(neural=score(b["query"], b["text"]))

    return hits.mapInPandas(work, schema)
