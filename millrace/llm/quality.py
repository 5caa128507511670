"""Quality rules: base limits, then robust multivariate outliers, with Spark expressions only.

Each document has a vector of four transformed statistics in thousandths, kept as whole
numbers so that sums do not depend on the order of rows: log mean word length, and the roots
of the shares of symbols and of capitals among word characters and of repeated words.
For each language and source the minimum-covariance-determinant estimate is sought from
three starts around the medians: the median deviations, the covariance of the directions
(spatial signs) and that of the values cut at twice the deviations. From each start,
concentration steps go on: the three quarters of the documents that lie nearest give the next
mean and covariance, ``STEPS`` times. The start whose last covariance has the least
determinant is the estimate. A document is rejected if its squared Mahalanobis distance to it
is over ``CUTOFF``. The quarter is cut at a thousandth of the distance, so that it needs
counts only.

Every step is an aggregate of counts and moments; hot groups are pre-aggregated and
documents meet their group's row through salted keys. Groups of fewer than ``LEAST``
documents use those of their language that are as small, and if these are too few, all such.
``FLOOR`` squared is added to each variance, so a statistic that is nearly constant does
not reject documents for tiny differences.

A group of fewer than ``LEAST`` documents has no covariance of its own to speak of; that its
documents are judged by a wider group is a rule of the method here, not a limit of the work.

Defined results: a null or empty text has no words and fails the base limits; null
languages and sources are values of their own; repeated rows are judged one by one;
ties in distance share a verdict; texts of any length are read whole; empty tables give empty results; other columns of the
input are ignored by :func:`quality_stats` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, let, stored, table

LEAST = 50
FLOOR = (120, 60, 60, 120)
STEPS = 3
STARTS = 3
#: Makes the covariance of the nearest three quarters consistent for normal data in 4 dimensions.
CONSISTENT = 1.485
CUTOFF = 25.0
SALTS = 16
#: Group tables of up to so many rows (a few hundred bytes each) are broadcast.
BROADCAST_ROWS = 20_000
X = ("x1", "x2", "x3", "x4")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
CENTRE, FACTOR = [f"m{i + 1}" for i in range(4)], [f"l{i + 1}{j + 1}" for i, j in PAIRS]


def _windows(h: Column) -> Column:
    """Hashes of the 5-word windows, from an array of word hashes."""
    tail = lambda a, k: F.slice(a, k + 1, F.size(a))
    mix = lambda a, b: F.xxhash64(a, b)
    two = F.zip_with(h, tail(h, 1), mix)
    return let(two, lambda p: F.slice(F.zip_with(F.zip_with(p, tail(p, 2), mix), tail(h, 4), mix), 1, F.greatest(F.size(h) - 4, F.lit(0))))


def _covered(places: Column) -> Column:
    """Words in 5-word windows that start at the ascending ``places``."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def repeated_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more in ``words``.

    Windows are compared by 64-bit hashes (two windows of one text of 100,000 words collide once in
    a few billion such texts); only texts in which some hash occurs twice are looked at more closely.
    """

    def twice(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.array_sort(F.array_compact(marked))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(F.array_sort(pairs), twice), _covered)).otherwise(0)

    return F.when(F.size(words) < 6, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), _windows), count)).cast("long")


def text_stats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of each row as struct ``row``, the contract's counts, base_failed and the vector."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("of"))
    split = given.select(
        "row", "of",
        F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    counted = split.select(
        "row", "of", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    whole = lambda x: F.floor(1000 * x + F.lit(0.5)).cast("long")
    share = lambda a, b: whole(F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1))))
    return counted.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        whole(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))).alias("x1"),
        share("n_symbols", "word_chars").alias("x2"),
        share("n_capitals", "word_chars").alias("x3"),
        share("n_repeat_words", "n_words").alias("x4"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """Each (lang, source) with the group whose estimate it uses."""
    sizes = rows.filter(~F.col("base_failed")).groupBy("of").count()
    small = sizes.filter(F.col("count") < LEAST).groupBy(F.col("of.lang").alias("small_lang")).agg(F.sum("count").alias("small_count"))
    joined = sizes.join(small, F.col("of.lang").eqNullSafe(F.col("small_lang")), "left")
    name = F.when(F.col("count") >= LEAST, F.struct(F.lit(2).alias("level"), F.col("of.lang").alias("lang"), F.col("of.source").alias("source")))
    name = name.when(F.col("small_count") >= LEAST, F.struct(F.lit(1).alias("level"), F.col("of.lang").alias("lang"), F.lit(None).cast("string").alias("source")))
    name = name.otherwise(F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    return joined.select("of", F.to_json(name).alias("g"))


def _meet(rows: DataFrame, groups: DataFrame, key: str, few: bool, how: str = "inner") -> DataFrame:
    """Join rows to their group's row: a table counted to be small is broadcast, a larger one met by salted keys."""
    if few:
        return rows.join(F.broadcast(groups), key, how)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [key, "salt"], how)


def _distance(rows: DataFrame) -> DataFrame:
    """d2 from the centre m1.. and the Cholesky factor l11.. in the row."""
    for i in range(4):
        rest = F.col(X[i]) - F.col(f"m{i + 1}")
        for j in range(i):
            rest = rest - F.col(f"l{i + 1}{j + 1}") * F.col(f"y{j + 1}")
        rows = rows.withColumn(f"y{i + 1}", rest / F.col(f"l{i + 1}{i + 1}"))
    return rows.withColumn("d2", sum((F.col(f"y{i + 1}") * F.col(f"y{i + 1}") for i in range(1, 4)), F.col("y1") * F.col("y1")))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(X[i]).alias(f"s{i + 1}") for i in range(4)]
    products = [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i + 1}{j + 1}") for i, j in PAIRS]
    got = rows.groupBy("g", "start").agg(F.count("*").cast("double").alias("n"), *sums, *products)
    got = got.select("g", "start", "n", *[(F.col(f"s{i + 1}") / F.col("n")).alias(f"m{i + 1}") for i in range(4)], *[f"p{i + 1}{j + 1}" for i, j in PAIRS])
    cov = {(i, j): (F.col(f"p{i + 1}{j + 1}") / F.col("n") - F.col(f"m{i + 1}") * F.col(f"m{j + 1}")) * CONSISTENT for i, j in PAIRS}
    return _factor(got, cov).select("g", "start", *CENTRE, *FACTOR, "det")


def _factor(rows: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """The Cholesky factor of each row's covariance plus the floor, and the log of its determinant."""
    for i, j in PAIRS:
        c = cov[i, j] + float(FLOOR[i] ** 2 if i == j else 0)
        for k in range(j):
            c = c - F.col(f"l{i + 1}{k + 1}") * F.col(f"l{j + 1}{k + 1}")
        rows = rows.withColumn(f"l{i + 1}{j + 1}", F.sqrt(c) if i == j else c / F.col(f"l{j + 1}{j + 1}"))
    return rows.withColumn("det", sum((F.log(f"l{i}{i}") for i in range(2, 5)), F.log("l11")))


def _bin() -> Column:
    return F.floor(1000 * F.log(1 + F.col("d2"))).cast("long")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """(g, start, m.., l..): three first estimates of each group, all around its medians."""
    middle = stored(rows.groupBy("g").agg(*[F.expr(f"percentile({x}, 0.5)").alias(f"m{i + 1}") for i, x in enumerate(X)]), "middle")
    away = _meet(rows, middle, "g", few).groupBy("g").agg(*[F.expr(f"percentile(abs({x} - m{i + 1}), 0.5)").alias(f"a{i + 1}") for i, x in enumerate(X)])
    scale = [F.greatest(1.4826 * F.col(f"a{i + 1}"), F.lit(float(FLOOR[i]))).alias(f"a{i + 1}") for i in range(4)]
    spread = stored(middle.join(away, "g").select("g", *CENTRE, *scale), "spread")
    u = [((F.col(X[i]) - F.col(f"m{i + 1}")) / F.col(f"a{i + 1}")).alias(f"u{i + 1}") for i in range(4)]
    scaled = _meet(rows, spread, "g", few).select("g", *u)
    far = F.greatest(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(2, 5)), F.col("u1") * F.col("u1")), F.lit(1e-12))
    cut = lambda i: F.least(F.greatest(F.col(f"u{i + 1}"), F.lit(-2.0)), F.lit(2.0))
    whole = lambda x: F.sum(F.floor(1e6 * x + 0.5).cast("long"))  # whole numbers, for sums in any order
    signs = [whole(4 * F.col(f"u{i + 1}") * F.col(f"u{j + 1}") / far).alias(f"s{i + 1}{j + 1}") for i, j in PAIRS]
    cuts = [whole(cut(i) * cut(j)).alias(f"c{i + 1}{j + 1}") for i, j in PAIRS]
    sums = spread.join(scaled.groupBy("g").agg(F.count("*").alias("n"), *signs, *cuts), "g")
    sums = sums.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    cov = {}
    for i, j in PAIRS:
        part = F.when(F.col("start") == 0, F.lit(float(i == j))).when(F.col("start") == 1, F.col(f"s{i + 1}{j + 1}") / 1e6 / F.col("n")).otherwise(F.col(f"c{i + 1}{j + 1}") / 1e6 / F.col("n"))
        cov[i, j] = part * F.col(f"a{i + 1}") * F.col(f"a{j + 1}")
    return _factor(sums, cov).select("g", "start", *CENTRE, *FACTOR, "det")


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Centre and Cholesky factor of each group g, from rows (g, salt, x1..x4): of the starts the one that ends at the least determinant."""
    now = stored(_starts(rows, few), "mcd0")
    for step in range(STEPS):
        bins = _distance(_meet(rows, now, "g", few)).groupBy("g", "start", _bin().alias("b")).count()
        w = Window.partitionBy("g", "start")
        cut = bins.withColumn("cum", F.sum("count").over(w.orderBy("b"))).withColumn("all", F.sum("count").over(w))
        cut = cut.filter(4 * F.col("cum") >= 3 * F.col("all")).groupBy("g", "start").agg(F.min("b").alias("cut"))
        near = _distance(_meet(rows, stored(now.join(cut, ["g", "start"]), "cut"), "g", few)).filter(_bin() <= F.col("cut"))
        now = stored(_moments(near), f"mcd{step + 1}")
    # as whole numbers, so that starts that end at one estimate are a tie
    best = now.groupBy("g").agg(F.min(F.struct(F.floor(1e6 * F.col("det")).alias("det"), "start")).alias("best")).select("g", F.col("best.start").alias("start"))
    return now.join(best, ["g", "start"]).select("g", *CENTRE, *FACTOR)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with the counts, base_failed, d2 and kept."""
    counted = text_stats(docs, keep)
    rows = stored(counted.withColumn("salt", F.pmod(F.xxhash64("row", "n_words", "x1"), F.lit(SALTS)).cast("int")), "stats")
    groups = stored(_groups(rows).withColumn("of", F.to_json("of")), "groups")
    few = groups.count() <= BROADCAST_ROWS
    named = _meet(rows.withColumn("of", F.to_json("of")), groups, "of", few, "left")
    now = stored(estimates(named.filter(~F.col("base_failed")).select("g", "salt", *X), few), "mcd")
    seen = _distance(_meet(named, now, "g", few, "left"))
    return seen.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def quality_stats(docs: DataFrame) -> DataFrame:
    """The contract's columns for (doc_id, text, lang, source)."""
    return judge(docs, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns."""
    return judge(docs).filter("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_stats(table(spark, sf_dir, "documents"))
