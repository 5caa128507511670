"""How the sources of a language differ in their terms, by SQL over shards.

Each task counts the terms of its documents in DuckDB, by language, source and term, before
anything is shuffled. Rows are dealt to shards by language and term, sorted, and read in
chunks of whole terms, so a shard may be of any size. DuckDB adds up a chunk and keeps the
terms in at least ``LEAST`` documents of their language. Spark adds the totals of groups
and languages to the kept counts and deals them again, and DuckDB makes the partial sums of a
chunk: the pairs of sources that share a term, the histogram of each group's counts, and a
group's best terms. Spark merges these, adds what terms in one or neither of two sources
give, and ranks.

A term that two sources a and b share adds f(pa, pb) - f(pa, b0) - f(a0, pb) + f(a0, b0),
where a0 and b0 are the shares of a count of 0; a term of a alone and one of b alone come
from the histograms; the rest is f(a0, b0) for all kept terms. So the work follows the
counts that occur, not terms times sources squared. All numbers are whole.

Defined results: null text, lang and source are read as ''; rows are documents, repeated
ones count each time; a group without terms has count 0 for each kept term; a language
without kept terms has value 0 for its pairs and no terms; a language of one source has
no pairs; ties go to the smaller item by its bytes; an empty table gives an empty result;
other columns are ignored. A text is in memory whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Documents of a language that a kept term is in at least.
LEAST = 3
#: Ranks of part ``term``.
RANKS = 200
#: What a share of 1 is as a whole number.
UNIT = 1_000_000_000
#: Bytes of text that are counted at a time, rows that a task holds before it sends them, rows of a chunk.
TEXT, HELD, CHUNK = 8_000_000, 1_000_000, 500_000
#: A term: letters A-Z and a-z and all beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNTS = f"""
WITH t AS (SELECT lang, source, i, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM batch),
d AS (SELECT lang, source, i, term, count(*) AS n FROM t GROUP BY ALL)
INSERT INTO part SELECT lang, source, term, CAST(sum(n) AS BIGINT), count(*) FROM d GROUP BY lang, source, term
"""
FOLD = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM {} GROUP BY ALL"
KEPT = """
WITH s AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM chunk GROUP BY ALL),
k AS (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS df FROM s QUALIFY df >= {least})
SELECT lang, source, term, CAST(n AS BIGINT) AS n, false AS whole FROM k
UNION ALL SELECT lang, '', term, CAST(sum(n) AS BIGINT), true FROM k GROUP BY lang, term
"""
SHARES = """
CREATE OR REPLACE TEMP TABLE share AS
SELECT lang, source, term, n, whole, CAST(1 + ({unit}::HUGEINT * (n + 1)) // (total + kinds) AS BIGINT) AS p,
  1 + {unit} // (total + kinds) AS none FROM chunk
"""
PARTS = """
WITH own AS (SELECT * FROM share WHERE NOT whole),
pairs AS (
  SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(0 AS BIGINT) AS n,
    CAST(sum(CAST((a.p - b.p) * (a.p - b.p) // b.p AS HUGEINT) - (a.p - b.none) * (a.p - b.none) // b.none
      - (a.none - b.p) * (a.none - b.p) // b.p + (a.none - b.none) * (a.none - b.none) // b.none) AS DECIMAL(38, 0)) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), counts AS (
  SELECT 'count' AS part, lang, source, '' AS item, n, CAST(count(*) AS DECIMAL(38, 0)) AS value FROM own GROUP BY ALL
), terms AS (
  SELECT 'term' AS part, a.lang, a.source, a.term AS item, CAST(0 AS BIGINT) AS n, CAST((a.p - q.p) * (a.p - q.p) // q.p AS DECIMAL(38, 0)) AS value
  FROM own a JOIN share q ON q.whole AND a.lang = q.lang AND a.term = q.term WHERE a.p > q.p
  QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY value DESC, item) <= {ranks}
)
SELECT * FROM pairs UNION ALL SELECT * FROM counts UNION ALL SELECT * FROM terms
"""
OUT = "part string, lang string, source string, item string, n long, value decimal(38,0)"


def _database():
    """A database in memory, one thread, that does not write to the worker's disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _done(con, sql: str) -> list[tuple]:
    """Run a statement to its end."""
    return con.execute(sql).fetchall()


def _rows(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches(max_chunksize=100_000)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the task's documents, a row for each term of a group, or a few."""
    con = _database()
    _done(con, "CREATE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    for batch in batches:
        size = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("text")), pa.int64())).to_pylist()
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and size[end] - (size[at - 1] if at else 0) <= TEXT:
                end += 1
            some = pa.Table.from_batches([batch.slice(at, end - at)])
            con.register("batch", some.append_column("i", pa.array(range(end - at), pa.int32())))
            _done(con, COUNTS)
            at = end
            if _done(con, "SELECT count(*) FROM part")[0][0] > HELD:
                _done(con, f"CREATE OR REPLACE TABLE part AS {FOLD.format('part')}")
                if _done(con, "SELECT count(*) FROM part")[0][0] > HELD // 2:
                    yield from _rows(con, "SELECT * FROM part")
                    _done(con, "DELETE FROM part")
    yield from _rows(con, FOLD.format("part"))
    con.close()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by lang and term in chunks of whole terms."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held)
        last = pc.and_(pc.equal(rows.column("lang"), rows.column("lang")[-1]), pc.equal(rows.column("term"), rows.column("term")[-1]))
        left = pc.sum(last).as_py()
        if left < rows.num_rows:
            yield rows.slice(0, rows.num_rows - left)
            rows = rows.slice(rows.num_rows - left)
        held = rows.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _queried(*queries: str):
    """Each chunk as table ``chunk`` through the queries; the rows of the last one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        for chunk in _chunks(batches):
            con.register("chunk", chunk)
            for q in queries[:-1]:
                _done(con, q)
            yield from _rows(con, queries[-1])
        con.close()

    return work


def _by_term(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term")


def _share(n: Column | int, group: str = "") -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kinds)) of a group's columns; 1 without any kept term."""
    whole = (F.col(f"{group}total") + F.col(f"{group}kinds")).cast("decimal(20,0)")
    n = (n if isinstance(n, Column) else F.lit(n)).cast("decimal(19,0)")
    return F.coalesce(F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1), F.when(whole > 0, whole)), F.lit(0)) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(19,0)")


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for (lang, source, text)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    kept = stored(_by_term(counted).mapInArrow(_queried(KEPT.format(least=least)), "lang string, source string, term string, n long, whole boolean"), "terms")
    totals = kept.groupBy("lang", "source", "whole").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    langs = totals.filter("whole").select("lang", "source", "whole", "total", "kinds")
    groups = rows.select("lang", "source").distinct().join(totals.filter(~F.col("whole")).select("lang", "source", "total"), ["lang", "source"], "left")
    groups = groups.join(langs.select("lang", "kinds"), "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    groups = stored(groups, "groups")
    sides = groups.select("lang", "source", F.lit(False).alias("whole"), "total", "kinds").unionByName(langs)
    dealt = _by_term(kept.join(sides, ["lang", "source", "whole"]))
    parts = stored(dealt.mapInArrow(_queried(SHARES.format(unit=UNIT), PARTS.format(ranks=ranks)), OUT), "parts")

    a = groups.select("lang", "source", F.col("total").alias("a_total"), F.col("kinds").alias("a_kinds"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("b_total"), F.col("kinds").alias("b_kinds"))
    pairs = a.join(b, "lang").filter(F.col("source") != F.col("item"))
    none_a, none_b = _share(0, "a_"), _share(0, "b_")
    base = pairs.select("lang", "source", "item", (F.col("a_kinds").cast("decimal(18,0)") * _gap(none_a, none_b)).alias("value"))
    counts = parts.filter("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").cast("decimal(18,0)").alias("times"))
    p = _share(F.col("n"), "a_")
    alone = counts.join(pairs, ["lang", "source"]).select(
        "lang",
        F.inline(F.array(
            F.struct("source", "item", (F.col("times") * (_gap(p, none_b) - _gap(none_a, none_b)).cast("decimal(20,0)")).alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (_gap(none_b, p) - _gap(none_b, none_a)).cast("decimal(20,0)")).alias("value")),
        )),
    )
    every = [x.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")) for x in (base, alone, parts.filter("part = 'pair'"))]
    paired = every[0].unionAll(every[1]).unionAll(every[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = paired.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"))
    both = both.unionAll(parts.filter("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3
), v AS (
  SELECT lang, count(*) AS kinds, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.kinds, v.total AS whole_total
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 1)) // (total + kinds) AS HUGEINT) AS p,
    CAST(1 + (1000000000 * (whole + 1)) // (whole_total + kinds) AS HUGEINT) AS q FROM f
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
