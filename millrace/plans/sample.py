"""Inputs of the registered queries: the driver's tables seen as a corpus, and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A path for each document that also gives test, example, compat, barrel and type-stub files. Same text in both engines.
PATH = """CASE doc_id % 11
  WHEN 0 THEN 'tests/' || source || '/doc_' || CAST(doc_id % 97 AS STRING) || '_test.py'
  WHEN 1 THEN 'examples/' || source || '/doc_' || CAST(doc_id % 97 AS STRING) || '.ts'
  WHEN 2 THEN 'compat/' || source || '/doc_' || CAST(doc_id % 97 AS STRING) || '.go'
  WHEN 3 THEN 'src/' || source || '/__init__.py'
  WHEN 4 THEN 'types/' || source || '/doc_' || CAST(doc_id % 97 AS STRING) || '.d.ts'
  ELSE 'src/' || source || '/doc_' || CAST(doc_id % 97 AS STRING) || '.py' END"""

CORPUS = f"corpus AS (SELECT doc_id AS chunk_id, {PATH} AS file, text, doc_id % 7 = 6 AS deleted FROM documents)"
#: Queries: the benchmark items.
ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
#: Parts of an identifier and the terms of a text, as DuckDB lists.
TERMS = """tok AS (
  SELECT {keys}, unnest(list_transform(regexp_extract_all({text}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda r:
    struct_pack(r := lower(r), p := CASE WHEN contains(r, '_') THEN list_filter(string_split(lower(r), '_'), lambda x: x <> '')
      ELSE list_transform(regexp_extract_all(regexp_replace(r, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) END))) AS t FROM {src}
), {out} AS (SELECT {keys}, unnest(CASE WHEN len(t.p) >= 2 THEN list_concat([t.r], t.p) ELSE [t.r] END) AS term FROM tok)"""


def terms_sql(src: str, keys: str, text: str, out: str) -> str:
    return TERMS.format(src=src, keys=keys, text=text, out=out).replace("tok AS", f"tok_{out} AS").replace("FROM tok)", f"FROM tok_{out})")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr(PATH).alias("file"), "text", F.expr("doc_id % 7 = 6").alias("deleted"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


class Literal:
    """A small table that both engines get with the query."""

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.columns, self.rows = name, columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def cte(self) -> str:
        def cell(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, list):
                return "[" + ", ".join(map(cell, v)) + "]::VARCHAR[]"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        names = ", ".join(c.strip().split(" ")[0] for c in self.columns.split(","))
        return f"{self.name}({names}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in self.rows)})"


#: Chunks of code and queries that ask for names, next to the documents and the benchmark items.
CODE = Literal("code", "chunk_id long, file string, text string", [
    (900001, "ledger/open_ledger.py", "import os\ndef openLedger(path):\n    return Ledger(path)"), (900002, "ledger/tests/ledger_test.py", "book = openLedger('a')\nassert book"),
    (900003, "ledger/ledger.py", "class Ledger:\n    def openLedger(self): pass"), (900004, "post/parcel_queue.go", "type ParcelQueue struct { size int }"), (900005, "post/sorter.go", "func SortParcels(q ParcelQueue) {}"),
    (900006, "post/ledger.sql", "create table ledger (id int)"), (900007, "post/depot.py", "class ParcelQueue:\n    pass\n# openLedger is called by the parcel queue"),
])
EXTRA = Literal("extra", "query_id long, query string", [(900001, "openLedger"), (900002, "store.Ledger"), (900003, "how does openLedger fill the ParcelQueue"), (900004, "waiting line of parcels"), (900005, "parcel queue size")])
PREDICTED = Literal("predicted", "query_id long, name string", [(900004, "ParcelQueue")])
CORPUS2 = f"{CODE.cte}, {EXTRA.cte}, {PREDICTED.cte}, " + CORPUS.replace(" FROM documents)", " FROM documents UNION ALL SELECT chunk_id, file, text, false FROM code)")
ASKED2 = ASKED.replace(" FROM benchmark)", " FROM benchmark UNION ALL SELECT query_id, query FROM extra), bag AS (SELECT * FROM asked UNION ALL SELECT query_id, name FROM predicted)")


def corpus2(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).unionByName(CODE.df(spark).withColumn("deleted", F.lit(False)))


def asked2(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).unionByName(EXTRA.df(spark))
