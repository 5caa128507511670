"""Catalogues of live databases as DataFrames: tables, columns, keys, foreign keys, indexes, views, routines, row samples.

SQLite is read with the standard library, on the driver, for a catalogue is small by nature.
Other engines are read over JDBC (their driver must be on the class path): the queries are
those of the standard's information schema and of the engine's own tables where it has none.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "schema string, table string, kind string, definition string"
COLUMNS = "schema string, table string, ordinal int, column string, type string, not_null boolean, default_value string, is_pk boolean"
FKS = "table string, column string, ref_table string, ref_column string"
INDEXES = "table string, index string, seq int, column string, is_unique boolean"
#: By engine: columns, foreign keys, indexes, views and routines, as queries a JDBC source can run.
QUERIES = {
    "postgres": {
        "columns": "SELECT table_schema AS schema, table_name AS \"table\", ordinal_position AS ordinal, column_name AS \"column\", data_type AS type, is_nullable = 'NO' AS not_null, coalesce(column_default, '') AS default_value FROM information_schema.columns",
        "keys": "SELECT k.table_name AS \"table\", k.column_name AS \"column\", c.constraint_type AS type FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name",
        "fks": "SELECT k.table_name AS \"table\", k.column_name AS \"column\", u.table_name AS ref_table, u.column_name AS ref_column FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema JOIN information_schema.key_column_usage u ON u.constraint_name = r.unique_constraint_name AND u.constraint_schema = r.unique_constraint_schema AND u.ordinal_position = k.position_in_unique_constraint",
        "indexes": "SELECT t.relname AS \"table\", i.relname AS index, a.n AS seq, pg_get_indexdef(x.indexrelid, a.n::int, true) AS \"column\", x.indisunique AS is_unique FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid CROSS JOIN LATERAL generate_series(1, x.indnkeyatts) AS a(n) WHERE NOT x.indisprimary",
        "views": "SELECT table_schema AS schema, table_name AS name, 'VIEW' AS kind, view_definition AS definition FROM information_schema.views UNION ALL SELECT schemaname, matviewname, 'MATERIALIZED VIEW', definition FROM pg_matviews",
        "routines": "SELECT r.routine_schema AS schema, r.routine_name AS name, r.routine_type AS kind, p.ordinal_position AS ordinal, coalesce(p.parameter_name, '') AS param, p.data_type AS type, r.data_type AS returns FROM information_schema.routines r LEFT JOIN information_schema.parameters p ON p.specific_name = r.specific_name AND p.parameter_mode <> 'OUT'",
        "estimates": "SELECT relname AS name, greatest(reltuples, 0)::bigint AS n FROM pg_class WHERE relkind IN ('r', 'p')",
    },
    "mysql": {
        "columns": "SELECT table_schema AS `schema`, table_name AS `table`, ordinal_position AS ordinal, column_name AS `column`, column_type AS type, is_nullable = 'NO' AS not_null, coalesce(column_default, '') AS default_value FROM information_schema.columns WHERE table_schema = database()",
        "keys": "SELECT table_name AS `table`, column_name AS `column`, CASE column_key WHEN 'PRI' THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS type FROM information_schema.columns WHERE table_schema = database() AND column_key IN ('PRI', 'UNI')",
        "fks": "SELECT table_name AS `table`, column_name AS `column`, referenced_table_name AS ref_table, referenced_column_name AS ref_column FROM information_schema.key_column_usage WHERE table_schema = database() AND referenced_table_name IS NOT NULL",
        "indexes": "SELECT table_name AS `table`, index_name AS `index`, seq_in_index AS seq, column_name AS `column`, non_unique = 0 AS is_unique FROM information_schema.statistics WHERE table_schema = database()",
        "views": "SELECT table_schema AS `schema`, table_name AS name, 'VIEW' AS kind, view_definition AS definition FROM information_schema.views WHERE table_schema = database()",
        "routines": "SELECT r.routine_schema AS `schema`, r.routine_name AS name, r.routine_type AS kind, p.ordinal_position AS ordinal, coalesce(p.parameter_name, '') AS param, p.dtd_identifier AS type, r.dtd_identifier AS returns FROM information_schema.routines r LEFT JOIN information_schema.parameters p ON p.specific_schema = r.routine_schema AND p.specific_name = r.routine_name AND p.ordinal_position > 0 WHERE r.routine_schema = database()",
        "estimates": "SELECT table_name AS name, table_rows AS n FROM information_schema.tables WHERE table_schema = database()",
    },
}


def jdbc(spark: SparkSession, url: str, engine: str, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The catalogue tables of a Postgres or MySQL database, by name; nothing is read before they are used."""
    return {name: spark.read.jdbc(url, f"({sql}) AS c", properties=properties or {}) for name, sql in QUERIES[engine].items()}


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalogue of a SQLite file: tables, columns, fks, indexes."""
    tables, columns, fks, indexes = [], [], [], []
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        for name, kind, sql in db.execute("SELECT name, type, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall():
            tables.append(("", name, "BASE TABLE" if kind == "table" else "VIEW", sql))
            q = _quote(name)
            columns += [("", name, cid + 1, col, typ.lower(), bool(no), default or "", bool(pk)) for cid, col, typ, no, default, pk in db.execute(f"PRAGMA table_info({q})")]
            for row in db.execute(f"PRAGMA foreign_key_list({q})").fetchall():
                keys = [c[1] for c in db.execute(f"PRAGMA table_info({_quote(row[2])})") if c[5]]
                fks.append((name, row[3], row[2], row[4] or (keys[0] if keys else "")))
            for _, index, unique, origin, *_ in db.execute(f"PRAGMA index_list({q})").fetchall():
                if origin == "c":
                    indexes += [(name, index, seq + 1, col, bool(unique)) for seq, _, col in db.execute(f"PRAGMA index_info({_quote(index)})") if col]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {"tables": frame(tables, TABLES), "columns": frame(columns, COLUMNS), "fks": frame(fks, FKS), "indexes": frame(indexes, INDEXES)}


def sqlite_sample(spark: SparkSession, path: str, table: str, rows: int = 5) -> DataFrame:
    """(row, column, value) of the first rows of a table; bytes as their number."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        got = db.execute(f"SELECT * FROM {_quote(table)} LIMIT ?", (rows,))
        names = [d[0] for d in got.description]
        cells = [(i, c, None if v is None else f"<{len(v)} bytes>" if isinstance(v, bytes) else str(v)) for i, r in enumerate(got.fetchall()) for c, v in zip(names, r, strict=True)]
    return spark.createDataFrame(cells, "row int, column string, value string")


def estimates(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """(name, n) of SQLite tables from the statistics of ANALYZE; null where there are none."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        there = db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'sqlite_stat1'").fetchone()[0]
        known = dict(db.execute("SELECT tbl, max(CAST(stat AS INTEGER)) FROM sqlite_stat1 GROUP BY tbl").fetchall()) if there else {}
    return spark.createDataFrame([(t, known.get(t)) for t in tables], "name string, n long")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(schema, table) whose columns (schema, table, ordinal, column, type, ..) differ between two polls of a catalogue."""
    print_ = lambda d, name: d.groupBy("schema", "table").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("ordinal", "column", "type", "not_null")))).alias(name))
    both = print_(old, "was").join(print_(new, "now"), ["schema", "table"], "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("schema", "table")
