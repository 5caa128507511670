"""Catalogue queries: columns, keys, foreign keys, indexes, rendering of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qualified(schema: Column, name: Column) -> Column:
    return F.when(F.coalesce(schema, F.lit("")).isin("", "public"), name).otherwise(F.concat_ws(".", schema, name))


def columns(tables: DataFrame, cols: DataFrame) -> DataFrame:
    """(table, ordinal, column, type, not_null) of base tables, with qualified names."""
    x = tables.filter("kind = 'BASE TABLE'").join(cols, ["schema", "table"])
    return x.select(qualified(F.col("schema"), F.col("table")).alias("table"), "ordinal", "column", "type", "not_null")


def keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """(table, column, is_pk, is_unique)."""
    x = constraints.filter("type IN ('PRIMARY KEY', 'UNIQUE')").join(usage, ["constraint"])
    return x.groupBy("table", "column").agg(F.bool_or(F.col("type") == "PRIMARY KEY").alias("is_pk"), F.bool_or(F.col("type") == "UNIQUE").alias("is_unique"))


def foreign_keys(usage: DataFrame) -> DataFrame:
    """(table, column, target) from usage rows that name the referenced column."""
    return usage.filter("ref_table IS NOT NULL").select("table", "column", F.concat_ws(".", "ref_table", "ref_column").alias("target"))


def back_references(fks: DataFrame) -> DataFrame:
    """(table, referrers) with sorted referring columns, joined by commas."""
    x = fks.select(F.substring_index("target", ".", 1).alias("table"), F.concat_ws(".", F.col("table"), "column").alias("by"))
    return x.groupBy("table").agg(F.array_join(F.array_sort(F.collect_list("by")), ", ").alias("referrers"))


def index_columns(parts: DataFrame) -> DataFrame:
    """(table, index, columns) by position, the primary key left out."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "column")))
    return parts.filter("index <> 'PRIMARY'").groupBy("table", "index").agg(F.array_join(F.transform(rows, lambda r: r["column"]), ", ").alias("columns"))


def modifiers(pk: Column, not_null: Column, unique: Column, default: Column, target: Column) -> Column:
    """Key, nullability, uniqueness, default and target of a column, in this order."""
    return F.concat_ws(
        " ",
        F.when(pk, "PK"),
        F.when(not_null, "NOT NULL"),
        F.when(unique & ~pk, "UNIQUE"),
        F.when(default != "", F.concat(F.lit("DEFAULT "), default)),
        F.when(target != "", F.concat(F.lit("→ "), target)),
    )


def render_tables(cols: DataFrame) -> DataFrame:
    """(table, body) of (table, ordinal, column, type, mods)."""
    line = F.concat(F.lit("  "), F.concat_ws(" ", "column", "type", F.when(F.col("mods") != "", F.col("mods"))))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("s"))))
    body = F.concat(F.lit("TABLE "), F.col("table"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n"))
    return cols.groupBy("table").agg(rows.alias("rows")).select("table", body.alias("body"))


def routines(params: DataFrame) -> DataFrame:
    """(schema, name, kind, signature) of parameter rows (schema, name, kind, ordinal, param, type, returns); ordinal null: none."""
    row = F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", F.concat_ws(" ", F.when(F.col("param") != "", F.col("param")), "type").alias("s")))
    args = F.array_sort(F.collect_list(row))
    x = params.groupBy("schema", "name", "kind").agg(args.alias("args"), F.max("returns").alias("returns"))
    text = F.concat(qualified(F.col("schema"), F.col("name")), F.lit("("), F.array_join(F.transform("args", lambda a: a["s"]), ", "), F.lit(")"), F.when(F.coalesce("returns", F.lit("")) != "", F.concat(F.lit(" → "), F.col("returns"))).otherwise(""))
    return x.select("schema", "name", "kind", text.alias("signature"))


def views(rows: DataFrame, most: int = 50) -> DataFrame:
    """(view, body) of (schema, name, kind, definition): views and materialised ones, bodies of up to ``most`` lines."""
    lines = F.split(F.rtrim(F.trim(F.col("definition"), F.lit(" \n\t\r")), F.lit(";")), "\n")
    body = F.array_join(F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most), F.array(F.lit("...")))).otherwise(lines), "\n")
    return rows.filter(F.upper("kind").isin("VIEW", "MATERIALIZED VIEW")).select(qualified(F.col("schema"), F.col("name")).alias("view"), body.alias("body"))


def sample_cell(value: Column, most: int = 80) -> Column:
    """A cell for display: NULL for nulls, bytes by their number, text cut after 80 characters."""
    s = value.cast("string")
    return F.when(s.isNull(), "NULL").when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes, mean and nearest-rank percentiles of a value by group.

    The percentiles add up counts of equal values before the shuffle, so a large group is no row-by-row sort.
    """
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(100 * p)}")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), pick(0.5), pick(0.95), pick(0.99))


def usage_report(rows: DataFrame) -> DataFrame:
    """(period, call, calls, saved, bar, percent) of usage rows (call, ts, file_chars, snippet_chars) for today, the last 7 days and all time.

    Days are counted back from that of the last row. Saved characters count four to a token; bar and percent are their
    share of the files' characters, rounded half up.
    """
    last = rows.agg(F.date_trunc("day", F.max("ts")).alias("today"))  # one row
    sums = lambda c: [F.count_if(c).alias("calls"), F.sum(F.when(c, F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0)))).alias("saved"), F.sum(F.when(c, F.greatest("file_chars", F.lit(0)))).alias("whole")]
    since = {"today": F.col("ts") >= F.col("today"), "last 7 days": F.col("ts") >= F.col("today") - F.expr("INTERVAL 6 DAYS"), "all time": F.lit(True)}
    one = rows.crossJoin(last).groupBy("call").agg(*[F.struct(*sums(c)).alias(f"p{i}") for i, c in enumerate(since.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("period"), F.col(f"p{i}").alias("p")) for i, name in enumerate(since)]))
    x = one.select("call", each.alias("e")).select("call", "e.period", "e.p.*").filter("calls > 0")
    share = F.least(F.greatest(F.col("saved") / F.greatest("whole", F.lit(1)), F.lit(0.0)), F.lit(1.0))
    t = F.floor(F.col("saved") / 4)
    text = F.when(t >= 1000000, F.format_string("%.1fM", t / 1000000)).when(t >= 1000, F.format_string("%.1fk", t / 1000)).otherwise(t.cast("string"))
    cells = F.floor(share * 16 + 0.5).cast("int")
    return x.select("period", "call", "calls", text.alias("saved"), F.concat(F.repeat(F.lit("#"), cells), F.repeat(F.lit("-"), 16 - cells)).alias("bar"), F.floor(share * 100 + 0.5).cast("int").alias("percent"))
