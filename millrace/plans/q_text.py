"""Scalar functions, scans and classifiers as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import corpus as C
from .sample import CORPUS, PATH, Literal, corpus, table, terms_sql

Q, O = {}, {}

NAMES = Literal("names", "name string", [(x,) for x in ("OrderBook", "tax_rate", "plain", "readCSVHeader", "TLSSocket", "ABc1D", "oddCase_x", "_inner", "x", "CSV", "split2Rows")])
ASKS = Literal("asks", "query string", [(x,) for x in ("payInvoice", "CSVReader", "BookTest", "tax_rate", "_inner", "Ledger::Row", "order.total", "Cart->add", "Shop\\Cart", "ledger", "payinvoice", "close the books at night", "where are taxes added", "b", " Order ", "p.q::r", "m->n.o")])
PATHS = Literal("paths", "path string", [(x,) for x in ("shop/cart.go", "cart_test.go", "shop/tests/rows.py", "shop/__init__.py", "compat/old.rs", "legacy/tax.c", "examples/demo.kt", "types/shop.d.ts", "tests/cart_test.go", "legacy/__init__.py", "web/cart.test.tsx", "docs_src/start.py", "testing/run.rb", "web\\tests\\row.py", "OrderTest.php", "latest/cart.go")])
SIZES = Literal("sizes", "size string", [(x,) for x in ("10", "4KB", "4KiB", " 2 MiB ", "1gb", "1GiB", "1.5MB", "12b", "7TB", "", "KB", "9223372036854775807", "5000000000gb", "-1")])
DSNS = Literal("dsns", "dsn string", [(x,) for x in ("postgres://u:p@h/db", "postgresql://h/db", "sqlite:///tmp/x.db", "sqlite3://x", "mysql://h/db", "u:p@tcp(h:3306)/db", "u@unix(/s)/db", "oracle://h", "plain", "POSTGRES://h")])
REPOS = Literal("repos", "source string", [(x,) for x in ("https://GitHub.com/A/b.git", "http://h/x/", "https://h/x?y=1#z", "ssh://h/x", "git@h:x/y.git", "/tmp/repo", "  https://H/a/  ", "", "file:///x")])
TYPES = Literal("types", "name string", [(x,) for x in ("character varying(255)", "timestamp without time zone", "timestamp with time zone", "time with time zone", "character(3)", "integer", "time without time zone")])
WIDTHS = Literal("widths", "name string", [(x,) for x in ("bigint(20) unsigned", "int(11)", "varchar(20)", "tinyint(1)", "decimal(10,2)", "mediumint(8)", "point(3)")])
TEXTS = Literal("texts", "id int, text string", [
    (1, "class SettleOrder:\n  pass"), (2, "  func SettleOrder(x)"), (3, "pub fn SettleOrder<T>"), (4, "x = SettleOrder()"), (5, "funcSettleOrder()"),
    (6, "defmodule App.SettleOrder do"), (7, "create table Stores (id int)"), (8, "class A::B::C {"), (9, "# see SettleOrder"), (10, "type SettleOrder struct {"),
    (11, ""), (12, "# label: func: login | calls: a, b\ndef login(): pass"), (13, "\n\n  first line  \nsecond"), (14, "a b_c 123456789 + (x)"), (15, "CREATE VIEW app.Active AS SELECT 1"),
])
STEMS = Literal("stems", "stem string, name string", [("order", "order"), ("orders", "order"), ("order_s", "order"), ("tax_rate", "taxrate"), ("glass", "glas"), ("ordr", "order"), ("tax_rates", "taxrate"), ("s", "")])
SAMPLES = Literal("samples", "id int, text string", [(1, "// Code generated by x. DO NOT EDIT."), (2, "DO NOT EDIT below this line"), (3, "@generated"), (4, "plain"), (5, "This generated file: do not edit"), (6, ""), (7, "auto-generated; please do not edit")])
RULES = Literal("rules", "family string, scope string, seq int, rule string", [
    ("git", "", 1, "*.log"), ("git", "", 2, "!keep.log"), ("git", "", 3, "/build/"), ("git", "sub", 4, "tmp"), ("own", "", 1, "docs/**/draft.md"), ("own", "", 2, "a?c.txt"), ("git", "", 5, "secret/"),
])
FILES = Literal("files", "path string", [(x,) for x in ("x.log", "keep.log", "build/out.o", "src/build/out.o", "sub/tmp/a.txt", "tmp/a.txt", "docs/a/b/draft.md", "docs/draft.md", "abc.txt", "a/abc.txt", "secret/k", "src/secret/deep/k", "main.go", "a/keep.log")])


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


SPLIT_SQL = """CASE WHEN contains(name, '_') THEN list_filter(string_split(lower(name), '_'), lambda x: x <> '')
  ELSE list_transform(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) END"""


@q("split_identifier", f"WITH {NAMES.cte}, p AS (SELECT name, {SPLIT_SQL} AS p FROM names) SELECT name, lower(name) || CASE WHEN len(p) >= 2 THEN ' ' || array_to_string(p, ' ') ELSE '' END AS terms FROM p")
def split_identifier(spark, sf):
    return NAMES.df(spark).select("name", F.array_join(T.identifier_terms(F.col("name")), " ").alias("terms"))


@q("tokenize", f"WITH {terms_sql('documents', 'doc_id', 'text', 'terms')} SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, CAST(sum(length(term)) AS BIGINT) AS chars FROM terms GROUP BY doc_id")
def tokenize(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.countDistinct("term").alias("n_distinct"), F.sum(F.length("term")).alias("chars"))


@q("query_class", f"""WITH {ASKS.cte}, k AS (SELECT query, CASE WHEN regexp_full_match(trim(query), '(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\\\|->|\\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9_]*)') THEN 'symbol' ELSE 'natural' END AS kind FROM asks)
SELECT query, kind, CASE kind WHEN 'symbol' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha FROM k""")
def query_class(spark, sf):
    k = ASKS.df(spark).withColumn("kind", T.query_kind(F.col("query")))
    return k.withColumn("alpha", F.when(F.col("kind") == "symbol", F.lit(0.3)).otherwise(F.lit(0.5)))


@q("symbol_name", f"""WITH {ASKS.cte}, t AS (SELECT query, trim(query) AS s FROM asks)
SELECT query, CASE WHEN contains(s, '::') THEN string_split(s, '::')[-1] WHEN contains(s, '\\') THEN string_split(s, '\\')[-1] WHEN contains(s, '->') THEN string_split(s, '->')[-1] WHEN contains(s, '.') THEN string_split(s, '.')[-1] ELSE s END AS symbol FROM t""")
def symbol_name(spark, sf):
    return ASKS.df(spark).select("query", T.symbol_name(F.trim("query")).alias("symbol"))


@q("bench_class", f"WITH {ASKS.cte} SELECT query, CASE WHEN length(trim(query)) <= 30 AND regexp_full_match(trim(query), '[A-Za-z_][A-Za-z0-9_]*') THEN 'symbol' ELSE 'natural' END AS kind FROM asks")
def bench_class(spark, sf):
    t = F.trim("query")
    return ASKS.df(spark).select("query", F.when((F.length(t) <= 30) & t.rlike(f"^{T.IDENT}$"), "symbol").otherwise("natural").alias("kind"))


PENALTY_SQL = f"""(CASE WHEN regexp_matches(p, '{T.TEST_FILES}') OR regexp_matches(p, '{T.TEST_DIRS}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN string_split(p, '/')[-1] IN ('__init__.py', 'package-info.java') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN regexp_matches(p, '{T.COMPAT_DIRS}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN regexp_matches(p, '{T.EXAMPLE_DIRS}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN p LIKE '%.d.ts' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)"""


@q("path_penalty", f"WITH {PATHS.cte}, {CORPUS}, a AS (SELECT path FROM paths UNION SELECT file FROM corpus), n AS (SELECT path, replace(path, '\\', '/') AS p FROM a) SELECT path, round({PENALTY_SQL}, 6) AS penalty FROM n")
def path_penalty(spark, sf):
    both = PATHS.df(spark).unionByName(corpus(spark, sf).select(F.col("file").alias("path"))).distinct()
    return both.select("path", F.round(T.path_penalty(F.col("path")), 6).alias("penalty"))


@q("bytesize", f"""WITH {SIZES.cte}, m AS (SELECT size, regexp_extract(lower(trim(size)), '^([0-9]+) *([a-z]*)$', 1) AS n, regexp_extract(lower(trim(size)), '^([0-9]+) *([a-z]*)$', 2) AS u FROM sizes),
v AS (SELECT size, TRY_CAST(n AS HUGEINT) * CASE u WHEN '' THEN 1 WHEN 'b' THEN 1 WHEN 'kib' THEN 1024 WHEN 'mib' THEN 1048576 WHEN 'gib' THEN 1073741824 WHEN 'kb' THEN 1000 WHEN 'mb' THEN 1000000 WHEN 'gb' THEN 1000000000 END AS v FROM m)
SELECT size, CASE WHEN v <= 4611686018427387904 THEN CAST(v AS BIGINT) END AS bytes FROM v""")
def bytesize(spark, sf):
    return SIZES.df(spark).select("size", T.byte_size(F.col("size")).alias("bytes"))


@q("dsn_engine", f"""WITH {DSNS.cte}, s AS (SELECT dsn, lower(regexp_extract(dsn, '^(.+?)://', 1)) AS s FROM dsns)
SELECT dsn, CASE WHEN s IN ('postgres', 'postgresql') THEN 'postgres' WHEN s IN ('sqlite', 'sqlite3') THEN 'sqlite' WHEN s = 'mysql' THEN 'mysql' WHEN s = '' AND (contains(dsn, '@tcp(') OR contains(dsn, '@unix(')) THEN 'mysql' ELSE '' END AS engine FROM s""")
def dsn_engine(spark, sf):
    return DSNS.df(spark).select("dsn", T.dsn_engine(F.col("dsn")).alias("engine"))


@q("repo_key", f"""WITH {REPOS.cte}, a AS (SELECT source FROM repos UNION SELECT url FROM pages), t AS (SELECT source, trim(source) AS t FROM a)
SELECT source, CASE WHEN regexp_matches(t, '^(?i:https?)://') THEN lower(regexp_extract(t, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(t, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(t, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', ''), '[.]git$', '')
 WHEN t = '' OR contains(t, '://') OR regexp_matches(t, '^[A-Za-z0-9._-]+@[A-Za-z0-9.-]+:.+') THEN NULL ELSE t END AS key FROM t""")
def repo_key(spark, sf):
    both = REPOS.df(spark).unionByName(table(spark, sf, "pages").select(F.col("url").alias("source"))).distinct()
    return both.select("source", T.repo_key(F.col("source")).alias("key"))


@q("type_shorthand", f"WITH {TYPES.cte} SELECT name, replace(replace(replace(replace(replace(replace(name, 'character varying', 'varchar'), 'character(', 'char('), 'timestamp without time zone', 'timestamp'), 'timestamp with time zone', 'timestamptz'), 'time without time zone', 'time'), 'time with time zone', 'timetz') AS short FROM types")
def type_shorthand(spark, sf):
    return TYPES.df(spark).select("name", T.type_shorthand(F.col("name")).alias("short"))


@q("int_width", f"WITH {WIDTHS.cte} SELECT name, regexp_replace(name, '\\b(bigint|int|mediumint|smallint|tinyint)\\([0-9]+\\)', '\\1', 'g') AS plain FROM widths")
def int_width(spark, sf):
    return WIDTHS.df(spark).select("name", F.regexp_replace("name", r"\b(bigint|int|mediumint|smallint|tinyint)\([0-9]+\)", "$1").alias("plain"))


@q("stem_match", f"WITH {STEMS.cte} SELECT stem, name, stem = name OR replace(stem, '_', '') = name OR rtrim(stem, 's') = name OR rtrim(replace(stem, '_', ''), 's') = name AS ok FROM stems")
def stem_match(spark, sf):
    from ..operators.retrieval import stem_matches

    return STEMS.df(spark).select("stem", "name", stem_matches(F.col("stem"), F.col("name")).alias("ok"))


@q("defines_symbol", f"""WITH {TEXTS.cte}, s(symbol) AS (VALUES ('SettleOrder'), ('stores'), ('Stores'), ('C'), ('B'), ('Active'))
SELECT id, symbol, list_contains(list_transform(regexp_extract_all(text, '(?m)(?:^|\\s)(?:class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef)\\s+((?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*[A-Za-z_][A-Za-z0-9_]*)(?:\\s|[<({{:\\[;]|$)', 1), lambda n: regexp_extract(n, '[A-Za-z0-9_]*$')), symbol)
 OR list_contains(list_transform(regexp_extract_all(text, '(?im)(?:^|\\s)(?:CREATE TABLE|CREATE VIEW|CREATE PROCEDURE|CREATE FUNCTION)\\s+((?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*[A-Za-z_][A-Za-z0-9_]*)(?:\\s|[<({{:\\[;]|$)', 1), lambda n: lower(regexp_extract(n, '[A-Za-z0-9_]*$'))), lower(symbol)) AS defines
FROM texts, s""")
def defines_symbol(spark, sf):
    from ..operators.retrieval import defines

    symbols = spark.createDataFrame([(x,) for x in ("SettleOrder", "stores", "Stores", "C", "B", "Active")], "symbol string")
    return TEXTS.df(spark).join(symbols, how="cross").select("id", "symbol", defines(F.col("text"), F.col("symbol")).alias("defines"))


@q("strip_label", f"WITH {TEXTS.cte} SELECT id, regexp_replace(text, '^# label: [^\\n]*\\n', '') AS body FROM texts")
def strip_label(spark, sf):
    from ..operators.structure import strip_label as strip

    return TEXTS.df(spark).select("id", strip(F.col("text")).alias("body"))


@q("preview_line", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS preview FROM documents")
def preview_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview_line(F.col("text")).alias("preview"))


TOKENS_SQL = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda r: (length(r) + 3) // 4)), 0) + length(regexp_replace(text, '[A-Za-z0-9_ \\t\\n\\r\\x0b\\x0c]', '', 'g')) AS INTEGER)"


@q("approx_tokens", f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@q("scan_minified", "SELECT page_id, strlen(html) AS bytes, strlen(html) >= 2048 AND strlen(html) // (strlen(html) - strlen(replace(html, chr(10), '')) + 1) > 1000 AS minified FROM pages")
def scan_minified(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), C.minified(F.col("html")).alias("minified"))


@q("scan_generated", f"""WITH {SAMPLES.cte}, l AS (SELECT id, text, lower(text) AS l FROM samples)
SELECT id, contains(text, '@generated') OR (contains(l, 'do not edit') AND (contains(l, 'code generated') OR contains(l, 'generated by') OR contains(l, 'autogenerated') OR contains(l, 'auto-generated') OR contains(l, 'generated file'))) AS generated FROM l""")
def scan_generated(spark, sf):
    return SAMPLES.df(spark).select("id", C.generated(F.col("text")).alias("generated"))


@q("scan_admit", f"""WITH {CORPUS} SELECT file, chunk_id, strlen(text) AS bytes FROM corpus
WHERE strlen(text) <= 2097152 AND NOT contains(text, chr(0)) AND NOT (strlen(text) >= 2048 AND strlen(text) // (strlen(text) - strlen(replace(text, chr(10), '')) + 1) > 1000)""")
def scan_admit(spark, sf):
    rows = corpus(spark, sf).withColumn("bytes", F.octet_length("text").cast("long"))
    return C.admitted(rows).select("file", "chunk_id", "bytes")


IGNORE_SQL = f"""WITH {RULES.cte}, {FILES.cte},
dirs AS (SELECT path, array_to_string(string_split(path, '/')[1:i], '/') AS node, i < len(string_split(path, '/')) AS is_dir FROM files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS i) t),
pats(family, scope, seq, rx, neg, dir_only) AS (VALUES
 ('git', '', 1, '^(?:.*/)?[^/]*\\.log$', false, false), ('git', '', 2, '^(?:.*/)?keep\\.log$', true, false), ('git', '', 3, '^build$', false, true), ('git', 'sub', 4, '^(?:.*/)?tmp$', false, false), ('git', '', 5, '^(?:.*/)?secret$', false, true),
 ('own', '', 1, '^docs/(?:.*/)?draft\\.md$', false, false), ('own', '', 2, '^(?:.*/)?a[^/]c\\.txt$', false, false)),
hit AS (SELECT d.path, d.node, p.family, arg_max(NOT p.neg, length(p.scope) * 1000 + p.seq) AS ignored FROM dirs d JOIN pats p ON (p.scope = '' OR d.node LIKE p.scope || '/%') AND (d.is_dir OR NOT p.dir_only)
  AND regexp_matches(CASE WHEN p.scope = '' THEN d.node ELSE substr(d.node, length(p.scope) + 2) END, p.rx) GROUP BY ALL)
SELECT f.path, coalesce(bool_or(h.ignored), false) AS ignored FROM files f LEFT JOIN hit h ON f.path = h.path GROUP BY f.path"""


@q("ignore_match", IGNORE_SQL)
def ignore_match(spark, sf):
    return C.ignored(FILES.df(spark), C.compiled(spark, [tuple(r) for r in RULES.rows]))
