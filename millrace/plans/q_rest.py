"""Structure, shaping, incremental and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as K
from ..operators import chunking as P
from ..operators import ddl as D
from ..operators import expansion as X
from ..operators import extraction as G
from ..operators import incremental as I
from ..operators import shaping as S
from ..operators import structure as U
from ..operators.ordering import after
from ..operators.postings import blocks, rows
from ..sources import corpus as C
from ..sources import history as H
from .q_search import BM25, bm25_top, rank_sql
from .q_text import TOKENS_SQL
from .sample import ASKED, CORPUS, PATH, Literal, asked, corpus, table, terms_sql

Q, O = {}, {}


def q(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# --- symbol graph: a literal table of file structures -------------------------------------------
FUNC = "struct<name:string,params:array<string>,return_type:string,is_method:boolean,enclosing_class:string,start_line:int,end_line:int>"
STRUCT = f"path string, functions array<{FUNC}>, classes array<struct<name:string,methods:array<{FUNC}>,start_line:int,end_line:int>>, imports array<string>, call_refs array<struct<callee:string,receiver:string,line:int,enclosing_symbol:string>>, raises array<string>"


def _fn(name, line, cls=""):
    return Row(name=name, params=[], return_type="", is_method=bool(cls), enclosing_class=cls, start_line=line, end_line=line + 1)


STRUCTS = [
    ("auth/login.py", [_fn("authenticate", 3), _fn("helper", 9)], [("User", [("Login", 20), ("logout", 25)], 18)], ["hashlib"], [("hash", 4), ("helper", 5), ("hash", 6)], ["ValueError"]),
    ("auth/admin.py", [_fn("audit", 2)], [("Admin", [("Login", 12)], 10)], ["authenticate", "User"], [("authenticate", 3), ("log", 4)], ["PermissionError", "ValueError"]),
    ("web/app.py", [_fn("main", 1)], [], ["audit"], [("audit", 2), ("authenticate", 3), ("Login", 4)], []),
    ("web/empty.py", [], [], [], [], []),
    ("util.py", [_fn("log", 1), _fn("log", 8)], [("Log", [], 12)], [], [], []),
]


def structs(spark):
    rows = []
    for path, fns, classes, imports, calls, raises in STRUCTS:
        cls = [Row(name=n, methods=[_fn(m, ln, n) for m, ln in ms], start_line=line, end_line=line + 9) for n, ms, line in classes]
        rows.append((path, fns, cls, imports, [Row(callee=c, receiver="", line=ln, enclosing_symbol="") for c, ln in calls], raises))
    return spark.createDataFrame(rows, STRUCT)


def _vals(rows, names):
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{names} AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


_defs = [(f.name, p, "function", f.start_line, "", k, -1) for p, fns, *_ in STRUCTS for k, f in enumerate(fns)]
_defs += [(n, p, "class", line, "", 1000 + k, -1) for p, _, cl, *_ in STRUCTS for k, (n, _, line) in enumerate(cl)]
_methods = [(m, p, "method", ln, n, 1000 + k, j) for p, _, cl, *_ in STRUCTS for k, (n, ms, _) in enumerate(cl) for j, (m, ln) in enumerate(ms)]
DEFS = _vals(_defs + _methods + [(f"{d[4]}.{d[0]}", *d[1:]) for d in _methods], "defs(name, path, kind, line, container, a, b)")
REFS = _vals([(c, p, "call") for p, _, _, _, calls, _ in STRUCTS for c, _ in calls] + [(i, p, "import") for p, _, _, imports, _, _ in STRUCTS for i in imports] + [(r, p, "raise") for p, *_, raises in STRUCTS for r in raises], "refs(name, path, kind)")
ALL = _vals([(s[0],) for s in STRUCTS], "files(path)")


@q("symbol_index", f"WITH {DEFS} SELECT name, array_to_string(list_sort(list_distinct(list(path))), ',') AS files FROM defs GROUP BY name")
def symbol_index(spark, sf):
    return U.symbol_index(structs(spark)).select("name", F.array_join("files", ",").alias("files"))


ASK = ["Login", "User.Login", "authenticate", "log", "Log", "nothing"]


@q("definition", f"WITH {DEFS}, r AS (SELECT *, row_number() OVER (PARTITION BY name, path, kind ORDER BY line, container) AS n FROM defs WHERE name IN ({', '.join(repr(a) for a in ASK)}) AND (NOT contains(name, '.') OR kind = 'method')) SELECT name, path, kind, CAST(line AS INTEGER) AS line, container FROM r WHERE n = 1")
def definition(spark, sf):
    return U.definition(structs(spark), spark.createDataFrame([(a,) for a in ASK], "name string"))


@q("references", f"WITH {REFS} SELECT name, path, kind, count(*) AS n FROM refs GROUP BY ALL")
def references(spark, sf):
    return U.references(structs(spark)).groupBy("name", "path", "kind").agg(F.count("*").alias("n"))


@q("callers", f"WITH {REFS} SELECT DISTINCT name, path FROM refs WHERE kind = 'call' AND name IN ('authenticate', 'hash', 'log')")
def callers(spark, sf):
    return U.callers(structs(spark), spark.createDataFrame([("authenticate",), ("hash",), ("log",)], "name string"))


@q("outline", f"WITH {DEFS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY a, b) AS INTEGER) AS n, name, CASE kind WHEN 'method' THEN 'function' ELSE kind END AS kind, container, CAST(line AS INTEGER) AS line FROM defs WHERE NOT contains(name, '.')")
def outline(spark, sf):
    return U.outline(structs(spark))


@q("symbols", f"WITH {DEFS} SELECT DISTINCT name FROM defs WHERE kind <> 'method' AND path LIKE 'auth/%'")
def symbols(spark, sf):
    return U.symbols(structs(spark), "auth/")


@q("files_under", f"WITH {CORPUS} SELECT DISTINCT file FROM corpus WHERE file = 'src/src1' OR starts_with(file, 'src/src1/')")
def files_under(spark, sf):
    return corpus(spark, sf).select("file").filter(U.under(F.col("file"), "src/src1")).distinct()


@q("symbol_stats", f"WITH {DEFS}, {REFS}, {ALL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT name) FROM defs WHERE NOT contains(name, '.')) AS symbols, (SELECT count(DISTINCT name) FROM refs WHERE kind = 'call') AS callees")
def symbol_stats(spark, sf):
    return U.stats(structs(spark))


@q("count_files", f"WITH {CORPUS} SELECT count(DISTINCT file) AS files FROM corpus WHERE NOT deleted")
def count_files(spark, sf):
    return corpus(spark, sf).filter("NOT deleted").agg(F.countDistinct("file").alias("files"))


@q("enrich_label", f"""WITH {ALL}, {_vals([(s[0], s[1][0].name) for s in STRUCTS if s[1]], 'f(path, fn)')}, {_vals([(s[0], ', '.join(dict.fromkeys(c for c, _ in s[4]))) for s in STRUCTS if s[4]], 'c(path, calls)')}, {_vals([(s[0], ', '.join(s[5][:4])) for s in STRUCTS if s[5]], 'r(path, raises)')},
b AS (SELECT path, concat_ws(' | ', 'func: ' || fn, 'calls: ' || calls, 'raises: ' || raises) AS b FROM files LEFT JOIN f USING (path) LEFT JOIN c USING (path) LEFT JOIN r USING (path)) SELECT path, CASE WHEN b = '' THEN '' ELSE '# label: ' || b END AS label FROM b""")
def enrich_label(spark, sf):
    return U.label(structs(spark))


PARAMS = {"authenticate": ["name", "secret"], "audit": ["who"]}


def rich(spark):
    """The structures with some parameters, and one class whose method comes first."""
    from pyspark.sql import functions as F

    names = F.create_map(*[x for k, v in PARAMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    full = F.transform("functions", lambda f: f.withField("params", F.coalesce(names[f["name"]], F.array().cast("array<string>"))).withField("return_type", F.when(f["name"] == "audit", "int").otherwise("")))
    own = structs(spark).withColumn("functions", full)
    only = [("auth/role.py", [Row(name="grant", params=["to"], return_type="bool", is_method=True, enclosing_class="Role", start_line=4, end_line=6)], [Row(name="Role", methods=[_fn("revoke", 8, "Role"), _fn("grant", 4, "Role"), _fn("check", 12, "Role")], start_line=2, end_line=20)], ["log"], [], [])]
    return own.unionByName(spark.createDataFrame(only, STRUCT))


@q("enrich_full", """SELECT * FROM (VALUES
 ('auth/login.py', '# label: func: authenticate | calls: hash, helper | raises: ValueError | called by: admin, app | imports: hashlib | params: name, secret'),
 ('auth/admin.py', '# label: func: audit | calls: authenticate, log | raises: PermissionError, ValueError | called by: app | imports: authenticate, User | params: who | returns: int'),
 ('web/app.py', '# label: func: main | calls: audit, authenticate, Login | imports: audit'),
 ('web/empty.py', ''), ('util.py', '# label: func: log | called by: admin'),
 ('auth/role.py', '# label: func: grant | imports: log | params: to | returns: bool | siblings: check, revoke')) AS t(path, label)""")
def enrich_full(spark, sf):
    return U.full_label(rich(spark))


@q("graph_expand", f"""WITH {DEFS}, {REFS}, seeds(query_id, file) AS (VALUES (1, 'web/app.py'), (2, 'auth/login.py')), d AS (SELECT DISTINCT name, path AS file FROM defs WHERE NOT contains(name, '.')), c AS (SELECT name, path AS file FROM refs WHERE kind = 'call'),
h AS (SELECT query_id, c.file, s.file AS seed FROM seeds s JOIN d ON d.file = s.file JOIN c ON c.name = d.name UNION ALL SELECT query_id, d.file, s.file FROM seeds s JOIN c ON c.file = s.file JOIN d ON d.name = c.name)
SELECT query_id, file, count(*) * 0.5::DOUBLE AS gain FROM h WHERE file <> seed GROUP BY query_id, file""")
def graph_expand(spark, sf):
    s = structs(spark)
    defs = U.definitions(s).filter("NOT contains(name, '.')").select("name", F.col("path").alias("file")).distinct()
    calls = U.references(s).filter("kind = 'call'").select(F.col("name").alias("callee"), F.col("path").alias("file"))
    return X.graph_expand(spark.createDataFrame([(1, "web/app.py"), (2, "auth/login.py")], "query_id int, file string"), calls, defs, 0.5)


# --- result shaping --------------------------------------------------------------------------------
HITS = f"WITH {BM25}, {rank_sql('bm25', 10, 'top')}, hits AS (SELECT query_id, rank, chunk_id, file, text, score FROM top JOIN corpus USING (chunk_id))"


def hits(spark, sf, k=10):
    # at most k rows a query of the batch, so no text is shuffled
    return F.broadcast(bm25_top(spark, sf, k)).join(corpus(spark, sf).drop("deleted"), "chunk_id")


@q("page_window", f"WITH {CORPUS}, t AS (SELECT count(*) AS total FROM corpus) SELECT chunk_id, file, total, 130 < total AS truncated, total > 0 AND 100 >= total AS overshot FROM (SELECT chunk_id, file FROM corpus ORDER BY chunk_id LIMIT 30 OFFSET 100), t")
def page_window(spark, sf):
    return S.page(corpus(spark, sf).select("chunk_id", "file"), ["chunk_id"], 100, 30, 500)


@q("page_after", f"WITH {CORPUS} SELECT chunk_id, file FROM corpus WHERE file > 'src/src1/' OR (file = 'src/src1/' AND chunk_id > 5) ORDER BY file, chunk_id LIMIT 40")
def page_after(spark, sf):
    """The page after a key: a filter that reaches the scan, no count of what was passed over."""
    return after(corpus(spark, sf).select("chunk_id", "file"), ["file", "chunk_id"], {"file": "src/src1/", "chunk_id": 5}, 40)


@q("token_budget", f"{HITS}, c AS (SELECT query_id, rank, chunk_id, {TOKENS_SQL} + {TOKENS_SQL.replace('text', 'file')} + 8 AS cost FROM hits), u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM c) SELECT query_id, rank, chunk_id, CAST(used AS BIGINT) AS used FROM u WHERE rank = 1 OR used <= 2000")
def token_budget(spark, sf):
    return S.within_budget(hits(spark, sf), 2000).select("query_id", "rank", "chunk_id", "used")


@q("match_explain", f"{HITS}, {terms_sql('hits', 'query_id, chunk_id', 'text', 'ct')}, w AS (SELECT query_id, list_distinct(list(term)) AS ts FROM wanted GROUP BY query_id), m AS (SELECT DISTINCT query_id, chunk_id, term FROM ct) SELECT h.query_id, h.chunk_id, (SELECT count(*) FROM m WHERE m.query_id = h.query_id AND m.chunk_id = h.chunk_id AND list_contains(w.ts, m.term)) AS n FROM hits h JOIN w USING (query_id)")
def match_explain(spark, sf):
    x = hits(spark, sf).join(asked(spark, sf), "query_id").select("query_id", "chunk_id", S.explained(F.col("query"), F.col("text")).alias("e"))
    return x.select("query_id", "chunk_id", F.when(F.col("e") == "semantic", 0).otherwise(F.size(F.split("e", ", "))).cast("long").alias("n"))


@q("render_md", f"{HITS} SELECT query_id, string_agg(printf('## %d. %s:%d-%d [score=%.3f]', rank, file, 1, length(text) - length(replace(text, chr(10), '')) + 1, score) || chr(10) || '```' || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) AS body FROM hits WHERE rank <= 3 GROUP BY query_id")
def render_md(spark, sf):
    x = hits(spark, sf, 3).withColumn("first", F.lit(1)).withColumn("last", F.size(F.split("text", "\n")))
    return S.render_markdown(x)


@q("cli_rows", f"{HITS} SELECT query_id, rank, printf('%.4f %s:%d-%d %s', score, file, 1, length(text) - length(replace(text, chr(10), '')) + 1, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '')) AS line FROM hits WHERE rank <= 5")
def cli_rows(spark, sf):
    return S.cli_rows(hits(spark, sf, 5).withColumn("first", F.lit(1)).withColumn("last", F.size(F.split("text", "\n"))))


@q("grep_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), '@mail')")
def grep_any(spark, sf):
    return S.grep(table(spark, sf, "documents").select("doc_id", "text"), ["License", "token", "@mail"]).select("doc_id")


PA = Literal("a", "x string", [("src/a.py",), ("a.py",), ("b/src/a.py",), ("xa.py",)])


@q("path_match", f"WITH {PA.cte} SELECT p.x AS l, q.x AS r FROM a p JOIN a q ON p.x = q.x OR p.x LIKE '%/' || q.x OR q.x LIKE '%/' || p.x")
def path_match(spark, sf):
    a = PA.df(spark)
    left, right = a.select(F.col("x").alias("l")), a.select(F.col("x").alias("r"))
    return left.join(right, S.same_path(F.col("l"), F.col("r")))


@q("resolve_chunk", """WITH c AS (SELECT o_orderkey AS chunk_id, CAST(o_custkey % 50 AS VARCHAR) AS file, o_orderkey % 400 AS first, o_orderkey % 400 + 50 AS last FROM orders), p AS (SELECT DISTINCT CAST(c_custkey % 50 AS VARCHAR) AS file, c_custkey % 300 AS line FROM customer),
r AS (SELECT p.file, p.line, c.chunk_id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY (line = last), chunk_id) AS n FROM p JOIN c ON p.file = c.file AND line BETWEEN first AND last) SELECT file, line, chunk_id FROM r WHERE n = 1""")
def resolve_chunk(spark, sf):
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(k.alias("chunk_id"), (F.col("o_custkey") % 50).cast("string").alias("file"), (k % 400).alias("first"), (k % 400 + 50).alias("last"))
    p = table(spark, sf, "customer").select((F.col("c_custkey") % 50).cast("string").alias("file"), (F.col("c_custkey") % 300).alias("line")).distinct()
    return S.resolve(p, c)


@q("dedupe_ordered", "SELECT doc_id, list_reduce(list_concat([''], string_split(lang || ' ' || source || ' ' || lang || ' x ' || source, ' ')), lambda a, b: CASE WHEN list_contains(string_split(a, ' '), b) THEN a ELSE trim(a || ' ' || b) END) AS words FROM documents")
def dedupe_ordered(spark, sf):
    w = F.split(F.concat_ws(" ", "lang", "source", "lang", F.lit("x"), "source"), " ")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(w), " ").alias("words"))


# --- chunking ----------------------------------------------------------------------------------------
@q("chunk_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(0, CASE WHEN len(l) <= 5 THEN 1 ELSE len(l) - 1 END, 4)) AS a FROM l) SELECT doc_id, a + 1 AS first, least(a + 5, len(l)) AS last, length(array_to_string(l[a + 1:a + 5], chr(10))) AS chars FROM s")
def chunk_lines(spark, sf):
    c = P.line_windows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 5, 1)
    return c.select("doc_id", "first", "last", F.length("text").cast("long").alias("chars"))


@q("chunk_headings", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), h AS (SELECT *, sum(CASE WHEN regexp_matches(s, '^[A-Z][a-z]{0,3}[ .,]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l) SELECT doc_id, sec, min(n) AS first, max(n) AS last, CAST(sum(length(s)) AS BIGINT) AS chars FROM h GROUP BY doc_id, sec")
def chunk_headings(spark, sf):
    c = P.heading_sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "^[A-Z][a-z]{0,3}[ .,]")
    return c.select("doc_id", F.col("sec").cast("long").alias("sec"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("chars").cast("long").alias("chars"))


@q("chunk_code")
def chunk_code(spark, sf):
    return P.packed_chunks(corpus(spark, sf).select("file", "text"), "file", 1500)


# --- incremental ------------------------------------------------------------------------------------
@q("manifest_diff", "WITH o AS (SELECT o_orderkey AS file, o_custkey AS m, CAST(o_totalprice AS BIGINT) AS s FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS file, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS m, CAST(o_totalprice AS BIGINT) AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT CAST(coalesce(o.file, n.file) AS VARCHAR) AS file, CASE WHEN n.file IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file = n.file WHERE n.file IS NULL OR o.file IS NULL OR o.m <> n.m OR o.s <> n.s")
def manifest_diff(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("file"), F.col("o_custkey").alias("mtime_ns"), F.round("o_totalprice").cast("long").alias("size"))
    new = base.filter("k % 11 <> 0").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    return I.manifest_diff(base.filter("k % 7 <> 0"), new)


@q("reconcile", f"WITH {CORPUS}, kept AS (SELECT file, chunk_id AS seq, text FROM corpus WHERE NOT starts_with(file, 'tests/') AND file <> 'src/src1/__init__.py' UNION ALL VALUES ('src/src1/__init__.py', 0, 'new'), ('zz/new.py', 0, 'added')) SELECT row_number() OVER (ORDER BY file, seq) - 1 AS chunk_id, file, seq FROM kept")
def reconcile(spark, sf):
    own = corpus(spark, sf).select("file", F.col("chunk_id").alias("seq"), "text")
    changes = spark.createDataFrame([("tests",), ("src/src1/__init__.py",)], "file string")
    fresh = spark.createDataFrame([("src/src1/__init__.py", 0, "new"), ("zz/new.py", 0, "added")], "file string, seq long, text string")
    return I.reconcile(own, changes, fresh).select("chunk_id", "file", "seq")


@q("debounce_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s")
def debounce_sessions(spark, sf):
    return I.debounced(table(spark, sf, "events").select("ts", "user_id"), "12 hours")


@q("debounce_capped", """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT user_id, k, ts, ts AS started, 1 AS s FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, e.ts, CASE WHEN e.ts - r.ts > INTERVAL 12 HOUR OR e.ts - r.started > INTERVAL 24 HOUR THEN e.ts ELSE r.started END, r.s + CASE WHEN e.ts - r.ts > INTERVAL 12 HOUR OR e.ts - r.started > INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, s""")
def debounce_capped(spark, sf):
    return I.debounced_capped(table(spark, sf, "events"), 12 * 3600, 24 * 3600)


EV = "e AS (SELECT 'f' || CAST(user_id AS VARCHAR) AS path, ts, event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END AS op FROM events)"


@q("merge_ops", f"WITH {EV}, o AS (SELECT path, list(op ORDER BY ts, event_id) AS ops FROM e GROUP BY path) SELECT path, CAST(list_reduce(list_concat([0], ops), lambda a, x: CASE WHEN (x & 12) <> 0 THEN x WHEN (a & 12) <> 0 THEN x ELSE a | x END) AS INTEGER) AS op FROM o")
def merge_ops(spark, sf):
    m = F.col("event_id") % 5
    op = F.when(m == 0, 1).when(m.isin(1, 2), 2).when(m == 3, 4).otherwise(8)
    return I.merged_ops(table(spark, sf, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), "ts", "event_id", op.alias("op")))


@q("embed_cache_miss", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def embed_cache_miss(spark, sf):
    d = table(spark, sf, "documents")
    return I.cache_misses(d, d.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash")).distinct())


@q("union_extras", f"WITH {CORPUS}, x AS (SELECT file, chunk_id AS seq FROM corpus WHERE chunk_id % 10 = 0), o AS (SELECT file, chunk_id AS seq FROM corpus WHERE chunk_id % 10 = 1) SELECT file, seq, 0 AS part FROM o WHERE file NOT IN (SELECT file FROM x) UNION ALL SELECT file, seq, 1 FROM x")
def union_extras(spark, sf):
    c = corpus(spark, sf).select("file", F.col("chunk_id").alias("seq"))
    return I.unioned(c.filter("seq % 10 = 1"), c.filter("seq % 10 = 0"))


USE = "u AS (SELECT event_type AS call, ts, CAST(value * 100 AS BIGINT) AS file_chars, event_id % 4000 AS snippet_chars FROM events), m AS (SELECT date_trunc('day', max(ts)) AS today FROM u)"


def usage(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("call"), "ts", F.round(F.col("value") * 100).cast("long").alias("file_chars"), (F.col("event_id") % 4000).alias("snippet_chars"))


def usage_sums(spark, sf):
    u = usage(spark, sf)
    today = u.agg(F.date_trunc("day", F.max("ts")).alias("today"))
    x = u.crossJoin(today).withColumn("saved", F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0)))
    day, week = F.col("ts") >= F.col("today"), F.col("ts") >= F.col("today") - F.expr("INTERVAL 6 DAYS")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("saved"))), F.lit(0))
    return x.groupBy("call").agg(F.count("*").alias("n"), total(day).alias("today"), total(week).alias("week"), F.sum("saved").alias("whole"))


@q("usage_rollup", f"WITH {USE}, s AS (SELECT call, greatest(file_chars - snippet_chars, 0) AS saved, ts >= today AS d, ts >= today - INTERVAL 6 DAY AS w FROM u, m) SELECT call, count(*) AS n, CAST(coalesce(sum(saved) FILTER (d), 0) AS BIGINT) AS today, CAST(coalesce(sum(saved) FILTER (w), 0) AS BIGINT) AS week, CAST(sum(saved) AS BIGINT) AS whole FROM s GROUP BY call")
def usage_rollup(spark, sf):
    return usage_sums(spark, sf)


@q("usage_report", f"""WITH {USE}, p AS (SELECT 1 AS n, 'today' AS period, today AS since FROM m UNION ALL SELECT 2, 'last 7 days', today - INTERVAL 6 DAY FROM m UNION ALL SELECT 3, 'all time', TIMESTAMP '1970-01-01 00:00:00' FROM m),
s AS (SELECT n, period, call, count(*) AS calls, CAST(sum(greatest(file_chars - snippet_chars, 0)) AS BIGINT) AS saved, CAST(sum(greatest(file_chars, 0)) AS BIGINT) AS whole FROM p JOIN u ON ts >= since GROUP BY ALL),
r AS (SELECT *, saved // 4 AS tokens, least(greatest(saved / greatest(whole, 1)::DOUBLE, 0), 1) AS share FROM s)
SELECT period, call, calls, CASE WHEN tokens >= 1000000 THEN printf('%.1fM', tokens / 1000000.0::DOUBLE) WHEN tokens >= 1000 THEN printf('%.1fk', tokens / 1000.0::DOUBLE) ELSE CAST(tokens AS VARCHAR) END AS saved,
 repeat('#', CAST(floor(share * 16 + 0.5) AS INTEGER)) || repeat('-', 16 - CAST(floor(share * 16 + 0.5) AS INTEGER)) AS bar, CAST(floor(share * 100 + 0.5) AS INTEGER) AS percent FROM r""")
def usage_report(spark, sf):
    return K.usage_report(usage(spark, sf))


@q("relative_time", """WITH t(s) AS (VALUES (-5), (0), (59), (60), (3599), (3600), (86399), (86400), (604799), (604800), (2591999), (2592000), (31535999), (31536000), (63071999), (63072000), (200000000)), d AS (SELECT s, TIMESTAMP '2024-05-06 07:08:09' - to_seconds(s) AS moment FROM t)
SELECT s, CASE WHEN s < 0 THEN strftime(moment, '%Y-%m-%d') WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 604800 THEN s // 86400 || 'd ago' WHEN s < 2592000 THEN s // 604800 || 'w ago' WHEN s < 31536000 THEN s // 2592000 || 'mo ago' WHEN s < 63072000 THEN strftime(moment, '%Y-%m-%d') ELSE s // 31536000 || 'y ago' END AS ago FROM d""")
def relative_time(spark, sf):
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    t = spark.createDataFrame([(s,) for s in (-5, 0, 59, 60, 3599, 3600, 86399, 86400, 604799, 604800, 2591999, 2592000, 31535999, 31536000, 63071999, 63072000, 200000000)], "s int")
    return t.select("s", T.relative_time(now, now - F.make_interval(secs=F.col("s"))).alias("ago"))


@q("number_words", "SELECT o_orderkey AS n, CASE WHEN o_orderkey = 1 THEN '1 row' ELSE o_orderkey || ' rows' END AS words, format('{:,}', o_orderkey * 12345) AS big, '\"' || o_orderpriority || '\"' AS name FROM orders")
def number_words(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("n"), T.plural(k, "row").alias("words"), T.thousands(k * 12345).alias("big"), T.quoted(F.col("o_orderpriority")).alias("name"))


@q("latency_stats", "WITH r AS (SELECT event_type AS call, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT call, max(n) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, max(value) FILTER (pos = ceil(n * 50 / 100)) AS p50, max(value) FILTER (pos = ceil(n * 95 / 100)) AS p95, max(value) FILTER (pos = ceil(n * 99 / 100)) AS p99 FROM r GROUP BY call")
def latency_stats(spark, sf):
    return K.latency(table(spark, sf, "events").select(F.col("event_type").alias("call"), "value"), "call", "value")


@q("recent_commits", "SELECT event_id, ts FROM (SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE starts_with(event_type, 'p')")
def recent_commits(spark, sf):
    """The newest hundred, and of these the ones that pass; the filter lets no older one in."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("commit"), "ts", "event_type")
    return H.latest(e, 100).filter(F.col("event_type").startswith("p")).select(F.col("commit").alias("event_id"), "ts")


#: A history of the events: ten are a commit; each writes or removes a file of its user. Same text in both engines.
COMMIT_OF, FILE_OF = "CAST(floor(event_id / 10) AS BIGINT)", "'src/' || event_type || '/u' || CAST(user_id % 40 AS STRING) || '.py'"
VERSIONS = f"""last AS (SELECT event_id, {COMMIT_OF} AS c, {FILE_OF} AS path, 'b' || CAST(event_id % 60 AS STRING) AS blob, event_id % 9 = 4 AS gone, row_number() OVER (PARTITION BY {COMMIT_OF}, {FILE_OF} ORDER BY event_id DESC) AS k FROM events),
versions AS (SELECT path, blob, gone, c, coalesce(lead(c) OVER (PARTITION BY path ORDER BY c), 1000000000) AS til FROM last WHERE k = 1)"""


@q("recent_changes", f"""WITH {VERSIONS}, commits AS (SELECT {COMMIT_OF} AS c, max(ts) AS ts FROM events GROUP BY ALL), first AS (SELECT *, row_number() OVER (ORDER BY c DESC) AS place FROM commits ORDER BY c DESC LIMIT 40),
t AS (SELECT f.c, path, blob FROM first f JOIN versions v ON v.c <= f.c AND f.c < v.til WHERE NOT gone), p AS (SELECT f.c, path, blob FROM first f JOIN versions v ON v.c <= f.c - 1 AND f.c - 1 < v.til WHERE NOT gone),
d AS (SELECT coalesce(t.c, p.c) AS c, coalesce(t.path, p.path) AS path, t.blob AS now, p.blob AS was FROM t FULL JOIN p ON t.c = p.c AND t.path = p.path WHERE t.blob IS DISTINCT FROM p.blob),
g AS (SELECT c, path, was AS blob, row_number() OVER (PARTITION BY c, was ORDER BY path) AS k FROM d WHERE now IS NULL), n AS (SELECT c, now AS blob, row_number() OVER (PARTITION BY c, now ORDER BY path) AS k FROM d WHERE was IS NULL),
a AS (SELECT c, path FROM d WHERE now IS NOT NULL UNION ALL SELECT c, path FROM g ANTI JOIN n USING (c, blob, k))
SELECT first.c AS commit, place, path FROM first JOIN a USING (c) WHERE starts_with(path, 'src/p')""")
def recent_changes(spark, sf):
    """The files that the newest forty commits change below a folder, against their first parents."""
    e = table(spark, sf, "events")
    # ten events are one commit, in the order of their numbers; some commits are merges
    commits = e.groupBy(F.expr(COMMIT_OF).alias("commit")).agg(F.max("ts").alias("at")).select("commit", "at", F.timestamp_seconds("commit").alias("ts"))
    commits = commits.withColumn("parents", F.expr("CASE WHEN commit = 0 THEN array() WHEN commit % 7 = 0 THEN array(commit - 1, commit - 2) ELSE array(commit - 1) END"))
    top = commits.agg(F.max("commit")).first()[0]
    rows = e.selectExpr("event_id", f"{COMMIT_OF} AS c", f"{FILE_OF} AS path", "concat('b', event_id % 60) AS blob", "event_id % 9 = 4 AS gone")
    last = rows.groupBy("path", "c").agg(F.max_by(F.struct("blob", "gone"), "event_id").alias("v"))
    til = F.coalesce(F.lead("c").over(Window.partitionBy("path").orderBy("c")), F.lit(top + 1))
    versions = last.select("path", "c", "v.*", til.alias("til")).filter(~F.col("gone") & (F.col("til") > top - 40))
    whole = F.sequence(F.greatest("c", F.lit(top - 40)), F.least(F.col("til") - 1, F.lit(top)))  # trees of the commits asked for and their parents
    trees = versions.select(F.explode(whole).alias("commit"), "path", "blob")
    return H.recent_changes(commits, trees, 40, "src/p").select("commit", "place", F.explode("files").alias("path"))


IGNORED_SQL = f"""WITH {CORPUS}, p AS (SELECT DISTINCT file AS path, split_part(file, '/', 1) AS a, split_part(file, '/', 2) AS s, split_part(file, '/', 3) AS b FROM corpus)
SELECT path, (a = 'src' AND ((starts_with(b, 'doc_1') AND ends_with(b, '.py') AND b <> 'doc_13.py') OR b = '__init__.py')) OR (a = 'tests' AND ends_with(b, '_test.py') AND NOT starts_with(b, 'doc_2'))
 OR (a = 'compat' AND starts_with(s, 'src1')) OR (a = 'examples' AND regexp_full_match(b, 'doc_3.\\.ts')) OR (a = 'types' AND s = 'src2' AND starts_with(b, 'doc_4') AND ends_with(b, '.d.ts')) AS ignored FROM p"""


@q("ignore_corpus", IGNORED_SQL)
def ignore_corpus(spark, sf):
    """All paths of the corpus against ignore files in every source's folders."""
    lines = [("git", "src", 1, "doc_1*.py"), ("git", "src", 2, "!doc_13.py"), ("git", "src", 3, "__init__.py"), ("git", "tests", 1, "*_test.py"), ("git", "tests", 2, "!doc_2*_test.py")]
    root = [("git", "", 1, "# folders"), ("git", "", 2, "compat/src1*/"), ("git", "", 3, "examples/**/doc_3?.ts"), ("own", "", 1, "types/src2/doc_4*.d.ts"), ("own", "", 2, "!src/**/doc_1*.py"), ("own", "", 3, "doc_50.py/")]
    folders = table(spark, sf, "documents").select("source").distinct()
    per = spark.createDataFrame(lines, "family string, top string, seq int, line string")
    nested = folders.crossJoin(per).select("family", F.concat_ws("/", "top", "source").alias("scope"), "seq", "line")  # five lines a folder
    rules = C.compiled_rows(nested.unionByName(spark.createDataFrame(root, "family string, scope string, seq int, line string")))
    return C.ignored(corpus(spark, sf).select(F.col("file").alias("path")).distinct(), rules)


# --- catalogue: the driver's tables described as a schema ------------------------------------------
TABS = Literal("tabs", 'schema string, "table" string, kind string'.replace('"', ""), [("public", "customer", "BASE TABLE"), ("sales", "orders", "BASE TABLE"), ("public", "v_orders", "VIEW"), ("sales", "lineitem", "BASE TABLE")])
COLS = Literal("cols", "schema string, table string, ordinal int, column string, type string, not_null boolean", [
    ("public", "customer", 1, "id", "bigint", True), ("public", "customer", 2, "name", "character varying(25)", False), ("sales", "orders", 1, "id", "bigint", True),
    ("sales", "orders", 2, "customer_id", "bigint", True), ("sales", "lineitem", 1, "order_id", "bigint", True), ("public", "v_orders", 1, "id", "bigint", False),
])
CONS = Literal("cons", "constraint string, type string", [("pk_c", "PRIMARY KEY"), ("uq_n", "UNIQUE"), ("pk_o", "PRIMARY KEY"), ("fk_o", "FOREIGN KEY")])
USAGE = Literal("usage", "constraint string, table string, column string, ref_table string, ref_column string", [
    ("pk_c", "customer", "id", None, None), ("uq_n", "customer", "name", None, None), ("pk_o", "orders", "id", None, None), ("fk_o", "orders", "customer_id", "customer", "id"),
    ("fk_l", "lineitem", "order_id", "orders", "id"), ("fk_l2", "lineitem", "customer_id", "customer", "id"),
])
IDX = Literal("idx", "table string, index string, seq int, column string", [("orders", "PRIMARY", 1, "id"), ("orders", "ix_a", 2, "b"), ("orders", "ix_a", 1, "a"), ("customer", "ix_n", 1, "name")])


def _quoted(sql: str) -> str:
    import re

    return re.sub(r'(?<![\w"\'])(table|column|constraint|index|schema|type|usage)(?![\w"\'(])', r'"\1"', sql)


@q("catalog_columns", _quoted(f"WITH {TABS.cte}, {COLS.cte} SELECT CASE WHEN t.schema = 'public' THEN t.table ELSE t.schema || '.' || t.table END AS table, ordinal, column, type, not_null FROM tabs t JOIN cols c ON t.schema = c.schema AND t.table = c.table WHERE kind = 'BASE TABLE'"))
def catalog_columns(spark, sf):
    return K.columns(TABS.df(spark), COLS.df(spark))


@q("catalog_keys", _quoted(f"WITH {CONS.cte}, {USAGE.cte} SELECT table, column, bool_or(type = 'PRIMARY KEY') AS is_pk, bool_or(type = 'UNIQUE') AS is_unique FROM cons c JOIN usage u ON c.constraint = u.constraint WHERE type IN ('PRIMARY KEY', 'UNIQUE') GROUP BY ALL"))
def catalog_keys(spark, sf):
    return K.keys(CONS.df(spark), USAGE.df(spark))


@q("catalog_fks", _quoted(f"WITH {USAGE.cte} SELECT table, column, ref_table || '.' || ref_column AS target FROM usage WHERE ref_table IS NOT NULL"))
def catalog_fks(spark, sf):
    return K.foreign_keys(USAGE.df(spark))


@q("fk_backrefs", _quoted(f"WITH {USAGE.cte} SELECT ref_table AS table, string_agg(table || '.' || column, ', ' ORDER BY table || '.' || column) AS referrers FROM usage WHERE ref_table IS NOT NULL GROUP BY ref_table"))
def fk_backrefs(spark, sf):
    return K.back_references(K.foreign_keys(USAGE.df(spark)))


@q("index_columns", _quoted(f"WITH {IDX.cte} SELECT table, index, string_agg(column, ', ' ORDER BY seq) AS columns FROM idx WHERE index <> 'PRIMARY' GROUP BY ALL"))
def index_columns(spark, sf):
    return K.index_columns(IDX.df(spark))


ROUTINES = Literal("routines", "schema string, name string, kind string, ordinal int, param string, type string, returns string", [
    ("public", "add_tax", "FUNCTION", 2, "rate", "numeric", "numeric"), ("public", "add_tax", "FUNCTION", 1, "net", "numeric", "numeric"), ("sales", "close_day", "PROCEDURE", None, "", None, None), ("sales", "move", "PROCEDURE", 1, "", "bigint", None),
])
LONG_VIEW = "SELECT 1" + "\n, 2" * 60
VIEWS = Literal("vs", "schema string, name string, kind string, definition string", [("public", "recent", "VIEW", " SELECT id FROM orders; "), ("sales", "sums", "MATERIALIZED VIEW", LONG_VIEW), ("public", "orders", "BASE TABLE", "")])


@q("routine_signatures", _quoted(f"WITH {ROUTINES.cte} SELECT schema, name, kind, CASE WHEN schema = 'public' THEN name ELSE schema || '.' || name END || '(' || coalesce(string_agg(trim(param || ' ' || type), ', ' ORDER BY ordinal), '') || ')' || coalesce(' → ' || max(returns), '') AS signature FROM routines GROUP BY schema, name, kind"))
def routine_signatures(spark, sf):
    return K.routines(ROUTINES.df(spark))


@q("catalog_views", """SELECT * FROM (VALUES ('recent', 'SELECT id FROM orders'), ('sales.sums', 'SELECT 1' || repeat(chr(10) || ', 2', 49) || chr(10) || '...')) AS t(view, body)""")
def catalog_views(spark, sf):
    return K.views(VIEWS.df(spark))


@q("render_table", _quoted(f"WITH {COLS.cte} SELECT table, 'TABLE ' || table || chr(10) || string_agg('  ' || column || ' ' || replace(type, 'character varying', 'varchar') || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END, chr(10) ORDER BY ordinal) AS body FROM cols GROUP BY table"))
def render_table(spark, sf):
    no = F.lit(False)
    mods = K.modifiers(no, F.col("not_null"), no, F.lit(""), F.lit(""))
    return K.render_tables(COLS.df(spark).select("table", "ordinal", "column", T.type_shorthand(F.col("type")).alias("type"), mods.alias("mods")))


@q("schema_filter", "WITH s(name) AS (VALUES ('public'), ('pg_temp_1'), ('information_schema'), ('sales'), ('audit')) SELECT name, name NOT IN ('information_schema', 'pg_catalog', 'pg_toast') AND NOT starts_with(name, 'pg_') AND name <> 'audit' AS ok FROM s")
def schema_filter(spark, sf):
    s = spark.createDataFrame([(x,) for x in ("public", "pg_temp_1", "information_schema", "sales", "audit")], "name string")
    return s.select("name", C.allowed_schema(F.col("name"), "postgres", [], ["audit"]).alias("ok"))


@q("row_sample", "SELECT c_custkey AS id, c_name AS name, CASE WHEN length(html) > 80 THEN substr(html, 1, 80) || '…' ELSE html END AS cell FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5) JOIN pages ON page_id = c_custkey")
def row_sample(spark, sf):
    first = table(spark, sf, "customer").orderBy("c_custkey").limit(5)
    return first.join(table(spark, sf, "pages"), F.col("page_id") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), K.sample_cell(F.col("html")).alias("cell"))


@q("approx_rows", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem")))
def approx_rows(spark, sf):
    out = None
    for t in ("customer", "orders", "lineitem"):
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@q("provenance", _quoted(f"WITH {TABS.cte} SELECT 'db://postgres@localhost:5432/' || schema || '.' || table AS file, strftime(TIMESTAMP '2024-05-06 07:08:09', '-- indexed at %Y-%m-%dT%H:%MZ from localhost') AS header FROM tabs"))
def provenance(spark, sf):
    at = F.date_format(F.lit("2024-05-06 07:08:09").cast("timestamp"), "yyyy-MM-dd'T'HH:mm'Z'")
    return TABS.df(spark).select(F.concat(F.lit("db://postgres@localhost:5432/"), F.concat_ws(".", "schema", "table")).alias("file"), F.concat(F.lit("-- indexed at "), at, F.lit(" from localhost")).alias("header"))


MIG = Literal("m", "path string", [(x,) for x in ("db/V1__a.sql", "db/V2__b.sql", "x/20240101000000_a.sql", "x/20240102000000_b.sql", "y/1_a.sql", "y/notes.sql", "z/001_a.sql", "z/2_b.sql", "w/V3__only.sql")])


@q("migration_dirs", f"WITH {MIG.cte}, c AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS b FROM m), k AS (SELECT dir, CASE WHEN regexp_matches(b, '^[0-9]{{14}}') THEN 'timestamp' WHEN regexp_matches(b, '^V[0-9]+__') THEN 'versioned' WHEN regexp_matches(b, '^[0-9]+_') THEN 'numbered' END AS class FROM c) SELECT dir, class, count(*) AS n FROM k WHERE class IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def migration_dirs(spark, sf):
    return D.migration_dirs(MIG.df(spark))


@q("ddl_tables", """SELECT * FROM (VALUES
 ('db/V1__init.sql', 0, 'table', 'users', 'TABLE users|  id BIGINT PRIMARY KEY|  email TEXT NOT NULL|  name VARCHAR(20)|  CONSTRAINT uq UNIQUE (email)|  INDEX ix_email (email)'),
 ('db/V2__more.sql', 0, 'view', 'v', 'VIEW v AS SELECT id FROM users'), ('db/V2__more.sql', 1, 'alter', 'users', 'ALTER TABLE users ADD COLUMN age INT DEFAULT 0'),
 ('db/V2__more.sql', 2, 'alter', 'users', 'ALTER TABLE users RENAME COLUMN name TO full_name'), ('db/V3__drop.sql', 0, 'table', 's.log', 'TABLE s.log|  at TIMESTAMP|  msg TEXT'),
 ('db/V3__drop.sql', 1, 'alter', 'users', 'ALTER TABLE users DROP COLUMN age, ALTER COLUMN email TYPE VARCHAR(99)'), ('db/V3__drop.sql', 2, 'alter', 'users', 'ALTER TABLE users DROP CONSTRAINT uq'),
 ('db/V3__drop.sql', 3, 'alter', 'users', 'ALTER TABLE users OWNER TO admin'), ('other/schema.sql', 0, 'table', 'Odd Name', 'TABLE Odd Name|  a int|  b text default ''x;y''|  UNIQUE INDEX u1 (a, b)')
) AS t(path, seq, kind, name, b), LATERAL (SELECT replace(b, '|', chr(10)) AS body)""".replace("SELECT * FROM (VALUES", "SELECT path, CAST(seq AS INTEGER) AS seq, kind, name, body FROM (VALUES"))
def ddl_tables(spark, sf):
    return D.parsed(spark.createDataFrame(D.EXAMPLES, "path string, text string"))


@q("fold_migrations", """SELECT dir, CAST(seq AS INTEGER) AS seq, kind, name, replace(b, '|', chr(10)) AS body FROM (VALUES
 ('db', 0, 'table', 'users', 'TABLE users|  id BIGINT PRIMARY KEY|  email VARCHAR(99) NOT NULL|  full_name VARCHAR(20)|  INDEX ix_email (email)'), ('db', 1, 'table', 's.log', 'TABLE s.log|  at TIMESTAMP|  msg TEXT'),
 ('db', 2, 'view', 'v', 'VIEW v AS SELECT id FROM users'), ('db', 3, 'alter', 'users', 'ALTER TABLE users OWNER TO admin')) AS t(dir, seq, kind, name, b)""")
def fold_migrations(spark, sf):
    return D.folded(spark.createDataFrame(D.EXAMPLES, "path string, text string"))


@q("extract_defs", """SELECT * FROM (VALUES
 ('a.py', 'A.f(q) 4-5, g(z) 6-7', 'A', 'ValueError@f, z.run@g, p.join@g', 'p, y', 'ValueError'),
 ('b.go', 'S.Run(x) 4-4, main() 5-5', 'S', 'Get@Run, Run@main', 'http', ''),
 ('c.ts', 'W.draw(x) 3-3, go() 5-5', 'W', 'this.paint@draw, Error@draw, a@go', 'a', 'Error'),
 ('d.rs', 'P.area() 3-3', 'P', 'sq@area', 'fmt', '')) AS t(path, functions, classes, calls, imports, raises)""")
def extract_defs(spark, sf):
    x = G.extracted(spark.createDataFrame(G.EXAMPLES, "path string, text string"))
    listed = lambda c, f: F.array_join(F.transform(c, f), ", ").alias(c)
    owner = lambda name, of: F.concat(F.when(of != "", F.concat(of, F.lit("."))).otherwise(""), name)
    fn = lambda f: F.concat(owner(f["name"], f["enclosing_class"]), F.lit("("), F.array_join(f["params"], ", "), F.lit(") "), f["start_line"], F.lit("-"), f["end_line"])
    call = lambda c: F.concat(owner(c["callee"], c["receiver"]), F.lit("@"), c["enclosing_symbol"])
    return x.select("path", listed("functions", fn), listed("classes", lambda c: c["name"]), F.array_join(F.transform("call_refs", call), ", ").alias("calls"), F.array_join("imports", ", ").alias("imports"), F.array_join("raises", ", ").alias("raises"))


@q("encode_mean", f"""WITH {CORPUS}, {terms_sql('corpus', 'chunk_id', 'text', 'terms')}, n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT chunk_id, length(term) % (SELECT n FROM n) AS vec_id, 1.0::DOUBLE + length(term) % 3 AS w FROM terms),
x AS (SELECT chunk_id, i, sum(w * embedding[i]::DOUBLE) / sum(w) AS x FROM w JOIN embeddings USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), z AS (SELECT chunk_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY chunk_id) SELECT chunk_id, CAST(i - 1 AS INTEGER) AS i, round(x / norm, 5) + 0.0 AS x FROM x JOIN z USING (chunk_id) UNION ALL SELECT chunk_id, CAST(i AS INTEGER), 0.0 FROM corpus, (SELECT unnest(range(0, 64)) AS i) WHERE chunk_id NOT IN (SELECT chunk_id FROM x)""")
def encode_mean(spark, sf):
    t = rows(blocks(corpus(spark, sf)))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    w = t.crossJoin(n).select("chunk_id", (F.length("term") % F.col("n")).alias("vec_id"), (F.col("tf") * (1.0 + F.length("term") % 3)).alias("w"))
    return P.weighted_mean(w, e, corpus(spark, sf)).select("chunk_id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 5) + 0.0)


@q("search_response", f"{HITS}, c AS (SELECT query_id, rank, file, text, score, {TOKENS_SQL} + {TOKENS_SQL.replace('text', 'file')} + 8 AS cost FROM hits WHERE rank <= 5), u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM c), r AS (SELECT * FROM u WHERE rank = 1 OR used <= 4000) SELECT query_id, '[' || string_agg('{{\"file\":' || to_json(file) || ',\"rank\":' || rank || ',\"score\":' || printf('%.4f', score) || ',\"text\":' || to_json(text) || '}}', ',' ORDER BY rank) || ']' AS body, count(*) AS hits FROM r GROUP BY query_id")
def search_response(spark, sf):
    return S.render_json(S.within_budget(hits(spark, sf, 5), 4000))


@q("mode_downgrade", """WITH m(mode) AS (VALUES ('bm25'), ('semantic'), ('hybrid'), ('hybrid-rerank')), b(x) AS (VALUES (true), (false))
SELECT mode, v.x AS vectors, s.x AS scorer, CASE WHEN mode = 'bm25' OR NOT v.x THEN 'bm25' WHEN mode = 'hybrid-rerank' AND NOT s.x THEN 'hybrid' ELSE mode END AS served FROM m, b v, b s""")
def mode_downgrade(spark, sf):
    from ..sources.index import MODES, resolve_mode

    rows = [(m, v, n, resolve_mode(m, v, n)) for m in MODES for v in (False, True) for n in (False, True)]
    return spark.createDataFrame(rows, "mode string, vectors boolean, scorer boolean, served string")
