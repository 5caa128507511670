"""Retrieval queries: BM25, vectors, fusion, boosts, expansion, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import expansion as X
from ..operators import retrieval as R
from ..operators.substring import GramIndex, grep_cost, holders
from .q_text import PENALTY_SQL
from .sample import ASKED, ASKED2, CORPUS, CORPUS2, PREDICTED, Literal, asked, asked2, corpus, corpus2, table, terms_sql

Q, O = {}, {}


def q(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


POST = f"""{CORPUS}, live AS (SELECT chunk_id, text FROM corpus WHERE NOT deleted), {terms_sql('live', 'chunk_id', 'text', 'terms')},
post AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL), dls AS (SELECT l.chunk_id, coalesce(sum(tf), 0) AS dl FROM live l LEFT JOIN post p USING (chunk_id) GROUP BY l.chunk_id),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""
BM25 = f"""{POST}, {ASKED}, {terms_sql('asked', 'query_id', 'query', 'wanted')},
times AS (SELECT query_id, term, count(*) AS times FROM wanted GROUP BY ALL),
bm25 AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM times JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (chunk_id), stats GROUP BY query_id, chunk_id HAVING score > 0)"""


def rank_sql(src: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {src}) WHERE rank <= {k})"


VECS = "vecs AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings), qv AS (SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON item_id * 3 = vec_id)"
DOT = "round(list_sum(list_transform(list_zip(qvec, vec), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9)"
KNN = f"{VECS}, cos AS (SELECT query_id, chunk_id, {DOT} AS score FROM qv, vecs)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def qvecs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("qvec"))
    return table(spark, sf, "benchmark").select("item_id", (F.col("item_id") * 3).alias("vec_id")).join(e, "vec_id").select(F.col("item_id").alias("query_id"), "qvec")


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@q("bm25_stats", f"WITH {POST} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM dfs, stats")
def bm25_stats(spark, sf):
    index = R.scanned(corpus(spark, sf))
    return r6(index.terms.crossJoin(index.stats).select("term", "df", "n", "avgdl"), "avgdl")


@q("term_idf", f"WITH {POST} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats")
def term_idf(spark, sf):
    index = R.scanned(corpus(spark, sf))
    return r6(index.terms.crossJoin(index.stats).select("term", R.idf(F.col("n"), F.col("df")).alias("idf")), "idf")


@q("bm25_score", f"WITH {BM25} SELECT query_id, count(*) AS hits, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM bm25 GROUP BY query_id")
def bm25_score(spark, sf):
    s = R.bm25(asked(spark, sf), corpus(spark, sf))
    return s.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


TOP = f"WITH {BM25}, {rank_sql('bm25', 10, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top"


def bm25_top(spark, sf, k=10):
    return R.best(asked(spark, sf), corpus(spark, sf), k)


@q("bm25_topk", TOP)
def bm25_topk(spark, sf):
    return r6(bm25_top(spark, sf).select("query_id", "rank", "chunk_id", "score"), "score")


@q("search_bm25", f"WITH {BM25}, {rank_sql('bm25', 5, 'top')} SELECT query_id, query, rank, chunk_id, file, round(score, 6) AS score FROM top JOIN asked USING (query_id) JOIN corpus USING (chunk_id)")
def search_bm25(spark, sf):
    c = corpus(spark, sf)
    hits = bm25_top(spark, sf, 5).join(asked(spark, sf), "query_id").join(c.select("chunk_id", "file"), "chunk_id")
    return r6(hits.select("query_id", "query", "rank", "chunk_id", "file", "score"), "score")


KNN_TOP = f"WITH {KNN}, {rank_sql('cos', 10, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top"


@q("knn_cosine", KNN_TOP)
def knn_cosine(spark, sf):
    return r6(R.knn(qvecs(spark, sf), vectors(spark, sf), 10).select("query_id", "rank", "chunk_id", "score"), "score")


Q["search_semantic"], O["search_semantic"] = Q["knn_cosine"], KNN_TOP


@q("search_qvec", f"WITH {VECS}, v AS (SELECT query_id, list_transform(qvec, lambda x: -x) AS qvec FROM qv), cos AS (SELECT query_id, chunk_id, {DOT} AS score FROM v, vecs), {rank_sql('cos', 3, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top")
def search_qvec(spark, sf):
    turned = qvecs(spark, sf).withColumn("qvec", F.transform("qvec", lambda x: -x))
    return r6(R.knn(turned, vectors(spark, sf), 3).select("query_id", "rank", "chunk_id", "score"), "score")


@q("topk", "SELECT orders.o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(25)


FUSED = f"""WITH {BM25}, {KNN}, {rank_sql('bm25', 50, 'lex')}, {rank_sql('cos', 50, 'sem')},
fused AS (SELECT query_id, chunk_id, round(sum(s), 12) AS score FROM (SELECT query_id, chunk_id, 0.5::DOUBLE / (60 + rank) AS s FROM sem UNION ALL SELECT query_id, chunk_id, 0.5::DOUBLE / (60 + rank) AS s FROM lex) GROUP BY ALL)"""


def fused(spark, sf):
    lex, sem = bm25_top(spark, sf, 50), R.knn(qvecs(spark, sf), vectors(spark, sf), 50)
    return R.fuse([(sem, F.lit(0.5)), (lex, F.lit(0.5))])


@q("rrf_fuse", f"{FUSED} SELECT query_id, chunk_id, round(score, 9) AS score FROM fused")
def rrf_fuse(spark, sf):
    return fused(spark, sf).withColumn("score", F.round("score", 9))


COH = f"""{FUSED}, x AS (SELECT query_id, chunk_id, file, score, sum(score) OVER f AS total, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, chunk_id) AS best, max(score) OVER (PARTITION BY query_id) AS top
  FROM fused JOIN corpus USING (chunk_id) WINDOW f AS (PARTITION BY query_id, file)),
coh AS (SELECT query_id, chunk_id, file, round(score + CASE WHEN best = 1 AND top > 0 THEN top * 0.2::DOUBLE * total / max(total) OVER (PARTITION BY query_id) ELSE 0 END, 12) AS score FROM x)"""


def files(spark, sf):
    return corpus(spark, sf).select("chunk_id", "file")


@q("file_coherence", f"{COH} SELECT query_id, chunk_id, file, round(score, 8) AS score FROM coh")
def file_coherence(spark, sf):
    return R.coherence(fused(spark, sf), files(spark, sf)).withColumn("score", F.round("score", 8))


def saturation_sql(src: str, k: int) -> str:
    return f"""pen AS (SELECT query_id, chunk_id, file, round(score * {PENALTY_SQL}, 12) AS pen FROM (SELECT *, file AS p FROM {src})),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pen DESC, file, chunk_id) - 1 AS pos FROM pen),
eff AS (SELECT *, pen * pow(0.5, row_number() OVER (PARTITION BY query_id, file ORDER BY pos) - 1) AS eff FROM pos),
low AS (SELECT *, min(eff) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM eff),
stop AS (SELECT *, min(CASE WHEN pos >= {k} AND pen <= low THEN pos END) OVER (PARTITION BY query_id) AS stop FROM low),
sat AS (SELECT query_id, chunk_id, file, eff AS score, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, chunk_id) AS rank FROM stop WHERE stop IS NULL OR pos < stop)"""


@q("saturation_topk", f"{COH}, {saturation_sql('coh', 10)} SELECT query_id, rank, chunk_id, file, round(score, 8) AS score FROM sat WHERE rank <= 10")
def saturation_topk(spark, sf):
    out = R.saturated(R.coherence(fused(spark, sf), files(spark, sf)), 10)
    return out.select("query_id", "rank", "chunk_id", "file", F.round("score", 8).alias("score"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
PARTS = "CASE WHEN contains({x}, '_') THEN list_filter(string_split(lower({x}), '_'), lambda x: x <> '') ELSE list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) END"


def stems_sql(src: str) -> str:
    return f"""kws AS (SELECT query_id, list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2), lambda w: lower(w))), lambda w: w NOT IN ({STOPS})) AS kw FROM asked),
names AS (SELECT DISTINCT file, regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') AS stem, coalesce(string_split(file, '/')[-2], '') AS folder FROM corpus),
np AS (SELECT file, stem, folder, {PARTS.format(x='stem')} AS sp, {PARTS.format(x='folder')} AS fp FROM names),
parts AS (SELECT file, list_distinct(list_concat(CASE WHEN len(sp) >= 2 THEN list_concat([lower(stem)], sp) ELSE [lower(stem)] END, CASE WHEN folder = '' THEN [] WHEN len(fp) >= 2 THEN list_concat([lower(folder)], fp) ELSE [lower(folder)] END)) AS parts FROM np),
rat AS (SELECT query_id, file, CASE WHEN len(kw) = 0 THEN 0 ELSE len(list_filter(kw, lambda w: list_contains(parts, w) OR len(list_filter(parts, lambda x: least(length(x), length(w)) >= 3 AND (starts_with(x, w) OR starts_with(w, x)))) > 0))::DOUBLE / len(kw) END AS ratio FROM kws, parts),
stm AS (SELECT s.query_id, chunk_id, s.file, round(score + CASE WHEN ratio >= 0.1 THEN max(score) OVER (PARTITION BY s.query_id) * ratio ELSE 0 END, 12) AS score FROM {src} s JOIN rat r ON s.query_id = r.query_id AND s.file = r.file)"""


ASK2 = Literal("asked", "query_id int, query string", [(1, "where is the test package doc"), (2, "src1 types"), (3, "compat of src3 documents"), (4, "a of the"), (5, "examples doc_12")])
SCORED = "scored AS (SELECT query_id, chunk_id, file, round(1.0::DOUBLE / (1 + (chunk_id * 7 + query_id) % 13), 12) AS score FROM corpus, asked WHERE chunk_id % 5 = query_id % 5)"


def literal_scores(spark, sf):
    c, a = files(spark, sf), ASK2.df(spark)
    x = c.join(a, F.col("chunk_id") % 5 == F.col("query_id") % 5)
    return x.select("query_id", "chunk_id", "file", F.round(1.0 / (1 + (F.col("chunk_id") * 7 + F.col("query_id")) % 13), 12).alias("score"))


@q("boost_stem", f"WITH {CORPUS}, {ASK2.cte}, {SCORED}, {stems_sql('scored')} SELECT query_id, chunk_id, file, round(score, 8) AS score FROM stm")
def boost_stem(spark, sf):
    return R.boost_stems(literal_scores(spark, sf), ASK2.df(spark)).withColumn("score", F.round("score", 8))


#: A query that is one name, as SQL; the same words as in the class query.
IS_SYMBOL = r"regexp_full_match(trim(query), '(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9_]*)')"
DEFINED2 = r"""(list_contains(list_transform(regexp_extract_all(text, '(?m)(?:^|\s)(?:class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef)\s+((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*[A-Za-z_][A-Za-z0-9_]*)(?:\s|[<({:\[;]|$)', 1), lambda n: regexp_extract(n, '[A-Za-z0-9_]*$')), symbol)
 OR list_contains(list_transform(regexp_extract_all(text, '(?im)(?:^|\s)(?:create table|create view|create procedure|create function)\s+((?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*[A-Za-z_][A-Za-z0-9_]*)(?:\s|[<({:\[;]|$)', 1), lambda n: lower(regexp_extract(n, '[A-Za-z0-9_]*$'))), lower(symbol)))"""
SAME_STEM = "(stem = n OR replace(stem, '_', '') = n OR rtrim(stem, 's') = n OR rtrim(replace(stem, '_', ''), 's') = n)"
STEM = "lower(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', ''))"
BM25H = BM25.replace(CORPUS, CORPUS2).replace(ASKED, ASKED2).replace(terms_sql("asked", "query_id", "query", "wanted"), terms_sql("bag", "query_id", "query", "wanted"))
HYBRID = f"""WITH {BM25H}, vecs AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM corpus WHERE deleted)), qv AS (SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON item_id * 3 = vec_id),
cos AS (SELECT query_id, chunk_id, {DOT} AS score FROM qv, vecs), {rank_sql('bm25', 50, 'lex')}, {rank_sql('cos', 50, 'sem')},
kinds AS (SELECT query_id, query, {IS_SYMBOL} AS sym, trim(query) AS q FROM asked), named AS (SELECT query_id, CASE WHEN contains(q, '::') THEN string_split(q, '::')[-1] WHEN contains(q, '\\') THEN string_split(q, '\\')[-1] WHEN contains(q, '->') THEN string_split(q, '->')[-1] WHEN contains(q, '.') THEN string_split(q, '.')[-1] ELSE q END AS symbol FROM kinds WHERE sym),
fused AS (SELECT query_id, chunk_id, round(sum(CASE WHEN arm = 1 THEN a ELSE 1 - a END / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank, 1 AS arm FROM sem UNION ALL SELECT query_id, chunk_id, rank, 2 FROM lex) JOIN (SELECT query_id, CASE WHEN sym THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS a FROM kinds) USING (query_id) GROUP BY ALL),
{COH[len(FUSED) + 2:]},
tops AS (SELECT query_id, max(score) AS top FROM coh GROUP BY query_id),
d1 AS (SELECT query_id, chunk_id, symbol, top, {STEM} AS stem, lower(symbol) AS n, {DEFINED2} AS def FROM named JOIN tops USING (query_id), corpus WHERE NOT deleted),
d2 AS (SELECT query_id, chunk_id, {SAME_STEM} AS ok, top * 3.0::DOUBLE * CASE WHEN {SAME_STEM} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS tier FROM d1 WHERE def),
by_name AS (SELECT query_id, chunk_id, coalesce(c.score, 0) + coalesce(tier, 0) AS score FROM d2 FULL JOIN (SELECT * FROM coh WHERE query_id IN (SELECT query_id FROM named)) c USING (query_id, chunk_id) WHERE c.score IS NOT NULL OR (ok AND tier > 0)),
plain AS (SELECT * FROM coh WHERE query_id NOT IN (SELECT query_id FROM named)), {stems_sql('plain')},
inner_names AS (SELECT DISTINCT query_id, symbol FROM (SELECT query_id, unnest(regexp_extract_all(query, '\\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\\b')) AS symbol FROM kinds WHERE NOT sym UNION ALL SELECT query_id, name FROM predicted)),
tops2 AS (SELECT query_id, max(score) AS top FROM stm GROUP BY query_id),
e1 AS (SELECT query_id, chunk_id, symbol, top, {STEM} AS stem, lower(symbol) AS n, {DEFINED2} AS def FROM inner_names JOIN tops2 USING (query_id), corpus WHERE NOT deleted),
e2 AS (SELECT query_id, chunk_id, max(CASE WHEN def THEN top * 1.5::DOUBLE * CASE WHEN {SAME_STEM} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0 END) AS tier, bool_or(stem = n OR replace(stem, '_', '') = n OR (length(stem) >= 4 AND starts_with(n, stem)) OR (length(replace(stem, '_', '')) >= 4 AND starts_with(n, replace(stem, '_', '')))) AS inj FROM e1 GROUP BY ALL),
by_words AS (SELECT query_id, chunk_id, coalesce(s.score, 0) + coalesce(tier, 0) AS score FROM e2 FULL JOIN stm s USING (query_id, chunk_id) WHERE s.score IS NOT NULL OR (inj AND tier > 0)),
both_kinds AS (SELECT b.query_id, b.chunk_id, file, b.score FROM (SELECT * FROM by_name UNION ALL SELECT * FROM by_words) b JOIN corpus USING (chunk_id)),
{saturation_sql('both_kinds', 10)} SELECT query_id, rank, chunk_id, file, round(score, 8) AS score FROM sat WHERE rank <= 10"""


@q("search_hybrid", HYBRID)
def search_hybrid(spark, sf):
    out = R.hybrid(asked2(spark, sf), corpus2(spark, sf), vectors(spark, sf), qvecs(spark, sf), 10, predicted=PREDICTED.df(spark))
    return out.select("query_id", "rank", "chunk_id", "file", F.round("score", 8).alias("score"))


@q("search_bulk", f"WITH {BM25}, {rank_sql('bm25', 5, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score, (SELECT greatest(count(*) - 20, 0) FROM asked) AS surplus FROM top WHERE query_id IN (SELECT query_id FROM asked ORDER BY query_id LIMIT 20)")
def search_bulk(spark, sf):
    first = R.bulk(asked(spark, sf))
    hits = R.best(first, corpus(spark, sf), 5).join(first.select("query_id", "surplus"), "query_id")
    return r6(hits.select("query_id", "rank", "chunk_id", "score", "surplus"), "score")


@q("search_stored", f"WITH {BM25}, {rank_sql('bm25', 5, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top")
def search_stored(spark, sf):
    """The batch against an index that is written to the shared folder and read back."""
    from uuid import uuid4

    from ..sources import index

    path = f"{index.shared_dir(spark)}/millrace-index-{uuid4().hex}"
    index.save(corpus(spark, sf), path, "bm25")
    stored = index.load(spark, path, "bm25")["index"]
    return r6(R.best(asked(spark, sf), stored, 5).select("query_id", "rank", "chunk_id", "score"), "score")


@q("search_filtered", f"WITH {BM25}, {rank_sql('bm25', 100, 'fetched')}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fetched JOIN corpus USING (chunk_id) WHERE lower(string_split(file, '.')[-1]) IN ('py', 'go') AND contains(file, 'src') AND NOT contains(file, '__init__')) SELECT query_id, n AS rank, chunk_id, file, round(score, 6) AS score FROM f WHERE n <= 10")
def search_filtered(spark, sf):
    from ..operators.shaping import filtered

    hits = bm25_top(spark, sf, 100).join(files(spark, sf), "chunk_id")
    return r6(filtered(hits, 10, ["py", ".GO"], "src", "__init__").select("query_id", "rank", "chunk_id", "file", "score"), "score")


@q("find_related", f"WITH vecs AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings), qv AS (SELECT chunk_id AS query_id, vec AS qvec FROM vecs WHERE chunk_id % 20 = 0), cos AS (SELECT query_id, chunk_id, {DOT} AS score FROM qv, vecs WHERE query_id <> chunk_id), {rank_sql('cos', 5, 'top')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM top")
def find_related(spark, sf):
    v = vectors(spark, sf)
    own = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return r6(R.knn(own, v, 5, itself=False).select("query_id", "rank", "chunk_id", "score"), "score")


DEFS = Literal("chunks", "chunk_id int, file string, text string", [
    (0, "a/user.py", "def getUser(id): pass"), (1, "a/user_test.py", "x = getUser(1)"), (2, "b/getuser.go", "func getUser() {}"), (3, "c/other.py", "class Foo:\n def bar(): pass"),
    (4, "d/foos.py", "class Foo(Base): pass"), (5, "e/x.sql", "CREATE TABLE foo (id int)"), (6, "f/handler_stack.py", "class HandlerStack: pass"), (7, "g/hand.py", "def HandlerStack(): pass"),
])
DQ = Literal("queries", "query_id int, query string", [(1, "getUser"), (2, "x.Foo"), (3, "Nope")])
DS = Literal("scores", "query_id int, chunk_id int, score double", [(1, 0, 0.5), (1, 1, 0.4), (2, 3, 0.25), (2, 1, 0.1), (3, 0, 1.0)])
DEFINED = "(list_contains(list_transform(regexp_extract_all(text, '(?m)(?:^|\\s)(?:" + R.KEYWORDS + ")\\s+" + R.NAME + "(?:\\s|[<({:\\[;]|$)', 1), lambda n: regexp_extract(n, '[A-Za-z0-9_]*$')), symbol) OR list_contains(list_transform(regexp_extract_all(text, '(?im)(?:^|\\s)(?:" + R.SQL_KEYWORDS + ")\\s+" + R.NAME + "(?:\\s|[<({:\\[;]|$)', 1), lambda n: lower(regexp_extract(n, '[A-Za-z0-9_]*$'))), lower(symbol)))"


@q("boost_definition", f"""WITH {DEFS.cte}, {DQ.cte}, {DS.cte}, qs AS (SELECT query_id, string_split(query, '.')[-1] AS symbol, max(score::DOUBLE) AS top FROM queries JOIN scores USING (query_id) GROUP BY ALL),
r AS (SELECT query_id, chunk_id, text, symbol, top, lower(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '')) AS stem, lower(symbol) AS n FROM qs, chunks),
t AS (SELECT query_id, chunk_id, (stem = n OR replace(stem, '_', '') = n OR rtrim(stem, 's') = n OR rtrim(replace(stem, '_', ''), 's') = n) AS ok, {DEFINED} AS def, top FROM r),
u AS (SELECT query_id, chunk_id, ok, CASE WHEN def THEN top * 3 * CASE WHEN ok THEN 1.5::DOUBLE ELSE 1 END ELSE 0 END AS tier FROM t)
SELECT u.query_id, u.chunk_id, round(coalesce(s.score::DOUBLE, 0) + tier, 6) AS score FROM u LEFT JOIN scores s USING (query_id, chunk_id) WHERE s.score IS NOT NULL OR (ok AND tier > 0)""")
def boost_definition(spark, sf):
    return r6(R.boost_definitions(DS.df(spark), DEFS.df(spark), DQ.df(spark)), "score")


EQ = Literal("queries", "query_id int, query string", [(1, "how does HandlerStack call getUser"), (2, "plain words only")])
ES = Literal("scores", "query_id int, chunk_id int, score double", [(1, 0, 0.5), (1, 1, 0.4), (2, 3, 0.25)])


@q("boost_embedded", f"""WITH {DEFS.cte}, {EQ.cte}, {ES.cte},
nm AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(query, '\\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\\b'))) AS symbol FROM queries),
top AS (SELECT query_id, max(score::DOUBLE) AS top FROM scores GROUP BY query_id),
r AS (SELECT query_id, chunk_id, text, symbol, top, lower(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '')) AS stem, lower(symbol) AS n FROM nm JOIN top USING (query_id), chunks),
t AS (SELECT query_id, chunk_id, top, {DEFINED} AS def, (stem = n OR replace(stem, '_', '') = n OR (length(stem) >= 4 AND starts_with(n, stem)) OR (length(replace(stem, '_', '')) >= 4 AND starts_with(n, replace(stem, '_', '')))) AS inj,
  (stem = n OR replace(stem, '_', '') = n OR rtrim(stem, 's') = n OR rtrim(replace(stem, '_', ''), 's') = n) AS ok FROM r),
u AS (SELECT query_id, chunk_id, max(CASE WHEN def THEN top * 1.5::DOUBLE * CASE WHEN ok THEN 1.5::DOUBLE ELSE 1 END ELSE 0 END) AS tier, bool_or(inj) AS inj FROM t GROUP BY ALL)
SELECT query_id, chunk_id, round(coalesce(s.score::DOUBLE, 0) + coalesce(tier, 0), 6) AS score FROM u FULL JOIN scores s USING (query_id, chunk_id) WHERE s.score IS NOT NULL OR (inj AND tier > 0)""")
def boost_embedded(spark, sf):
    return r6(X.boost_embedded(ES.df(spark), DEFS.df(spark), EQ.df(spark)), "score")


BLEND = """s AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS chunk_id, c_acctbal AS score, CAST((c_custkey * 37) % 101 AS DOUBLE) AS neural FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM s)"""


def blend_in(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"), ((F.col("c_custkey") * 37) % 101).cast("double").alias("neural"))


@q("rerank_blend", f"""WITH {BLEND}, h AS (SELECT *, pos <= 20 AS head FROM p),
m AS (SELECT *, CASE WHEN max(neural) OVER w = min(neural) OVER w THEN 0.5 ELSE (neural - min(neural) OVER w) / (max(neural) OVER w - min(neural) OVER w) END AS mn, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ms FROM h WINDOW w AS (PARTITION BY query_id, head)),
f AS (SELECT *, CASE WHEN head THEN round(0.25::DOUBLE * mn + 0.75::DOUBLE * ms, 9) ELSE score END AS final FROM m)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN -final ELSE pos END, pos) AS rank, round(final, 6) AS final FROM f""")
def rerank_blend(spark, sf):
    return r6(R.blend(blend_in(spark, sf), head=20), "final")


@q("rerank_adaptive", f"""WITH {BLEND}, t AS (SELECT query_id, max(CASE WHEN pos = 1 THEN score END) AS s0, max(CASE WHEN pos = 2 THEN score END) AS s1, count(*) AS n FROM p GROUP BY query_id)
SELECT query_id, least(n, CASE WHEN s0 > 0 AND (s0 - s1) / s0 >= 0.05 THEN 10 ELSE 50 END) AS head FROM t""")
def rerank_adaptive(spark, sf):
    return X.adaptive_head(blend_in(spark, sf), 0.05, 10, 50)


@q("vector_blend", "WITH m AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.3::DOUBLE * p[1]::DOUBLE + 0.7::DOUBLE * p[2]::DOUBLE) AS mix FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1), n AS (SELECT *, sqrt(list_sum(list_transform(mix, lambda x: x * x))) AS norm FROM m) SELECT vec_id, CAST(i AS INTEGER) AS i, round(mix[i + 1] / norm, 6) + 0.0 AS x FROM n, (SELECT unnest(range(0, 64)) AS i) WHERE norm > 0")
def vector_blend(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("s"))
    b = table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("q"))
    x = a.join(b, "vec_id").withColumn("mix", X.mixed(F.col("s"), F.col("q"), 0.3))
    return x.select("vec_id", F.posexplode(X.unit(F.col("mix"))).alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


PRF = f"""{BM25}, {rank_sql('bm25', 10, 'top')},
gain AS (SELECT query_id, term, sum(score * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf) AS g FROM top JOIN post USING (chunk_id) JOIN dfs USING (term), stats GROUP BY query_id, term),
kept AS (SELECT query_id, term, round(g, 4) AS g FROM gain WHERE length(term) > 2 AND term NOT IN ({STOPS}) AND (query_id, term) NOT IN (SELECT query_id, term FROM wanted))"""


@q("expand_prf", f"WITH {PRF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, term) AS rank FROM kept) SELECT query_id, rank, term FROM r WHERE rank <= 8")
def expand_prf(spark, sf):
    return X.expand_prf(asked(spark, sf), corpus(spark, sf), 10, 8)


CENT = f"""{POST}, mid AS (SELECT term FROM dfs, stats WHERE df BETWEEN 5 AND greatest(50, n / 100) AND length(term) > 2 AND term NOT IN ({STOPS})),
tv AS (SELECT term, i, avg(vec[i]::DOUBLE) AS x FROM mid JOIN post USING (term) JOIN (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings) USING (chunk_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
cent AS (SELECT term, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS norm FROM tv GROUP BY term)"""


@q("term_centroid", f"WITH {CENT} SELECT term, CAST(i AS INTEGER) AS i, round(c[i + 1] / norm, 6) + 0.0 AS x, round(norm, 6) AS norm FROM cent, (SELECT unnest(range(0, 64)) AS i) WHERE norm > 0")
def term_centroid(spark, sf):
    c = X.centroids(corpus(spark, sf), vectors(spark, sf))
    return c.select("term", F.posexplode("centroid").alias("i", "x"), F.round("norm", 6).alias("norm")).withColumn("x", F.round("x", 6) + 0.0)


@q("expand_centroid", f"WITH {CENT}, {VECS}, s AS (SELECT query_id, term, round(list_sum(list_transform(list_zip(qvec, c), lambda p: p[1]::DOUBLE * p[2])) / norm, 9) AS score FROM qv, cent WHERE norm > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM s) SELECT query_id, rank, term, round(score, 6) AS score FROM r WHERE rank <= 8 AND score >= 0.3")
def expand_centroid(spark, sf):
    return X.expand_centroid(qvecs(spark, sf), X.centroids(corpus(spark, sf), vectors(spark, sf)), 8, 0.3)


QREL = "qrel AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def qrels(spark, sf):
    """Documents that hold a benchmark item, by the items' rarest 3-grams."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    found = holders(items, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("pattern_id").alias("query_id"), F.col("id").alias("chunk_id"))


@q("expand_oracle", f"WITH {BM25}, {QREL}, g AS (SELECT DISTINCT query_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM qrel JOIN post USING (chunk_id) JOIN dfs USING (term), stats), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS rank FROM g WHERE (query_id, term) NOT IN (SELECT query_id, term FROM wanted)) SELECT query_id, rank, term, idf FROM r WHERE rank <= 8")
def expand_oracle(spark, sf):
    return X.expand_oracle(asked(spark, sf), corpus(spark, sf), qrels(spark, sf), 8)


EVAL = f"WITH {BM25}, {rank_sql('bm25', 10, 'top')}, {QREL}, rel AS (SELECT t.query_id, t.rank, (q.chunk_id IS NOT NULL) AS rel FROM top t LEFT JOIN qrel q ON t.query_id = q.query_id AND t.chunk_id = q.chunk_id), n AS (SELECT query_id, count(*) AS n FROM qrel GROUP BY query_id)"


@q("ndcg_at_k", f"{EVAL}, d AS (SELECT a.query_id, coalesce(sum(1 / log2(rank + 1)) FILTER (rel), 0) AS dcg FROM asked a LEFT JOIN rel USING (query_id) GROUP BY a.query_id), i AS (SELECT query_id, list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1))) AS ideal FROM n) SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(avg(coalesce(dcg / ideal, 0)) OVER (), 6) AS mean FROM d LEFT JOIN i USING (query_id)")
def ndcg_at_k(spark, sf):
    rel = qrels(spark, sf).select("query_id", "chunk_id", F.lit(1.0).alias("rel"))
    n = E.ndcg(bm25_top(spark, sf), rel, 10, asked(spark, sf).select("query_id"))
    mean = n.agg(F.avg("ndcg").alias("mean"))
    return r6(n.crossJoin(mean), "ndcg", "mean")


@q("recall_at_k", f"{EVAL}, h AS (SELECT query_id, count(*) FILTER (rel) AS hit FROM rel GROUP BY query_id) SELECT query_id, round(coalesce(hit, 0)::DOUBLE / n, 6) AS recall FROM n LEFT JOIN h USING (query_id)")
def recall_at_k(spark, sf):
    return r6(E.recall(bm25_top(spark, sf), qrels(spark, sf)), "recall")


@q("first_rel", f"{EVAL} SELECT a.query_id, coalesce(min(rank) FILTER (rel), 0) AS first FROM asked a LEFT JOIN rel USING (query_id) GROUP BY a.query_id")
def first_rel(spark, sf):
    return E.first_relevant(bm25_top(spark, sf), qrels(spark, sf), asked(spark, sf).select("query_id"))


@q("recall_decomp", f"{EVAL}, {rank_sql('bm25', 50, 'pool')}, p AS (SELECT query_id, bool_or(rank <= 10) AS near, true AS pool FROM pool JOIN qrel USING (query_id, chunk_id) GROUP BY query_id) SELECT count(*) AS queries, round(avg(CASE WHEN coalesce(pool, false) THEN 0 ELSE 1 END), 6) AS pool_loss, round(avg(CASE WHEN coalesce(pool, false) AND NOT near THEN 1 ELSE 0 END), 6) AS rank_loss FROM n LEFT JOIN p USING (query_id)")
def recall_decomp(spark, sf):
    return r6(E.decomposition(bm25_top(spark, sf, 50), qrels(spark, sf), 10), "pool_loss", "rank_loss")


COST_SQL = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda r: (length(r) + 3) // 4)), 0) + length(regexp_replace(text, '[A-Za-z0-9_ \\t\\n\\r\\x0b\\x0c]', '', 'g')) AS BIGINT)"
GREP = f"""cost AS (SELECT doc_id, lower(text) AS low, least({COST_SQL}, 20000) AS tokens FROM documents), parts AS (SELECT DISTINCT query_id, term FROM wanted),
terms_in AS (SELECT term, doc_id FROM (SELECT DISTINCT term FROM parts) JOIN cost ON contains(low, term)), pairs AS (SELECT DISTINCT query_id, doc_id FROM parts JOIN terms_in USING (term)),
grepped AS (SELECT a.query_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(p.doc_id) AS matched, coalesce(bool_or(r.chunk_id IS NOT NULL), false) AS recall
 FROM asked a LEFT JOIN pairs p USING (query_id) LEFT JOIN cost USING (doc_id) LEFT JOIN qrel r ON r.query_id = p.query_id AND r.chunk_id = p.doc_id GROUP BY a.query_id)"""


def grepped(spark, sf, rel, literal=False):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return grep_cost(asked(spark, sf), d, T.approx_tokens(F.col("text")).cast("long"), rel.withColumnRenamed("chunk_id", "id"), literal)


@q("grep_baseline", f"WITH {ASKED}, {terms_sql('asked', 'query_id', 'query', 'wanted')}, {QREL}, {GREP} SELECT * FROM grepped")
def grep_baseline(spark, sf):
    """What an agent reads that greps each term of a query and reads the matching files whole."""
    return grepped(spark, sf, qrels(spark, sf))


@q("grep_literal", f"""WITH {ASKED}, {QREL}, cost AS (SELECT doc_id, lower(text) AS low, least({COST_SQL}, 20000) AS tokens FROM documents), pairs AS (SELECT query_id, doc_id FROM asked JOIN cost ON contains(low, lower(trim(query))))
SELECT a.query_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(p.doc_id) AS matched, coalesce(bool_or(r.chunk_id IS NOT NULL), false) AS recall
FROM asked a LEFT JOIN pairs p USING (query_id) LEFT JOIN cost USING (doc_id) LEFT JOIN qrel r ON r.query_id = p.query_id AND r.chunk_id = p.doc_id GROUP BY a.query_id""")
def grep_literal(spark, sf):
    return grepped(spark, sf, qrels(spark, sf), literal=True)


@q("grep_indexed", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substring(b.text, 20, 12)) WHERE length(substring(b.text, 20, 12)) > 0")
def grep_indexed(spark, sf):
    """Twelve characters of each item against all documents, through a stored 3-gram index."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern_id"), F.substring("text", 20, 12).alias("pattern"))
    index = GramIndex.build(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), buckets=16)
    return index.holders(items).select(F.col("pattern_id").alias("item_id"), F.col("id").alias("doc_id"))


@q("tokens_at_recall", f"""{EVAL}, c AS (SELECT t.query_id, rank, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda r: (length(r) + 3) // 4)), 0) + length(regexp_replace(text, '[A-Za-z0-9_ \\t\\n\\r\\x0b\\x0c]', '', 'g')) AS INTEGER) AS tokens, q.chunk_id IS NOT NULL AS rel FROM top t JOIN corpus USING (chunk_id) LEFT JOIN qrel q ON q.query_id = t.query_id AND q.chunk_id = t.chunk_id),
{GREP}, k AS (SELECT unnest([1, 3, 5, 10]) AS k), s AS (SELECT k, query_id, sum(tokens) AS tokens, count(*) FILTER (rel) AS hits FROM c JOIN k ON rank <= k GROUP BY ALL)
SELECT k, round(median(tokens), 6) AS median_tokens, round(avg(hits::DOUBLE / n), 6) AS recall, (SELECT round(median(tokens), 6) FROM grepped) AS grep_tokens FROM s LEFT JOIN n USING (query_id) GROUP BY k""")
def tokens_at_recall(spark, sf):
    cost = corpus(spark, sf).select("chunk_id", T.approx_tokens(F.col("text")).alias("tokens"))
    rel = qrels(spark, sf)
    grep = grepped(spark, sf, rel).agg(F.expr("percentile(tokens, 0.5)").alias("grep_tokens"))  # one row
    return r6(E.tokens_at(bm25_top(spark, sf), cost, rel, [1, 3, 5, 10]).crossJoin(grep), "median_tokens", "recall", "grep_tokens")


@q("doc_collapse", f"WITH {BM25}, {rank_sql('bm25', 50, 'top')}, g AS (SELECT query_id, file, max(score) AS score, min(rank) AS first FROM top JOIN corpus USING (chunk_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM g) SELECT query_id, rank, file, round(score, 6) AS score FROM r")
def doc_collapse(spark, sf):
    hits = bm25_top(spark, sf, 50).join(files(spark, sf), "chunk_id")
    g = hits.groupBy("query_id", "file").agg(F.max("score").alias("score"), F.min("rank").alias("first"))
    return g.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("rank"), "file", F.round("score", 6).alias("score"))
