"""Findings of reviews: each test failed before its mend."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import postings, sparse, substring
from millrace.operators import retrieval as R
from millrace.sources import segments, vectors


def test_preview_line_trims_spaces_of_any_kind(spark):
    rows = [("　 \n  first  \nsecond", "first"), ("\t\nx", "\t"), (" ", ""), (None, "")]
    got = spark.createDataFrame(rows, "text string, want string").select("want", T.preview_line(F.col("text")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_tally_counts_the_terms_of_a_text(spark):
    texts = ["HTTPServer open_file openFile x1 _a_ __ ABc Ñandú café2 a a", "", "XMLHttpRequest2Foo foo__bar A AB aB1C _"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.terms(F.col("text")).alias("terms")).collect()
    for r in got:
        assert T.tally(r.text, T.Names()) == {t: r.terms.count(t) for t in set(r.terms)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_best_of_each_query_leave_their_block(spark, monkeypatch):
    words = ["alpha", "beta_gamma", "deltaEpsilon", "x"]
    chunks = spark.createDataFrame([(i, " ".join(words[j % 4] for j in range(i % 7)), i % 10 == 9) for i in range(60)], "chunk_id long, text string, deleted boolean")
    asked = spark.createDataFrame([(1, "alpha alpha gamma"), (2, "delta none"), (3, "")], "query_id long, query string")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    want = rows(R.ranked(R.bm25(asked, chunks), 4))
    for cells in (4_000_000, 1):
        monkeypatch.setattr(postings, "CELLS", cells)
        got = R.best(asked, chunks, 4)
        assert rows(got) == want and "Generate" not in _plan(got)
    assert R.best(asked, chunks.limit(0), 4).count() == 0 == R.best(asked.limit(0), chunks, 4).count()


def test_texts_are_scanned_for_a_batch_without_rows_for_their_grams(spark):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choices("abcdeéf日", k=rnd.randint(0, 300)))) for i in range(40)] + [(40, "aaaaaaaaaaaaaaaaaaaaa"), (41, None)]
    patterns = [t[k : k + n] for _, t in texts if t for k, n in ((0, 1), (3, 4), (5, 8), (2, 9), (1, 30))] + ["aaaaaaaa", "aaaaaaaab", "日", "zz"]
    p, t = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string"), spark.createDataFrame(texts, "id long, text string")
    found = substring.holders(p, t)
    assert {tuple(r) for r in found.collect()} == {(i, d) for i, x in enumerate(patterns) if x for d, y in texts if y and x in y}
    assert "Generate" not in _plan(found)


def test_grep_keeps_no_row_for_a_query_and_text(spark):
    docs = spark.range(50).select("id", F.concat(F.lit("Word "), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([(1, "word"), (2, "none")], "query_id long, query string")
    out = substring.grep_cost(asked, docs, F.length("text").cast("long"), spark.createDataFrame([(1, 3)], "query_id long, id long"))
    assert {tuple(r) for r in out.collect()} == {(1, 10 * 6 + 40 * 7, 50, True), (2, 0, 0, False)}
    assert "Generate" not in _plan(out)


def test_partial_sums_of_a_slice_are_bounded_by_their_cells(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(sparse, "SUMS", 64)
    plain = sparse._block

    def counted(entries, vectors):
        sizes.add(int(entries.num_rows > 16))
        return plain(entries, vectors)

    monkeypatch.setattr(sparse, "_block", counted)
    e = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 2).alias("col"), F.lit(1.0).alias("w"))
    v = spark.createDataFrame([(0, [1.0] * 8), (1, [2.0] * 8)], "col long, vec array<float>")
    got = {r.row: (r.total, r.sums) for r in sparse.weighted_sums(e, v).collect()}
    assert got == {i: (1.0, [1.0 + i % 2] * 8) for i in range(200)} and sizes.value <= 12


def test_neural_scores_find_their_hits_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def met(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    hits = spark.createDataFrame([(1, "q", "a"), (2, "q", "bb")], "chunk_id long, query string, text string").mapInArrow(met, "chunk_id long, query string, text string")
    encode = lambda texts: texts.select("hash", F.array(F.lit(1.0), F.length("text").cast("double")).alias("vec"))
    out = vectors.neural_scores(hits, vectors.VectorCache(spark, str(tmp_path), "s"), encode)
    assert out.count() == 2 and out.select(F.sum("neural")).first()[0] > 1.9 and seen.value == 2


def test_a_stored_index_is_searched_without_rows_for_queries(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"d/{i % 5}.py", " ".join(f"w{j}" for j in range(i % 9))) for i in range(90)], "chunk_id long, file string, text string")
    asked = spark.createDataFrame([(i, f"w{i % 9} w1") for i in range(40)], "query_id long, query string")
    store = segments.Segments(spark, str(tmp_path), "c", 4)
    store.commit(chunks.limit(0), chunks)
    store.commit(chunks.filter("file = 'd/3.py'"), chunks.limit(0))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    snap = store.snapshot()
    want = rows(R.ranked(R.bm25(asked, chunks.withColumn("deleted", F.col("file") == "d/3.py")), 3))
    for most in (400_000, 1):
        postings.ROWS = most
        assert rows(snap.best(asked, 3)) == want == rows(R.best(asked, snap, 3))
    postings.ROWS = 400_000


def test_tallies_of_a_batch_are_those_of_each_text():
    rnd = random.Random(3)
    some = ["", None, "12", "3ab_C9", "HTTPServer open_file openFile x1 _a_ __ ABc Ñandú café2 a a", "ab", "cd"]
    for texts in ([], [None], some, *([None if rnd.random() < 0.1 else "".join(rnd.choices("aAbB_19 é.日\n", k=rnd.randint(0, 30))) for _ in range(9)] for _ in range(50))):
        batch = pa.array(["cut off", *texts], pa.string()).slice(1)
        terms, tfs = (x.to_pylist() for x in T.tallies(batch, T.Names()))
        assert [dict(zip(a, b, strict=True)) for a, b in zip(terms, tfs, strict=True)] == [T.tally(t or "", T.Names()) for t in texts]
        assert all(len(a) == len(set(a)) for a in terms)


def test_compaction_cuts_no_text_again_and_rows_hold_many_blocks(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(i, f"d/{i % 5}.py", " ".join(f"w{j} w{j % 3}" for j in range(i % 9))) for i in range(90)], "chunk_id long, file string, text string")
    asked = spark.createDataFrame([(i, f"w{i} w1 w8") for i in range(9)], "query_id long, query string")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    want = rows(R.ranked(R.bm25(asked, chunks.withColumn("deleted", F.col("file") == "d/3.py")), 3))
    monkeypatch.setattr(segments, "SPAN", 4)
    for most in (2_000_000, 7):
        monkeypatch.setattr(segments, "WRITTEN", most)
        store = segments.Segments(spark, str(tmp_path / str(most)), "c", 4)
        store.commit(chunks.limit(0), chunks)
        store.commit(chunks.filter("file = 'd/3.py'"), chunks.limit(0))
        assert rows(store.snapshot().best(asked, 3)) == want
        with monkeypatch.context() as m:
            m.setattr(segments, "_measured", None)
            store.compact()
        assert rows(store.snapshot().best(asked, 3)) == want
        n = store.table("blocks").agg(F.count("*"), F.sum(F.size("spans"))).first()
        assert n[0] < n[1] / 2 if most > 7 else n[0] <= n[1]
        heads, whole = (f(store.table("blocks")) for f in (segments._heads, segments._ranges))
        for r in whole.join(heads, ["segment", "term", "span"]).collect() if most > 7 else ():
            held = list(zip(r.tfs, r.dls, strict=True))
            peaks = {p for p in held if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in held)}
            assert r.n == len(held) and {(p.tf, p.dl) for p in r.peaks} == peaks and len(r.peaks) == len(peaks)
