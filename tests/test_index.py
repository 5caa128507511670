"""Stored segments, numbering in ranges, 3-gram index and block products against plain versions."""

import json
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.operators import sparse, substring
from millrace.operators.ordering import Ordered, after
from millrace.sources import index as X
from millrace.sources import segments as S

WORDS = [f"w{i}" for i in range(60)] + ["getUser", "parse_config", "HTTPServer"]


def texts(rnd, ids):
    return [(i, f"src/f{i % 17}.py", " ".join(rnd.choices(WORDS, [1 / (1 + j) for j in range(len(WORDS))], k=rnd.randint(0, 40)))) for i in ids]


def store(spark, tmp_path, config="c", buckets=2):
    return S.Segments(spark, str(tmp_path / "ix"), config, buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, file string, text string")


def queries(spark):
    return spark.createDataFrame([(1, "w1 w30 getUser"), (2, "w0 w0 w2"), (3, "parse config w59"), (4, ""), (5, "absent")], "query_id long, query string")


def scores(df):
    return {(r.query_id, r.chunk_id): round(r.score, 6) for r in df.collect()}


def fresh(spark, rows):
    return frame(spark, rows).withColumn("deleted", F.lit(False))


def test_segments_answer_as_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 4)
    monkeypatch.setattr(S, "FIRST", 2)
    rnd, ix = random.Random(5), store(spark, tmp_path)
    held = {r[0]: r for r in texts(rnd, range(120))}
    ix.commit(frame(spark, []), frame(spark, list(held.values())))
    for step in range(2):
        files = {f"src/f{(3 * step + j) % 17}.py" for j in range(3)}
        new = [r for r in texts(rnd, [1000 * (step + 1) + j for j in range(51)]) if r[1] in files][: 6 * (step != 1)]
        new += [(i, f, "again getUser") for i, f, _ in held.values() if f in files][:2]  # an id may come back
        held = {i: r for i, r in held.items() if r[1] not in files} | {r[0]: r for r in new}
        ix.commit(spark.createDataFrame([(f,) for f in files], "file string"), frame(spark, new))
        whole = fresh(spark, list(held.values()))
        want = scores(R.bm25(queries(spark), whole))
        snap = ix.snapshot()
        assert scores(R.bm25(queries(spark), snap)) == want
        for k in (2, 200)[step:]:
            assert scores(snap.best(queries(spark), k)) == scores(R.ranked(R.bm25(queries(spark), whole), k))
        assert {(r.chunk_id, r.file, r.text) for r in ix.live().collect()} == set(held.values())
        base = R.scanned(whole)
        assert {r.term: r.df for r in snap.terms.collect()} == {r.term: r.df for r in base.terms.collect()}
        ix.verify()
    before = [s["name"] for s in ix.state()["segments"]]
    assert len(before) == 3 and ix.merge(fan=2) >= 1 and len(ix.state()["segments"]) < 3
    assert scores(ix.snapshot().best(queries(spark), 3)) == scores(R.ranked(R.bm25(queries(spark), whole), 3))
    ix.compact()
    one = ix.state()["segments"]
    assert len(one) == 1 and one[0]["chunks"] == len(held) and one[0]["gone"] == 0
    assert scores(R.bm25(queries(spark), ix.snapshot())) == want
    assert ix.vacuum(keep=1) >= 3 and scores(R.bm25(queries(spark), ix.snapshot())) == want
    assert ix.table("gone").count() == 0


def test_a_commit_writes_what_changed(spark, tmp_path):
    rnd, ix = random.Random(6), store(spark, tmp_path)
    rows = texts(rnd, range(300))
    ix.commit(frame(spark, []), frame(spark, rows))
    first = ix.state()["segments"][0]
    out = ix.commit(spark.createDataFrame([("src/f3.py",)], "file string"), frame(spark, [(900, "src/f3.py", "w1 w2"), (901, "src/new.py", None)]))
    new = out["segments"][1]
    assert out["segments"][0] == first and new["chunks"] == 2 and new["postings"] == 5 and new["gone"] == sum(r[1] == "src/f3.py" for r in rows)
    assert out["chunks"] == 300 - new["gone"] + 2
    ix.commit(spark.createDataFrame([("nowhere.py",)], "file string"), frame(spark, []))
    assert ix.state()["chunks"] == out["chunks"]


def test_two_writers(spark, tmp_path):
    """Both commits are there, in two numbers; a writer that is always overtaken says so."""
    root, errors = tmp_path, []

    def write(i):
        try:
            store(spark, root).commit(frame(spark, []), frame(spark, [(i, f"f{i}.py", "w1 w2")]))
        except Exception as e:  # seen below
            errors.append(e)

    both = [threading.Thread(target=write, args=(i,)) for i in (1, 2)]
    [t.start() for t in both]
    [t.join() for t in both]
    ix = store(spark, root)
    assert not errors and ix.state()["number"] == 2 and {r.chunk_id for r in ix.live().collect()} == {1, 2}
    ix._announce = lambda manifest: False
    with pytest.raises(S.Conflict):
        ix.commit(frame(spark, []), frame(spark, [(3, "f3.py", "w1")]), tries=2)
    assert ix.state()["number"] == 2
    assert ix.state()["number"] == 2 and not store(spark, root)._announce({"number": 2})


def test_what_is_wrong_has_a_type(spark, tmp_path):
    ix = store(spark, tmp_path, S.config_key("bm25"))
    assert ix.state()["chunks"] == 0 and ix.snapshot().best(queries(spark), 3).count() == 0
    ix.commit(frame(spark, []), frame(spark, texts(random.Random(1), range(40))))
    keys = {S.config_key(*a) for a in [("bm25",), ("hybrid",), ("bm25", "regex"), ("bm25", "line", "m1"), ("bm25", "line", "bm25", True), ("bm25", "line", "bm25", False, True), ("bm25", "line", "bm25", False, False, True)]}
    assert len(keys) == 7 and S.config_key("bm25") in keys
    for other in keys - {S.config_key("bm25")}:
        with pytest.raises(X.ConfigMismatch):
            store(spark, tmp_path, other).state()
    at = tmp_path / "ix" / "blocks"
    file = next(os.path.join(d, f) for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet"))
    ix.verify()
    os.remove(file)
    with pytest.raises(X.Damaged):
        ix.verify()
    commit = tmp_path / "ix" / "_commits" / f"{1:012d}.json"
    held = json.loads(commit.read_text())
    os.remove(tmp_path / "ix" / "_commits" / f".{1:012d}.json.crc") if (tmp_path / "ix" / "_commits" / f".{1:012d}.json.crc").exists() else None
    commit.write_text(json.dumps(held | {"format": 99}))
    with pytest.raises(X.VersionMismatch):
        ix.state()
    commit.write_text("{")
    with pytest.raises(X.Damaged):
        ix.state()


def test_bounds_leave_postings_out(spark, tmp_path):
    rnd, ix = random.Random(8), store(spark, tmp_path)
    rare = [f"r{i}" for i in range(400)]
    rows = [(i, f"f{i}.py", " ".join(rnd.choices(["the", "of", "and", "in"], k=30) + rnd.choices(rare, k=3))) for i in range(1500)]
    ix.commit(frame(spark, []), frame(spark, rows))
    asked = spark.createDataFrame([(1, "the of and in r1 r2 r3 r4")], "query_id long, query string")
    read, all_ = ix.snapshot().effort(asked, 5)
    assert all_ > 5000 and read < all_ / 3


def test_names_are_stored(spark, tmp_path):
    ix = store(spark, tmp_path)
    ix.commit(frame(spark, []), frame(spark, [(1, "a.py", "def getUser(): pass"), (2, "b.sql", "create table Users (id int)"), (3, "c.py", "getUser()")]))
    asked = spark.createDataFrame([(1, "getUser"), (2, "USERS"), (3, "getuser")], "query_id long, symbol string")
    found = R.defining(ix.snapshot().definitions(asked), asked)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(1, 1), (2, 2)]
    ix.commit(spark.createDataFrame([("a.py",)], "file string"), frame(spark, []))
    assert ix.snapshot().definitions(asked).count() == 1


def test_numbers_and_pages(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), i) for i in range(500)] + [(None, 900)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    ordered = Ordered(df, ["a", "b"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r.nth: (r.a, r.b) for r in ordered.numbered("nth").collect()}
    assert got == dict(enumerate(want)) and ordered.total == 501
    for offset, limit in [(0, 10), (495, 30), (120, 200), (501, 5), (600, 5)]:
        assert sorted(((r.a, r.b) for r in ordered.page(offset, limit).collect()), key=want.index) == want[offset : offset + limit]
    assert Ordered(df.limit(0), ["a"]).numbered("n").count() == 0 == Ordered(df.limit(0), ["a"]).page(0, 5).count()
    assert [(r.a, r.b) for r in after(df.filter("a IS NOT NULL"), ["a", "b"], {"a": 5, "b": 100}, 7).collect()] == [w for w in want[1:] if w > (5, 100)][:7]


def test_substrings(spark):
    rnd = random.Random(4)
    texts_ = ["".join(rnd.choices("abcé日\U0001f600 ", k=rnd.randint(0, 60))) for _ in range(80)] + [None, "", "ab", "abc", "a\nb.c*"]
    patterns = [(i, p) for i, p in enumerate(["abc", "a", "é日", "", None, "zzz", "b.c*", "\nb.", *(t[k : k + 5] for t in texts_[:30] if t for k in (0, 7))])]
    rows = [(i % 60, t) for i, t in enumerate(texts_)]
    want = {(i, d) for i, p in patterns if p for d, t in rows if t is not None and p in t}
    p, t = spark.createDataFrame(patterns, "pattern_id long, pattern string"), spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in substring.holders(p, t).select("pattern_id", "id").collect()} == want
    index = substring.GramIndex.build(t, buckets=4)
    every = [tuple(r) for r in index.holders(p).select("pattern_id", "id").collect()]
    assert set(every) == want and len(every) == sum(p in x for _, p in patterns if p for _, x in rows if x is not None)
    assert substring.holders(p, t.limit(0)).count() == 0 == substring.holders(p.limit(0), t).count()


def test_grep_cost(spark):
    docs = spark.createDataFrame([(1, "Parse the Config"), (2, "parser " * 9), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "parse"), (2, "nothing here"), (3, "")], "query_id long, query string")
    rel = spark.createDataFrame([(1, 2)], "query_id long, id long")
    out = {r.query_id: (r.tokens, r.matched, r.recall) for r in substring.grep_cost(asked, docs, F.length("text").cast("long"), rel, cap=20).collect()}
    assert out == {1: (16 + 20, 2, True), 2: (0, 0, False), 3: (0, 0, False)}
    out = {r.query_id: r.matched for r in substring.grep_cost(asked.filter("query_id = 1").withColumn("query", F.lit(" PARSE THE ")), docs, F.length("text").cast("long"), rel, literal=True).collect()}
    assert out == {1: 1}


@pytest.mark.parametrize(("cols", "entries"), [(4096, 1_000_000), (3, 10)])
def test_block_products(spark, monkeypatch, cols, entries):
    monkeypatch.setattr(sparse, "COLS", cols)
    monkeypatch.setattr(sparse, "ENTRIES", entries)
    rnd = random.Random(7)
    vecs = {i: [rnd.gauss(0, 1) for _ in range(4 if i % 5 else 2)] for i in range(20)}
    rows = [(rnd.choice("abcde"), rnd.choice([0, 0, 0, rnd.randrange(25)]), rnd.random()) for _ in range(200)] + [("gone", 99, 1.0)]
    want = {}
    for r, c, w in rows:
        if c in vecs and c != 7:
            t, s = want.get(r, (0.0, np.zeros(4)))
            want[r] = (t + w, s + w * np.pad(vecs[c], (0, 4 - len(vecs[c]))))
    v = spark.createDataFrame([(i, x if i != 7 else None) for i, x in vecs.items()], "col long, vec array<double>")
    e = spark.createDataFrame(rows, "row string, col long, w double")
    got = {r.row: (r.total, r.sums) for r in sparse.weighted_sums(e, v).collect()}
    assert got.keys() == want.keys()
    for r, (t, s) in want.items():
        assert got[r][0] == pytest.approx(t) and np.pad(got[r][1], (0, 4 - len(got[r][1]))) == pytest.approx(s)
    assert sparse.weighted_sums(e.limit(0), v).count() == 0 == sparse.weighted_sums(e, v.limit(0)).count()
