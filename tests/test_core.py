"""The engine's registered queries against DuckDB, and literal cases of its operators."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, ddl, extraction, incremental, retrieval, shaping
from millrace.plans import registry
from millrace.sources import corpus, index
from tests.oracle import agree

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    agree(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize(("path", "penalty"), [("shop/cart.py", 1), ("shop/cart_test.go", 0.3), ("shop/tests/rows.rb", 0.3), ("shop/__init__.py", 0.5), ("compat/old.rs", 0.3), ("examples/demo.kt", 0.3), ("web/shop.d.ts", 0.7), ("legacy/__init__.py", 0.15), ("examples/tests/__init__.py", 0.045)])
def test_penalty(spark, path, penalty):
    assert spark.createDataFrame([(path,)], "p string").select(T.path_penalty(F.col("p"))).first()[0] == pytest.approx(penalty)


def test_identifiers(spark):
    cases = {"OrderBook": "orderbook order book", "tax_rate": "tax_rate tax rate", "plain": "plain", "readCSVHeader": "readcsvheader read csv header", "TLSSocket": "tlssocket tls socket"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: " ".join(r.t) for r in df.select("n", T.identifier_terms(F.col("n")).alias("t")).collect()} == cases


def test_saturation_and_gating(spark):
    one = spark.createDataFrame([(1, i, "a.go", 1.0) for i in range(3)], "query_id int, chunk_id int, file string, score double")
    assert [r.score for r in retrieval.saturated(one, 5).orderBy("rank").collect()] == [1.0, 0.5, 0.25]
    two = spark.createDataFrame([(1, 0, "svc_test.go", 1.0), (1, 1, "svc.go", 1.0)], "query_id int, chunk_id int, file string, score double")
    assert [(r.file, r.score) for r in retrieval.saturated(two, 5).orderBy("rank").collect()] == [("svc.go", 1.0), ("svc_test.go", 0.3)]
    assert {r.score for r in retrieval.saturated(two, 5, penalise=False).collect()} == {1.0}


def test_coherence(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, 2, 0.8)], "query_id int, chunk_id int, score double")
    f = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "chunk_id int, file string")
    got = {r.chunk_id: r.score for r in retrieval.coherence(s, f).collect()}
    assert got == pytest.approx({0: 1.2, 1: 0.5, 2: 0.8 + 0.2 * 0.8 / 1.5})


def test_saturation_is_the_greedy_pass(spark):
    import random

    rnd = random.Random(5)
    rows = [(q, i, f"f{rnd.randrange(4)}.go", rnd.choice([1.0, 0.5, 0.25, 0.75])) for q in range(40) for i in range(12)]
    got = {}
    for r in retrieval.saturated(spark.createDataFrame(rows, "query_id int, chunk_id int, file string, score double"), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    for q in range(40):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2], r[1]))
        kept, seen = [], {}
        for n, (_, i, f, s) in enumerate(order):
            if n >= 3 and s <= min(e for e, _ in kept):
                break
            kept.append((s * 0.5 ** seen.get(f, 0), i))
            seen[f] = seen.get(f, 0) + 1
        want = [i for _, i in sorted(kept, key=lambda x: (-x[0], x[1]))[:3]]
        assert [i for _, i in sorted(got[q])] == want


def test_blend(spark):
    rows = spark.createDataFrame([(1, 0, 3.0, 1.0), (1, 1, 2.0, 2.0), (1, 2, 1.0, 3.0)], "query_id int, chunk_id int, score double, neural double")
    order = lambda beta: [r.chunk_id for r in retrieval.blend(rows, beta=beta).orderBy("rank").collect()]
    assert order(0.0) == [0, 1, 2] and order(1.0) == [2, 1, 0]


def test_budget_keeps_a_prefix(spark):
    hits = spark.createDataFrame([(1, i, "f", "word " * 50 * i) for i in range(1, 6)], "query_id int, rank int, file string, text string")
    assert [r["rank"] for r in shaping.within_budget(hits, 10).collect()] == [1]
    assert [r["rank"] for r in shaping.within_budget(hits, 500).orderBy("rank").collect()] == [1, 2, 3]


def test_manifest_against_nothing(spark):
    m = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "file string, mtime_ns long, size long")
    none = m.limit(0)
    assert {r.change for r in incremental.manifest_diff(none, m).collect()} == {"changed"}
    assert {r.change for r in incremental.manifest_diff(m, none).collect()} == {"deleted"}
    assert incremental.manifest_diff(m, m).count() == 0


def test_folder_removal_spares_siblings(spark):
    c = spark.createDataFrame([("a/x", 0, "1"), ("ab/y", 0, "2"), ("a/b/z", 0, "3")], "file string, seq long, text string")
    gone = spark.createDataFrame([("a",)], "file string")
    assert [r.file for r in incremental.reconcile(c, gone, c.limit(0)).collect()] == ["ab/y"]


def test_chunks_put_together_are_the_text():
    for text in ("", "a", "x\n" * 4000, "def f():\n  pass\n" * 300, "é" * 5000 + "\nend"):
        parts = chunking.pack_lines(text, 1500)
        assert "".join(p[2] for p in parts) == text
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert chunking.lines_of("a\x0cb\u2028c\r\nd\n") == ["a\x0cb\u2028c\r\n", "d\n"]


def test_ddl_replay():
    got = {(k, n): b for k, n, b in ddl.replay([(p, t) for p, t in ddl.EXAMPLES if p.startswith("db/")])}
    users = got["table", "users"]
    assert "full_name VARCHAR(20)" in users and "email VARCHAR(99)" in users and "age" not in users and "uq" not in users
    assert "INDEX ix_email (email)" in users and ("view", "v") in got and got["alter", "users"].endswith("OWNER TO admin")


def test_statements():
    assert ddl.statements("a; -- x;\nb /* ; /* n */ */ ; select $q$ ; $q$; tail ';'") == ["a", "b", "select $q$ ; $q$", "tail ';'"]


def test_extract_python():
    got = extraction.extract("a.py", extraction.EXAMPLES[0][1])
    assert [f["name"] for f in got["functions"]] == ["f", "g"] and got["functions"][0]["params"] == ["q"]
    assert got["imports"] == ["p", "y"] and got["raises"] == ["ValueError"]
    assert [(c["callee"], c["receiver"]) for c in got["call_refs"]] == [("ValueError", ""), ("run", "z"), ("join", "p")]
    assert extraction.extract("bad.py", "def (") is None


@pytest.mark.parametrize(("path", "text", "functions", "imports", "calls", "raises"), [
    ("a.rs", "use std::{fmt, io::{self, Read as R}};\nstruct A; struct B;\nimpl A { fn x(&self, n: u8) -> u8 { helper(n) } }\nimpl fmt::Display for B {\n  fn fmt(&self) -> R { out.put(1) }\n}\nfn helper(n: u8) -> u8 { n }\n",
     [("x", "A", "n", "u8", 3), ("fmt", "B", "", "R", 5), ("helper", "", "n", "u8", 7)], "fmt io R", [("helper", "", "x"), ("put", "out", "fmt")], ""),
    ("b.ts", "import d, { a, b as c } from './x';\nimport * as ns from 'y';\nconst q = require('z');\nclass W extends V {\n  draw(x: number, y = 2): void { this.paint(x); if (x) { throw new Odd('e()'); } }\n  static make() { return a(); }\n}\nexport const go = async (u, v) => { c(u); };\n",
     [("draw", "W", "x y", "void", 5), ("make", "W", "", "", 6), ("go", "", "u v", "", 8)], "d a c ns q", [("paint", "this", "draw"), ("Odd", "", "draw"), ("a", "", "make"), ("c", "", "go")], "Odd"),
    ("C.java", "import java.util.List;\npublic class Box { private int n; public int get(int k) throws E { return calc(k); } Box(String s) { fill(s); }\n  void put(List<String> xs) {\n    if (xs.isEmpty()) { throw new Full(\"no\"); }\n  }\n}\n",
     [("get", "Box", "k", "int", 2), ("Box", "Box", "s", "", 2), ("put", "Box", "xs", "void", 3)], "List", [("calc", "", "get"), ("fill", "", "Box"), ("isEmpty", "xs", "put"), ("Full", "", "put")], "Full"),
    ("d.go", 'package d\nimport (\n  "net/http"\n  al "a/b-c"\n)\nvar names = []string{\n  "x",\n}\ntype S struct { n int }\nfunc (s *S) Run(x int, y string) (int, error) { return http.Get(x) }\nfunc main() { s.Run(1) }\n',
     [("Run", "S", "x y", "(int, error)", 10), ("main", "", "", "", 11)], "http al", [("Get", "", "Run"), ("Run", "", "main")], ""),
    ("e.php", "<?php\nuse App\\Models\\{User, Post as P};\nclass K { use T; public function go($a, int $b): string { $this->run($a); throw new \\My\\Oops('x'); } }\n",
     [("go", "K", "a b", "string", 3)], "User P", [("run", "this", "go"), ("Oops", "", "go")], "Oops"),
    ("f.cpp", '#include <vector>\n#include "x/y.h"\nclass Q : public R {\n  int size() const { return n_; }\n};\nint Q::grow(int k, char* p) {\n  helper(k);\n  while (k) { step(k); }\n}\n',
     [("size", "Q", "", "int", 4), ("grow", "Q", "k p", "int", 6)], "vector y.h", [("helper", "", "grow"), ("step", "", "grow")], ""),
    ("g.kt", 'import a.b.Cee\nclass M(val x: Int) {\n  fun area(y: Int): Int = mul(x, y)\n}\nfun top(z: String) { throw Bad("x") }\n',
     [("area", "M", "y", "Int", 3), ("top", "", "z", "", 5)], "Cee", [("mul", "", "area"), ("Bad", "", "top")], "Bad"),
    ("h.cs", 'using System.Text;\nnamespace N { public class P { public async Task<int> Run(int a, string b) { await Go(a); throw new Odd("x"); } } }\n',
     [("Run", "P", "a b", "Task<int>", 2)], "Text", [("Go", "", "Run"), ("Odd", "", "Run")], "Odd"),
    ("i.swift", "import Foundation\nstruct S { func f(a b: Int) -> Int { return g(b) } }\nextension S { func h() { f(1) } }\n",
     [("f", "S", "b", "Int", 2), ("h", "S", "", "", 3)], "Foundation", [("g", "", "f"), ("f", "", "h")], ""),
    ("j.scala", "import a.b.{C, D => E}\nobject O { def f(x: Int): Int = { g(x) } }\n", [("f", "O", "x", "Int", 2)], "C E", [("g", "", "f")], ""),
    ("k.dart", "import 'package:x/y.dart' as z;\nclass D { int f(int a) { return g(a); } }\n", [("f", "D", "a", "int", 2)], "z", [("g", "", "f")], ""),
    ("l.rb", "require 'json'\nmodule A\n  class B\n    def go(x, y = 1)\n      run(x)\n      raise ArgumentError, 'no'\n    end\n  end\nend\ndef free\n  b.call(1)\nend\n",
     [("go", "B", "x y", "", 4), ("free", "", "", "", 10)], "json", [("run", "", "go"), ("call", "b", "free")], "ArgumentError"),
    ("m.ex", "defmodule A.B do\n  alias X.Y\n  def go(x) do\n    run(x)\n    raise ArgumentError\n  end\nend\n", [("go", "B", "x", "", 3)], "Y", [("run", "", "go")], "ArgumentError"),
])
def test_extract_languages(path, text, functions, imports, calls, raises):
    got = extraction.extract(path, text)
    assert [(f["name"], f["enclosing_class"], " ".join(f["params"]), f["return_type"], f["start_line"]) for f in got["functions"]] == functions
    assert (" ".join(got["imports"]), [(c["callee"], c["receiver"], c["enclosing_symbol"]) for c in got["call_refs"]], " ".join(got["raises"])) == (imports, calls, raises)
    assert all(f["is_method"] == bool(f["enclosing_class"]) and f["end_line"] >= f["start_line"] for f in got["functions"])


@pytest.mark.parametrize(("alters", "has", "left"), [
    ("RENAME COLUMN code TO sku", "CONSTRAINT one UNIQUE (sku, shop)\n  INDEX ix (sku)", None),
    ("RENAME COLUMN nothing TO sku", "code TEXT NOT NULL", "RENAME COLUMN nothing TO sku"),
    ("ALTER COLUMN code TYPE VARCHAR(9) USING code::varchar", "code VARCHAR(9) NOT NULL", None),
    ("ALTER COLUMN nothing TYPE INT", "code TEXT NOT NULL", "ALTER COLUMN nothing TYPE INT"),
    ("ALTER COLUMN code DROP NOT NULL", "code TEXT\n", None),
    ("ALTER COLUMN shop SET DEFAULT 7", "shop INT DEFAULT 7", None),
    ("DROP COLUMN nothing", "code TEXT NOT NULL", "DROP COLUMN nothing"),
    ("DROP COLUMN IF EXISTS nothing, ADD tax INT", "tax INT", None),
    ("DROP CONSTRAINT one", "shop INT\n  INDEX ix (code)", None),
    ("RENAME CONSTRAINT one TO two", "CONSTRAINT two UNIQUE (code, shop)", None),
    ("ENABLE ROW LEVEL SECURITY", "code TEXT NOT NULL", "ENABLE ROW LEVEL SECURITY"),
])
def test_fold_actions(alters, has, left):
    first = "CREATE TABLE t (code TEXT NOT NULL, shop INT, CONSTRAINT one UNIQUE (code, shop)); CREATE INDEX ix ON t (code);"
    got = {(k, n): b for k, n, b in ddl.replay([("m/1_a.sql", first), ("m/2_b.sql", f"ALTER TABLE t {alters};")])}
    assert has in got["table", "t"] + "\n"
    assert got.get(("alter", "t")) == (f"ALTER TABLE t {left}" if left else None)


def test_views_are_cut_and_splitting_is_linear():
    import time

    body = "\n".join(f"  c{i}," for i in range(80))
    (view,) = ddl.statements(f"CREATE VIEW v AS SELECT\n{body}\n 1")
    _, name, d = ddl.parse(view)
    assert name == "v" and d["body"].count("\n") == ddl.VIEW_LINES and d["body"].endswith("...")
    began = time.time()
    assert len(ddl.statements("INSERT INTO t VALUES ('a', $1); -- $x\n" * 20_000)) == 20_000
    assert time.time() - began < 3


def test_ignore_rules():
    assert corpus.rule_regex("docs/**/d.md") == ("^docs/(?:.*/)?d\\.md$", False, False)
    assert corpus.rule_regex("!*.log") == ("^(?:.*/)?[^/]*\\.log$", True, False)
    import re

    for rule, yes, no in [("[a-c]x", "bx", "dx"), ("[!a-c]x", "dx", "bx"), ("a\\*b", "a*b", "aab"), ("\\!x", "!x", "x"), ("x  ", "x", "x  "), ("*.[oa]", "d/lib.a", "lib.so"), ("\\#a", "#a", "a")]:
        pattern = corpus.rule_regex(rule)[0]
        assert re.match(pattern, yes) and not re.match(pattern, no), rule


def test_stored_index(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a.py", "def getUser(): pass", False), (1, "b.py", "other user", False), (2, "c.py", "user", True), (3, "d.py", None, False)], "chunk_id long, file string, text string, deleted boolean")
    path = str(tmp_path / "ix")
    index.save(chunks, path, "cfg", buckets=2)
    stored = index.load(spark, path, "cfg")
    assert stored["chunks"].count() == 4
    queries = spark.createDataFrame([(1, "get user"), (2, "nothing")], "query_id int, query string")
    rows = lambda s: sorted(tuple(r) for r in retrieval.bm25(queries, s).collect())
    assert rows(stored["index"]) == rows(chunks) and len(rows(chunks)) == 2
    index.save(chunks.filter("chunk_id > 0"), path, "cfg", buckets=3)
    assert [r[1] for r in rows(index.load(spark, path, "cfg")["index"])] == [1]
    with pytest.raises(index.ConfigMismatch):
        index.load(spark, path, "other")
    with pytest.raises(index.Damaged):
        index.load(spark, str(tmp_path / "none"), "cfg")
    assert index.resolve_mode("hybrid", False, False) == "bm25" and index.resolve_mode("hybrid-rerank", True, False) == "hybrid"


def test_walk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "min.js").write_text("y" * 5000)
    (tmp_path / ".git" / "c").write_text("z")
    (tmp_path / "src" / "pic.png").write_bytes(b"\x89PNG\r\n\x00\x1a\xff\xfe")
    (tmp_path / "src" / "latin.txt").write_bytes(b"caf\xe9\n")
    got = corpus.admitted(corpus.files(spark, str(tmp_path)))
    assert sorted(os.path.basename(r.file) for r in got.collect()) == ["a.py", "latin.txt"]
    with pytest.raises(ValueError, match="more than"):
        corpus.capped(got.unionByName(got), 1)


def test_debounce_stream(spark, tmp_path):
    from millrace.streaming import maintain

    spark.createDataFrame([("a", 0), ("a", 1), ("a", 9), ("b", 0), ("a", 100)], "path string, s int").select("path", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    q = maintain.debounced_stream(stream, 2, 10).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM deb WHERE path = 'a'").collect())[:2] == [1, 2]


def test_published_versions(spark, tmp_path):
    from millrace.streaming import maintain

    store = maintain.Published(spark, str(tmp_path / "pub"))
    with pytest.raises(FileNotFoundError):
        store.current()
    c = spark.createDataFrame([("a", 0, "1")], "file string, seq long, text string")
    assert store.publish(c) == 0 and store.publish(c.unionByName(c)) == 1
    assert store.current().count() == 2


def test_sqlite_catalogue(spark, tmp_path):
    import sqlite3

    from millrace.operators import catalog
    from millrace.sources import databases

    path = str(tmp_path / "shop.db")
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE store (id INTEGER PRIMARY KEY, name TEXT NOT NULL, logo BLOB, opened TEXT DEFAULT 'now');
        CREATE TABLE "odd order" (id INTEGER PRIMARY KEY, store_id INT REFERENCES store, tax REAL); CREATE UNIQUE INDEX ux ON "odd order" (store_id, tax);
        CREATE VIEW big AS SELECT * FROM store; INSERT INTO store VALUES (1, 'north', x'0001', NULL), (2, 'south', NULL, 'then'); ANALYZE;""")
    db.commit()
    db.close()
    got = databases.sqlite(spark, path)
    cols = {(r.table, r.ordinal): (r.column, r.type, r.not_null, r.is_pk) for r in catalog.columns(got["tables"], got["columns"]).join(got["columns"].select("table", "ordinal", "is_pk"), ["table", "ordinal"]).collect()}
    assert cols["store", 2] == ("name", "text", True, False) and cols["odd order", 1] == ("id", "integer", False, True) and len(cols) == 7
    assert [tuple(r) for r in catalog.foreign_keys(got["fks"]).collect()] == [("odd order", "store_id", "store.id")]
    assert [tuple(r) for r in catalog.index_columns(got["indexes"]).collect()] == [("odd order", "ux", "store_id, tax")]
    assert [r.view for r in catalog.views(got["tables"].select("schema", F.col("table").alias("name"), "kind", "definition")).collect()] == ["big"]
    cells = {(r.row, r.column): r.value for r in databases.sqlite_sample(spark, path, "store").collect()}
    assert cells[0, "logo"] == "<2 bytes>" and cells[1, "logo"] is None and cells[1, "name"] == "south"
    assert {r.name: r.n for r in databases.estimates(spark, path, ["store", "none"]).collect()} == {"store": 2, "none": None}
    other = got["columns"].withColumn("type", F.when(F.col("column") == "tax", "int").otherwise(F.col("type")))
    assert [r.table for r in databases.changed(got["columns"], other).collect()] == ["odd order"] and databases.changed(got["columns"], got["columns"]).count() == 0


def test_chunk_routing(spark):
    files = spark.createDataFrame([("a/x.sql", "create table t (a int);"), ("m/1_x.sql", "create table u (a int);"), ("r.MD", "# one\n\ntext\n# two\n"), ("c.py", "x = 1\n")], "path string, text string")
    skip = spark.createDataFrame([("m",)], "dir string")
    got = sorted((r.path, r.kind, r["first"], r["last"]) for r in chunking.routed_chunks(files, skip=skip).collect())
    assert got == [("a/x.sql", "lines", 1, 1), ("a/x.sql", "table", 1, 2), ("c.py", "lines", 1, 1), ("m/1_x.sql", "lines", 1, 1), ("r.MD", "markdown", 1, 3), ("r.MD", "markdown", 4, 4)]


def test_tree_chunks():
    text = "import os\n\n" + "".join(f"def f{i}():\n    return {i}\n\n" for i in range(20)) + "class A:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(40)) + "# end\n"
    got = chunking.tree_chunks(text, 300)
    assert "".join(c[2] for c in got) == text and all(len(c[2].encode()) <= 300 for c in got)
    assert all(c[2].startswith(("import", "def ", "class ", "    def ")) for c in got)
    assert "".join(c[2] for c in chunking.tree_chunks("def (\n" * 99, 100)) == "def (\n" * 99


def test_resync_and_reuse(spark):
    from millrace.streaming import maintain

    m = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "file string, mtime_ns long, size long")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "file string, mtime_ns long, size long")
    batch = spark.createDataFrame([("a",), ("b",), ("x",)], "file string")
    assert {tuple(r) for r in maintain.resynced(m, now, batch).collect()} == {("a", "changed"), ("b", "changed"), ("c", "deleted"), ("d", "changed"), ("x", "deleted")}
    texts = spark.createDataFrame([("a", 0, "one"), ("b", 0, "two")], "file string, seq long, text string")
    cache = spark.createDataFrame([("one", ["o"]), ("old", ["x"])], "text string, tokens array<string>").select(F.sha2("text", 256).alias("hash"), "tokens")
    hit, kept = incremental.reused(texts, cache)
    assert {r.file: r.tokens for r in hit.collect()} == {"a": ["o"], "b": None} and [r.tokens for r in kept.collect()] == [["o"]]


def test_stream_admission_and_log(spark, tmp_path):
    from millrace.streaming import maintain

    rules = corpus.compiled(spark, [("git", "", 1, "*.log"), ("git", "", 2, "!keep.log"), ("own", "", 1, "tmp/")])
    rows = [("a.py", "write", 3, "x=1"), ("b.log", "write", 3, "x"), ("keep.log", "write", 1, "x"), ("tmp/c.py", "write", 1, "x"), ("big.js", "write", 5000, "y" * 5000), ("gone.py", "remove", None, None), ("n.bin", "write", 2, "\x00a")]
    df = spark.createDataFrame(rows, "path string, op string, bytes long, text string")
    assert sorted(r.path for r in maintain.admitted_stream(df, rules).collect()) == ["a.py", "gone.py", "keep.log"]
    whole = corpus.ignored(df.select("path"), rules)
    hidden = corpus.matched(rules)
    assert {r.path for r in whole.filter("ignored").collect()} == {r.path for r in df.filter(hidden(F.col("path"))).collect()}
    use = spark.createDataFrame([(1.0, "search", 2, 10, 90)], "ts double, call string, results int, snippet_chars long, file_chars long")
    maintain.recorded(use, str(tmp_path / "log"))
    maintain.recorded(use, str(tmp_path / "log"))
    assert index.usage_log(spark, str(tmp_path / "log")).count() == 2


def test_unchanged_files_publish_nothing(spark, tmp_path):
    from millrace.streaming import maintain

    store = maintain.Published(spark, str(tmp_path / "pub"))
    chunks = spark.createDataFrame([("a", 0, "1"), ("b", 0, "2")], "file string, seq long, text string")
    store.publish(chunks)
    for n, (file, text) in enumerate([("a", "1"), ("b", "new")]):
        spark.createDataFrame([(file, "write")], "file string, op string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("file string, op string").parquet(str(tmp_path / "in"))
        fresh = lambda files, f=file, t=text: spark.createDataFrame([(f, 0, t)], "file string, seq long, text string").join(files, "file", "left_semi")
        maintain.maintained(stream, store, fresh, str(tmp_path / "cp")).awaitTermination()
        assert store.version() == n
    assert {r.file: r.text for r in store.current().collect()} == {"a": "1", "b": "new"}


def test_deleted_chunks_are_in_neither_arm(spark):
    chunks = spark.createDataFrame([(0, "a.py", "blue sky", True), (1, "b.py", "blue sea", False), (2, "c.py", "red sea", False)], "chunk_id long, file string, text string, deleted boolean")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "chunk_id long, vec array<double>")
    queries = spark.createDataFrame([(7, "blue sky above")], "query_id int, query string")
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, qvec array<double>")
    got = retrieval.hybrid(queries, chunks, vecs, qv, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2]
    # all weight on vectors: no path penalty, and the lexical arm adds nothing
    far = spark.createDataFrame([(1, "tests/b_test.py", "blue", False), (2, "c.py", "blue", False)], "chunk_id long, file string, text string, deleted boolean")
    assert [r.chunk_id for r in retrieval.hybrid(queries, far, vecs, qv, 5, alpha=1.0).orderBy("rank").collect()] == [1, 2]
    assert [r.chunk_id for r in retrieval.hybrid(queries, far, vecs, qv, 5).orderBy("rank").collect()] == [2, 1]


def test_blocks_of_vectors(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(300, None)]
    v = spark.createDataFrame(rows, "chunk_id long, vec array<float>")
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.knn(q, v, 4, itself=False).collect())
    want = []
    for i in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(rows[i][1], w)), j) for j, w in rows[:300] if j != i)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want
