"""Listing source, ignore rules by folders, commit differences and the watcher's state against plain versions."""

import random

from pyspark.sql import functions as F

from millrace.sources import corpus, history, listing
from millrace.streaming.watcher import Watcher, merged


def tree(tmp_path, files):
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


FILES = {
    ".gitignore": "*.log\nbuild/\n# a comment\n\n", ".millraceignore": "docs/secret*\n!a/keep.log\n", ".indexignore": "src/\n", "a/keep.log": "x", "a/b.py": "x", "build/deep/x.py": "x", "docs/secret.md": "x",
    "docs/open.md": "x", "pkg/.gitignore": "node_modules/\n!z.log\n", "pkg/node_modules/.gitignore": "!*", "pkg/node_modules/lib/m.js": "x", "pkg/src/z.log": "x", "pkg/src/index.ts": "é", "src/main.go": "x", "a.b/c": "x",
    ".git/config": "x", "pkg/.millrace/index": "x", "bin/tool": b"\x00\x01", "bad.txt": b"\xff ok", "empty.txt": "", "big.txt": "y" * 500, "only/.indexignore": "vendor/\n", "only/vendor/v.go": "x", "only/v.go": "x",
}
SEEN = [".gitignore", ".indexignore", ".millraceignore", "a/b.py", "a.b/c", "bad.txt", "big.txt", "docs/open.md", "empty.txt", "only/.indexignore", "only/v.go", "pkg/.gitignore", "pkg/src/index.ts", "pkg/src/z.log", "src/main.go"]


def test_listing_keeps_what_is_not_ignored(spark, tmp_path):
    root = tree(tmp_path, FILES)
    for folders in (1, 4, 64):
        rows = listing.listed(spark, root, folders).collect()
        assert sorted(r.file for r in rows) == sorted(SEEN), folders
    text = {r.file: (r.bytes, r.text) for r in rows}
    assert text["pkg/src/index.ts"] == (2, "é") and text["bad.txt"] == (4, "� ok") and text["empty.txt"] == (0, "")
    assert listing.listed(spark, root, largest=100).filter("file = 'big.txt'").count() == 0
    assert listing.listed(spark, tree(tmp_path / "none", {"x/.gitignore": "*"})).count() == 0


def test_nothing_ignored_is_opened(tmp_path):
    root, opened = tree(tmp_path, FILES), []

    class Told(listing.Tree):
        def read(self, path):
            opened.append(path)
            return super().read(path)

        def entries(self, folder):
            opened.append(folder + "/")
            return super().entries(folder)

    files = [f for f, _, _ in listing.walk(Told(root), "", (), lambda p, size: size < 100)]
    assert sorted(files) == sorted(f for f in SEEN if f != "big.txt")
    assert files == sorted(files, key=lambda f: f.split("/"))  # lexical order of the walk
    assert not {"a/keep.log", "build/", "build/deep/", "docs/secret.md", "pkg/node_modules/", "pkg/node_modules/.gitignore", ".git/", "pkg/.millrace/", "big.txt"} & set(opened)


def test_conditions_reach_the_source(spark, tmp_path):
    root = tree(tmp_path, FILES)
    df = listing.listed(spark, root, 4).filter(F.col("file").startswith("pkg/src") & (F.col("bytes") <= 1))
    assert [r.file for r in df.collect()] == ["pkg/src/z.log"]
    reader = listing.ListingReader(root, 64, 1000)
    left = list(reader.pushFilters([listing.StringStartsWith(("file",), "pkg/"), listing.LessThan(("bytes",), 10), listing.StringStartsWith(("text",), "x")]))
    assert len(left) == 1 and (reader.prefix, reader.largest) == ("pkg/", 9)
    assert {p.path for p in reader.partitions()} <= {"", "pkg", "pkg/src"}


def test_rules_by_folder_agree_with_the_walk(spark):
    rnd = random.Random(2)
    names = ["a", "b", "ab", "c.log", "d.py", "test_d.py"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(150)})
    globs = ["*.log", "!c.log", "a/", "b/**/d.py", "/ab", "test_*", "!test_d.py", "?", "[bc]*", "!b", "**/ab/*", "# no", "", "a/b"]
    scopes = ["", "a", "b", "a/b", "ab"]
    lines = [(f, s, n, rnd.choice(globs)) for f in ("git", "own") for s in scopes for n in range(rnd.randint(0, 4))]
    rules = corpus.compiled_rows(spark.createDataFrame(lines, "family string, scope string, seq int, line string"))
    got = {r.path: r.ignored for r in corpus.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    stack = {}
    for family, scope, _, line in sorted(lines, key=lambda x: (len(x[1]), x[2])):
        if line.strip() and not line.startswith("#"):
            stack.setdefault((family, scope), []).append(corpus.rule_regex(line))
    held = [(f, s, tuple(r)) for (f, s), r in sorted(stack.items(), key=lambda x: len(x[0][1]))]

    def hidden(path):
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            node = "/".join(parts[:k])
            above = tuple(x for x in held if x[1] == "" or node.startswith(x[1] + "/"))
            if listing.is_ignored(above, node, k < len(parts)):
                return True
        return False

    assert got == {p: hidden(p) for p in paths} and any(got.values()) and not all(got.values())
    plan = corpus.ignored(spark.createDataFrame([("a",)], "path string"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_commit_differences(spark):
    trees = {
        1: {"a": "1", "b": "2", "d/x": "9"}, 2: {"a": "1", "c": "2", "d/x": "9"}, 3: {"a": "7", "d/y": "9", "d/z": "9"}, 4: {"a": "7", "d/y": "9", "d/z": "9"}, 9: {"q": "0"},
        5: {"d/y": "9"},
    }
    commits = spark.createDataFrame([(1, 10, []), (2, 20, [1]), (3, 30, [2]), (4, 40, [3, 9]), (5, 40, [4])], "commit long, ts long, parents array<long>")
    rows = spark.createDataFrame([(c, p, b) for c, t in trees.items() for p, b in t.items()], "commit long, path string, blob string")
    got = {r.commit: (r.place, r.files) for r in history.recent_changes(commits, rows, 9).collect()}
    # 2: b moved to c; 3: c goes, d/x moves to d/y, d/z is new; 4: a merge that changes nothing against its first parent
    assert got == {5: (1, ["a", "d/z"]), 4: (2, []), 3: (3, ["a", "c", "d/y", "d/z"]), 2: (4, ["c"]), 1: (5, ["a", "b", "d/x"])}
    assert {r.commit: r.files for r in history.recent_changes(commits, rows, 3, "d/").collect()} == {5: ["d/z"], 3: ["d/y", "d/z"]}
    assert history.recent_changes(commits.limit(0), rows, 3).count() == 0


class Held:
    """The part of a handle that the watcher uses, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        held = Held()
        held.iterator, held.clear = lambda: iter(list(held.map.items())), lambda: held.map.clear()
        return held

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class Event:
    def __init__(self, us, seq, path, op):
        self.us, self.seq, self.path, self.op = us, seq, path, op


def test_watcher_cuts_a_burst_and_merges_its_operations():
    """Events every second without a pause are still cut at the cap; the last batch comes with its timer."""
    handle, second = Held(), 1_000_000
    w = Watcher(2 * second, 10 * second)
    w.init(handle)
    out = []
    events = [Event(k * second, k, "ab"[k % 2], [1, 2, 4, 2][k % 4]) for k in range(25)]
    for k in range(0, 25, 5):
        out += w.handleInputRows((7,), iter(reversed(events[k : k + 5])), None)
        assert len(handle.timers) == 1
    assert sorted({(r.first // second, r.last // second, r.n) for r in out}) == [(0, 10, 11), (11, 21, 11)]
    assert handle.listTimers() == [26_001]
    out = list(w.handleExpiredTimer((7,), None, None))
    assert {(r.first // second, r.last // second, r.n, r.path) for r in out} == {(22, 24, 3, "a"), (22, 24, 3, "b")}
    assert not list(w.handleExpiredTimer((7,), None, None)) and not handle.exists()
    ops = 0
    for op in (1, 2, 4, 2, 8, 1):
        ops = merged(ops, op)
    assert ops == 1 and merged(1, 2) == 3
