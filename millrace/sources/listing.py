"""A file tree as a Spark data source that leaves out ignored folders before anything in them is opened.

:func:`listed` gives (file, bytes, text) of the files that the ignore files found on the way let
through. The driver lists folders until there are ``folders`` of them
and deals one task each, with the rules that hold there; a task walks its folder in lexical order, reads
the ignore files of each folder before its entries, and opens only what is left. Conditions on the file's
beginning and its size are met before files are opened: Spark hands them to the source.

Defined results: paths are relative, with slashes, in lexical order within a task; ``.git`` and ``.millrace``
are left out; ignore files themselves are files; a folder's ignore file does not concern the folder itself; each
family (``.gitignore``; ``.millraceignore``, or ``.indexignore`` where there is none) decides by its last matching rule, inner
folders after outer, and one cannot let in what the other ignores; files with a NUL byte at their
beginning are binary and left out; bytes that are no UTF-8 become replacement characters; an empty tree has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .corpus import LARGEST, PRUNED, SNIFF, rule_regex

FAMILIES = {"git": (".gitignore",), "own": (".millraceignore", ".indexignore")}
Scope = tuple[str, str, tuple[tuple[str, bool, bool], ...]]


def is_ignored(scopes: tuple[Scope, ...], path: str, is_dir: bool) -> bool:
    """Whether the rules of the folders above ignore a path."""
    says: dict[str, bool] = {}
    for family, folder, rules in scopes:
        rest = path[len(folder) + 1 :] if folder else path
        for regex, negate, dir_only in rules:
            if (is_dir or not dir_only) and re.search(regex, rest, re.DOTALL):
                says[family] = not negate
    return any(says.values())


class Tree:
    """Listing and reading below a root, on any file system that pyarrow knows."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, bytes) of a folder in lexical order."""
        at = f"{self.root}/{folder}".rstrip("/")
        found = self.fs.get_file_info(pafs.FileSelector(at))
        kept = [i for i in found if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
        return sorted((i.base_name, i.type == pafs.FileType.Directory, i.size or 0) for i in kept)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()


def scopes_of(tree: Tree, folder: str, names: set[str], outer: tuple[Scope, ...]) -> tuple[Scope, ...]:
    """The rules that hold inside a folder: the outer ones and those of its own ignore files."""
    for family, files in FAMILIES.items():
        name = next((n for n in files if n in names), None)
        if name:
            lines = tree.read(f"{folder}/{name}".lstrip("/")).decode("utf-8", "replace").splitlines()
            rules = tuple(rule_regex(r) for r in lines if r.strip() and not r.startswith("#"))
            outer = (*outer, (family, folder, rules)) if rules else outer
    return outer


def inside(tree: Tree, folder: str, scopes: tuple[Scope, ...]) -> tuple[list[tuple[str, bool, int]], tuple[Scope, ...]]:
    """(path, is a folder, bytes) of what a folder holds and is not ignored, and the rules in it."""
    entries = tree.entries(folder)
    scopes = scopes_of(tree, folder, {n for n, is_dir, _ in entries if not is_dir}, scopes)
    paths = [(f"{folder}/{n}".lstrip("/"), is_dir, size) for n, is_dir, size in entries if not (is_dir and n in PRUNED)]
    return [e for e in paths if not is_ignored(scopes, e[0], e[1])], scopes


def walk(tree: Tree, folder: str, scopes: tuple[Scope, ...], wanted: Callable[[str, int], bool], deep: bool = True) -> Iterator[tuple[str, int, str]]:
    """(file, bytes, text) of the wanted files in a folder and, if ``deep``, below it."""
    entries, scopes = inside(tree, folder, scopes)
    for path, is_dir, size in entries:
        if is_dir:
            if deep:
                yield from walk(tree, path, scopes, wanted)
        elif wanted(path, size):
            raw = tree.read(path)
            if b"\0" not in raw[:SNIFF]:
                yield path, size, raw.decode("utf-8", "replace")


def write_tree(files: DataFrame, root: str) -> None:
    """Write rows (file, text) as files below a root that all machines see; a task that runs again writes the same."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(root)
        for b in batches:
            for name, text in zip(b["file"], b["text"], strict=True):
                at = f"{tree.root}/{name}"
                tree.fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with tree.fs.open_output_stream(at) as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(b)]})

    files.select("file", "text").mapInPandas(work, "n long").write.format("noop").mode("overwrite").save()


@dataclass
class Folder(InputPartition):
    """A task: a folder, the rules outside it, and whether what lies below is its own."""

    path: str
    scopes: tuple[Scope, ...] = field(default_factory=tuple)
    deep: bool = True

    def __init__(self, path: str, scopes: tuple[Scope, ...] = (), deep: bool = True):
        super().__init__(path)
        self.path, self.scopes, self.deep = path, scopes, deep


class ListingReader(DataSourceReader):
    def __init__(self, root: str, folders: int, largest: int):
        self.root, self.folders, self.largest, self.prefix = root, folders, largest, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("file",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("bytes",):
                self.largest = min(self.largest, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _near(self, folder: str) -> bool:
        """Whether a folder may hold files with the prefix."""
        return f"{folder}/".startswith(self.prefix) or self.prefix.startswith(f"{folder}/")

    def partitions(self) -> list[Folder]:
        tree, todo, done = Tree(self.root), [Folder("")], []
        # level by level, until there are folders enough; those opened here keep their own files as a task
        while todo and len(todo) + len(done) < self.folders:
            below = []
            for f in todo:
                entries, scopes = inside(tree, f.path, f.scopes)
                done.append(Folder(f.path, f.scopes, False))
                below += [Folder(p, scopes) for p, is_dir, _ in entries if is_dir and self._near(p)]
            todo = below
        return sorted(done + todo, key=lambda f: f.path.split("/"))

    def read(self, partition: Folder) -> Iterator[tuple[str, int, str]]:
        prefix, largest = self.prefix, self.largest
        return walk(Tree(self.root), partition.path, partition.scopes, lambda p, size: p.startswith(prefix) and size <= largest, partition.deep)


class Listing(DataSource):
    """Options: path, ``folders`` (tasks to aim at), ``largest`` (bytes of a file at most)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_listing"

    def schema(self) -> str:
        return "file string, bytes long, text string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("folders", "64")), int(self.options.get("largest", str(LARGEST))))


def listed(spark: SparkSession, root: str, folders: int = 64, largest: int = LARGEST) -> DataFrame:
    """The files below a root. Filters reach the source, for which the session's setting is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format(Listing.name()).option("folders", folders).option("largest", largest).load(root)
