"""Corpus sources: reading files, admission filters and ignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST, MOST_FILES, SNIFF, HEAD = 2 << 20, 1_000_000, 32768, 2048
#: Phrases that tell a generated file next to "do not edit".
GENERATED_BY = ("code generated", "generated by", "autogenerated", "auto-generated", "generated file")
PRUNED = (".git", ".millrace")


def files(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """(file, bytes, text) below a folder; the size filter reaches the file listing.

    Files with a NUL byte among the first ``SNIFF`` are binary and left out; in others, bytes that are no
    UTF-8 become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.filter((F.col("length") <= largest) & ~F.contains(F.substring("content", 1, SNIFF), F.lit(b"\x00")))
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", "[.]") + "/", "")
    text = raw.select(rel.alias("file"), F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return text.filter(~F.col("file").rlike(r"(^|/)[.](git|millrace)(/|$)"))


def capped(rows: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The rows, or an error where there are more than ``most``; never a part of them."""
    if rows.select(F.lit(1)).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    return rows


def minified(text: Column, most: int = 1000) -> Column:
    """Average line length over ``most`` bytes in a text of 2048 or more; 0 turns the test off."""
    size = F.octet_length(text)
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.lit(most > 0) & (size >= HEAD) & (F.floor(size / lines) > most)


def generated(text: Column) -> Column:
    head = F.substring(text, 1, HEAD)
    low = F.lower(head)
    by = F.lit(False)
    for phrase in GENERATED_BY:
        by = by | low.contains(phrase)
    return head.contains("@generated") | (low.contains("do not edit") & by)


def admitted(rows: DataFrame, largest: int = LARGEST, longest_line: int = 1000, skip_generated: bool = False) -> DataFrame:
    """Rows (.., bytes, text) that are indexed: not too large, binary, minified or, if asked, generated."""
    return rows.filter(indexable(largest, longest_line, skip_generated))


def indexable(largest: int = LARGEST, longest_line: int = 1000, skip_generated: bool = False) -> Column:
    """Whether a row (bytes, text) is indexed; the same test for a walk and for one change of a stream."""
    ok = (F.col("bytes") <= largest) & ~F.substring("text", 1, SNIFF).contains("\x00") & ~minified(F.col("text"), longest_line)
    return ok & ~generated(F.col("text")) if skip_generated else ok


def matched(rules: DataFrame):
    """The test of :func:`ignored` as an expression of a path, for streams; the rules are few and become part of the plan."""
    by_family: dict[str, list] = {}
    for r in sorted(rules.collect(), key=lambda r: (len(r.scope) * 1000 + r.seq)):
        by_family.setdefault(r.family, []).append(r)

    def test(path: Column) -> Column:
        parts = F.split(path, "/")
        nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), (i < F.size(parts)).alias("is_dir")))

        def hidden(n: Column) -> Column:
            out = F.lit(False)
            for own in by_family.values():
                last = F.lit(False)
                for r in own:
                    inside = F.lit(True) if r.scope == "" else n["node"].startswith(r.scope + "/")
                    rest = n["node"] if r.scope == "" else F.substring(n["node"], len(r.scope) + 2, 1 << 20)
                    hit = inside & (n["is_dir"] | F.lit(not r.dir_only)) & F.regexp_like(rest, F.lit(r.regex))
                    last = F.when(hit, not r.negate).otherwise(last)
                out = out | last
            return out

        return F.exists(nodes, hidden)

    return test


def rule_regex(rule: str) -> tuple[str, bool, bool]:
    """(anchored pattern, negated, directories only) of an ignore line.

    ``*`` and ``?`` stay inside a component, ``**`` spans components where it is one itself; ``[a-z]`` and
    ``[!a-z]`` are classes, a backslash takes the next character as it is, blanks at the end do not count
    unless one stands before them; a slash inside the rule ties it to its folder.
    """
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    negate = rule.startswith("!")
    rule = rule[1:] if negate else rule
    dir_only = rule.endswith("/")
    rule = rule.rstrip("/")
    tied = "/" in rule
    parts = rule.lstrip("/").split("/")
    out = "" if tied else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
            continue
        for own in re.finditer(r"\\(.)|\[([!^]?)(\]?[^\]]*)\]|(.)", part):
            escaped, sign, chars, c = own.groups()
            if chars is not None:
                out += "[" + ("^/" if sign else "") + re.sub(r"([\\\[\]&~])", r"\\\1", chars) + "]"
            else:
                out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([\\.+^$(){}|\[\]*?])", r"\\\1", escaped or c)
        out += "" if last else "/"
    return f"^{out}$", negate, dir_only


def compiled(spark: SparkSession, lines: list[tuple[str, str, int, str]]) -> DataFrame:
    """Rules (family, scope, seq, regex, negate, dir_only) of lines (family, folder, number, text)."""
    rows = [(f, s, n, *rule_regex(r)) for f, s, n, r in lines if r.strip() and not r.startswith("#")]
    return spark.createDataFrame(rows, "family string, scope string, seq int, regex string, negate boolean, dir_only boolean")


def compiled_rows(lines: DataFrame) -> DataFrame:
    """As :func:`compiled`, for any number of lines (family, scope, seq, line)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, o, n, *rule_regex(r)) for f, o, n, r in zip(b.family, b["scope"], b.seq, b.line, strict=True) if r.strip() and not r.startswith("#")]
            yield pd.DataFrame(rows, columns=["family", "scope", "seq", "regex", "negate", "dir_only"])

    return lines.select("family", "scope", "seq", "line").filter("line IS NOT NULL").mapInPandas(work, "family string, scope string, seq int, regex string, negate boolean, dir_only boolean")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored): the last matching rule of each family decides, inner folders after outer; any ignored ancestor counts.

    The paths' folders and files, each once, meet the rules of the folders above them by equality. The rules of
    a folder and family are one row, with all patterns in one that leaves out most names at once.
    """
    parts = F.split("path", "/")
    node = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), (i < F.size(parts)).alias("is_dir")))
    every = paths.select("path").distinct().select("path", F.inline(node))
    nodes = every.select("node", "is_dir").distinct()
    own = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_join(F.slice(own, 1, i), "/"))
    rule = F.struct("seq", "regex", "negate", "dir_only")
    folders = rules.groupBy("scope", "family").agg(F.array_sort(F.collect_list(rule)).alias("rules"), F.array_join(F.transform(F.collect_set("regex"), lambda r: F.concat(F.lit("(?:"), r, F.lit(")"))), "|").alias("any"))
    met = nodes.withColumn("scope", F.explode(above)).join(folders, "scope")
    rest = F.when(F.col("scope") == "", F.col("node")).otherwise(F.expr("substring(node, length(scope) + 2)"))
    met = met.withColumn("rest", rest).filter(F.regexp_like("rest", F.col("any")))
    hits = lambda r: (F.col("is_dir") | ~r["dir_only"]) & F.regexp_like(F.col("rest"), r["regex"])
    says = F.aggregate("rules", F.lit(None).cast("boolean"), lambda acc, r: F.when(hits(r), ~r["negate"]).otherwise(acc))
    last = met.withColumn("says", says).filter("says IS NOT NULL").groupBy("node", "is_dir", "family").agg(F.max_by("says", F.length("scope")).alias("hit"))
    hidden = last.filter("hit").select("node", "is_dir").distinct()
    out = every.join(hidden, ["node", "is_dir"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def allowed_schema(name: Column, engine: str, include: list[str], exclude: list[str]) -> Column:
    """System schemas are always out; an allow list rules where there is one, else the deny list."""
    #: System schemas.
    system = {"postgres": ["information_schema", "pg_catalog", "pg_toast"], "mysql": ["mysql", "information_schema", "performance_schema", "sys"]}.get(engine, [])
    ok = ~name.isin(*system) if system else F.lit(True)
    if engine == "postgres":
        ok = ok & ~name.startswith("pg_")
    return ok & (name.isin(*include) if include else ~name.isin(*exclude) if exclude else F.lit(True))
