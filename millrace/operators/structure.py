"""Symbol graph: labels, symbol index and exact lookups over per-file structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINEL = "# label: "


def strip_label(text: Column) -> Column:
    """A text without its label line."""
    return F.regexp_replace(text, "^" + SENTINEL + "[^\n]*\n", "")


def callers_of(files: DataFrame) -> DataFrame:
    """(path, callers): of each file's primary function, the sorted base names without extension of the other files that call it."""
    own = files.select("path", _primary(F.col("functions"))["name"].alias("name")).filter("name IS NOT NULL")
    base = F.regexp_replace(F.substring_index("caller", "/", -1), r"(.)\.[^.]*$", "$1")
    calls = files.select(F.col("path").alias("caller"), F.explode(F.array_distinct("call_refs.callee")).alias("name"))
    met = own.join(calls, "name").filter("caller <> path").groupBy("path").agg(F.array_sort(F.collect_set(base)).alias("callers"))
    return met


def _primary(f: Column) -> Column:
    """The first function that is no method, else the first."""
    return F.coalesce(F.get(F.filter(f, lambda x: ~x["is_method"]), F.lit(0)), F.get(f, F.lit(0)))


def full_label(files: DataFrame, most: int = 8) -> DataFrame:
    """As :func:`label`, with the sections called by, imports, params and returns, and siblings after it."""
    one = _primary(F.col("functions"))
    cut = lambda a: F.array_join(F.slice(a, 1, most), ", ")
    part = lambda name, v: F.when((v != "") & v.isNotNull(), F.concat(F.lit(name + ": "), v))
    mine = F.filter("classes", lambda c: c["name"] == one["enclosing_class"])
    siblings = F.array_sort(F.array_except(F.flatten(F.transform(mine, lambda c: F.transform(c["methods"], lambda m: m["name"]))), F.array(one["name"])))
    x = files.join(label(files, most), "path").join(callers_of(files), "path", "left")
    more = [part("called by", cut(F.col("callers"))), part("imports", cut(F.col("imports"))), part("params", cut(one["params"])), part("returns", one["return_type"]), part("siblings", F.when(one["enclosing_class"] != "", cut(siblings)))]
    rest = F.concat_ws(" | ", *more)
    whole = F.when(rest == "", F.col("label")).when(F.col("label") == "", F.concat(F.lit(SENTINEL), rest)).otherwise(F.concat_ws(" | ", "label", rest))
    return x.select("path", whole.alias("label"))


def label(files: DataFrame, most: int = 8, raises: int = 4) -> DataFrame:
    """(path, label) of (path, functions, call_refs, raises): primary function, calls, raises; empty sections are left out."""
    f = F.col("functions")
    primary = _primary(f)["name"]
    calls = F.array_join(F.slice(F.array_distinct(F.transform("call_refs", lambda c: c["callee"])), 1, most), ", ")
    thrown = F.array_join(F.slice("raises", 1, raises), ", ")
    part = lambda name, v: F.when((v != "") & v.isNotNull(), F.concat(F.lit(name + ": "), v))
    body = F.concat_ws(" | ", part("func", primary), part("calls", calls), part("raises", thrown))
    return files.select("path", F.when(body != "", F.concat(F.lit(SENTINEL), body)).otherwise("").alias("label"))


def apply_label(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Every chunk of a labelled file starts with the label."""
    x = chunks.join(labels.select(F.col("path").alias("_path"), F.col("label").alias("_label")), F.col("file") == F.col("_path"), "left")
    text = F.when(F.coalesce("_label", F.lit("")) != "", F.concat("_label", F.lit("\n"), "text")).otherwise(F.col("text"))
    return x.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in chunks.columns])


def definitions(files: DataFrame) -> DataFrame:
    """(name, path, kind, line, container) of functions, classes and methods; methods also as Type.method."""
    fn = files.select("path", F.explode("functions").alias("f")).filter("NOT f.is_method").select(F.col("f.name").alias("name"), "path", F.lit("function").alias("kind"), F.col("f.start_line").alias("line"), F.lit("").alias("container"))
    cls = files.select("path", F.explode("classes").alias("c"))
    own = cls.select(F.col("c.name").alias("name"), "path", F.lit("class").alias("kind"), F.col("c.start_line").alias("line"), F.lit("").alias("container"))
    m = cls.select("path", F.col("c.name").alias("container"), F.explode("c.methods").alias("m"))
    bare = m.select(F.col("m.name").alias("name"), "path", F.lit("method").alias("kind"), F.col("m.start_line").alias("line"), "container")
    full = bare.withColumn("name", F.concat_ws(".", "container", "name"))
    return fn.unionByName(own).unionByName(bare).unionByName(full)


def definition(files: DataFrame, names: DataFrame) -> DataFrame:
    """One site for each (name, file, kind) asked for, the first; dotted names find methods only."""
    hit = definitions(files).join(names, "name").filter(~F.col("name").contains(".") | (F.col("kind") == "method"))
    w = Window.partitionBy("name", "path", "kind").orderBy("line", "container")
    return hit.withColumn("n", F.row_number().over(w)).filter("n = 1").select("name", "path", "kind", "line", "container")


def symbol_index(files: DataFrame) -> DataFrame:
    """(name, files) with the sorted distinct files that define the name."""
    return definitions(files).groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("files"))


def references(files: DataFrame) -> DataFrame:
    """(name, path, kind) of calls, imports and raises."""
    call = files.select(F.explode("call_refs.callee").alias("name"), "path", F.lit("call").alias("kind"))
    imp = files.select(F.explode("imports").alias("name"), "path", F.lit("import").alias("kind"))
    thrown = files.select(F.explode("raises").alias("name"), "path", F.lit("raise").alias("kind"))
    return call.unionByName(imp).unionByName(thrown)


def callers(files: DataFrame, names: DataFrame) -> DataFrame:
    return references(files).filter("kind = 'call'").join(names, "name", "left_semi").select("name", "path").distinct()


def outline(files: DataFrame) -> DataFrame:
    """(path, n, name, kind, container, line): functions, then each class followed by its methods."""
    fn = files.select("path", F.posexplode("functions").alias("i", "f")).filter("NOT f.is_method").select("path", F.struct(F.lit(0).alias("a"), F.col("i").alias("b"), F.lit(-1).alias("c")).alias("o"), F.col("f.name").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("container"), F.col("f.start_line").alias("line"))
    cls = files.select("path", F.posexplode("classes").alias("i", "c"))
    own = cls.select("path", F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), F.lit(-1).alias("c")).alias("o"), F.col("c.name").alias("name"), F.lit("class").alias("kind"), F.lit("").alias("container"), F.col("c.start_line").alias("line"))
    m = cls.select("path", "i", F.col("c.name").alias("container"), F.posexplode("c.methods").alias("j", "m"))
    method = m.select("path", F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), F.col("j").alias("c")).alias("o"), F.col("m.name").alias("name"), F.lit("function").alias("kind"), "container", F.col("m.start_line").alias("line"))
    every = fn.unionByName(own).unionByName(method)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("o"))).drop("o")


def under(path: Column, prefix: str) -> Column:
    p = prefix.strip("/")
    return F.lit(p in ("", ".")) | (path == p) | path.startswith(p + "/")


def symbols(files: DataFrame, prefix: str) -> DataFrame:
    """Top-level names under a path."""
    return definitions(files).filter("kind <> 'method'").filter(under(F.col("path"), prefix)).select("name").distinct()


def stats(files: DataFrame) -> DataFrame:
    names = definitions(files).filter("NOT contains(name, '.')").agg(F.countDistinct("name").alias("symbols"))
    callees = references(files).filter("kind = 'call'").agg(F.countDistinct("name").alias("callees"))
    return files.agg(F.countDistinct("path").alias("files")).crossJoin(names).crossJoin(callees)
