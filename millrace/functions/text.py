"""Text and path functions as columns."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = "[a-zA-Z_][a-zA-Z0-9_]*"
#: Fixed value: words that carry no content in a natural-language query.
STOP_WORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def camel_parts(name: Column) -> Column:
    """Lower-cased parts of a camel-case name; acronyms and digit runs are parts of their own."""
    cut = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(cut, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), 0), F.lower)


def snake_parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "_"), lambda p: p != "")


def identifier_terms(name: Column) -> Column:
    """The name lower-cased, then its parts where it has two or more; underscores rule out camel case."""
    parts = F.when(name.contains("_"), snake_parts(name)).otherwise(camel_parts(name))
    split = let(parts, lambda p: F.when(F.size(p) >= 2, F.concat(F.array(F.lower(name)), p)).otherwise(F.array(F.lower(name))))
    # most names are plain words, which have one part
    return F.when(name.rlike("^[A-Z]?[a-z]+$"), F.array(F.lower(name))).otherwise(split)


def terms(text: Column) -> Column:
    """The index terms of a text, in order, with repeats."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENT), 0), identifier_terms))


_ident, _plain, _camel, _part = (re.compile(p) for p in (IDENT, "[A-Z]?[a-z]+", "([A-Z]+)([A-Z][a-z])", "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"))


class Names(dict):
    """The terms of each name met so far, as :func:`identifier_terms` gives them; it forgets all beyond a number of names."""

    MOST = 200_000

    def __missing__(self, name: str) -> tuple[str, ...]:
        low = name.lower()
        if _plain.fullmatch(name):
            out = (low,)
        else:
            parts = [p for p in low.split("_") if p] if "_" in name else [p.lower() for p in _part.findall(_camel.sub(r"\1 \2", name))]
            out = (low, *parts) if len(parts) >= 2 else (low,)
        if len(self) >= self.MOST:
            self.clear()
        self[name] = out
        return out


def tally(text: str, names: Names) -> dict[str, int]:
    """How often each of a text's :func:`terms` occurs, in plain Python for Arrow batches."""
    out: dict[str, int] = {}
    for name, n in Counter(_ident.findall(text)).items():
        for term in names[name]:
            out[term] = out.get(term, 0) + n
    return out


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def tallies(texts: pa.StringArray, names: Names) -> tuple[pa.ListArray, pa.ListArray]:
    """The different :func:`terms` of each text of an Arrow batch and their counts, as :func:`tally` has them, in no given order.

    A run of letters, digits and underscores holds one name, what follows its leading digits; runs are told apart
    and counted for all texts together. Null texts have none.
    """
    n = len(texts)
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    held = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[held[0] : held[-1]]
    held -= held[0]
    word = _WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = held[(held > 0) & (held < len(data))]
    begins[edges] = word[edges]  # a text begins anew
    begins = np.flatnonzero(begins)
    letters = data[word]
    sizes = np.add.reduceat(word, begins, dtype=np.int32) if len(begins) else begins
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    runs = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(letters.tobytes())).dictionary_encode()
    of = np.searchsorted(held, begins, "right") - 1
    different = len(runs.dictionary)
    met, times = np.unique(of * max(different, 1) + runs.indices.to_numpy(), return_counts=True)  # a row for each text and run
    of, run = np.divmod(met, max(different, 1))

    vocab: dict[str, int] = {}
    held_terms = [names[name] if (name := r.lstrip("0123456789")) else () for r in runs.dictionary.to_pylist()]
    codes = np.array([vocab.setdefault(t, len(vocab)) for own in held_terms for t in own], np.int64)
    sizes = np.array([len(own) for own in held_terms], np.int64)
    starts = np.cumsum(sizes) - sizes
    own = sizes[run]
    code = codes[np.repeat(starts[run] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
    key = np.repeat(of, own) * max(len(vocab), 1) + code
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.add.reduceat(np.repeat(times, own)[by], first) if len(key) else first
    of, code = np.divmod(key[first], max(len(vocab), 1))
    at = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(list(vocab), pa.string()).take(pa.array(code))), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))


def approx_tokens(text: Column) -> Column:
    """A word run costs a token for each 4 characters begun, any other visible character one."""
    runs = F.aggregate(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), 0), F.lit(0), lambda a, r: a + F.ceil(F.length(r) / 4).cast("int"))
    return runs + F.length(F.regexp_replace(text, r"[A-Za-z0-9_ \t\n\r\x0b\x0c]", ""))


#: Fixed value: the characters of Unicode's category of spaces.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def preview_line(text: Column) -> Column:
    """The first line that is more than spaces of any kind, without those around it; '' where there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def query_kind(query: Column) -> Column:
    """symbol for one qualified or cased identifier, else natural."""
    one = F.trim(query).rlike(r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9_]*)$")
    return F.when(one, "symbol").otherwise("natural")


def symbol_name(query: Column) -> Column:
    """What follows the last of the first separator that occurs, in the order :: \\ -> . ."""
    out = query
    for sep in (".", "->", "\\", "::"):
        out = F.when(query.contains(sep), F.substring_index(query, sep, -1)).otherwise(out)
    return out


#: Names of test files, and of directories that lower a result.
TEST_FILES = r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
TEST_DIRS = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIRS = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLE_DIRS = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
BARRELS = ("__init__.py", "package-info.java")


def path_penalty(path: Column) -> Column:
    """Product of the factors that apply to a path."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    rules = [
        (clean.rlike(TEST_FILES) | clean.rlike(TEST_DIRS), 0.3),
        (basename(clean).isin(*BARRELS), 0.5),
        (clean.rlike(COMPAT_DIRS), 0.3),
        (clean.rlike(EXAMPLE_DIRS), 0.3),
        (clean.endswith(".d.ts"), 0.7),
    ]
    out = F.lit(1.0)
    for holds, factor in rules:
        out = out * F.when(holds, factor).otherwise(1.0)
    return out


#: Multipliers of size units.
UNITS = {"": 1, "b": 1, "kib": 1024, "mib": 1024**2, "gib": 1024**3, "kb": 1000, "mb": 1000**2, "gb": 1000**3}


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 10, 4KB or 4 KiB; null for fractions, unknown units and more than 2 ** 62."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, "^([0-9]{1,19})[ ]*([a-z]*)$", 1).try_cast("decimal(38,0)")
    unit = F.regexp_extract(t, "^([0-9]{1,19})[ ]*([a-z]*)$", 2)
    scale = F.lit(None).cast("decimal(20,0)")
    for name, factor in UNITS.items():
        scale = F.when(unit == name, F.lit(factor).cast("decimal(20,0)")).otherwise(scale)
    value = (number * scale).cast("decimal(38,0)")
    return F.when(value <= 2**62, value.cast("long"))


def repo_key(source: Column) -> Column:
    """Normal form of an http(s) repository address, the path of a local one; null for other schemes and empty text."""
    t = F.trim(source)
    host = F.lower(F.regexp_extract(t, "^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/$", ""), "[.]git$", "")
    web = F.concat(F.lower(F.regexp_extract(t, "^([A-Za-z]+)://", 1)), F.lit("://"), host, path)
    return F.when(t.rlike("^(?i:https?)://"), web).when((t == "") | t.contains("://") | t.rlike("^[A-Za-z0-9._-]+@[A-Za-z0-9.-]+:.+"), None).otherwise(t)


def dsn_engine(dsn: Column) -> Column:
    """Database engine of a connection string; empty where none is known."""
    scheme = F.lower(F.regexp_extract(dsn, "^(.+?)://", 1))
    out = F.when(scheme.isin("postgres", "postgresql"), "postgres").when(scheme.isin("sqlite", "sqlite3"), "sqlite").when(scheme == "mysql", "mysql")
    return out.when(~dsn.contains("://") & (dsn.contains("@tcp(") | dsn.contains("@unix(")), "mysql").otherwise("")


#: Long type names and their short forms, applied in this order.
SHORT_TYPES = [
    ("character varying", "varchar"),
    ("character(", "char("),
    ("timestamp without time zone", "timestamp"),
    ("timestamp with time zone", "timestamptz"),
    ("time without time zone", "time"),
    ("time with time zone", "timetz"),
]


def type_shorthand(name: Column) -> Column:
    """Short display names of SQL types."""
    for long, short in SHORT_TYPES:
        name = F.replace(name, F.lit(long), F.lit(short))
    return name


def relative_time(now: Column, then: Column) -> Column:
    """How long ago, in the largest whole unit; dates of the future and of one to two years ago as they are."""
    s = (F.unix_micros(now) - F.unix_micros(then)) / 1_000_000
    ago = lambda seconds, unit: F.concat(F.floor(s / seconds).cast("string"), F.lit(f"{unit} ago"))
    day, date = 86400, F.date_format(then, "yyyy-MM-dd")
    return (
        F.when(s < 0, date).when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < day, ago(3600, "h")).when(s < 7 * day, ago(day, "d"))
        .when(s < 30 * day, ago(7 * day, "w")).when(s < 365 * day, ago(30 * day, "mo")).when(s < 730 * day, date).otherwise(ago(365 * day, "y"))
    )


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def quoted(name: Column) -> Column:
    """An identifier in double quotes."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
