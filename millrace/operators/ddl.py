"""Schema text: splitting and parsing DDL statements, and replaying migrations in order.

A file is a sequential scan and a migration folder an ordered fold, so both go to Python: files as
Arrow batches, folders as groups (a folder of migrations is small by nature).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = [
    ("db/V1__init.sql", "CREATE TABLE users (id BIGINT PRIMARY KEY, email TEXT NOT NULL, -- mail; of user\n name VARCHAR(20), CONSTRAINT uq UNIQUE (email));\nCREATE INDEX ix_email ON users (email);"),
    ("db/V2__more.sql", "ALTER TABLE users ADD COLUMN age INT DEFAULT 0; ALTER TABLE users RENAME COLUMN name TO full_name; /* x; /* nested */ */ CREATE VIEW v AS SELECT id FROM users"),
    ("db/V3__drop.sql", "ALTER TABLE users DROP COLUMN age, ALTER COLUMN email TYPE VARCHAR(99); ALTER TABLE users DROP CONSTRAINT uq; CREATE TABLE IF NOT EXISTS s.log (at TIMESTAMP, msg TEXT); ALTER TABLE users OWNER TO admin;"),
    ("other/schema.sql", "create table \"Odd Name\" (a int, b text default 'x;y'); $$ not ddl; $$; create unique index u1 on \"Odd Name\" (a, b);"),
]
IDENT = r'(?:"(?:[^"]|"")+"|`[^`]+`|[A-Za-z_][\w$]*)'
NAME = rf"({IDENT}(?:\s*\.\s*{IDENT})*)"
CONSTRAINT = re.compile(r"^(?:CONSTRAINT|PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK|EXCLUDE|KEY|INDEX)\b", re.I)
#: File names of migrations, the first that fits.
CLASSES = [("timestamp", r"^\d{14}_[\w.\-]+\.sql$"), ("versioned", r"^V\d+__[\w.\-]+\.sql$"), ("numbered", r"^\d+_[\w.\-]+\.sql$")]
#: Fixed value: lines of a view's body that are shown.
VIEW_LINES = 50
PLAIN = re.compile(r"[^-/'\"`$;()]+")
DOLLAR = re.compile(r"\$(?:[A-Za-z_]\w*)?\$")


def statements(text: str) -> list[str]:
    """Statements without comments; quotes, dollar quotes and nested comments hide semicolons; a tail without one counts."""
    out, buf, i, depth = [], [], 0, 0
    while i < len(text):
        if (m := PLAIN.match(text, i)) is not None:
            buf.append(m[0])
            i = m.end()
        elif text.startswith("--", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
            buf.append(" ")
        elif text.startswith("/*", i):
            level, i = 1, i + 2
            while level:
                m = re.compile(r"/\*|\*/").search(text, i)
                level, i = (level + (1 if m[0] == "/*" else -1), m.end()) if m else (0, len(text))
            buf.append(" ")
        elif text[i] in "'\"`":
            j = i + 1
            while j < len(text) and (text[j] != text[i] or text[j + 1 : j + 2] == text[i]):
                j += 2 if text[j] == text[i] else 1
            buf.append(text[i : j + 1])
            i = j + 1
        elif (m := DOLLAR.match(text, i)) is not None:
            j = text.find(m[0], i + len(m[0]))
            j = len(text) if j < 0 else j + len(m[0])
            buf.append(text[i:j])
            i = j
        elif text[i] == ";" and depth == 0:
            out.append("".join(buf))
            buf, i = [], i + 1
        else:
            depth = max(0, depth + {"(": 1, ")": -1}.get(text[i], 0))
            buf.append(text[i])
            i += 1
    out.append("".join(buf))
    return [s for x in out if (s := x.strip() if VIEW.match(x) else " ".join(x.split()))]


#: Views keep their lines.
VIEW = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:MATERIALIZED\s+)?VIEW\b", re.I)


def parts(body: str) -> list[str]:
    """The comma-separated parts at the outer level."""
    out, depth, at, quote = [], 0, 0, ""
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append(body[at:i])
            at = i + 1
    return [s for x in [*out, body[at:]] if (s := x.strip())]


def bare(name: str) -> str:
    return ".".join(p.strip().strip('"`') for p in re.split(r"\.(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", name))


def parse(statement: str) -> tuple[str, str, dict] | None:
    """(kind, name, details) of a table, index, view or alter statement."""
    if m := re.match(rf"CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)[^)]*$", statement, re.I | re.S):
        cols, rules = [], []
        for p in parts(m[2]):
            if CONSTRAINT.match(p):
                rules.append(p)
            elif c := re.match(rf"({IDENT})\s*(.*)$", p, re.S):
                cols.append([bare(c[1]), c[2]])
        return "table", bare(m[1]), {"columns": cols, "constraints": rules}
    if m := re.match(rf"CREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+ON\s+(?:ONLY\s+)?{NAME}\s*(.*)$", statement, re.I | re.S):
        return "index", bare(m[2]), {"table": bare(m[3]), "rest": m[4], "unique": bool(m[1])}
    if m := re.match(rf"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*(?:\([^)]*\))?\s+AS\s+(.*)$", statement, re.I | re.S):
        lines = m[2].split("\n")
        return "view", bare(m[1]), {"body": "\n".join([*lines[:VIEW_LINES], *(["..."] if len(lines) > VIEW_LINES else [])])}
    if m := re.match(rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{NAME}\s+(.*)$", statement, re.I | re.S):
        return "alter", bare(m[1]), {"action": m[2]}
    return None


def render(kind: str, name: str, d: dict, indexes: list[tuple[str, dict]] = ()) -> str:
    if kind == "table":
        lines = [f"TABLE {name}", *(f"  {c} {rest}".rstrip() for c, rest in d["columns"]), *(f"  {r}" for r in d["constraints"])]
        return "\n".join([*lines, *(f"  {'UNIQUE ' * x['unique']}INDEX {n} {x['rest']}" for n, x in indexes)])
    if kind == "index":
        return f"{'UNIQUE ' * d['unique']}INDEX {name} ON {d['table']} {d['rest']}"
    return f"VIEW {name} AS {d['body']}" if kind == "view" else f"ALTER TABLE {name} {d['action']}"


def rendered(items: list[tuple[str, str, dict]]) -> list[tuple[str, str, str]]:
    """(kind, name, text): tables with their indexes, then indexes of other tables, views, alters."""
    tables = {n.lower() for k, n, _ in items if k == "table"}
    by_table: dict[str, list] = {}
    for k, n, d in items:
        if k == "index" and d["table"].lower() in tables:
            by_table.setdefault(d["table"].lower(), []).append((n, d))
    out = [(k, n, render(k, n, d, by_table.get(n.lower(), []))) for k, n, d in items if k == "table"]
    out += [(k, n, render(k, n, d)) for k, n, d in items if k == "index" and d["table"].lower() not in tables]
    return out + [(k, n, render(k, n, d)) for want in ("view", "alter") for k, n, d in items if k == want]


def parsed(files: DataFrame) -> DataFrame:
    """(path, seq, kind, name, body) of each schema object of each file."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b.path, b.text, strict=True):
                items = [x for s in statements(text or "") if (x := parse(s))]
                rows += [(path, i, *r) for i, r in enumerate(rendered(items))]
            yield pd.DataFrame(rows, columns=["path", "seq", "kind", "name", "body"])

    wanted = files.filter(F.lower("path").rlike(r"\.(sql|ddl)$")).select("path", "text")
    return wanted.mapInPandas(work, "path string, seq int, kind string, name string, body string")


def _class_of(base):
    out = None
    for name, pattern in CLASSES:
        cond = base.rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def migration_dirs(files: DataFrame) -> DataFrame:
    """(dir, class, n) of folders with two or more files of one naming scheme."""
    x = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), _class_of(F.regexp_extract("path", "[^/]*$", 0)).alias("class"))
    return x.filter("class IS NOT NULL").groupBy("dir", "class").agg(F.count("*").alias("n")).filter("n >= 2")


def _renamed(text: str, old: str, new: str) -> str:
    """A rule or an index's columns with one name for another, outside of quoted strings."""
    word = rf"[\"`]{re.escape(old)}[\"`]|(?<![\w$.'\"`]){re.escape(old)}(?![\w$(\"`])"
    return re.sub(rf"('(?:[^']|'')*')|{word}", lambda m: m[1] or new, text, flags=re.I)


def apply_action(table: dict, action: str, indexes: list[dict] = ()) -> bool:
    """Apply one ALTER TABLE action to a table and its indexes; False where it is none that a schema shows, or what it names is not there."""
    cols = table["columns"]
    at = {c.lower(): i for i, (c, _) in enumerate(cols)}
    if m := re.match(rf"ADD\s+(?:COLUMN\s+)(?:IF\s+NOT\s+EXISTS\s+)?({IDENT})\s+(.*)$", action, re.I | re.S):
        if bare(m[1]).lower() not in at:
            cols.append([bare(m[1]), m[2]])
    elif m := re.match(r"ADD\s+(.*)$", action, re.I | re.S):
        if CONSTRAINT.match(m[1]):
            table["constraints"].append(m[1])
        elif c := re.match(rf"({IDENT})\s+(.*)$", m[1], re.S):
            cols.append([bare(c[1]), c[2]])
    elif m := re.match(rf"DROP\s+CONSTRAINT\s+(IF\s+EXISTS\s+)?({IDENT})", action, re.I):
        kept = [r for r in table["constraints"] if not re.match(rf"CONSTRAINT\s+[\"`]?{re.escape(bare(m[2]))}[\"`]?(?!\w)", r, re.I)]
        if len(kept) == len(table["constraints"]) and not m[1]:
            return False
        table["constraints"] = kept
    elif m := re.match(rf"DROP\s+(?:COLUMN\s+)?(IF\s+EXISTS\s+)?({IDENT})", action, re.I):
        if bare(m[2]).lower() not in at and not m[1]:
            return False
        table["columns"] = [c for c in cols if c[0].lower() != bare(m[2]).lower()]
    elif m := re.match(rf"ALTER\s+(?:COLUMN\s+)?({IDENT})\s+(?:SET\s+DATA\s+)?TYPE\s+(.*)$", action, re.I | re.S):
        if (i := at.get(bare(m[1]).lower())) is None:
            return False
        # what follows the type (keys, defaults) stays
        rest = re.search(r"\b(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|GENERATED|COLLATE)\b.*$", cols[i][1], re.I | re.S)
        cols[i][1] = " ".join([re.sub(r"\s+USING\b.*$", "", m[2], flags=re.I | re.S), *([rest[0]] if rest else [])])
    elif m := re.match(rf"ALTER\s+(?:COLUMN\s+)?({IDENT})\s+(SET|DROP)\s+(NOT\s+NULL|DEFAULT)\s*(.*)$", action, re.I | re.S):
        if (i := at.get(bare(m[1]).lower())) is None:
            return False
        gone = r"\s*\bNOT\s+NULL\b" if m[3].upper().startswith("NOT") else r"\s*\bDEFAULT\s+(?:'(?:[^']|'')*'|\S+?\([^)]*\)|\S+)"
        cols[i][1] = re.sub(gone, "", cols[i][1], flags=re.I)
        if m[2].upper() == "SET":
            cols[i][1] += " NOT NULL" if m[3].upper().startswith("NOT") else f" DEFAULT {m[4]}"
    elif m := re.match(rf"RENAME\s+CONSTRAINT\s+({IDENT})\s+TO\s+({IDENT})", action, re.I):
        table["constraints"] = [re.sub(rf"^(CONSTRAINT\s+)[\"`]?{re.escape(bare(m[1]))}[\"`]?", rf"\g<1>{bare(m[2])}", r, flags=re.I) for r in table["constraints"]]
    elif m := re.match(rf"RENAME\s+(?:COLUMN\s+)?({IDENT})\s+TO\s+({IDENT})", action, re.I):
        if (i := at.get(bare(m[1]).lower())) is None:
            return False
        old, new = cols[i][0], bare(m[2])
        cols[i][0] = new
        table["constraints"] = [_renamed(r, old, new) for r in table["constraints"]]
        for x in indexes:
            x["rest"] = _renamed(x["rest"], old, new)
    else:
        return False
    return True


def replay(files: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Fold files (path, text) in lexical order; what can't be folded stays as an alter entry."""
    tables, rest, left = {}, [], []
    for _, text in sorted(files):
        for s in statements(text or ""):
            got = parse(s)
            if not got:
                continue
            kind, name, d = got
            if kind == "table":
                tables.setdefault(name.lower(), (name, d))
            elif kind != "alter":
                rest.append(got)
            elif name.lower() not in tables:
                left.append(got)
            else:
                own = [x for k, _, x in rest if k == "index" and x["table"].lower() == name.lower()]
                for a in parts(d["action"]):
                    if not apply_action(tables[name.lower()][1], a, own):
                        left.append((kind, name, {"action": a}))
    return rendered([*(("table", n, d) for n, d in tables.values()), *rest, *left])


def folded(files: DataFrame) -> DataFrame:
    """(dir, seq, kind, name, body): the schema after each migration folder's files."""
    x = files.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("class", _class_of(F.regexp_extract("path", "[^/]*$", 0)))
    most = migration_dirs(files).groupBy("dir").agg(F.max_by("class", F.struct("n", "class")).alias("class"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["dir"].iloc[0], i, *r) for i, r in enumerate(replay(list(zip(pdf.path, pdf.text, strict=True))))]
        return pd.DataFrame(rows, columns=["dir", "seq", "kind", "name", "body"])

    return x.join(most, ["dir", "class"]).select("dir", "path", "text").groupBy("dir").applyInPandas(fold, "dir string, seq int, kind string, name string, body string")
