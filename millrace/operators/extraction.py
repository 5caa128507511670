"""Structure of source files: functions, classes, calls, imports, raises.

Python files are read exactly with ``ast``. For languages with braces a scanner takes comments
and strings out and follows the braces, so that a definition belongs to the type whose block it
is in, on whatever lines; for languages that close blocks with ``end`` indentation does so.
Patterns name the definitions, which is less exact than a grammar. Files over 64 KiB, and
Python files that do not parse, are left out.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 65536
FUNC = "struct<name:string,params:array<string>,return_type:string,is_method:boolean,enclosing_class:string,start_line:int,end_line:int>"
SCHEMA = f"path string, functions array<{FUNC}>, classes array<struct<name:string,methods:array<{FUNC}>,start_line:int,end_line:int>>, imports array<string>, call_refs array<struct<callee:string,receiver:string,line:int,enclosing_symbol:string>>, raises array<string>"
EXAMPLES = [
    ("a.py", "import os.path as p\nfrom x import y\nclass A:\n  def f(self, q):\n    raise ValueError(q)\ndef g(z):\n  return z.run(p.join(z))\n"),
    ("b.go", 'package b\nimport "net/http"\ntype S struct {}\nfunc (s *S) Run(x int) error { return http.Get(x) }\nfunc main() { Run() }\n'),
    ("c.ts", "import { a } from './a';\nexport class W {\n  draw(x) { this.paint(x); throw new Error('e'); }\n}\nfunction go() { a(); }\n"),
    ("d.rs", "use std::fmt;\npub struct P;\nimpl P { pub fn area(&self) -> f64 { sq(self.x) } }\n"),
    ("bad.py", "def ("),
]
#: Words that stand before a parenthesis and name nothing.
WORDS = set("if for while switch return catch func function fn def class sizeof typeof match when loop select defer super self this await async yield assert del not and or in is elif else try except with lambda throw throws using import package struct enum interface trait impl type let var const val unless until elsif case guard where raise".split())
#: Calls of each language's own names, which say nothing about a corpus.
BUILTINS = {
    lang: set(names.split())
    for lang, names in {
        "go": "append cap clear close complex copy delete imag len make max min new panic print println real recover string int int64 float64 byte rune bool error any",
        "rs": "Some None Ok Err vec println eprintln print eprint format panic assert assert_eq assert_ne debug_assert dbg write writeln todo unreachable matches",
        "py": "print len range str int float bool list dict set tuple isinstance issubclass type repr sorted enumerate zip map filter sum min max any all abs open getattr setattr hasattr super iter next vars id hash",
        "ts": "require parseInt parseFloat isNaN String Number Boolean Array Object Symbol Promise setTimeout setInterval clearTimeout clearInterval",
        "php": "isset empty unset array list echo print die exit count strlen is_null in_array",
        "rb": "puts print p require require_relative attr_accessor attr_reader attr_writer raise private public new loop lambda proc",
        "kt": "println print require check error listOf mapOf setOf arrayOf mutableListOf mutableMapOf lazy",
        "scala": "println print require assert Some List Map Seq Set Vector Array Option Left Right",
        "swift": "print fatalError precondition assert min max abs",
        "dart": "print assert identical",
        "ex": "raise is_nil is_list is_map is_binary is_atom length elem hd tl",
        "c": "printf fprintf sizeof malloc free memcpy memset strlen assert static_cast dynamic_cast reinterpret_cast const_cast",
    }.items()
}
#: Modifiers before a member, and what may stand between its parameters and its body.
MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|open|inline|external|late|const|export|default|readonly|get|set|suspend|fileprivate|mutating|lazy|implicit|partial|extern|unsafe)\s+)*"
MEMBER = rf"(?<![\w.>]){MODS}(?:<[^<>{{}}()]*>\s*)?(?:(?P<ret>[\w.]+(?:<[^(){{}};=]*>)?(?:\[\])*[?*&]*)\s+)?(?P<fn>~?\w+)\s*(?P<par>\([^(){{}};]*(?:\([^()]*\)[^(){{}};]*)*\))(?P<end>\s*(?:throws\s+[\w.,\s]+|const|noexcept|override|async\*?|where\s+[^{{}};]+)*)\s*(?=\{{|=>)"
AFTER = r"(?P<par>\([^(){}]*(?:\([^()]*\)[^(){}]*)*\))?(?:\s*(?:throws|rethrows|async))*\s*(?:(?:->|:)\s*(?P<end>[^{};=\n]+))?"
#: For each language with braces: functions, types, imports, throws.
LANGS = {
    "go": (r"\bfunc\s+(?:\([^()]*?\*?\b(?P<cls>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<fn>\w+)(?:\[[^\]]*\])?\s*(?P<par>\([^(){}]*(?:\([^()]*\)[^(){}]*)*\))\s*(?P<end>\([^()]*\)|[\w.*\[\]]+)?\s*(?=\{|\n|$)", r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b", None, None),
    "rs": (r"\bfn\s+(?P<fn>\w+)\s*(?:<[^(){}]*>)?\s*" + AFTER.replace("(?:->|:)", "->"), r"\b(?:struct|enum|trait|union)\s+(\w+)", r"\buse\s+([^;]+);", None),
    "java": (MEMBER, r"\b(?:class|interface|record|enum)\s+(\w+)", r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", r"\bthrow\s+new\s+(?:\w+\.)*(\w+)"),
    "ts": (rf"\bfunction\s*\*?\s*(?P<fn>\w+)\s*(?:<[^(){{}}]*>)?\s*{AFTER}|\b(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:(?P<apar>\([^(){{}}]*(?:\([^()]*\)[^(){{}}]*)*\))\s*(?::\s*[\w.<>\[\]| ]+)?|\w+)\s*=>|(?<![\w.)>])(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*(?P<m>[A-Za-z_$#]\w*)\s*(?:<[^(){{}}]*>)?(?P<mpar>\([^(){{}}]*(?:\([^()]*\)[^(){{}}]*)*\))\s*(?::\s*(?P<mend>[\w.<>\[\]|, ]+?)\s*)?(?=\{{)", r"\b(?:class|interface|enum)\s+(\w+)", None, r"\bthrow\s+new\s+(?:\w+\.)*(\w+)"),
    "php": (r"\bfunction\s+&?(?P<fn>\w+)\s*" + AFTER, r"\b(?:class|interface|trait|enum)\s+(\w+)", r"\buse\s+(?:function\s+|const\s+)?([\w\\]+(?:\{[^}]*\})?(?:\s+as\s+\w+)?)\s*;", r"\bthrow\s+new\s+\\?(?:\w+\\)*(\w+)"),
    "c": (MEMBER.replace(r"(?P<fn>~?\w+)", r"[*&\s]*(?:(?P<cls>\w+)::)?(?P<fn>~?\w+)"), r"\b(?:class|struct|union|enum(?:\s+class)?)\s+(\w+)\s*(?=[:{]|final)", None, r"\bthrow\s+(?:\w+::)*(\w+)"),
    "kt": (r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<fn>\w+)\s*" + AFTER, r"\b(?:class|interface|object)\s+(\w+)", r"\bimport\s+([\w.]+(?:\s+as\s+\w+)?)", r"\bthrow\s+(?:\w+\.)*(\w+)"),
    "cs": (MEMBER, r"\b(?:class|interface|struct|record|enum)\s+(\w+)", r"\busing\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", r"\bthrow\s+new\s+(?:\w+\.)*(\w+)"),
    "swift": (r"\bfunc\s+(?P<fn>\w+)\s*(?:<[^(){}]*>)?\s*" + AFTER, r"\b(?:class|struct|enum|protocol|actor)\s+(?!func\b|var\b)(\w+)", r"\bimport[ \t]+(?:\w+[ \t]+)?([\w.]+)", r"\bthrow\s+(?:\w+\.)*(\w+)"),
    "scala": (r"\bdef\s+(?P<fn>\w+)\s*(?:\[[^\]]*\])?\s*" + AFTER, r"\b(?:class|object|trait)\s+(\w+)", r"\bimport\s+([\w.]+(?:\{[^}]*\})?)", r"\bthrow\s+new\s+(?:\w+\.)*(\w+)"),
    "dart": (MEMBER, r"\b(?:class|mixin|enum)\s+(\w+)", None, r"\bthrow\s+(?:new\s+)?(\w+)"),
}
#: For languages that close blocks with end: functions, types, imports, throws.
ENDED = {
    "rb": (r"def\s+(?:self\.)?(?P<fn>\w+[?!=]?)\s*(?P<par>\([^()]*\))?", r"(?:class|module)\s+(?:\w+::)*(\w+)", None, r"\b(?:raise|fail)\s+(?:\w+::)*([A-Z]\w*)"),
    "ex": (r"defp?\s+(?P<fn>\w+[?!]?)\s*(?P<par>\([^()]*\))?", r"(?:defmodule|defprotocol)\s+(?:\w+\.)*(\w+)", r"^\s*(?:import|alias|require|use)\s+(?:\w+\.)*(\w+)", r"\b(?:raise|reraise)\s+(?:\w+\.)*([A-Z]\w*)"),
}
EXT = {"go": "go", "rs": "rs", "java": "java", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "rb": "rb", "php": "php", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "kt": "kt", "kts": "kt", "cs": "cs", "swift": "swift", "scala": "scala", "sc": "scala", "dart": "dart", "ex": "ex", "exs": "ex"}
CALL = re.compile(r"(?:([A-Za-z_][\w]*)\s*(?:\?\.|\.|::)\s*)?([A-Za-z_]\w*)\s*!?\s*\(")
#: Where -> asks for a member.
ARROW_CALL = re.compile(CALL.pattern.replace("::)", "::|\\??->)"))


def _function(name: str, line: int, end: int, cls: str = "", params: list[str] = (), returns: str = "") -> dict:
    return {"name": name, "params": list(params), "return_type": returns, "is_method": bool(cls), "enclosing_class": cls, "start_line": line, "end_line": end}


class _Python(ast.NodeVisitor):
    def __init__(self):
        self.functions, self.classes, self.imports, self.calls, self.raises = [], [], [], [], []
        self.stack: list[str] = []
        self.owner: dict | None = None

    def visit_ClassDef(self, node):
        own = {"name": node.name, "methods": [], "start_line": node.lineno, "end_line": node.end_lineno}
        self.classes.append(own)
        before, self.owner = self.owner, own
        self.generic_visit(node)
        self.owner = before

    def visit_FunctionDef(self, node):
        a = node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if x.arg not in ("self", "cls")]
        f = _function(node.name, node.lineno, node.end_lineno, self.owner["name"] if self.owner else "", params, ast.unparse(node.returns) if node.returns else "")
        self.functions.append(f)
        if self.owner:
            self.owner["methods"].append(f)
        self.stack.append(node.name)
        self.generic_visit(node)
        self.stack.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node):
        f = node.func
        if isinstance(f, ast.Attribute):
            self.calls.append({"callee": f.attr, "receiver": ast.unparse(f.value), "line": node.lineno, "enclosing_symbol": self.stack[-1] if self.stack else ""})
        elif isinstance(f, ast.Name) and f.id not in BUILTINS["py"]:
            self.calls.append({"callee": f.id, "receiver": "", "line": node.lineno, "enclosing_symbol": self.stack[-1] if self.stack else ""})
        self.generic_visit(node)

    def visit_Raise(self, node):
        x = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        name = x.attr if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else ""
        if name and name not in self.raises:
            self.raises.append(name)
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            name = a.asname or a.name.rpartition(".")[2]
            if name not in self.imports:
                self.imports.append(name)

    visit_ImportFrom = visit_Import


def extract(path: str, text: str) -> dict | None:
    """The structure of one file; None where it has no known language or does not parse."""
    ext = path.rpartition(".")[2].lower()
    if len(text.encode()) > LARGEST:
        return None
    if ext == "py":
        try:
            v = _Python()
            v.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return None
        return {"path": path, "functions": v.functions, "classes": v.classes, "imports": v.imports, "call_refs": v.calls, "raises": v.raises}
    if ext not in EXT:
        return None
    lang = EXT[ext]
    return (_ended if lang in ENDED else _braced)(path, text, lang)


def masked(text: str, lang: str) -> str:
    """The text with comments and the insides of strings as blanks; places and line ends stay."""
    quotes = r'"""[\s\S]*?"""|`(?:[^`\\]|\\.)*`|"(?:[^"\\\n]|\\.)*"' + ("" if lang == "rs" else r"|'(?:[^'\\\n]|\\.)*'") + (r"|'(?:[^'\\\n]|\\.[^'\n]*)'" if lang == "rs" else "")
    comments = r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*" + (r"|\#[^\n]*" if lang in ("php", "rb", "ex") else "")
    return re.sub(f"{comments}|{quotes}", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _leaves(spec: str) -> list[str]:
    """The names that an import binds: aliases or last components, also inside braces."""
    spec = spec.strip()
    if (m := re.match(r"([^{]*)\{(.*)\}\s*$", spec, re.S)) is not None:
        depth, at, inner = 0, 0, []
        for i, c in enumerate(m[2] + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                inner.append(m[2][at:i])
                at = i + 1
        base = re.split(r"::|[.\\/]", m[1].rstrip(":.\\ "))[-1]
        return [base if x == "self" else x for part in inner if part.strip() for x in _leaves(part.replace("=>", " as "))]
    alias = re.split(r"\s+as\s+", spec)
    name = re.split(r"::|[.\\/]", alias[-1].strip())[-1]
    return [name] if re.fullmatch(r"[\w$-]+", name) and name != "_" else []


def _imports(text: str, code: str, lang: str) -> list[str]:
    out: list[str] = []
    if lang == "go":
        for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]*))", text, re.M):
            for x in re.finditer(r'(?:([\w.]+)\s+)?"(?:[^"\n]*/)?([\w.-]+)"', m[1] or m[2] or ""):
                out += [x[1] if x[1] and x[1] not in ("_", ".") else x[2]]
    elif lang == "ts":
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s*as\s+(\w+)|\{([^}]*)\})?\s*from\b", code):
            out += [x for x in (m[1], m[2]) if x] + [y for x in (m[3] or "").split(",") if x.strip() for y in _leaves(re.sub(r"^\s*type\s+", "", x))]
        for m in re.finditer(r"\b(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\s*\(", code):
            out += [m[1]] if m[1] else [y for x in m[2].split(",") if x.strip() for y in _leaves(x.replace(":", " as "))]
    elif lang == "c":
        out += [m[1] for m in re.finditer(r'^\s*#\s*include\s+[<"](?:[^>"\n]*/)?([\w.]+)[>"]', text, re.M)]
    elif lang == "dart":
        out += [m[2] or m[1] for m in re.finditer(r"^\s*import\s+['\"](?:[^'\"\n]*[/:])?(\w+)(?:\.dart)?['\"](?:\s+as\s+(\w+))?", text, re.M)]
    elif (pattern := LANGS[lang][2]) is not None:
        for m in re.finditer(pattern, code):
            if lang != "php" or code.count("{", 0, m.start()) == code.count("}", 0, m.start()):
                out += _leaves(m[1])
    return list(dict.fromkeys(out))


def _params(spec: str | None, lang: str) -> list[str]:
    out = []
    for part in re.split(r",(?![^<\[({]*[>\])}])", (spec or "").strip()[1:-1]):
        part = re.sub(r"=.*$", "", part, flags=re.S).strip()
        if not part or part in ("self", "&self", "&mut self", "mut self", "void"):
            continue
        if lang in ("ts", "kt", "rs", "swift", "scala"):
            name = part.split(":")[0].split()[-1]
        else:
            words = re.findall(r"[\w$]+", part)
            name = words[0] if lang in ("go", "ex", "rb") else words[-1] if words else ""
        if (name := name.strip("&*.$?@! ")) and name not in ("self", "this"):
            out.append(name)
    return out


def _braced(path: str, text: str, lang: str) -> dict:
    code = masked(text, lang)
    fn, cls, _, thrown = (re.compile(p) if p else None for p in LANGS[lang])
    line_at = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(line_at, at)
    functions, classes, calls, spans = [], {}, [], []

    def type_of(name: str, at: int, end: int) -> dict:
        return classes.setdefault(name, {"name": name, "methods": [], "start_line": line(at), "end_line": line(max(end - 1, 0))})

    # definitions by place, then one walk over the braces that gives each its block
    found: dict[int, tuple[str, re.Match]] = {}
    for m in fn.finditer(code):
        g = m.groupdict()
        name = g.get("fn") or g.get("arrow") or g.get("m")
        if name and name not in WORDS and (g.get("ret") or "") not in ("return", "new", "else", "throw", "await", "case"):
            found[m.start()] = ("fn", m)
    for m in cls.finditer(code):
        found[m.start()] = ("cls", m)
    if lang == "rs":
        for m in re.finditer(r"\bimpl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?&?(?:\w+::)*(\w+)", code):
            found[m.start()] = ("impl", m)
    if lang == "swift":
        for m in re.finditer(r"\bextension\s+(\w+)", code):
            found[m.start()] = ("impl", m)
    ends, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    for at, (kind, m) in sorted(found.items()):
        stop = re.compile(r"[{;]").search(code, m.end())
        arrow = kind == "fn" and re.match(r"\s*=>?", code[m.end() : m.end() + 4]) is not None
        block = (stop.start(), ends.get(stop.start(), len(code))) if stop and stop[0] == "{" and not (arrow and "\n" in code[m.end() : stop.start()]) else None
        end = block[1] if block else (code.find("\n", m.end()) + 1 or len(code))
        if kind == "fn":
            g = m.groupdict()
            name = g.get("fn") or g.get("arrow") or g.get("m")
            inside = [x for x in spans if x[0] <= at < x[1]]
            if g.get("m") and not (inside and inside[-1][2] == "cls"):
                continue  # a call before a block, or a method of no type
            owner = g.get("cls") or next((x[3] for x in reversed(inside) if x[2] == "cls"), "")
            if any(x[2] == "fn" for x in inside) and (not inside or inside[-1][2] == "fn") and lang in ("java", "cs", "c", "dart"):
                continue  # these have no functions in functions: a call before a block
            returns = (g.get("ret") or g.get("end") or g.get("mend") or "").strip()
            f = _function(name, line(at + len(m[0]) - len(m[0].lstrip())), line(max(end - 1, 0)), owner, _params(g.get("par") or g.get("apar") or g.get("mpar"), lang), "" if returns.startswith(("throws", "const", "override", "noexcept", "async", "where")) else returns)
            functions.append(f)
            if owner:
                type_of(owner, at, end)["methods"].append(f)
            spans.append((at, end, "fn", name, m.end()))
        else:
            if kind == "cls":
                type_of(m[1], at, end)
            if block:
                spans.append((*block, "cls", m[1], m.end()))
    own = BUILTINS.get(lang, ())
    heads = [(at, m.end()) for at, (_, m) in found.items()]
    for c in (ARROW_CALL if lang in ("php", "c") else CALL).finditer(code):
        if c[2] in WORDS or c[2] in own or any(a <= c.start(2) < z for a, z in heads if a > c.start(2) - 4096):
            continue
        inner = [x for x in spans if x[2] == "fn" and x[4] <= c.start() < x[1]]
        receiver = "" if lang == "go" else c[1] or ""
        calls.append({"callee": c[2], "receiver": receiver, "line": line(c.start(2)), "enclosing_symbol": inner[-1][3] if inner else ""})
    raises = list(dict.fromkeys(m[1] for m in thrown.finditer(code))) if thrown else []
    return {"path": path, "functions": functions, "classes": list(classes.values()), "imports": _imports(text, code, lang), "call_refs": calls, "raises": raises}


def _ended(path: str, text: str, lang: str) -> dict:
    fn, cls, imp, thrown = (re.compile(p) if p else None for p in ENDED[lang])
    functions, classes, imports, calls, raises = [], {}, [], [], []
    open_: list[tuple[int, str, str, dict]] = []  # indent, kind, name, what it is
    for n, line in enumerate(masked(text, lang).split("\n"), 1):
        body = line.strip()
        if not body:
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()[3]["end_line"] = n if body.startswith("end") else n - 1
        m, c = fn.match(body), cls.match(body)
        if c:
            own = classes.setdefault(c[1], {"name": c[1], "methods": [], "start_line": n, "end_line": n})
            open_.append((indent, "cls", c[1], own))
        elif m:
            owner = next((x[2] for x in reversed(open_) if x[1] == "cls"), "")
            f = _function(m["fn"], n, n, owner, _params(m["par"], lang))
            functions.append(f)
            if owner:
                classes[owner]["methods"].append(f)
            open_.append((indent, "fn", m["fn"], f))
        symbol = next((x[2] for x in reversed(open_) if x[1] == "fn"), "")
        for x in CALL.finditer(body):
            if x[2] not in WORDS and x[2] not in BUILTINS[lang] and not (m and x.start(2) <= m.end("fn")):
                calls.append({"callee": x[2], "receiver": x[1] or "", "line": n, "enclosing_symbol": symbol})
        imports += [x[1] for x in imp.finditer(line)] if imp else []
        raises += [x[1] for x in thrown.finditer(body)]
    if lang == "rb":
        imports = [x[1] for x in re.finditer(r"^\s*require(?:_relative)?\s+['\"](?:[^'\"\n]*/)?(\w+)['\"]", text, re.M)]
    return {"path": path, "functions": functions, "classes": list(classes.values()), "imports": list(dict.fromkeys(imports)), "call_refs": calls, "raises": list(dict.fromkeys(raises))}


def extracted(files: DataFrame) -> DataFrame:
    """The structure (path, functions, classes, imports, call_refs, raises) of the files that have one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for p, t in zip(b.path, b.text, strict=True) if (x := extract(p, t or ""))]
            yield pd.DataFrame(rows, columns=["path", "functions", "classes", "imports", "call_refs", "raises"])

    return files.filter(F.octet_length("text") <= LARGEST).select("path", "text").mapInPandas(work, SCHEMA)
