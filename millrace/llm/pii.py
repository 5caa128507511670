r"""Personal data by candidates and gradient boosting, with Spark expressions only.

Base spans are the leftmost non-overlapping matches of one pattern for each kind, less
those that fail their check; they always stay. High-recall generators propose further,
overlapping spans, of any length. A proposal is worth adding only if it is a valid base match once
it is written plainly (``PLAINLY``: (at) and (dot), brackets, separators of numbers). Whether
such a form is personal data or a number that passes by chance is left to boosted trees of
two levels over ten yes/no features of the format and of the text around it. No feature
states the check or anything that the check asks for, nor how the form was written.

The trees learn from proposals whose label is known without them: right are those that hold a
base span as they stand, wrong those that fail the check in plain form too. The wide forms
themselves have no label. Texts are split by their hash: three quarters grow the trees,
one quarter calibrates them. There, the shares of right proposals by score are made
monotone (pooled neighbours), and a kind's threshold is the lowest score whose share is at
least ``PRECISION``; a kind without right proposals there has no threshold and gains nothing.
Only counts of equal feature vectors leave Spark, at most 2 * 4 * 2 ** 10 of them.

Wide forms over their threshold that touch no base span and no better wide form are added.

The patterns are those of the contract with possessive quantifiers and guards that stop a
second try inside a run that has failed, so a match is the same and time is linear; places
come from sums by blocks (:func:`running`), texts are cut by blocks.

Defined results: null and empty texts have no spans; texts of any length are searched whole; positions count code points from 0,
ends exclusive; repeated rows are searched one by one; empty tables give empty results;
other columns are ignored by :func:`find_pii` and kept by :func:`redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators' patterns.
WIDE = {
    "email": r"(?<![\w.+-])[\w.+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\w-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:(?:[.:]|\x20?[\[(](?:\.|dot)[\])]\x20?)[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,}+",
    "phone": r"\(?\+\(?[0-9](?:[\x20()./-]{0,2}[0-9]){3,}+",
}
#: Words that announce a kind, and words that announce other numbers.
NEAR = {"email": "mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": "card|visa|credit|account", "phone": "phone|tel|call|mobil|fax"}
OTHER = {"email": "https?:|git|ssh", "ip": r"version|release|section|\bv$", "card": "order|serial|isbn|invoice|ref|number", "phone": "score|offset|delta|change"}
#: What is usual in each kind's plain form, apart from its check.
USUAL = {"email": r"\.[A-Za-z]{2,6}$", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*+))*+$", "card": r"^[0-9]{4}(?:[^0-9][0-9]{4})++", "phone": r"^\+[0-9]{1,3}[^0-9]"}
OCTET = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
#: How wide forms are written plainly, by replacements in this order.
PLAINLY = {
    "email": [(r"\x20?(?:\(at\)|\[at\]|@)\x20?", "@"), (r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?", ".")],
    "ip": [(r"\x20?[\[(](?:\.|dot)[\])]\x20?", ".")],
    "card": [(r"[\x20._/-]+", "-")],
    "phone": [(r"^\(?\+\(?", "+"), ("/", "-")],
}
FEATURES = 10
TREES, RATE, PRECISION = 40, 0.4, 0.98
#: One text in so many, by hash, calibrates.
FOLDS = 4
BLOCK = 128
SPAN = "array<struct<start:bigint,end:bigint>>"
FOUND = "array<struct<start:bigint,end:bigint,s:string,before:string,after:string>>"
PROPOSED = "array<struct<start:bigint,end:bigint,held:boolean,right:boolean,code:int>>"


def running(xs: Column, zero: Column, op) -> Column:
    """For each place of an array, ``op`` over all values before it: over whole blocks, then inside its own."""

    def before(values: Column, of: Column, start: Column) -> Column:
        return F.transform(of, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i), start, op))

    def by_blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        heads = lambda b: let(F.transform(b, lambda x: F.aggregate(x, zero, op)), lambda t: before(t, t, zero))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, heads(b), lambda x, head: before(x, x, head))))

    return let(xs, by_blocks)


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places and what stands around them: what splitting leaves gives the gaps between them."""
    none = F.array().cast(FOUND)

    def placed(gaps: Column, hits: Column) -> Column:
        pairs = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit"), F.get(gaps, i + 1).alias("next")))
        sums = lambda p: running(F.transform(p, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

        def one(x: Column, at: Column) -> Column:
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("s"), F.right(x["gap"], F.lit(24)).alias("before"), F.substring(x["next"], 1, 1).alias("after"))

        return let(pairs, lambda p: F.zip_with(p, sums(p), one))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, pattern), lambda gaps: placed(gaps, hits))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes; wrong for other strings."""
    each = F.transform(F.split(F.reverse(d), "(?!^)(?!$)"), lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike(OCTET))
    if kind == "card":
        return let(digits(s), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(s)).between(8, 15)
    return F.lit(True)


def held(kind: str, s: Column) -> Column:
    """Whether the first base match in a proposal is valid."""
    hit = F.regexp_extract(s, BASE[kind].replace(r"\G|", "^|"), 0)
    return F.coalesce((hit != "") & valid(kind, hit), F.lit(False))


def plain(kind: str, s: Column) -> Column:
    for wide, narrow in PLAINLY[kind]:
        s = F.regexp_replace(s, wide, narrow)
    return s


def base_spans(text: Column, kind: str) -> Column:
    worth = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    own = F.transform(F.filter(matches(text, BASE[kind]), lambda m: valid(kind, m["s"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(worth, own).otherwise(F.array().cast(SPAN))


def whole(kind: str, s: Column) -> Column:
    """Whether a text in plain form is one valid base match."""
    return (F.regexp_extract(s, BASE[kind].replace(r"\G|", "^|"), 0) == s) & valid(kind, s)


def features(kind: str, m: Column, s: Column) -> list[Column]:
    """Yes/no features of a proposal ``m`` with the plain form ``s``; none depends on the check."""
    before, near = m["before"], F.lower(m["before"])
    return [
        near.rlike(NEAR[kind]),
        near.rlike(OTHER[kind]),
        before.rlike(r"[\w.+@/#%-]$"),
        before.rlike(r"[:=(<\[\"']\x20?$"),
        before.rlike(r"(?:^|\n)\x20*$"),
        m["after"].rlike(r"[\w@/#%-]"),
        m["after"].rlike(r"[.,;:)>\]\"']"),
        s.rlike(USUAL[kind]),
        s.rlike(r"([0-9])\1\1\1") if kind != "email" else s.rlike("^[A-Za-z]+[._]?[A-Za-z]*@"),
        F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("[^0-9+]"), 0))) <= 1 if kind != "email" else s.rlike(r"@[A-Za-z-]+\.[A-Za-z]+$"),
    ]


def proposals(text: Column, kind: str) -> Column:
    """array<struct<start, end, held, right, code>>: held with a base match as it stands, right with one in plain form; code holds the features as bits above the kind's number."""

    def seen(m: Column) -> Column:
        def rated(s: Column) -> Column:
            code = F.lit(KINDS.index(kind))
            for k, bit in enumerate(features(kind, m, s)):
                code = code + F.when(bit, 4 << k).otherwise(0)
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), held(kind, m["s"]).alias("held"), F.coalesce(whole(kind, s), F.lit(False)).alias("right"), code.alias("code"))

        return let(plain(kind, m["s"]), rated)

    worth = {"email": text.rlike(r"@|at[)\]]"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(worth, F.transform(matches(text, WIDE[kind]), seen)).otherwise(F.array().cast(PROPOSED))


def grow(counts: list[tuple[int, int, int]]) -> list[tuple]:
    """Boosted trees on (code, right, wrong): (feature, (feature, leaf, leaf), (feature, leaf, leaf)); a leaf for clear, then for set bits."""
    bits = range(2 + FEATURES)
    score = {c: 0.0 for c, _, _ in counts}
    trees = []
    for _ in range(TREES if counts else 0):
        grad = {c: (r - (r + w) / (1 + math.exp(-score[c])), (r + w) * (p := 1 / (1 + math.exp(-score[c]))) * (1 - p)) for c, r, w in counts}

        def sums(codes: list[int]) -> tuple[float, float]:
            return sum(grad[c][0] for c in codes), sum(grad[c][1] for c in codes) + 1.0

        def best(codes: list[int]) -> tuple[float, int]:
            def gain(k: int) -> float:
                return sum(g * g / h for g, h in (sums([c for c in codes if c >> k & 1 == v]) for v in (0, 1)))

            return max((gain(k), -k) for k in bits)

        root = -best(list(score))[1]
        tree = [root]
        for side in (0, 1):
            codes = [c for c in score if c >> root & 1 == side]
            k = -best(codes)[1]
            leaves = [RATE * g / h for g, h in (sums([c for c in codes if c >> k & 1 == v]) for v in (0, 1))]
            tree.append((k, *leaves))
            for c in codes:
                score[c] += leaves[c >> k & 1]
        trees.append(tuple(tree))
    return trees


def total(trees: list[tuple], code: int) -> float:
    return sum(t[1 + (code >> t[0] & 1)][1 + (code >> t[1 + (code >> t[0] & 1)][0] & 1)] for t in trees)


def thresholds(trees: list[tuple], counts: list[tuple[int, int, int]]) -> list[float]:
    """For each kind the lowest score whose calibrated share of right proposals is high enough, or infinity."""
    out = []
    for kind in range(len(KINDS)):
        levels: dict[float, tuple[int, int]] = {}
        for c, r, w in counts:
            if c & 3 == kind:
                level = round(total(trees, c), 9)
                levels[level] = tuple(a + b for a, b in zip(levels.get(level, (0, 0)), (r, w), strict=True))
        pools: list[list] = []  # lowest score, right, wrong; shares rise
        for level, (r, w) in sorted(levels.items()):
            pools.append([level, r, w])
            while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
                _, r2, w2 = pools.pop()
                pools[-1][1] += r2
                pools[-1][2] += w2
        good = [level for level, r, w in pools if r and r >= PRECISION * (r + w)]
        out.append(min(good, default=math.inf))
    return out


def scored(trees: list[tuple], code: Column) -> Column:
    def bit(k: int) -> Column:
        return code.bitwiseAND(1 << k) != 0

    out = F.lit(0.0)
    for root, (a, a0, a1), (b, b0, b1) in trees:
        out = out + F.when(bit(root), F.when(bit(b), b1).otherwise(b0)).otherwise(F.when(bit(a), a1).otherwise(a0))
    return out


def apart(spans: Column, base: Column) -> Column:
    """The spans that touch none of ``base``: by place, no base span before them reaches them and none after them starts within."""
    tag = lambda own: lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m.alias("m"))
    as_span = lambda m: F.struct(m["start"].alias("start"), F.lit(False).alias("own"), F.struct(F.lit(0.0).alias("p"), m["start"].alias("start"), m["end"].alias("end"), F.lit(0).alias("code")).alias("m"))
    far = 2**62

    def placed(x: Column) -> Column:
        reach = running(F.transform(x, lambda e: F.when(e["own"], F.lit(-1)).otherwise(e["m"]["end"]).cast("long")), F.lit(-1).cast("long"), lambda a, v: F.greatest(a, v))
        back = F.reverse(F.transform(x, lambda e: F.when(e["own"], F.lit(far)).otherwise(e["start"]).cast("long")))
        ahead = F.reverse(running(back, F.lit(far).cast("long"), lambda a, v: F.least(a, v)))
        around = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
        rows = F.zip_with(x, around, lambda e, n: F.struct(e["own"].alias("own"), n["reach"].alias("reach"), n["ahead"].alias("ahead"), e["m"].alias("m")))
        return F.transform(F.filter(rows, lambda e: e["own"] & (e["reach"] <= e["m"]["start"]) & (e["ahead"] >= e["m"]["end"])), lambda e: e["m"])

    return let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(let(F.array_sort(F.concat(F.transform(base, as_span), F.transform(s, tag(True)))), placed)))


def runs(spans: Column) -> Column:
    """Spans with a start and an end, sorted, as arrays of spans that hang together."""

    def split(x: Column) -> Column:
        reach = running(F.transform(x, lambda m: m["end"]), F.lit(-1).cast("long"), lambda a, v: F.greatest(a, v))
        firsts = F.filter(F.zip_with(F.sequence(F.lit(1), F.size(x)), F.zip_with(x, reach, lambda m, r: m["start"] >= r), lambda i, new: F.when(new, i)), lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda at, k: F.slice(x, at, F.coalesce(F.get(f, k + 1), F.size(x) + 1) - at)))

    return let(spans, lambda x: F.when(F.size(x) == 0, F.array().cast(f"array<{FLAT}>")).otherwise(split(x)))


FLAT = "array<struct<start:bigint,end:bigint,p:double,code:int>>"


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows with the columns ``keep`` (all) as struct ``row``, base arrays email, ip, card, phone and ``spans`` array<struct<kind, start, end>>."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = given.select("row", *[base_spans(text, k).alias(k) for k in KINDS], F.concat(*[proposals(text, k) for k in KINDS]).alias("more"), (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("apart"))
    found = stored(found, "pii")
    m = F.col("m")
    labelled = found.select("apart", F.explode("more").alias("m")).filter(m["held"] | ~m["right"])
    counts = labelled.groupBy("apart", "m.code").agg(F.count_if(m["held"]).alias("right"), F.count_if(~m["held"]).alias("wrong"))
    seen = sorted((r.apart, r.code, r.right, r.wrong) for r in counts.collect())  # at most 2 * 4 * 2 ** FEATURES rows
    trees = grow([tuple(r) for held_out, *r in seen if not held_out])
    least = thresholds(trees, [tuple(r) for held_out, *r in seen if held_out])
    kind = lambda i: F.element_at(F.array(*[F.lit(k) for k in KINDS]), i + 1)
    numbered = lambda i: lambda m: F.struct(F.lit(i).alias("i"), m["start"].alias("start"), m["end"].alias("end"))
    base = F.concat(*[F.transform(k, numbered(i)) for i, k in enumerate(KINDS)])
    worth = F.filter("more", lambda m: ~m["held"] & m["right"])
    rated = F.transform(worth, lambda m: F.struct(scored(trees, m["code"]).alias("p"), m["start"].alias("start"), m["end"].alias("end"), m["code"].alias("code")))
    over = lambda m: F.element_at(F.array(*[F.lit(t - 1e-9) for t in least]), m["code"].bitwiseAND(3) + 1)
    new = apart(F.filter(rated, lambda m: m["p"] >= over(m)), base)
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["code"] < b["code"]))))
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    by_place = F.array_sort(F.transform(new, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["p"].alias("p"), m["code"].alias("code"))))
    lone = F.flatten(F.transform(runs(by_place), lambda n: F.filter(n, lambda m: ~F.exists(n, lambda o: better(o, m) & touch(o, m)))))
    added = F.transform(lone, lambda m: F.struct(m["code"].bitwiseAND(3).alias("i"), m["start"].alias("start"), m["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat(base, added)), lambda m: F.struct(kind(m["i"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return found.select("row", *KINDS, spans.alias("spans"))


def _joined(spans: Column, kind: Column | None = None) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", m["kind"] if kind is None else kind, m["start"], m["end"]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select(
        "row.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[_joined(F.col(k), F.lit(k)) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(_joined(F.col("spans")), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (.., text) with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    out = find_pii(docs)
    text = F.col("row.text")
    size = 4096

    def cut(blocks: Column, at: Column, end: Column) -> Column:
        """Characters from ``at`` to ``end``, read from the blocks that hold them."""
        first = F.floor(at / size).cast("int")
        held_by = F.slice(blocks, first + 1, F.greatest(F.floor((end - 1) / size).cast("int") - first + 1, F.lit(0)))
        part = lambda b, i: F.substring(b, (F.greatest(at - (first + i) * size, F.lit(0)) + 1).cast("int"), (F.least(end - (first + i) * size, F.lit(size)) - F.greatest(at - (first + i) * size, F.lit(0))).cast("int"))
        return F.array_join(F.transform(held_by, part), "")

    def replaced(blocks: Column) -> Column:
        def over(x: Column) -> Column:
            reach = running(F.transform(x, lambda m: m["end"]), F.lit(0).cast("long"), lambda a, v: F.greatest(a, v))
            marks = F.filter(F.zip_with(x, reach, lambda m, r: F.struct(r.alias("at"), m["start"].alias("start"), m["kind"].alias("kind"))), lambda m: m["start"] >= m["at"])
            pieces = F.transform(marks, lambda m: F.concat(cut(blocks, m["at"], m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
            return F.concat(F.array_join(pieces, ""), cut(blocks, F.array_max(F.transform(x, lambda m: m["end"])), F.length(text).cast("long")))

        return let(F.array_sort(F.transform("spans", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")))), over)

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0), replaced)
    return out.select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("text"))
