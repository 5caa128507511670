"""Source divergence, suffix dedup and lexical search against plain versions, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import divergence, lexical, suffixdedup

ODD = [None, "", " ", "\n\n", "a", "a" * 5000, "Zoë \U0001f600 naïve 日本", "x y z " * 3000, "\0\1 mixed\0zero"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- 11 --------------------------------------------------------------------------------------------
def plain_divergence(rows, least, ranks):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    df, own, whole, out = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in rows:
        df[lang].update(set(terms))
        own[lang, source].update(terms)
        whole[lang].update(terms)
    for lang, source in own:
        kept = [t for t in df[lang] if df[lang][t] >= least]

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = share(own[lang, source]), share(whole[lang])
        pairs = []
        for lang2, other in own:
            if lang2 == lang and other != source:
                o = share(own[lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


@pytest.mark.parametrize(("held", "chunk"), [(1_000_000, 500_000), (40, 7)])
def test_divergence(spark, monkeypatch, held, chunk):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rnd = random.Random(4)
    words = [*"the The of and sea Ärger ärger über x1y no-way 日本 ſ".split(), "\U0001f600"]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for _ in range(120)]
    rows += [("fr", "only", "said once"), ("xx", "a", "one two"), ("xx", "b", None), ("", "", "the the")] + [("en", "odd", t) for t in ODD] * 2 + rows[:10]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n long, term int")
    got = sorted(tuple(r) for r in divergence.divergence(df, ranks=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 3, 5)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_passes_64_bits(spark):
    """Shares of counts beyond 9.2e9 are exact: the SQL adds them as wide numbers."""
    con = divergence._database()
    rows = "SELECT 'l' AS lang, s AS source, 't' AS term, CAST(n AS BIGINT) AS n, s = '' AS whole, CAST(5e12 AS BIGINT) AS total, CAST(10 AS BIGINT) AS kinds FROM (VALUES ('a', 40000000000), ('b', 0), ('', 40000000000)) v(s, n)"
    divergence._done(con, f"CREATE TABLE chunk AS {rows}")
    divergence._done(con, divergence.SHARES.format(unit=divergence.UNIT))
    assert divergence._done(con, "SELECT p FROM share WHERE source = 'a'")[0][0] == 1 + 10**9 * (40_000_000_001) // (5 * 10**12 + 10)


# --- 12 --------------------------------------------------------------------------------------------
def plain_repeats(rows):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((-1 if i is None else i, len(b), tuple(spans), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def repeats(df, **how):
    rows = suffixdedup.remove_repeats(df, **how).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("how", [{}, {"crowd": 2}, {"block_bytes": 2000}, {"block_bytes": 2000, "crowd": 3}])
def test_repeats(spark, how):
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(40, 200))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choices("xyz", k=rnd.randint(0, 60))), rnd.choice(passages)[rnd.randrange(20) :], "=" * rnd.randint(0, 150)]) for _ in range(rnd.randint(0, 6)))
        rows.append((rnd.choice([i, i, i, 5, None]), rnd.choice([t, t, None]) if i % 9 == 0 else t))
    rows += [(200 + i, t) for i, t in enumerate(ODD * 2)] + rows[-5:]
    df = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, block int, kept string")
    assert repeats(df, **how) == plain_repeats(rows)
    assert repeats(df.limit(0), **how) == []


@pytest.mark.parametrize("letters", [b"ab", bytes(range(256))])
def test_run_index(letters):
    rnd = random.Random(7)
    for _ in range(40):
        base = bytes(rnd.choices(letters, k=300))
        pieces = set()
        while len(pieces) < 40:
            a, n = rnd.randrange(200), rnd.randint(50, 80)
            p = bytearray(base[a : a + n])
            if rnd.random() < 0.5:
                p[rnd.randrange(n)] = rnd.choice(letters)
            pieces.add(bytes(p))
        pieces = sorted(pieces, key=lambda p: rnd.random())
        index = suffixdedup.RunIndex(pieces)
        suffixes = sorted((p[k:], j, k) for j, p in enumerate(pieces) for k in range(len(p) + 1))
        places = [int(index.starts_of[j]) + k for _, j, k in suffixes]
        assert index.located(np.arange(len(places))).tolist() == places  # all ranks from the samples
        before = [pieces[j][k - 1] + 1 if k else 0 for _, j, k in suffixes]
        assert len(index.heads) == 1 + sum(a != b for a, b in zip(before, before[1:], strict=False))
        holders = np.array([rnd.randrange(20) for _ in pieces])
        first = {}
        for p, h in zip(pieces, holders.tolist(), strict=True):
            for k in range(len(p) - 49):
                first[p[k : k + 50]] = min(h, first.get(p[k : k + 50], h))
        want = [sum(1 << k for k in range(len(p) - 49) if first[p[k : k + 50]] < h) for p, h in zip(pieces, holders.tolist(), strict=True)]
        assert suffixdedup.earlier(pieces, holders).tolist() == want


def test_every_window_meets_its_equals():
    """Equal windows have equal minimizers, whatever is around them and where slices end."""
    rnd = random.Random(1)
    data = np.frombuffer(bytes(rnd.choices(b"abc", k=5000)), np.uint8)
    whole = dict(zip(range(len(data) - 49), suffixdedup.minima(data).tolist(), strict=True))
    assert all(suffixdedup.minima(data[i : i + 50]).tolist() == [whole[i]] for i in range(0, 4950, 37))
    start, count, h, doc = suffixdedup.cut(data, np.array([0, 1000, 1020, 5000]))
    covered = [(i, m) for a, n, m in zip(start.tolist(), count.tolist(), h.tolist(), strict=True) for i in range(a, a + n)]
    assert covered == [(i, whole[i]) for i in range(4951) if i <= 950 or i >= 1020] and max(count) <= suffixdedup.WIDE


# --- 13 --------------------------------------------------------------------------------------------
def plain_search(docs, items, k):
    docs = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for i, t in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n, total, df, asked, out = len(docs), sum(x for _, _, x in docs), Counter(), defaultdict(set), []
    for _, c, _ in docs:
        df.update(c.keys())
    for i, t in items:
        asked[i].update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))
    for item, terms in asked.items():
        scores = []
        for i, c, size in docs:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1) if item is not None]
    return sorted(out)


@pytest.mark.parametrize(("shard", "batch"), [(4_000_000, 2_000_000), (300, 200)])
def test_lexical_search(spark, shard, batch):
    rnd = random.Random(9)
    words = [f"w{int(rnd.paretovariate(0.6)) % 90}" for _ in range(400)] + ["Ärger", "日本", "X-ray", "It's"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(150)]
    docs += docs[:20] + [(None, docs[3][1]), (3, "w1 w1 w2")] + [(300 + i, t) for i, t in enumerate(ODD)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for i in range(25)] + [(2, "w5"), (None, "w1"), (70, None), (71, "absent"), (72, "a X zero")]
    data = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    asked = spark.createDataFrame([(*d, 0) for d in items], "item_id long, text string, doc_id int")
    index = lexical.counted(data, shard)
    got = sorted(tuple(r) for r in lexical.search(index, asked, 10, batch).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items, 10)
    assert lexical.search(lexical.counted(data.limit(0)), asked).count() == 0 == lexical.search(index, asked.limit(0)).count()


def test_bounds_leave_documents_out(spark):
    """The first level decides: upper bounds hold, and few documents are scored exactly."""
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=60))) for i in range(1500)], "doc_id long, text string")
    row = lexical.counted(df.coalesce(1)).first().asDict()
    shard = lexical.Shard(row, row["n_docs"], row["n_terms"])
    exact = shard.impact(slice(0, len(shard.docs)))
    up = shard.level.astype(np.int64) * lexical.STEP
    assert (up >= exact).all() and (up - lexical.STEP < exact).all()
    docs, _ = shard.search([(w.encode(), 1000 + j) for j, w in enumerate(sorted(set(words))[:30])], 10, 1)
    assert 10 <= len(docs) < 150
