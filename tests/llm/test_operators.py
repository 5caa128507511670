"""The training-data operators against plain versions, and their edge cases."""

import cProfile
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, langid, linededup, mixing, neardup, packing, pii, quality, registry, topk
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a" * 5000, "Zoë \U0001f600 naïve 日本", "x y z " * 3000, "the same line of more than ten words, said once and again\n" * 3]


def docs(spark, texts, extra=True):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", i, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score int")
    return df if extra else df.drop("n_words", "score")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    agree(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


# --- 1 ---------------------------------------------------------------------------------------------
def test_lm_base_and_learning(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zéta"]
    texts = [" ".join(rnd.choices(words, [9, 5, 3, 2, 1, 1], k=rnd.randint(0, 60))) for _ in range(200)] + ODD
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    out = {r.doc_id: r for r in mixing.score_texts(docs(spark, texts), held).collect()}
    tokens = {i: [*mixing.tokens_of(t), None] for i, t in enumerate(texts)}
    off = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i in tokens if not off[i] for w in tokens[i])
    total, kinds = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (off[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)
    assert mixing.score_texts(docs(spark, texts).limit(0), held).count() == 0


class PlainMixing:
    """The model bit by bit, with dictionaries."""

    def __init__(self, texts, mixer):
        self.mixer, self.counts = mixer, {}
        for text in texts:
            for token, contexts in self.places(text):
                for c, own in zip(token, contexts, strict=True):
                    for context in own:
                        at = self.counts.setdefault(context, {})
                        for j in range(mixing.START[c], mixing.START[c] + mixing.SIZE[c]):
                            at.setdefault(int(mixing.NODE[j]), [0, 0])[mixing.BIT[j]] += 1

    @staticmethod
    def places(text):
        before = b""
        for t in [*mixing.tokens_of(text), None]:
            token = mixing.END if t is None else t + b" "
            short = [[(k, (bytes(3) + token[:i])[-k:]) for k in (1, 2, 3)] for i in range(len(token))]
            long = [("before", before[-3:], token[:i]) if i < 2 else ("far", (bytes(mixing.LONG) + token[:i])[-mixing.LONG :]) if i > 2 else ("none",) for i in range(len(token))]
            yield token, [[*s, x] for s, x in zip(short, long, strict=True)]
            before = t

    def bits(self, c, i, contexts, delta):
        """(probability of the bit, sum of the short inputs, long input, was it a one) of each bit of byte ``c``."""
        for depth, j in enumerate(range(mixing.START[c], mixing.START[c] + mixing.SIZE[c])):
            n = [self.counts.get(x, {}).get(int(mixing.NODE[j]), [0, 0]) if x != ("none",) else [0, 0] for x in contexts]
            x = [max(-127, min(127, round(math.log((one + 0.3) / (zero + 0.3)) * 16))) / 16 for zero, one in n]
            gate = min(i, 3) * 3 + min((depth + 1) // 2, 2) + 12 * (x[3] != 0)
            z = sum(float(w) * v for w, v in zip(self.mixer.weights[gate], x, strict=True)) + delta[0] * sum(x[:3]) + delta[1] * x[3]
            z = max(-10, min(10, z))
            z += float(self.mixer.refine[gate * 17 + 8 + round(z * 0.8)])
            one = int(mixing.BIT[j])
            yield 1 / (1 + math.exp(-z if one else z)), sum(x[:3]), x[3], one

    def score(self, text):
        out, delta, seen = 0.0, [0.0, 0.0], []
        for n, (token, contexts) in enumerate(self.places(text)):
            if n and n % mixing.STEP == 0:
                for k in (0, 1):
                    delta[k] += 0.02 / math.sqrt(len(seen)) * sum(x[k] * (1 - p if one else p - 1) for p, *x, one in seen)
                seen = []
            for i, c in enumerate(token):
                own = list(self.bits(c, i, contexts[i], delta))
                seen += own
                out += sum(math.log(p) for p, *_ in own)
        return out


def mixer(seed):
    rnd = np.random.default_rng(seed)
    return mixing.Mixer(rnd.uniform(0.1, 0.5, (mixing.GATES, mixing.K)), rnd.uniform(-0.05, 0.05, mixing.GATES * mixing.CELLS))


def some_texts(n, words="alpha beta gamma delta Epsilon zéta al be gammas a".split()):
    rnd = random.Random(15)
    return [" ".join(rnd.choices(words, k=rnd.randint(0, 70))) for _ in range(n)] + [*ODD, "x" * 300 + " é"]


def test_lm_equals_a_plain_version():
    texts = some_texts(40)
    block, m = mixing.Block.of(texts), mixer(1)
    learned = np.arange(len(texts)) % 3 != 0
    n = block.counts(learned)[0]
    sent = {}
    for p, own in mixing.by_part(mixing.shard_of(block.pairs, 3)):
        size, alone, (values,) = mixing.predicted(block.pairs[own], [n[own]])
        sent[p] = mixing.coded(values, np.cumsum(size) - size, size, alone)
        assert (mixing.decoded(sent[p], block.pairs[own]) == values).all()
    got = mixing.score(block, mixing.Inputs(block, 3, sent), m)[0]
    plain = PlainMixing([t for t, ok in zip(texts, learned, strict=True) if ok], m)
    assert got == pytest.approx([plain.score(t) for t in texts], rel=1e-4)


def test_lm_tokens_of_a_block():
    """A block's tokens are those of ``tokens_of``, in all texts, also after they were packed."""
    spaces = "".join(map(chr, [*range(33), 0x7F, 0x85, 0xA0, 0x2003, 0x3000]))
    texts = [*ODD, *(f"{c}A{c}{c}b{c}" for c in spaces), spaces, "\ud800 É İ", "a b"]
    packed = mixing.Block.of(texts)
    for block in (packed, mixing.Block.unpacked(*packed.packed(), packed.sizes.tolist())):
        tokens = [bytes(block.bytes[a : a + n]) for a, n in zip(block.start, block.length, strict=True)]
        assert len(set(tokens)) == len(tokens) and tokens[0] == mixing.END
        ends = np.cumsum(block.sizes)
        assert [[tokens[k] for k in block.seq[z - n : z]] for z, n in zip(ends, block.sizes, strict=True)] == [[*(t + b" " for t in mixing.tokens_of(x)), mixing.END] for x in texts]
        of, at = block.hashes()
        assert len(of) == len(tokens)
        assert of[at].tolist() == [sum(int(mixing._term(np.array([k << 8 | c], np.uint64))[0]) for k, c in enumerate(t)) % 2**64 for t in tokens]


def test_lm_block_makes_no_calls_for_each_token():
    """F1 (round 4): a block is made by calls over all its tokens; some calls for each token took a third of its seconds."""
    texts = [" ".join(f"w{i * 7919 % 20011}x" for i in range(20000))] * 2
    profile = cProfile.Profile()
    block = profile.runcall(lambda: mixing.Block.of(texts))
    assert len(block.length) == 20001
    assert sum(x.callcount for x in profile.getstats()) < 2000
    profile = cProfile.Profile()
    profile.runcall(block.hashes)
    assert sum(x.callcount for x in profile.getstats()) < 200


def test_lm_scores_do_not_depend_on_who_goes_along(monkeypatch):
    """Texts scored a few at a time, and bits laid out a few bytes at a time, give the same doubles."""
    texts, m = some_texts(200), mixer(4)
    block = mixing.Block.of(texts)
    n = block.counts(np.arange(len(texts)) % 3 != 0)[0]
    size, alone, (values,) = mixing.predicted(block.pairs, [n])
    sent = {0: mixing.coded(values, np.cumsum(size) - size, size, alone)}
    want = mixing.score(block, mixing.Inputs(block, 1, sent), m)
    for lanes, laid in ((1, 1), (7, 100), (10**6, 10**6)):
        monkeypatch.setattr(mixing, "LANES", lanes)
        monkeypatch.setattr(mixing, "LAID", laid)
        got = mixing.score(block, mixing.Inputs(block, 1, sent), m)
        assert (got[0] == want[0]).all() and got[1] == want[1]


def test_lm_is_a_distribution():
    plain = PlainMixing(some_texts(40), mixer(2))
    for token, contexts in list(plain.places("alpha gammas zéta q"))[:4]:
        for i in range(len(token)):
            p = [math.prod(p for p, *_ in plain.bits(c, i, contexts[i], [0.1, -0.1])) for c in range(256)]
            assert sum(p) == pytest.approx(1)


def test_lm_bits_per_byte(spark):
    texts = some_texts(60)
    for r in mixing.score_texts(docs(spark, texts), F.col("doc_id") % 10 == 0).collect():
        size = sum(len(t) + 1 for t in mixing.tokens_of(texts[r.doc_id])) + 1
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size)


def test_lm_blocks_do_not_change_the_model(spark, monkeypatch):
    rnd = random.Random(16)
    texts = [" ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 50))) for _ in range(200)] + ODD
    held = F.col("doc_id") % 10 == 0
    monkeypatch.setattr(mixing, "_tuned", lambda *_: mixer(3).flat())
    one = {r.doc_id: (r.base_score, r.score) for r in mixing.score_texts(docs(spark, texts), held).collect()}
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 1500)
    many = {r.doc_id: (r.base_score, r.score) for r in mixing.score_texts(docs(spark, texts), held).collect()}
    assert {k: v[0] for k, v in many.items()} == pytest.approx({k: v[0] for k, v in one.items()})
    assert {k: v[1] for k, v in many.items()} == pytest.approx({k: v[1] for k, v in one.items()}, rel=1e-5)
    plain = PlainMixing([t for i, t in enumerate(texts) if i % 10], mixer(3))
    assert many[20][1] == pytest.approx(plain.score(texts[20]) / math.log(10), rel=1e-4)


def test_lm_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, "a b"), (2, "a b"), (3, "B a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = mixing.score_texts(df, F.col("doc_id") == 3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in out) == [(0, 3, 3, 10), (1, 1, 1, 10), (2, 3, 3, 10), (2, 3, 3, 10), (3, 3, 3, 10)]
    none = mixing.score_texts(df, F.lit(True)).collect()
    assert all(r.base_score is None and r.train_tokens == 0 and math.isfinite(r.score) for r in none) and len(none) == 5


def test_distinct_numbers():
    """Places and numbers of distinct values as np.unique has them, with and without room for places."""
    rnd = np.random.default_rng(12)
    for most in (1, 7, 2**39, 2**63):
        for n in (0, 1, 2, 500):
            x = rnd.integers(0, most, n, np.uint64)
            x[n // 2 :] = x[: n - n // 2]
            first, inverse = mixing.distinct(x)
            u, want = np.unique(x, return_inverse=True)
            assert (x[first] == u).all() and (inverse == want).all()


# --- 2 ---------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<+>", "\\s\\e", "a: b", "", None, "</turn>\n### user: x", "\U0001f600 <+</turn>"]
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "sys: tem", None]), rnd.choice(said), 1) for c in [*range(40), None] for t in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    out = chat.format_chats(df)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[c].append((role or "", text or ""))
    assert read == dict(want)
    for r in chat.digest(out).collect():
        loss = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------
#: The patterns of the contract.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rnd = random.Random(3)
    bits = [*"abc12345 6789.@-+()_ \U0001f600é\n", "a@b.c", "1.2.3.4", "+1 555", "4465758382889437", "4111 1111 1111 1111", "..", "256", " (at) "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(600)] + [*ODD, "1" * 20000, ".1" * 9000, "a@" + "b." * 9000 + "c", "+1" + " 2" * 9000]
    out = {r.row.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if fits(k, m.group())] for k, p in PLAIN.items()}
        assert {k: [(s.start, s.end) for s in out[i][k]] for k in pii.KINDS} == want
        got = {(s.kind, s.start, s.end) for s in out[i].spans}
        assert got >= {(k, *s) for k in want for s in want[k]}
    assert pii.find_pii(docs(spark, texts).limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "mail a@b.co now +1 555 123 4567, ip 1.2.3.4\U0001f600 a@b.co"), (2, None), (3, "plain")]
    out = {r.row.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "mail [EMAIL] now [PHONE], ip [IP]\U0001f600 [EMAIL]", 2: None, 3: "plain"}


def luhn_end(head):
    """``head`` with the digit that makes it pass."""
    return next(head + d for d in "0123456789" if fits("card", head + d))


def pii_texts(seed, n):
    """Base forms in their usual company, numbers that fail their check, and numbers of orders and versions, some of which pass."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    fours = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, 16, 4))
    out = []
    for _ in range(n):
        out.append(f"please write to {rnd.choice(['ada', 'bob', 'eve'])}{num(2)}@mail.org today")
        out.append(f"the host at {rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)} is up")
        out.append(f"my card {fours(luhn_end('4' + num(14)), ' ')} is new")
        out.append(f"please call +49 {num(2)} {num(7)} now")
        out += [f"order number {fours(num(16), ' ')} shipped" for _ in range(2)]
        out.append(f"release version {rnd.randint(300, 900)}.{rnd.randint(0, 99)}.{rnd.randint(0, 99)}.{rnd.randint(0, 9)} is out")
        out.append(f"write a{num(3)}@b_{num(2)}.c")
        out.append(f"the score +{num(2)} {num(20)} stands")
    return out


@pytest.mark.parametrize("seed,many", [(1, 1), (2, 30)])
def test_pii_wide_forms(spark, seed, many):
    """Wide forms in company of their kind are found, whatever their number; those that pass by chance in other company are not."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    slashed = lambda: "/".join(re.findall("....", luhn_end("4" + num(14))))
    kinds = {
        "email": lambda: ("please write to {} today", f"ada{num(2)} (at) mail (dot) org"),
        "ip": lambda: ("the host at {} is up", f"10[.]{rnd.randint(0, 255)}[.]0[.]{rnd.randint(0, 255)}"),
        "card": lambda: ("my card {} is new", slashed()),
        "phone": lambda: ("please call {} now", f"+49/{num(2)}/{num(7)}"),
    }
    planted = [(kind, *make()) for kind, make in kinds.items() for _ in range(many)]
    traps = [f"order number {slashed()} shipped" for _ in range(30)] + ["at 12:30:45 we met", "meet (at) home now (dot) then", "on 2024/01/15 10/20"]
    known = pii_texts(seed, 60)
    texts = known + [around.format(x) for _, around, x in planted] + traps
    out = {r.row.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    got = [[(s.kind, t[s.start : s.end]) for s in out[i].spans] for i, t in enumerate(texts)]
    assert got[len(known) : len(known) + len(planted)] == [[(kind, x)] for kind, _, x in planted]
    assert got[len(known) + len(planted) :] == [[]] * len(traps)
    assert all(len(out[i].spans) == sum(len(out[i][k]) for k in pii.KINDS) for i in range(len(known)))  # nothing more where all is plain


def test_pii_features_do_not_state_the_label(spark, monkeypatch):
    """Feature vectors carry both labels, and no feature changes when every check is turned round."""
    texts = pii_texts(3, 40)
    ask = lambda: [[(m.start, m.end, m.code, m.right) for k in pii.KINDS for m in r[k]] for r in docs(spark, texts).select(*[pii.proposals(F.col("text"), k).alias(k) for k in pii.KINDS]).collect()]
    first = ask()
    by_code = defaultdict(set)
    for row in first:
        for _, _, code, right in row:
            by_code[code].add(right)
    assert any(len(v) == 2 for v in by_code.values())
    monkeypatch.setattr(pii, "valid", lambda kind, s: F.length(s) < 0)
    assert [[m[:3] for m in row] for row in ask()] == [[m[:3] for m in row] for row in first]


def test_pii_thresholds_follow_a_monotone_share():
    trees = [(2, (3, -2.0, -1.0), (3, 1.0, 2.0))]  # scores -2, -1, 1, 2 by bits 2 and 3, of kind 0
    counts = [(0, 1, 9), (8, 60, 0), (4, 30, 2), (12, 200, 0)]
    assert pii.thresholds(trees, counts) == [2.0, math.inf, math.inf, math.inf]  # the 60 of score -1 join the 2 wrong above
    assert pii.thresholds(trees, [(0, 1, 9), (8, 60, 0), (4, 140, 2)])[0] == -1.0


def test_pii_of_a_text_with_many_matches(spark):
    n = 100_000
    text = "host 10.0.0.1 x " * n
    begun = time.time()
    (r,) = pii.redact(docs(spark, [text])).collect()
    assert r.text == "host [IP] x " * n
    assert time.time() - begun < 60


# --- 4 and 5 -----------------------------------------------------------------------------------------
def tokenizer(name):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path(name), Tokenizer.from_file(P.path(name))


def test_packing(spark):
    path, lib = tokenizer("word_bpe_49k.json")
    rnd = random.Random(4)
    texts = ["word Word, déjà x9 " * rnd.randint(0, 900) for _ in range(60)] + [*ODD, "<|endoftext|> a", " b c \x1c d"]
    rows = packing.pack(packing.tokenised(docs(spark, texts), path)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(by_doc[i]) == [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    for placed in by_seq.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 2
    assert packing.pack(packing.tokenised(docs(spark, texts).limit(0), path)).count() == 0


def test_fullest_is_the_best_subset():
    from itertools import product

    rnd = random.Random(6)
    for _ in range(60):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(1, 30)
        best = max(s for ks in product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * c for k, c in zip(ks, counts))) <= room)
        got = packing.fullest(counts, room)
        assert sum(x * n for x, n in got) == best and all(n <= counts[x] for x, n in got)


def test_plan_uses_every_piece():
    rnd = random.Random(7)
    hist = {rnd.randint(1, 100): rnd.randint(1, 40) for _ in range(30)}
    used = Counter()
    for n, parts in packing.plan(hist, 100):
        assert sum(x * k for x, k in parts) <= 100
        for x, k in parts:
            used[x] += n * k
    assert used == Counter(hist)


def test_bpe_equals_the_library(spark):
    path, lib = tokenizer("byte_bpe_50k.json")
    own = bpe.ByteBPE(path)
    rnd = random.Random(5)
    bits = [*"abcde  \n\t'stremv.,!01\x1c\x85\xa0 é日\U0001f600́", "'ll", "<|endoftext|>", "<|endo", "the ", " The"]
    for t in ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [t or "" for t in ODD]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    texts = [*ODD, "<|endoftext|>x"]
    out = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, texts).limit(0), path).count() == 0
    twice = bpe.round_trip(docs(spark, texts).unionAll(docs(spark, texts)), path)
    assert Counter(twice.collect()) == Counter({r: 2 for r in out.values()})
    back = bpe.decoded(bpe.encoded(docs(spark, texts), path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_keeps_frequent_words_when_its_memory_is_full(monkeypatch):
    path, lib = tokenizer("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own, merged = bpe.ByteBPE(path), Counter()
    monkeypatch.setattr(own, "merge", lambda piece, merge=own.merge: merged.update([piece]) or merge(piece))
    for k in range(300):
        text = f"New{k} the été, {'abcdefghij'[k % 10] * (k // 10 + 1)}.\nxy the"
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert merged[b" the"] == merged[" été".encode()] == merged[b"xy"] == 1
    assert merged[b" " + b"a" * 30] == 1


# --- 6 ---------------------------------------------------------------------------------------------
def test_topk_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([0.0, 0.1, -0.3, 0.25, rnd.uniform(-1, 1)]) for _ in range(rnd.choice([4, 6]))], 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, [None, 1.0], 1), (1002, [float("nan")], 1), (1003, [], 1), (None, [1.0], 1), (1004, [3e30, 1.0], 1), (1005, rows[0][1], 1), (1006, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(got) == {i for i in whole if i % 10 == 0}
    for q, found in got.items():
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_over_many_blocks(spark, monkeypatch):
    """Several shards and blocks of queries in each partition; repeated vectors tie by id."""
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rnd = random.Random(21)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(5)], 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows}
    for q in range(0, 400, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_topk_sends_no_queries_by_the_driver(spark, monkeypatch):
    """Queries reach every group of shards by a shuffle; the best of many groups and shards are merged."""
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "HELD", 2000, raising=False)
    rnd = random.Random(22)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0, rnd.uniform(-60, 60)]) for _ in range(rnd.choice([0, 3, 5]))]) for i in range(400)]
    rows += [(400, [1e6, -1e7]), (401, [1e12, 1.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    got = defaultdict(list)
    for r in out.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 401, 20):
        best = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


# --- 7 ---------------------------------------------------------------------------------------------
def test_language_id(spark):
    from pyspark.sql import Row

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([Row(doc_id=-1, text=None, lang="en"), Row(doc_id=-2, text="123 !", lang="en"), Row(doc_id=None, text="the", lang=None)], "doc_id long, text string, lang string")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    out = langid.identify(d.unionByName(odd), F.coalesce(learn, F.lit(True))).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in out if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (-1, -2)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd.limit(1), F.lit(False)).collect()} == {"und"}


def test_language_model_against_brute_force(spark):
    """Predictions are those of the nearest of all centroids, computed here from the same sample one by one."""
    rnd = random.Random(20)
    letters = {"a": "aeiou", "b": "bcdfg", "c": "xyzéü"}
    texts = [(i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(4)) for _ in range(rnd.randint(1, 30))), lang) for i, lang in enumerate("abc" * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    learn = F.col("doc_id") % 4 != 2
    out = {r.doc_id: r for r in langid.identify(df, learn).collect()}
    own = [(lang, langid.grams(t).astype(np.float32)) for i, t, lang in texts if i % 4 != 2]
    df_ = sum((c > 0).astype(int) for _, c in own)
    idf = (np.log((1 + len(own)) / (1 + df_)) + 1).astype(np.float32)
    vec = lambda c: (v := np.log1p(c) * idf) / np.linalg.norm(v)
    centres = []
    for lang in "abc":
        x = np.array([vec(c) for c in sorted((c for k, c in own if k == lang), key=lambda c: c.tobytes())])
        centres += [(lang, c) for c in langid.clusters(x)[0]]
    for i, t, _ in texts:
        score, lang = max((float(vec(langid.grams(t).astype(np.float32)) @ c), lang) for lang, c in centres)
        assert out[i].lang_pred == lang and out[i].score == pytest.approx(min(1, score), abs=1e-4)


def test_language_sample_is_bounded(spark, monkeypatch):
    """Repeated rows count once, and every one of many languages is learned."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 3)
    rows = [(1, "the same text", "en")] * 500 + [(k, f"text number {k}", "en") for k in range(2, 40)] + [(1000 + k, chr(0x4E00 + k) * 5, f"l{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid._labelled(df, F.lit(True)).collect())
    assert got["en"] == 3 and len(got) == 501
    out = langid.identify(df, F.lit(True)).filter("doc_id >= 1000").collect()
    assert len(out) == 500 and len({r.lang_pred for r in out}) > 300
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none, F.lit(True)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------
def plain_components(texts, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {x: lo if c == hi else c for x, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 40, 120]))]
        for _ in range(rnd.randint(1, 14)):  # chains: copies of copies drift apart
            texts.append(" ".join(base).title() if rnd.random() < 0.2 else " ".join(base))
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = word()
    out = {r.id: (r.n, r.comp) for r in neardup.linked(docs(spark, texts).withColumnRenamed("doc_id", "id"), k).collect()}
    assert out == plain_components(texts, k)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (3, None)], "id long, text string").withColumn("comp", F.lit("clash"))
    got = sorted(((r.id, r.comp) for r in neardup.linked(df, 2).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert neardup.linked(df.limit(0), 2).count() == 0


def test_pigeonhole_guarantee():
    rnd = np.random.default_rng(9)
    for _ in range(200):
        a = rnd.integers(0, 256, (1, neardup.PLACES)).astype(np.uint8)
        b = a.copy()
        at = rnd.choice(neardup.PLACES, neardup.DISTANCE, replace=False)
        b[0, at] += 1
        assert np.isin(neardup.keys(a)[0], neardup.keys(b)[0]).any()


def test_links_within_a_family():
    """Links join the same sets as all pairs do, each found once."""
    rnd = np.random.default_rng(17)

    def joined(n, pairs):
        comp = list(range(n))
        for a, b in pairs:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        return [[c == d for d in comp] for c in comp]

    for _ in range(150):
        base, sets = rnd.integers(0, 2**63, 60, np.uint64), []
        for _ in range(rnd.integers(2, 12)):
            x = base.copy()
            k = rnd.integers(0, 14)
            x[rnd.choice(60, k, replace=False)] = rnd.integers(0, 2**63, k, np.uint64)
            sets.append(np.unique(x if rnd.random() < 0.7 else rnd.integers(0, 2**63, rnd.integers(1, 50), np.uint64)))
        n = len(sets)
        asks, home = rnd.random(n) < 0.6, rnd.random(n) < 0.8
        both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))  # noqa: B023, E731
        alike = [(a, b) for a in range(n) for b in range(n) if a != b and asks[a] and home[b] and 100 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - both(a, b))]
        found = neardup.links_within(np.arange(n), asks, home, sets, 80)
        assert set(found) <= set(alike) and len(found) < n and joined(n, found) == joined(n, alike)


def test_large_families_are_dealt(spark, monkeypatch):
    """Families in slices and buckets that keep all give the same components."""
    rnd = random.Random(18)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    texts = []
    for _ in range(90):
        own = list(base)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(60)] = f"w{rnd.randrange(500)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(neardup, "SLICE", 700)
    monkeypatch.setattr(neardup, "SMALL", 2)
    out = {r.id: (r.n, r.comp) for r in neardup.linked(docs(spark, texts).withColumnRenamed("doc_id", "id"), 2).collect()}
    assert out == plain_components(texts, 2)


def test_word_hashes_take_little_memory():
    """However many distinct words a Python worker meets; forgotten words hash as before."""
    import sys

    first = neardup.shingles("a b c d e f", 5)
    for k in range(200):
        neardup.shingles(" ".join(f"word{k}x{j}" for j in range(1000)), 5)
    held = sys.getsizeof(neardup._HASHES) + sum(sys.getsizeof(w) + sys.getsizeof(h) for w, h in neardup._HASHES.items())
    assert held < 16_000_000
    assert (neardup.shingles("a b c d e f", 5) == first).all()


# --- 9 ---------------------------------------------------------------------------------------------
def test_patience():
    assert linededup.patience(list("abcde"), list("xbcye")) == [(1, 1), (2, 2), (4, 4)]
    assert linededup.patience([], list("ab")) == []
    rnd = random.Random(10)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        m = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_line_dedup(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, f"own three\n{long}\nend", 1), (1, f"{long}\nown one", 1), (2, f"own two\n\n {long} \ntail", 1), (4, None, 1), (5, "", 1), (None, long, 1), (6, long, 1), (6, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int").drop("gone")
    out = sorted(((r.row.doc_id, r.text) for r in linededup.dedup_lines(df).collect()), key=str)
    assert out == sorted([(1, f"{long}\nown one"), (2, "own two\n\ntail"), (3, "own three\nend"), (4, None), (5, ""), (None, long), (6, ""), (6, "")], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def plain_runs(x, least):
    """The least runs (first, end) with enough words, from each line on and back from each."""
    n = [len(line.split()) for line in x]
    ahead = {(a, next((b for b in range(a + 1, len(x) + 1) if sum(n[a:b]) >= least), None)) for a in range(len(x))}
    back = {(next((a for a in range(b - 1, -1, -1) if sum(n[a:b]) >= least), None), b) for b in range(1, len(x) + 1)}
    return {r for r in ahead | back if None not in r}


def plain_aligned(docs, least):
    """Places that go, by aligning each document with the first holder of each of its runs: docs are (id, lines)."""
    out = {}
    for k, x in docs:
        gone = out[k] = set()
        holders = set()
        for a, b in plain_runs(x, least):
            holders |= set([j for j, y in docs if j < k and any(y[i : i + b - a] == x[a:b] for i in range(len(y)))][:1])
        for j, y in docs:
            left = list(range(len(x))) if j in holders else []
            while left:
                runs, last = [], None
                for i, m in linededup.patience([x[p] for p in left], y):
                    if last == (left[i] - 1, m - 1):
                        runs[-1].append(left[i])
                    else:
                        runs.append([left[i]])
                    last = left[i], m
                found = {p for r in runs if sum(len(x[p].split()) for p in r) >= least for p in r}
                gone |= found
                left = [p for p in left if p not in found] if found else []
    return out


def test_line_dedup_meets_every_holder(spark):
    passage = [f"p{i} " * 6 + "end" for i in range(8)]
    rows = [(1, "\n".join(passage[::2])), (2, "\n".join(["own two", *passage])), (3, "\n".join(["own three", *passage, "tail"]))]
    out = {r.row.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # lines of the first document stand alone in the others; the second holds the whole passage
    assert out == {1: rows[0][1], 2: rows[1][1], 3: "own three\ntail"}


def test_line_dedup_plain(spark):
    rnd = random.Random(14)
    line = [" ".join(f"{c}{i}" for i in range(rnd.randint(1, 12))) for c in "abcdefg"]
    texts = [(k, [rnd.choice(line) for _ in range(rnd.randint(0, 14))]) for k in range(60)]
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in texts], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {r.row.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, gone in plain_aligned(texts, linededup.LEAST_WORDS).items():
        assert out[k] == "\n".join(s for i, s in enumerate(texts[k][1]) if i not in gone)


def test_alignment_decides(spark, monkeypatch):
    """A line that is aligned elsewhere than its neighbours stays; without alignments other lines go."""
    u, v, w = "u1 u2 u3", "v1 v2 v3 v4 v5 v6 v7", "w1 w2 w3 w4 w5"
    rows = [(1, f"{u}\n{u}\n{v}\n{w}"), (2, f"{u}\n{v}\n{w}"), (3, f"{w}\n{v}\n{u}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.row.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert run() == {1: rows[0][1], 2: u, 3: rows[2][1]}
    assert linededup.aligned(list("uvw"), list("uuvw"), [3, 7, 5], 10) == [(1, 3)]
    # all lines that any run of the holder has: what hashes of runs alone would say
    assert plain_runs([u, v, w], 10) == {(0, 2), (1, 3)}
    assert linededup.aligned([], ["a"], [], 10) == linededup.aligned(["a"], [], [20], 10) == []
    assert linededup.aligned(list("xpypz"), ["p"], [1, 12, 1, 12, 1], 10) == [(1, 2), (3, 4)]
    assert linededup.patience(list("xpypz"), list("qpqpq"))[0] == (1, 1)


def test_line_dedup_texts_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(12))
    rows = [(1, long), (6, f"own a\n{long}"), (6, f"{long}\nown b"), (6, "own c")]
    out = sorted(r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.row.doc_id == 6)
    assert out == ["own a", "own b", "own c"]


def test_line_dedup_repeats_and_order(spark):
    p = "\n".join(f"p{i} two three" for i in range(5))
    q = "\n".join(f"q{i} two three" for i in range(5))
    rows = [(1, f"{q}\n{p}"), (2, f"{p}\n{p}"), (3, f"{p}\n{p}\n{q}"), (4, f"own\n{p}\nend\n{q}")]
    out = {r.row.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "", 3: "", 4: "own\nend"}


# --- 10 --------------------------------------------------------------------------------------------
def plain_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_base(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["a", "b", "#c", "d|", "éé", "x\ny"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ODD
    out = {r.doc_id: r for r in quality.quality_stats(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = out[i], plain_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_stats(docs(spark, texts).limit(0)).count() == 0


def plain_mcd(x):
    """Squared distances of whole rows to their estimate, by numpy."""
    floor = np.diag(np.array(quality.FLOOR, float) ** 2)
    m = np.median(x, 0)
    a = np.maximum(1.4826 * np.median(abs(x - m), 0), quality.FLOOR)
    u = (x - m) / a
    cut = np.clip(u, -2, 2)
    starts = [np.eye(4), 4 * (u / np.maximum((u * u).sum(1, keepdims=True), 1e-12)).T @ u / len(x), cut.T @ cut / len(x)]
    found = []
    for k, c in enumerate(starts):
        centre, cov = m, c * np.outer(a, a) + floor
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            bins = np.floor(1000 * np.log1p(d))
            near = x[bins <= np.sort(bins)[-(-3 * len(x) // 4) - 1]]
            centre, cov = near.mean(0), np.cov(near.T, bias=True) * quality.CONSISTENT + floor
        found.append((round(np.linalg.slogdet(cov)[1], 4), k, centre, cov))
    _, _, centre, cov = min(found, key=lambda f: f[:2])
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def test_quality_equals_a_plain_estimate(spark):
    rnd = random.Random(19)
    word = lambda n: "".join(rnd.choice("etaoinsh") for _ in range(n))
    texts = []
    for i in range(400):
        words = [word(rnd.randint(1, 9)) for _ in range(50)]
        if i % 5 == 0:  # a fifth apart from the others, in two statistics together
            words = [w.upper() + "##" for w in words]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = sorted(quality.judge(df, ["doc_id"]).collect(), key=lambda r: r.row.doc_id)
    assert not any(r.base_failed for r in rows)
    d = plain_mcd(np.array([[r.x1, r.x2, r.x3, r.x4] for r in rows], float))
    assert [r.d2 for r in rows] == pytest.approx(d.tolist(), rel=1e-3, abs=1e-3)
    assert [r.kept for r in rows] == (d <= quality.CUTOFF).tolist() and 300 < sum(r.kept for r in rows) < 330


def test_quality_finds_outliers(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("etaoinsh") for _ in range(rnd.randint(2, 9)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    junk = [" ".join(word() + "***" for _ in range(60)) for _ in range(40)] + [" ".join(word().upper() for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(kept & set(range(300))) >= 298 and not kept & set(range(300, 380))
