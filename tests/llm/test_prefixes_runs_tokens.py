"""Conversation tries, periodic runs and BPE against plain versions, and with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import bpe, periodic, trie
from corridor.llm import queries as llm

TALKS = "conv_id long, turn int, role string, text string"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here no id"), (5, "same row twice"), (5, "same row twice"), (6, "long " * 30_000), (7, "été über ñandú 日本語 " * 12), (8, "x" * 150_000)]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], DOCS + ", n int, ids string, row int").repartition(3)


# conversation tries


def _plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    node, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(int)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        s = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            node[tuple(s[:d])].append(c)
    leaves, saved = collections.defaultdict(int), collections.defaultdict(int)
    for p in sorted(node, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(node[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(((min(v), len(p), min(node[p[:-1]]) if p else None, len(v), kids[p], leaves[p], saved[p], sha(ends[p])) for p, v in node.items()), key=str)


def test_trie_of_the_given_conversations(spark, sf):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = tuples(trie.prefix_trie(trie.rebuilt(talks)))
    assert got == _plain_trie(talks.select("conv_id", "turn", "role", "text").collect()) and len(got) > 300


def test_trie_of_odd_conversations(spark, monkeypatch):
    """Null and tied turns, repeated rows, a null id, negative ids, one conversation inside another, copies, deep stretches, no own turns, clashing names."""
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 4)
    monkeypatch.setattr(trie, "HOT", 3)
    r = random.Random(7)
    rows = [(None, 0, "user", "lost"), (100, None, "user", "first"), (100, 1, None, None), (100, 1, None, None), (100, 1, "b", "é日"), (107, 5, "x", "own"), (-3, 0, "user", "below"), (207, 0, "u", "base is absent")]
    rows += [(c, k, "user", f"t{k}") for c in (300, 301, 302, 350) for k in range(40 + (c % 3) * 25)]
    rows += [(c, k, r.choice("ab"), r.choice("xy")) for c in range(400, 520) for k in range(r.randint(1, 6))]
    rows += [(600 + c, k, "user", "copy") for c in range(99) for k in range(3)]
    talks = spark.createDataFrame(rows, TALKS).withColumns({"depth": F.lit("own"), "keys": F.lit(1), "n": F.lit(2)}).repartition(5)
    got = tuples(trie.prefix_trie(trie.rebuilt(talks)))
    assert got == _plain_trie(rows) and any(x[1] > 80 for x in got) and any(x[3] >= 99 for x in got)
    assert trie.prefix_trie(trie.rebuilt(talks.limit(0))).count() == 0


def test_a_single_conversation_is_one_strand(spark):
    rows = [(5, k, "user", "x" * k) for k in range(9)]
    assert tuples(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TALKS)))) == _plain_trie(rows)


# periodic runs


def _plain_runs(w):
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i - p, j - 1), p)
            i = max(j, i + 1)
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def _woven(r):
    letters = [bytes([97 + k]) for k in range(r.choice([1, 2, 3, 5]))]
    w, n = [], r.randint(0, 220)
    while len(w) < n:
        kind = r.random()
        if kind < 0.5:
            u = [r.choice(letters) for _ in range(r.randint(1, 25))]
            w += u * r.randint(1, 12) + u[: r.randint(0, len(u))]
        elif kind < 0.7:
            w.append(b"x%d" % r.randint(0, 1))
        elif kind < 0.85 and w:
            a = r.randrange(len(w))
            w += w[a : a + r.randint(1, 80)]
        else:
            w += [r.choice(letters) for _ in range(r.randint(1, 10))]
    return w[:n]


@pytest.mark.parametrize("many", [0, 48])
def test_runs_against_every_lag(monkeypatch, many):
    monkeypatch.setattr(periodic, "MANY", many)
    r, n = random.Random(11), 0
    for _ in range(1500):
        w = _woven(r)
        got = periodic.runs_of(w)
        assert got == _plain_runs(w)
        n += len(got)
    assert n > 1000


def test_runs_of_long_and_repeating_texts():
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of([b"w%d" % (k % 301) for k in range(60_000)]) == [(0, 60_000, 301)]
    blocks = [w for k in range(60) for w in [b"a"] * 50 + [b"s%d" % k]]
    assert periodic.runs_of(blocks) == [(51 * k, 50, 1) for k in range(60)]


@pytest.mark.parametrize("many", [0, 48])
def test_runs_do_not_hang_on_the_hash(monkeypatch, many):
    """Windows and words that only share a hash are told apart."""
    hashed = periodic._window_codes
    monkeypatch.setattr(periodic, "_window_codes", lambda words: hashed(words) % np.uint64(3))
    monkeypatch.setattr(periodic, "MANY", many)
    r = random.Random(3)
    for _ in range(200):
        w = _woven(r)
        assert periodic.runs_of(w) == _plain_runs(w)


def test_run_query_against_plain_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in llm.op12_periodic_runs(spark, sf).collect()}
    n = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, size = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and w:
            g = h // 10
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        runs = _plain_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        n += len(runs)
    assert n > 10 and len(got) == docs.count()


def test_runs_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["n_words"]): r for r in periodic.find_runs(odd, periodic.repeat_some).collect()}
    assert got[1, 0]["runs"] == [] and got[1, 0]["collapsed"] == "" and (2, 0) in got and (3, 0) in got and (None, 5) in got
    assert [tuple(x) for x in got[6, 30_000]["runs"]] == [(0, 30_000, 1)] and got[6, 30_000]["collapsed"] == "long"
    assert periodic.find_runs(odd).count() == len(ODD) and periodic.find_runs(odd.limit(0)).count() == 0


# BPE

TEXTS = ["etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "aaab", "<|endoftext|>'s", "日本語é́ñÅ", "!?.,-_=+", "0123 abc", "İıſßΣς", "ȩ́  \x85\x1c\x1f a‍", "<|>'sStTreRE'LL'dm", "".join(map(chr, range(33, 127))), "".join(map(chr, range(0xA1, 0x250)))]


def _mixed(r):
    t = "".join("".join(r.choices(r.choice(TEXTS), k=r.randint(1, 60))) for _ in range(r.randint(1, 8)))
    return t + r.choice(["", "<|endoftext|>", "<|startoftext|>" + t[:20]])


def test_bpe_of_cut_texts_is_that_of_the_library(spark, path):
    """Texts of all kinds, cut into parts of one symbol and more, and joined again; decoding too."""
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(path), random.Random(3)
    texts = [_mixed(r) for _ in range(400)] + [x or "" for _, x in ODD] + ["etaoinshrdlu" * 3000, "".join(r.choices("etaoinshrdlu", k=20_000))]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    for part in (1, 7, 1000):
        some = docs if part > 1 else docs.where("length(text) < 600")
        got = {x["doc_id"]: x for x in bpe.decode(bpe.encode(some, path, part), path).collect()}
        assert len(got) == some.count() >= 400
        for k, x in got.items():
            assert x["ids"] == want[k], (part, texts[k][:200])
            assert x["text"] == t.decode(want[k], skip_special_tokens=False)


def test_seams_grow_until_both_sides_agree(path, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 1)
    v, r = bpe.Vocabulary(path), random.Random(5)
    for _ in range(3000):
        w = "".join(r.choices(r.choice(["etaoinshrdlu", "ab", "a", "theinganre"]), k=r.randint(2, 80)))
        cut = r.randrange(1, len(w))
        left, right = (np.array([t.id for t in m.tokenize(x)], np.int32) for m, x in ((v.open, w[:cut]), (v.whole, w[cut:])))
        assert v.seam(left, right).tolist() == [t.id for t in v.whole.tokenize(w)]


def test_bpe_of_odd_rows(spark, odd, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = bpe.encode(odd, path).collect()
    want = [(k, t.encode(x or "", add_special_tokens=False).ids) for k, x in ODD]
    assert sorted(map(str, [(r["doc_id"], r["ids"]) for r in got])) == sorted(map(str, want))
    assert bpe.decode(bpe.encode(odd.limit(0), path), path).count() == 0
    given = spark.createDataFrame([(1, None), (2, []), (3, [320, 99_999_999, -1, 49407])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(given, path).collect()} == {1: "", 2: "", 3: t.decode([320, 49407], skip_special_tokens=False)}


def test_bpe_query_against_the_library(spark, sf, path):
    from tokenizers import Tokenizer

    t, sha = Tokenizer.from_file(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: r for r in llm.op13_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for (doc_id, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True):
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False)))
    assert len(got) == len(docs)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs"])
def test_queries_match_their_sql(matches_sql, name):
    assert matches_sql(llm.QUERIES[name], llm.ORACLE_SQL[name]) > 0
