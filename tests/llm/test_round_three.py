"""Phrases, language-model scores and the prefix trie against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyflow.llm import collocations, common, elias_fano, lm_scoring, prefix_trie

from .test_operators import CLASHES, ODD, documents, rows


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- op11 ----------------------------------------------------------------------------------


def brute_collocations(docs, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low(text)):
            ws = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    inner = set()
    for p, c in often.items():
        ws = p[1:]
        for k in range(2, len(ws)):
            inner |= {(p[0], *ws[i : i + k], c) for i in range(len(ws) - k + 1)}
    out = {}
    for p, a in often.items():
        ws, lang = p[1:], p[0]
        if len(ws) < 2 or (*p, a) in inner:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted(((lang, i + 1, ph.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, ph, l, r) in enumerate(sorted(xs)[:top])), key=repr)


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def texts_of_phrases():
    rnd = random.Random(5)
    vocabulary = ["of", "the", "a", "New", "York", "é", "x\x0by", "日本", "\x00", "\xa0z", "st.", "go go", "the\tend"]
    docs = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", "\n", "!"]) for _ in range(rnd.randrange(60)))) for _ in range(60)]
    return [*docs, *[("en", t) for _, t in ODD if t is None or len(t) < 30_000], ("en", "word " * 9_000), ("en", "of the " * 300)]


@pytest.mark.parametrize(("size", "longest", "top"), [(1 << 20, 5, 2000), (100, 5, 7), (1000, 3, 2000), (64, 2, 50)])
def test_phrases_are_those_of_brute_force(spark, size, longest, top):
    docs = texts_of_phrases()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3).withColumns({c: F.lit("x") for c in CLASHES})
    got = collocations.collocations(df, least=6, longest=longest, top=top, size=size)
    assert rows(got, *PHRASE) == brute_collocations(docs, 6, longest, top)


def test_scores_beyond_64_bits(spark):
    # 1000 * a * n passes 2^63 here; the product is exact all the same.
    score = spark.sql("SELECT cast((cast(30000000000 as decimal(17,0)) * cast(9000000000001 as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast(30000000001 as decimal(17,0)) * cast(30000000000 as decimal(17,0))) as long) AS s").first()["s"]
    assert score == 30000000000 * 9000000000001 * 1000 // (30000000001 * 30000000000)


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string"), least=1).count() == 0


def test_a_bitmap_crosses_blocks_but_no_piece():
    words = np.array([0, 1] * 20)
    at = np.arange(40)
    maps = collocations.gathered(words, at // 16, (1 << (at % 16)).astype(np.uint16))
    starts = np.zeros(3, np.uint16)
    starts[0], starts[1] = 1, 1 << 3  # pieces begin at positions 0 and 19
    a, b, n = collocations.pairs(collocations.Shard.of(maps, starts), maps, 2)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 1, 19), (1, 0, 19)]


# -- op12 ----------------------------------------------------------------------------------


def brute_scores(docs, weights):
    c1, c2, c3, cut = Counter(), Counter(), Counter(), []
    for doc, text in docs:
        ws = [*re.findall("[^\\x20\\x09-\\x0D]+", low(text)), "\n"]
        out = doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0
        cut.append((doc, ws))
        if not out:
            c1.update(ws)
            c2.update(zip(ws, ws[1:]))
            c3.update(zip(ws, ws[1:], ws[2:]))
    n, v, (a, b) = sum(c1.values()), len(c1), weights
    step = lambda p: -min(32767, max(0, round(-math.log10(p) * 2048))) / 2048
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    k = Counter()
    for x, c in c3.items():
        k[x[:2]] += c if c >= 2 else 0

    def two(x, y):
        if c2[x, y]:
            return step((c2[x, y] + a * p1(y)) / (c1[x] + a))
        return (step(a / (c1[x] + a)) if c1[x] else 0) + math.log10(p1(y))

    def three(x, y, z):
        if c3[x, y, z] >= 2:
            return step((c3[x, y, z] + b * 10 ** two(y, z)) / (k[x, y] + b))
        return (step(b / (k[x, y] + b)) if k[x, y] else 0) + two(y, z)

    for doc, ws in cut:
        base = [math.log10(p1(w)) for w in ws]
        yield doc, len(ws), sum(c1[w] > 0 for w in ws), n, sum(base), base[0] + sum(two(*ws[:2]) for _ in ws[1:2]) + sum(three(*ws[i - 2 : i + 1]) for i in range(2, len(ws)))


@pytest.mark.parametrize(("size", "part"), [(1 << 20, 1 << 24), (50, 2000)])
def test_scores_are_those_of_brute_force(spark, tmp_path, size, part):
    rnd = random.Random(7)
    docs = [*ODD, *[(100 + i, " ".join(rnd.choice(["of", "the", "A", "é", "日本", "\x00", "x\x1cy", f"w{rnd.randrange(30)}"]) for _ in range(rnd.randrange(80)))) for i in range(80)]]
    got = lm_scoring.score(documents(spark, docs), chunk_tokens=size, part_bytes=part, weights=(5.0, 2.0), folder=f"file://{tmp_path}/model")
    got = rows(got, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(brute_scores(docs, (5.0, 2.0)), key=repr)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(math.isclose(x[i], y[i], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got, want) for i in (4, 5))
    assert list((tmp_path / "model").glob("triples-*.trie"))


def test_the_model_is_better_than_single_words_on_held_out_texts(spark, sf):
    got = lm_scoring.op12_trie_scores(spark, sf).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got["s"] > got["b"]


def test_no_texts_and_no_training(spark):
    assert lm_scoring.score(documents(spark, [])).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm_scoring.score(documents(spark, [(out, "a b a b")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (5, 0, 0, 0.0, 0.0)


def test_sequences_give_their_numbers_and_successors_back():
    rnd = random.Random(1)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (1000, 10), (1000, 10**6), (5000, 10**14), (40000, 70000)):
        values = np.sort(np.array([rnd.randrange(top) for _ in range(n)], np.int64))
        ef = elias_fano.EliasFano(np.frombuffer(elias_fano.EliasFano.encode(values), np.uint8))
        if n:
            assert (ef[np.arange(n)] == values).all()
        x = np.array([rnd.randrange(top + 5) for _ in range(500)], np.int64)
        if n:
            lo = np.array([rnd.randrange(n + 1) for _ in x])
            hi = np.array([rnd.randrange(a, n + 1) for a in lo])
            assert (ef.successor(x, lo, hi) == np.clip(np.searchsorted(values, x), lo, hi)).all()


def test_a_trie_finds_its_n_grams_alone():
    rnd = random.Random(2)
    grams = sorted({(rnd.randrange(20), rnd.randrange(50)) for _ in range(300)})
    tops = np.array(sorted({a for a, _ in grams} | {30}))
    a, b = (np.array(c) for c in zip(*grams))
    trie = elias_fano.Trie(np.frombuffer(elias_fano.encode([elias_fano.Level(np.zeros(len(tops), np.int64), tops, tops), elias_fano.Level(np.searchsorted(tops, a), b, a * 100 + b)]), np.uint8))
    x, y = np.meshgrid(np.arange(32), np.arange(52), indexing="ij")
    _, node = trie.find(0, np.zeros(x.size, np.int64), x.ravel())
    found, child = trie.find(1, node, y.ravel())
    assert found.tolist() == [g in set(grams) for g in zip(x.ravel().tolist(), y.ravel().tolist())]
    assert (trie.codes(1, child[found]) == (x.ravel() * 100 + y.ravel())[found]).all()


# -- op13 ----------------------------------------------------------------------------------

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(turns, query=True):
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(xs)] for c, xs in own.items()}
    built = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if query else 0
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + xs[h:] if query else xs
    members = {}
    for c, xs in built.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rnd = random.Random(11)
    say = ["", None, "hi", "hello", "é ß", "x" * 500, "日本"]
    turns = [(c, t, rnd.choice(["user", None, "bot"]), rnd.choice(say)) for c in range(-7, 40) for t in range(rnd.randrange(12))]
    turns += [(c, t, "user", say[t % 7]) for c in range(100, 130) for t in range(rnd.choice([1, 3, 20]))]
    turns += [(50, None, "user", "b"), (50, None, "user", "a"), (50, 0, None, "c"), (50, 0, None, "c"), (None, 1, "user", "x"), (203, 1, "user", "only"), (204, 2, "user", "only")]
    turns += [(301, t, "user", f"t{t // 3}") for t in range(700)] + [(302, t, "user", f"t{t // 3}") for t in range(650)]
    return turns


@pytest.mark.parametrize("query", [True, False])
@pytest.mark.parametrize(("primes", "bits", "size"), [(prefix_trie.PRIMES, 64, 1 << 25), ((101, 3), 64, 3000), (prefix_trie.PRIMES, 2, 1 << 25), ((5, 3), 3, 3000)])
def test_trie_is_that_of_brute_force(spark, monkeypatch, primes, bits, size, query):
    """With narrow fingerprints and hashes collisions are many, and all are split."""
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", size)
    monkeypatch.setattr(prefix_trie, "IDS_A_CHUNK", 4)
    turns = conversations() if query else [t for t in conversations() if t[0] is None or t[0] < 60 or t[0] > 120]
    if primes[0] < 100 or not query:
        turns = [t for t in turns if t[0] not in (301, 302)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit("x") for c in CLASHES})
    conv = F.col("conv_id")
    how = {"base": conv - conv % 5, "lent": F.crc32(conv.cast("string").cast("binary")) % 9} if query else {}
    assert rows(prefix_trie.trie(df, primes=primes, bits=bits, **how), *NODE) == brute_trie(turns, query)


def test_no_conversations_no_root(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(none).count() == 0
    assert prefix_trie.trie(none.union(spark.createDataFrame([(None, 1, "a", "b")], none.schema))).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.session_dir(spark).startswith("file:")
