"""The corpus operators against brute force and SQL, and their defined cases."""

import glob
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storyflow.llm import decontamination, language, licenses, packing, queries, secrets, sharding, simhash, token_counts, token_store, tokenizing, topk, wavelet

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows, extra=True):
    """Documents of (doc_id, text) with the other columns, one clashing with inner names."""
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


#: Names that operators use inside, and one with a dot.
CLASHES = ("th", "fp", "k", "n", "s", "h", "part", "slot", "words", "row", "cut", "found", "score", "lang_pred", "bits_per_byte", "root", "items", "none", "c", "r", "d", "f", "key", "size", "shard", "bucket", "at", "a.b", "start", "end")

SHORT = "One two three four five six seven eight nine ten eleven"
ODD = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "a"), (4, SHORT), (4, SHORT), (4, SHORT), (5, SHORT + " twelve"), (None, SHORT), (None, None),
    (6, "é ß ́ 日本 ²"), (7, "x" * 70_000), (8, "word " * 9_000), (9, "No " * 3000 + "AKIA" + "A1" * 10), (10, "!!! ... ###"), (-3, "zwei Wörter"),
]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


# -- against the SQL of the queries --------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    con_rows = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert rows(got, *cols) == sorted(con_rows, key=repr)


# -- tokenizers ----------------------------------------------------------------------------

TEXTS = ["", None, "  a  b ", "a▁b", "é x", "́x a", "İSTANBUL Σας", "it's 'll ''s 12a½ ²3 ª", "<|endoftext|> hi", "a\tb\x0bc\x1cd", " ", "\n\n", "don'T'S", "日本語", "x" * 500, "ß ﬁ Ǆ", "a\0b", "ẞ STRASSE"]


def test_word_ids_are_the_librarys():
    tok = tokenizing.WordBpe("word_bpe_49k.json")
    assert tok._cuts
    got = [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(TEXTS)]
    assert got == [tok.library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("seats_log2", [1, 6, 12])
def test_word_ids_with_few_seats(seats_log2):
    """Words that share a seat, and a memory that is emptied all the time, change no id."""
    tok = tokenizing.WordBpe("word_bpe_49k.json", seats_log2)
    rnd = random.Random(12)
    atoms = ["'", "'s", "'T", "'re", "'ve", "'m", "'ll", "'d", "!", "...", " ", "\n", "\t", "12", "Don", "mé", "ÀÉ", "ß", "÷", "x" * 8, "w" * 15, "w" * 16, "w" * 17, "é" * 16, "日", "<|endoftext|>"]
    texts = [None, ""] + ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["word " * 70_000]
    got = [np.frombuffer(x, tok.dtype).tolist() for at in range(0, len(texts), 50) for x in tok.encode(texts[at : at + 50])]
    assert got == [tok.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_most_of_a_million_words_are_remembered():
    """Words met before a million others: few are learnt again."""
    tok = tokenizing.WordBpe("word_bpe_49k.json")
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    first = " ".join(map(word, range(2000)))
    want = tok.encode([first])
    for at in range(2000, 1_000_000, 10_000):
        tok.encode([" ".join(map(word, range(at, at + 10_000)))])
    learn, asked = tok._learn, []
    tok._learn = lambda new: asked.extend(new) or learn(new)
    assert tok.encode([first]) == want and len(asked) < 700


def test_piece_counts_are_the_librarys():
    tok = tokenizing.PieceCounter("piece_bpe_32k.model")
    assert tok._cuts
    assert tok.count(TEXTS) == [len(tok.library.encode(t or "")) for t in TEXTS]


# -- op1 -----------------------------------------------------------------------------------


def test_secret_spans(spark):
    key = "aB3" * 12
    texts = {
        1: 'Token = "abcdef" and passwd:abc, api-key: zzzzzzzz',
        2: "AKIA" + "Z" * 16 + " beside " + key,
        3: key + " alone",
        4: "https://db.example.com/x alone",
        5: "https://db.example.com/x secret=hunter22 user: bob",
        6: "é" * 30 + "0123456789abcdef" * 2,
        7: "passwd=token:abcdefgh",
    }
    out = {r["doc_id"]: r["s"] for r in secrets.scan(documents(spark, texts.items())).select("doc_id", secrets._joined(F.col("found")).alias("s")).collect()}
    assert out == {
        1: "assign:0:15",
        2: f"access:0:20,key:28:{28 + len(key)}",
        3: "",
        4: "",
        5: "endpoint:0:24,assign:25:40,ident:41:50",
        6: "hex:30:62",
        7: "",
    }


def test_linked_parts_are_named(spark):
    key = "aB3" * 12
    docs = documents(spark, [(2, "AKIA" + "Z" * 16 + " beside " + key), (3, key + " alone"), (None, "https://db.example.com/x secret=hunter22"), (4, None)])
    got = rows(secrets.credentials(docs), "doc_id", "kind", "start", "end", "other_kind", "other_start", "other_end")
    assert got == sorted([(2, "key", 28, 28 + len(key), "access", 0, 20), (None, "endpoint", 0, 24, "assign", 25, 40)], key=repr)


def test_secrets_in_odd_rows_and_redaction(spark):
    docs = documents(spark, ODD)
    assert len(rows(secrets.scan(docs), "doc_id")) == len(ODD)
    red = secrets.redact(documents(spark, [(1, "password=abcdefgh; then secret: zzzzzz"), (2, "clean"), (None, None), (1, "clean")]))
    assert rows(red, "doc_id", "text", "n_chars") == sorted([(1, "[SECRET]; then [SECRET]", 23), (2, "clean", 5), (None, None, 0), (1, "clean", 5)], key=repr)
    assert secrets.scan(docs.limit(0)).count() == 0


# -- op2 -----------------------------------------------------------------------------------


def hits(text, items):
    ws, marked, found = WORD.findall(low(text)), set(), set()
    for item, t in items:
        iw = WORD.findall(low(t))
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in windows:
                marked.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(ws), len(marked), ",".join(sorted(found))


def test_contaminated_words(spark):
    rnd = random.Random(5)
    vocabulary = ["No", "el", "zwei", "ß", "a1", "b"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (1, text(12)), (2, "No No No No No No No No No No No No"), (30, text(7)), (4, "b zwei el"), (5, "ß"), (6, None), (7, "..."), (None, text(11))]
    docs = [*ODD, *[(100 + i, text(rnd.choice([3, 9, 10, 40, 300]))) for i in range(40)], (200, items[0][1]), (201, "x " + items[1][1] + " y")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_chars", F.lit(1))
    got = decontamination.decontaminate(documents(spark, docs), bench)
    want = sorted(((i, *hits(t, items)) for i, t in docs), key=repr)
    assert rows(got.withColumn("s", F.array_join("items", ",")), "doc_id", "n_words", "n_hit", "s") == want
    kept = decontamination.remove_contaminated(documents(spark, docs), bench)
    assert rows(kept, "doc_id", "text") == sorted(((i, t) for i, t in docs if not hits(t, items)[1]), key=repr)
    assert decontamination.decontaminate(documents(spark, docs[:3]), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(documents(spark, docs).limit(0), bench).count() == 0


# -- op3 -----------------------------------------------------------------------------------


def test_wavelet_file():
    rnd = np.random.default_rng(1)
    for n, size in ((0, 1), (1, 5), (1000, 1), (70_001, 300), (600_000, 49_408)):
        ids = rnd.zipf(1.3, n).astype(np.int64) % size
        shard = wavelet.Shard(wavelet.encode(ids.astype(np.uint16), np.arange(2), np.array([n, 0])))
        assert (shard.decode() == ids).all()
        for i in rnd.integers(0, n, 20) if n else []:
            token = int(ids[i])
            at = np.flatnonzero(ids == token)
            assert shard.access(int(i)) == token and shard.rank(token) == len(at)
            assert shard.rank(token, int(i)) == (at < i).sum()
            j = int(rnd.integers(0, len(at)))
            assert shard.select(token, j) == at[j]
        assert shard.rank(size + 7) == 0 and shard.locate(size + 7) == []
    assert wavelet.Shard(wavelet.encode(np.array([3, 1, 3], np.uint16), np.array([0]), np.array([3]))).locate(3) == [0, 2]


@pytest.mark.parametrize("shard_tokens", [64, 1 << 20])
def test_token_files(spark, tmp_path, shard_tokens):
    docs = documents(spark, ODD).repartition(3)
    manifest = token_store.write(docs, str(tmp_path / "store"), shard_tokens=shard_tokens)
    got = [tuple(r) for r in token_store.read(spark, str(tmp_path / "store"), manifest).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tok = tokenizing.WordBpe("word_bpe_49k.json")
    ids = lambda t: tok.library.encode(t or "", add_special_tokens=False).ids + [2]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert sorted(((i, len(ids(t)), crc(t)) for i, t in ODD), key=repr) == sorted(((d, n, c) for d, _, n, c in got), key=repr)
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    order = [-(10**9) if d is None else d for d, *_ in got]
    assert order == sorted(order)
    empty = token_store.write(docs.limit(0), str(tmp_path / "none"))
    assert token_store.read(spark, str(tmp_path / "none"), empty).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    """A task that ran twice leaves files that the manifest does not name."""
    folder = str(tmp_path / "store")
    docs = documents(spark, ODD)
    manifest = token_store.write(docs, folder)
    want = rows(token_store.read(spark, folder, manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    token_store.write(docs, folder)
    assert rows(token_store.read(spark, folder, manifest), "doc_id", "start", "n_tokens", "ids_crc32") == want


# -- op4 -----------------------------------------------------------------------------------


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    vectors = [(i, rnd.integers(-4, 5, 6).astype(float).tolist()) for i in range(400)]
    vectors += [(400 + i, [1.0] * 6) for i in range(60)] + [(50, [2.0] * 6), (None, [9.0] * 6), (901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (950, [1.0, 2.0]), (951, [3.0, 1.0]), (1000, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "q": F.lit(2)})
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.top_k(v, F.col("vec_id") % 50 == 0, vector_block=100, query_block=4)
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in vectors if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for a, (qi, q) in enumerate(good):
        if qi % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, e)), i) for b, (i, e) in enumerate(good) if b != a and len(e) == len(q))[:5]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_lists_read_in_part_or_whole():
    rnd = np.random.default_rng(4)
    for n in (1, 4, 30, 500):
        x, q = rnd.integers(-300, 300, (n, 8)), rnd.integers(-300, 300, (9, 8))
        q[8] = 0
        x[: n // 2] *= 20  # some vectors that stand out end the reading early
        own = np.array([0] + [-1] * 8)
        for i, (at, scores, _) in enumerate(topk.read_lists(x, q, own, 5)):
            exact = x @ q[i]
            assert (exact[at] == scores).all() and own[i] not in at
            rest = np.delete(exact, own[i]) if own[i] >= 0 else exact
            assert sorted(scores)[-5:] == sorted(rest)[-5:]
    (at, scores, _), = topk.read_lists(np.array([[2**40, 1]]), np.array([[2**40, 1]]), np.array([-1]), 5)
    assert scores.tolist() == [2**63 - 1]
    big = rnd.integers(-(2**40), 2**40, (60, 3))
    (at, scores, _), = topk.read_lists(big, big[:1], np.array([0]), 5)
    exact = [sum(int(a) * int(b) for a, b in zip(v, big[0])) for v in big[1:]]
    assert sorted(scores)[-5:] == sorted(max(-(2**63), min(2**63 - 1, e)) for e in exact)[-5:]


def test_reading_stops_when_no_outsider_can_qualify():
    """Five vectors lead every list: the first batch already shows that no other can reach them."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 10, (640, 4))
    x[100:105] += 1000 + np.arange(5)[:, None]
    (at, scores, entries), = topk.read_lists(x, np.ones((1, 4), int), np.array([-1]), 5)
    assert sorted(at) == [100, 101, 102, 103, 104] and (scores == x[at].sum(axis=1)).all()
    assert entries <= 4 * 640 // 32
    (_, _, entries), = topk.read_lists(rnd.integers(0, 10, (640, 4)), np.ones((1, 4), int), np.array([-1]), 640)
    assert entries == 4 * 640  # all qualify, and all their entries are read


# -- op5 -----------------------------------------------------------------------------------


def test_labels_of_notices_that_are_alike():
    index = licenses.Index(licenses.TEMPLATES, {}, licenses.THRESHOLD)
    said = lambda text: set(index.meets(text.encode().split()))
    assert said("released under the apache license") == set()
    assert said("this book was released on license under the sea") == set()
    assert said("licensed under cc by 4 0") == set()
    assert said("licensed under cc by sa 4 0") == {"cc-by-sa"}
    assert said("this work is licensed under a creative commons attribution noncommercial license") == {"cc-by-nc"}
    assert said("this work is licensed under a creative commons attribution license") == {"cc-by"}
    assert said("this library is licensed under the gnu lesser general public license") == {"lgpl"}
    assert said("this work is licensed under the gnu general public license version 3") == {"gpl"}
    assert said("released under the mit license") == {"mit"}
    for label, text, *_ in licenses.TEMPLATES:
        assert said(text) == {label}


def test_license_blocks(spark):
    texts = [
        (1, "x MIT License y\nmit, license MIT License"),
        (2, "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this program and"),
        (3, "redistribution and use in source and binary forms"),
        (4, "CC BY 4.0 cc-by"),
        (5, "All rights reserved. Copyright 2020"),
        *ODD,
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).where("doc_id between 1 and 5").collect() if r["n_words"] not in (0, 11, 12)}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 4, "mit")
    assert got[2]["labels"] == "mit" and got[2]["base_labels"] == "" and 0.8 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["labels"]) == (2, 0, 4, "cc-by")
    assert got[5]["labels"] == "reserved" and got[5]["score"] == 1
    assert licenses.scan(documents(spark, ODD).limit(0)).count() == 0


def test_filters_lose_no_block():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rnd.sample(words, rnd.randint(1, 9)))) for i in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = licenses.Index(templates, {w.encode(): rnd.randint(0, 5) for w in words}, threshold)
        for _ in range(300):
            block = [rnd.choice(words).encode() for _ in range(rnd.randint(0, 12))]
            share = {label: len(t & set(block)) / len(t) for label, t in licenses._tokens(templates)}
            assert index.meets(block) == {k: s for k, s in share.items() if s >= threshold - 1e-9}


# -- op6 -----------------------------------------------------------------------------------


def test_cached_counts(spark, tmp_path):
    cache = str(tmp_path / "cache")
    lib = tokenizing.PieceCounter("piece_bpe_32k.model").library
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in ODD), key=repr)
    docs = documents(spark, ODD)
    for _ in range(2):
        assert rows(token_counts.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens") == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in ODD})  # each distinct text once, ever
    token_counts.count_tokens(documents(spark, [(1, "new"), (2, "new"), (3, "a")]), cache)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ODD}) + 1
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# -- op7 -----------------------------------------------------------------------------------


def shingle_bits(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low(text)) if w]
    if not ws:
        return 0
    import xxhash

    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_groups(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(200)) for _ in range(6)]
    docs = [*ODD, *[(100 + i, t) for i, t in enumerate(base)]]
    for i in range(60):
        ws = rnd.choice(base).split()
        ws[rnd.randrange(len(ws))] = "changed"
        docs.append((200 + i, " ".join(ws)))
    got = simhash.near_duplicates(documents(spark, docs))
    fps = [shingle_bits(t) for _, t in docs]
    roots = brute_components(fps, 2)
    least = {r: min((docs[i][0] for i in range(len(docs)) if roots[i] == r and docs[i][0] is not None), default=None) for r in set(roots)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert rows(got, "doc_id", "fp", "component_id") == sorted(((d, f, least[r]) for (d, _), f, r in zip(docs, signed, roots)), key=repr)
    kept = rows(simhash.keep_first(documents(spark, docs)), "doc_id")
    assert kept == sorted(((least[r],) for r in set(roots)), key=repr)
    assert simhash.near_duplicates(documents(spark, docs).limit(0)).count() == 0
    assert simhash.keep_first(documents(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("bits,blocks,crowd", [(2, 5, 64), (2, 5, 3), (2, 4, 2), (3, 6, 64), (1, 3, 2)])
def test_links_lose_no_component(spark, bits, blocks, crowd):
    rnd = random.Random(bits)
    values = set()
    for _ in range(8):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bits=bits, blocks=blocks, crowd=crowd)).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    mine = [found.get(v, v) for v in signed]
    want = brute_components(values, bits)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# -- op8 -----------------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    docs = documents(spark, ODD + [(1000 + i, f"text {i}") for i in range(500)])
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=7, bucket_bytes=500)
    back = sharding.read_shards(spark, str(tmp_path / "shards"))
    assert rows(back, "doc_id", "text") == rows(docs, "doc_id", "text")
    got = back.drop("text").toPandas()
    assert got["shard"].between(0, 6).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    assert spark.read.parquet(str(tmp_path / "shards")).agg(F.max("bucket")).first()[0] > 0
    more = docs.select(sharding.rendezvous(F.col("doc_id"), 7).alias("a"), sharding.rendezvous(F.col("doc_id"), 8).alias("b")).where("a <> b").select("b").distinct().collect()
    assert [r["b"] for r in more] == [7]
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_order_is_a_function_of_the_seed(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}") for i in range(400)] + [(7, "again")] * 3)
    kept, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for i, (parts, n) in enumerate([(2, "2"), (5, "7")]):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sharding.write_shards(docs.repartition(parts), str(tmp_path / str(i)), shards=3, bucket_bytes=900)
        out.append(rows(sharding.read_shards(spark, str(tmp_path / str(i))), "doc_id", "text", "shard", "slot"))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert out[0] == out[1]
    slots = [s for *_, shard, s in sorted(out[0]) if shard == 0]
    assert slots != sorted(slots)


def test_hot_record_is_scattered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "OFTEN", 20)
    docs = documents(spark, [(None, "same")] * 300 + [(i, "x") for i in range(20)])
    sharding.write_shards(docs, str(tmp_path / "hot"), shards=2, bucket_bytes=400)
    sizes = spark.read.parquet(str(tmp_path / "hot")).groupBy("shard", "bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 100 and sharding.read_shards(spark, str(tmp_path / "hot")).count() == 320


# -- op9 -----------------------------------------------------------------------------------


def test_least_squares():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        a, b = rnd.random((12, 20)), rnd.random(12) * 5
        offer = lambda r, a=a: (float((r @ a).max()), a[:, (r @ a).argmax()])
        rows_, x = packing.nnls(offer, b)
        slope = a.T @ (b - x @ rows_)
        assert (x > 0).all() and (slope <= 1e-5).all() and np.abs(rows_ @ (b - x @ rows_)).max(initial=0) < 1e-5


def test_best_combination_is_the_best_of_all():
    rnd = np.random.default_rng(8)

    def every(left, most, least=1):
        if left == 0:
            yield ()
        elif most:
            for x in range(least, left + 1):
                for rest in every(left - x, most - 1, x):
                    yield (x, *rest)

    for _ in range(20):
        worth, depth = rnd.normal(size=9), int(rnd.integers(1, 6))
        value, counts = packing.best_combination(worth, depth)
        assert value == pytest.approx(max(sum(worth[x - 1] for x in c) for c in every(9, depth)))
        assert counts.sum() <= depth and counts @ np.arange(1, 10) == 9 and value == pytest.approx(worth @ counts)


def test_plan_uses_no_length_too_often():
    rnd = np.random.default_rng(6)
    for h in (rnd.integers(0, 50, 32), np.zeros(32, int), np.eye(32, dtype=int)[20] * 9, rnd.poisson(0.3, 32), rnd.integers(0, 5000, 32)):
        used, times = packing.plan(h.astype(float))
        had = used.T @ times if len(times) else np.zeros(32, int)
        assert (had <= h).all() and all(int(r @ np.arange(1, 33)) == 32 and r.sum() <= packing.DEPTH for r in used)
        more, n = packing.greedy(h - had)
        both = had + (more.T @ n if len(n) else 0)
        assert (both <= h).all() and all(31 <= int(r @ np.arange(1, 33)) <= 32 for r in more)
    assert had.sum() > 0.8 * h.sum()  # most of a large histogram is fitted, whatever its shape


def test_most_documents_are_seated_uncut(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = packing.pack(docs).drop("ids").toPandas()
    seats = got.groupby(["doc_id"]).size()
    whole = got[got["doc_tokens"] < 4096].groupby("doc_id").size()
    assert (whole == 1).mean() > 0.9 and len(seats) == docs.count()
    assert 1 - got["length"].sum() / 4096 / got["sequence_id"].nunique() < 0.015


def test_pieces_cover_every_document_once(spark):
    rnd = random.Random(9)
    docs = ODD + [(1000 + i, "abc de " * rnd.randint(0, 900)) for i in range(150)]
    got = packing.pack(documents(spark, docs).repartition(5)).withColumn("c", F.crc32("ids")).drop("ids").toPandas()
    tok = tokenizing.WordBpe("word_bpe_49k.json")
    full = sorted(tuple(tok.library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in docs)
    assert got["length"].sum() == sum(map(len, full)) and (got["length"] > 0).all()
    for i, t in docs:
        if sum(x == i for x, _ in docs) > 1:
            continue
        ids = tok.library.encode(t or "", add_special_tokens=False).ids + [2]
        mine, at = got[got["doc_id"] == i].sort_values("start"), 0
        for r in mine.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.c == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096
    n = got["sequence_id"].nunique()
    assert sorted(got["sequence_id"].unique()) == list(range(n)) and n <= got["length"].sum() / 4096 * 1.03 + 2
    assert packing.pack(documents(spark, docs).limit(0)).count() == 0


def test_tasks_learn_words_once(monkeypatch):
    """What op9 and op3 give for Arrow batches: the library's ids, and few words asked for again after 800,000 others."""
    import pyarrow as pa

    monkeypatch.setattr(tokenizing, "_LOADED", {})
    tok = tokenizing.loaded(tokenizing.WordBpe, packing.TOKENIZER)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    again = pa.record_batch({"doc_id": [1, 2], "text": [" ".join(map(word, range(3000))), "It's " + word(7)]})
    others = pa.record_batch({"doc_id": range(200), "text": [" ".join(map(word, range(at, at + 4000))) for at in range(3000, 803_000, 4000)]})
    learn, asked = tok._learn, []
    tok._learn = lambda new: asked.append(len(new)) or learn(new)
    seen = [(raws, sum(asked)) for _, raws in packing.encoded([again, others, again], packing.TOKENIZER)]
    assert [np.frombuffer(x, tok.dtype).tolist() for x in seen[-1][0]] == [tok.library.encode(t, add_special_tokens=False).ids for t in again.column(1).to_pylist()]
    assert seen[-1][1] - seen[-2][1] < 1000


# -- op10 ----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language.identify(docs, keep=True).where(language.held_out(F.col("doc_id"))).select(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_code_lengths_by_hand():
    """With order 1 over 'abab': P(b|a) = 2/3; P(a|b) = 1/2; 'aa': an escape of 1/3 after a, then a without b: 2/4... """
    texts = {"x": "abab"}
    grams = {}
    for t in texts.values():
        b = t.encode()
        for n in (1, 2):
            for i in range(len(b) - n + 1):
                code = n
                for c in b[i : i + n]:
                    code = code * 256 + c
                grams[code] = grams.get(code, 0) + 1
    m = language.build(["x"], 1, np.zeros(len(grams), int), np.array(list(grams)), np.array(list(grams.values())))
    first = -np.log2(2 / 6)  # a: twice of four, and two escapes
    assert m.lengths(b"ab")[0] == pytest.approx(first - np.log2(2 / 3), abs=1e-5)
    assert m.lengths(b"aa")[0] == pytest.approx(first - np.log2(1 / 3) - np.log2(2 / 3), abs=1e-5)  # b is ruled out: a has 2 of 2 + 1 escape
    assert m.lengths(b"az")[0] == pytest.approx(first - np.log2(1 / 3) - np.log2(1 / 3) - np.log2(1 / 254), abs=1e-5)


def counted(texts, order):
    grams = {}
    for lang, data in texts:
        for n in range(1, order + 2):
            for i in range(len(data) - n + 1):
                key = lang, int.from_bytes(bytes([n]) + data[i : i + n], "big")
                grams[key] = grams.get(key, 0) + 1
    keys = list(grams)
    return np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.int64), np.array(list(grams.values()))


def brute_bits(data, tree, context, symbol):
    """Escape method C with exclusion, context by context."""
    left, out = 1.0, set()
    while True:
        seen = {b: c for b, c in tree.get(context, {}).items() if b not in out}
        if seen:
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return -np.log2(left * seen[symbol] / total)
            left *= len(seen) / total
            out |= set(seen)
        if not context:
            return -np.log2(left / (256 - len(out)))
        context = context[1:]


def test_code_lengths_against_brute_force():
    rnd = np.random.default_rng(1)
    data = [bytes(rnd.choice(list(s), 200).tolist()) for s in (b"abcde", b"abxyz")]
    m = language.build(["x", "y"], 3, *counted(list(enumerate(data)), 3))
    trees = []
    for d in data:
        trees.append({})
        for n in range(4):
            for i in range(len(d) - n):
                f = trees[-1].setdefault(d[i : i + n], {})
                f[d[i + n]] = f.get(d[i + n], 0) + 1
    for text in (b"a", b"abcdeabxyz?qab", bytes(rnd.choice(list(b"abcdexyzq"), 300).tolist())):
        want = [sum(brute_bits(d, t, text[max(0, i - 3) : i], text[i]) for i in range(len(text))) for d, t in zip(data, trees)]
        assert m.lengths(text) == pytest.approx(want)
    for context in (b"", b"a", b"ab", b"abx", b"zzz"):
        cost = np.array([m.lengths(context + bytes([b])) - m.lengths(context) for b in range(256)])
        assert np.exp2(-cost).sum(axis=0) == pytest.approx(1)


def test_long_text_is_coded_piece_by_piece():
    m = language.build(["x"], 3, *counted([(0, b"the cat sat on the mat")], 3))
    part = b"the mat sat "
    assert m.lengths(part * 9000)[0] == pytest.approx(m.lengths(part)[0] + 8999 * (m.lengths(part * 3) - m.lengths(part * 2))[0])


def test_language_of_odd_rows(spark):
    docs = documents(spark, ODD)
    got = rows(language.identify(docs), "doc_id", "lang_pred", "score")
    assert len(got) == len(ODD) and all(0 <= s <= 1 for *_, s in got)
    und = {0, 1, 2, 10}
    assert all((lang == "und") == (i in und) for i, lang, _ in got if i is not None)
    assert language.identify(docs.limit(0)).count() == 0
    assert {lang for _, lang, _ in rows(language.identify(docs.withColumn("lang", F.lit(None).cast("string"))), "doc_id", "lang_pred", "score")} == {"und"}



# -- the queries themselves, against brute force -----------------------------------------------


@pytest.fixture(scope="module")
def table(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def library_ids(texts):
    lib = tokenizing.WordBpe("word_bpe_49k.json").library
    return [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_query_of_the_token_store(spark, sf, table):
    ids = library_ids(t for _, t, _ in table)
    starts = np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    want = [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _, _), s, x in zip(table, starts, ids)]
    assert rows(queries.QUERIES["op3_wavelet_store"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_query_of_token_counts(spark, sf, table, tmp_path):
    lib = tokenizing.PieceCounter("piece_bpe_32k.model").library
    want = [(d, len((t or "").encode()), len(lib.encode(t or ""))) for d, t, _ in table]
    spark.conf.set(token_counts.SETTING, str(tmp_path / "cache"))
    for _ in range(2):  # the second call finds all counts in the cache
        got = rows(queries.QUERIES["op6_digest_counts"](spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == sorted(((*w, w[2] > 4096) for w in want), key=repr)
    spark.conf.unset(token_counts.SETTING)


def test_query_of_simhash_groups(spark, sf, table):
    fps = [shingle_bits(t) for _, t, _ in table]
    roots = brute_components(fps, 2)
    least = {}
    for (d, _, _), r in zip(table, roots):
        least[r] = min(d, least.get(r, d))
    want = [(d, f"{f:016x}", least[r]) for (d, _, _), f, r in zip(table, fps, roots)]
    assert rows(queries.QUERIES["op7_simhash_groups"](spark, sf), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_query_of_shards(spark, sf, table):
    got = queries.QUERIES["op8_two_pass_shards"](spark, sf).toPandas()
    by_id = got.set_index("doc_id")
    for d, t, _ in table:
        r, raw = by_id.loc[d], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(got) == len(table) and (moved["grown_shard"] == 40).all() and 0 < len(moved) < len(table) / 8
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    scores = spark.createDataFrame([(d, s) for d, _, _ in table for s in range(41)], "d long, s int").select("d", "s", F.xxhash64(F.lit(sharding.SEED), "d", "s").alias("h")).toPandas()
    best = lambda n: scores[scores["s"] < n].sort_values(["h", "s"]).groupby("d").tail(1).set_index("d")["s"]
    assert (by_id["shard"].sort_index() == best(40).sort_index()).all() and (by_id["grown_shard"].sort_index() == best(41).sort_index()).all()


def test_query_of_packing(spark, sf, table):
    got = queries.QUERIES["op9_nnls_packing"](spark, sf).toPandas()
    for (d, _, _), ids in zip(table, library_ids(t for _, t, _ in table)):
        at = 0
        for p in got[got["doc_id"] == d].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))


def test_query_of_languages(spark, sf, table):
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    teach = [(lang, t) for d, t, lang in table if lang and t and not held(d)]
    langs = sorted({lang for lang, _ in teach})
    trees = [{} for _ in langs]
    for lang, t in teach:
        data, tree = t.encode(), trees[langs.index(lang)]
        for n in range(4):
            for i in range(len(data) - n):
                f = tree.setdefault(data[i : i + n], {})
                f[data[i + n]] = f.get(data[i + n], 0) + 1
    known = [{} for _ in langs]

    def cost(g, tree, data):
        total = 0.0
        for i in range(len(data)):
            key = data[max(0, i - 3) : i + 1], min(i, 3)
            if key not in known[g]:
                known[g][key] = brute_bits(None, tree, key[0][:-1], key[0][-1])
            total += known[g][key]
        return total

    got = {r["doc_id"]: r for r in queries.QUERIES["op10_ppm_language"](spark, sf).collect()}
    assert len(got) == len(table)
    for d, t, _ in table:
        data = (t or "").encode()
        assert got[d]["held_out"] == held(d)
        if not any(map(str.isalpha, t or "")):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
        elif len(data) < 4000:
            bits = np.array([cost(g, tree, data) for g, tree in enumerate(trees)])
            assert got[d]["lang_pred"] == langs[int(bits.argmin())]
            assert got[d]["score"] == pytest.approx(1 / np.exp2((bits.min() - bits) * min(1, 24 / len(data))).sum(), abs=1e-6)
