"""The pipeline's stages against plain Python over the same rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from storyflow.llm import secrets, tokenizing

from .test_near_copies import brute_kept
from .test_operators import CLASHES, ODD, documents, hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def assignments(text):
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [m.span() for m in pattern.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = "", 0
    merged = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out, at = out + text[at:s] + "[SECRET]", e
    return out + text[at:]


def test_stages(spark, sf):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(-1000 - i if d is not None else None, t) for i, (d, t) in enumerate(ODD)]
    extra = odd + [(5000, "Some words here. password=abcdefgh1 and more"), (5001, "x " + bench[0][1] + " y")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "s", 0) for i, t in extra], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    steps, df = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != "packing":
            assert out.columns == COLUMNS
            out = spark.createDataFrame(out.collect(), docs.schema)
            steps.append(sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr))
        else:
            pieces = out.toPandas()
        df = out

    known, single, clean, safe = steps
    noise = "x" * 70_000  # no language explains it
    assert known == sorted(((i, t) for i, t in rows if t and t != noise and any(map(str.isalpha, t))), key=repr)

    assert sorted(((i,) for i, _ in single), key=repr) == brute_kept(known) and set(single) <= set(known)

    assert clean == [r for r in single if not hits(r[1], bench)[1]] and len(clean) < len(single)
    assert [i for i, _ in safe] == [i for i, _ in clean]
    assert sorted(safe, key=repr) == sorted(((i, assignments(t)) for i, t in clean), key=repr)
    assert any("[SECRET]" in t for _, t in safe)

    lib = tokenizing.WordBpe("word_bpe_49k.json").library
    for i, t in safe:
        ids, at = lib.encode(t, add_special_tokens=False).ids + [2], 0
        mine = pieces[pieces["doc_id"].isna() if i is None else pieces["doc_id"] == i].sort_values("start")
        for p in mine.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_clashing_columns_come_through_unchanged(spark, sf):
    """Each stage keeps rows as they are, whatever its inner names: all columns of all rows."""
    rows = [*ODD, (600, "Nothing but plain English words that no other text repeats here at all"), (601, "password=abcdefgh1 is in this plain text of English words")]
    docs = documents(spark, rows).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES if c != "a.b"})
    held = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.collect()
        assert got
        if name == "secrets":
            assert sum(r["text"] is not None and "[SECRET]" in r["text"] for r in got) == 2
            got = [r for r in got if r["text"] is None or "[SECRET]" not in r["text"]]
        assert {tuple(r) for r in got} <= held, name
    pieces = corpus_pipeline.packed(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_empty_input_passes_all_stages(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        assert df.count() == 0


def test_linked_parts_are_redacted_too(spark):
    key = "aB3" * 12
    df = spark.createDataFrame([(1, f"user: bob {key} AKIA{'Z' * 16}", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert secrets.redact(df).select("text", F.col("n_chars")).first()[0] == "[SECRET] [SECRET] [SECRET]"
