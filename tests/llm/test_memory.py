"""What the Python workers of the pipeline hold: they live on from stage to stage."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

import corpus_pipeline
from storyflow.llm import common, language, packing, tokenizing

ENCODE = """
def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) >> 10

import json
import numpy as np
import tokenizers
from storyflow.llm.tokenizing import WordBpe

def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(5))

before = held()
tok = WordBpe("word_bpe_49k.json")
for at in range(0, 300_000, 4000):
    tok.encode([" ".join(map(word, range(at, at + 4000)))])
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory can't be read here")
def test_the_encoder_holds_what_its_words_need():
    """A worker with 300,000 words: one model, and memory for these words rather than for all that may come."""
    root = os.path.dirname(corpus_pipeline.__file__)
    got = subprocess.run([sys.executable, "-c", ENCODE], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 110, got.stdout


def test_both_encoders_have_one_model():
    tok = tokenizing.WordBpe("word_bpe_49k.json")
    tok.library.model.dropout = 0.25
    assert tok._model.model.dropout == 0.25


def test_texts_go_to_the_language_model_once(spark, monkeypatch):
    """The tasks get each text once and hand rows back some at a time; rows come back as they were."""
    rows = [(i % 7, f"some text of number {i}", "en" if i % 2 else "de", i) for i in range(600)] + [(None, None, None, None), (3, "", "en", 5)]
    docs = spark.createDataFrame(rows, "`a.b` int, Text string, lang string, doc_id long")
    model = language.train(language.sample(docs))
    seen, kind = [], type(docs)
    ask = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: seen.append((self, f)) or ask(self, f, schema))
    got = language.predict(docs, model, keep=True).select("row.*")
    assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    (sent, run), = seen
    assert sent.schema.simpleString().lower().count("text") == 1
    given = pa.Table.from_batches(sent.toArrow().to_batches()).combine_chunks().to_batches()
    assert [b.num_rows for b in given] == [602]
    back = list(run(given))
    assert max(b.num_rows for b in back) <= 256 and sum(b.num_rows for b in back) == 602


def test_texts_go_to_the_tokenizer_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(name), []
    docs = spark.range(1500).coalesce(1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    monkeypatch.setattr(common, "saved", lambda df, **_: sizes.extend(r.n for r in docs.mapInArrow(count, "n long").collect()) or df)
    packing.tokenised(docs)
    assert sum(sizes) == 1500 and max(sizes) <= 512 and spark.conf.get(name) == before
    spark.conf.set(name, "100")
    try:
        with common.text_batches(spark):
            assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
