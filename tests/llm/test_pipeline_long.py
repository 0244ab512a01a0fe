"""Very long texts through all stages of the pipeline."""

import zlib

import numpy as np

import corpus_pipeline
from storyflow.llm import tokenizing

from .test_operators import ODD


def test_very_long_texts_pass_the_stages(spark, sf):
    long = [t for _, t in ODD if t is not None and len(t) >= 20_000]
    assert [len(t) for t in long] == [70_000, 45_000]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = docs.unionByName(spark.createDataFrame([(-1 - i, t, None, "s", 0) for i, t in enumerate(long)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        if name == "packing":
            break
        df = spark.createDataFrame(df.collect(), docs.schema)
        # The one word of 70,000 letters is coded in more bits than it has; the 9,000 words stay as they are.
        assert [(r["doc_id"], r["text"]) for r in df.where("doc_id < 0").collect()] == [(-2, long[1])]
    pieces = df.where("doc_id < 0").toPandas().sort_values("start")
    ids, at = tokenizing.WordBpe("word_bpe_49k.json").library.encode(long[1], add_special_tokens=False).ids + [2], 0
    for p in pieces.itertuples():
        assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
        at += p.length
    assert at == len(ids)
