"""Token counts by a digest cache.

A text's key is the digest of its content and of the tokenizer's version.  Keys found
in the cache take its counts; of the others each distinct text is encoded once, and
the counts are appended to the cache, a Parquet table
(digest binary, version string, n_tokens long).

Content is normalised only as the tokenizer itself would ignore (not at all, unless
``normalise`` is given), so counts are exact.  Copies of a text are merged by an aggregate
over digests, first where they lie: of each distinct text a copy a task is shuffled, so a
text of many copies is no hot key.  The cache is partitioned by version.

Defined cases: a null text is empty and has no tokens; repeated rows and copies share
one encoding and all keep their rows; an empty table gives no row; a null doc_id stays
null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"
#: Session setting that names a cache folder for the query; without it, each call has a cache of its own.
SETTING = "spark.storyflow.tokenCache"


def version(tokenizer: str) -> str:
    """The tokenizer's version: its name and the digest of its file."""
    import hashlib
    import os

    from .tokenizing import vocabulary_path

    path = tokenizer if os.path.sep in tokenizer else vocabulary_path(tokenizer)
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{hashlib.sha256(f.read()).hexdigest()}"


def counter(tokenizer: str) -> Callable[[list[str | None]], list[int]]:
    """The counting function of a vocabulary file, one for each Python worker."""
    from .tokenizing import PieceCounter, WordBpe, loaded

    if tokenizer.endswith(".model"):
        return loaded(PieceCounter, tokenizer).count
    tok = loaded(WordBpe, tokenizer)
    return lambda texts: [len(raw) // tok.dtype.itemsize for raw in tok.encode(texts)]


def count_tokens(docs: DataFrame, cache: str | None = None, *, tokenizer: str = TOKENIZER, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row of ``docs`` (doc_id, text).

    ``cache``: the folder of the cache table; new counts are appended to it.  Without
    one, the cache lasts for this call."""
    spark, name = docs.sparkSession, version(tokenizer)
    folder = cache or common.shared_dir(spark)
    text = common.text_of()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")

    # Distinct texts first: copies are merged where they lie, so that a text of many copies
    # crosses the shuffle once a task, and the look-up needs no shuffle of its own.
    misses = docs.select(digest, "text").groupBy("digest").agg(F.first("text").alias("text"))
    if _there(spark, folder):
        misses = misses.join(_cache(spark, folder).where(F.col("version") == name).select("digest"), "digest", "left_anti")

    def encode(batches):
        import pyarrow as pa

        count = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * part.num_rows), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").partitionBy("version").parquet(folder)
    # Written, so that the join below deals both sides anew and Spark can split a hot digest.
    counts = common.saved(_cache(spark, folder).where(F.col("version") == name).select("digest", "n_tokens").dropDuplicates(["digest"]))
    return docs.select("doc_id", "n_bytes", digest).join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(folder)


def op6_digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether they exceed the limit."""
    counts = count_tokens(common.table(spark, sf_dir, "documents"), spark.conf.get(SETTING, None))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
