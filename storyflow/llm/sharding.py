"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

A record's shard is the one of highest seeded hash of its key and the shard's number
(rendezvous hashing): the key and the number of shards decide, and one more shard only
takes records into itself.  Pass one scatters the records of each shard uniformly, by a
seeded hash, into buckets of about ``bucket_bytes``; pass two puts each bucket into an
array, in the order of its keys, shuffles it (Spark's shuffle() is a Fisher-Yates shuffle
with a seed) and writes it.  A record's slot is its place in its bucket after the shard's
buckets before.

The order is a function of the seed and the records: buckets come from hashes of keys and
contents, and are dealt into as many partitions as there are buckets, whatever number of
shuffle partitions the session has.

Defined cases: a null text has no bytes and stays null; records that repeat a key, and
those of a null key, share a shard, are scattered over its buckets by their content (those
that repeat it more than ``OFTEN`` times, by their place in the input) and have slots of
their own; long texts lie in buckets of their own size; an empty table gives no row; other
columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
SEED = 20240601
BUCKET_BYTES = 16 << 20
#: Records of one key and content beyond which they are scattered by their place in the input.
OFTEN = 1024
#: Tasks of pass two at most; beyond, a task has several buckets.
MOST_TASKS = 100_000
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, from 0, whose number's seeded hash with the key is highest."""
    score = lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), score)).getField("s")


def two_pass_shuffle(records: DataFrame, *, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``key``, ``size``, the columns of ``carry``, ``shard``, ``bucket`` and ``pos``, the place in
    the bucket from 0, of each record (columns key and size, its bytes)."""
    content = F.xxhash64(F.lit(seed), *(carry or ["size"]))
    rows = records.select(F.struct("key", "size", *(carry or [])).alias("r"), content.alias("c"), rendezvous(F.col("key"), shards, seed).alias("shard"))
    held = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("r.size").alias("b")).collect()}  # a row for each shard
    number = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    often = common.saved(rows.groupBy(F.col("r.key").alias("key"), "c").count().where(F.col("count") > OFTEN).select("key", "c"))
    row = F.monotonically_increasing_id()
    rows = rows.withColumn("row", row) if often.first() is None else rows.withColumn("row", row).alias("a").join(often.alias("o"), F.expr("a.r.key <=> o.key AND a.c = o.c"), "left").select("r", "a.c", "shard", "row", F.when(F.col("o.c").isNotNull(), F.col("row")).alias("apart"))
    apart = [F.col("apart")] if "apart" in rows.columns else []
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "r.key", "c", *apart), F.get(F.array(*map(F.lit, number)), F.col("shard")).cast("long"))
    tasks = min(sum(number), MOST_TASKS)
    scattered = rows.withColumn("bucket", bucket).repartition(tasks, "shard", "bucket").groupBy("shard", "bucket")
    # Records that have all in common but their place in the input are the same to each other.
    gathered = scattered.agg(F.array_sort(F.collect_list(F.struct(F.col("r.key").alias("key"), "c", "row", "r"))).alias("records")).sortWithinPartitions("shard", "bucket")
    drawn = gathered.select("shard", "bucket", F.posexplode(F.shuffle(F.transform("records", lambda x: x["r"]), seed)).alias("pos", "r"))
    return drawn.select("r.*", "shard", "bucket", F.col("pos").cast("long").alias("pos"))


def write_shards(documents: DataFrame, folder: str, **options) -> None:
    """Writes ``documents`` (doc_id, text) as one folder for each shard, each bucket in its shuffled order."""
    records = documents.select(F.col("doc_id").cast("long").alias("key"), (F.octet_length(common.text_of()) + RECORD_BYTES).cast("long").alias("size"), "text")
    out = two_pass_shuffle(records, carry=["text"], **options)
    out.select(F.col("key").alias("doc_id"), "text", "size", "shard", "bucket", "pos").write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, *, content: Column | None = None) -> DataFrame:
    """``doc_id``, ``content`` (the text, if not given), ``size, shard, slot`` of all records of
    the written shards: slots run from 0 in each shard without a gap."""
    rows = spark.read.schema("doc_id long, text string, size long, bucket long, pos long, shard int").parquet(folder)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first = common.saved(counts.select("shard", "bucket", ahead.alias("first")))  # a row for each bucket
    rows = rows.select("doc_id", F.col("text") if content is None else content, "size", "shard", "bucket", "pos")
    return rows.join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("pos")).drop("bucket", "pos", "first")


def op8_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, read back from the shards, and its shard if there were one more."""
    folder = common.shared_dir(spark)
    write_shards(common.table(spark, sf_dir, "documents"), folder)
    out = read_shards(spark, folder, content=F.crc32(common.text_of().cast("binary")).alias("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))
