"""Token-ID output: every text's ids in wavelet-matrix shard files (see wavelet.py).

Texts are dealt by ranges of doc_id, so that each task tokenises one range in
ascending order and writes its ids into one shard file, or into several of at most
``shard_tokens`` ids (a longer document has a shard of its own).  Every attempt of a
task writes files of names of its own; the manifest, a table that Spark commits, names
those of the attempts that count, and only these are read.  Reading goes through
Spark's binaryFile source.

Defined cases: a null text is empty (only the end id); rows that repeat a doc_id are
all kept, next to each other, ordered by their text's hash; a null doc_id comes first
and stays null; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 22
#: Bytes of text that a task tokenises, about.
RANGE_BYTES = 24 << 20
#: Texts handed to the encoder at once: few enough for its words to stay in the CPU's cache.
BATCH = 64

MANIFEST = "part long, k int, file string, docs long, tokens long"
ROWS = "file string, doc_id long, before long, n_tokens long, ids_crc32 long"


def encoded(batches, name: str, text: str = "text") -> Iterator[tuple[list, list[bytes]]]:
    """(rows as a list of dicts without the text, ids as bytes) of Arrow batches, some texts at a time."""
    from .tokenizing import WordBpe, loaded

    tok = loaded(WordBpe, name)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, tok.encode(part.column(part.schema.get_field_index(text)).to_pylist())


def write(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the shard files of ``docs`` (doc_id, text) to ``folder`` and returns their
    manifest: part, k, file, docs, tokens."""
    spark = docs.sparkSession
    folder = common.qualified(spark, folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    n = common.pieces(docs, range_bytes, spark.sparkContext.defaultParallelism, F.octet_length("text"))
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    dealt = dealt.repartitionByRange(n, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")

    def to_files(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from . import wavelet
        from .tokenizing import WordBpe, loaded

        part, k, files, attempt = TaskContext.get().partitionId(), 0, [], uuid.uuid4().hex
        dtype = loaded(WordBpe, tokenizer).dtype
        end = np.array([end_id], dtype).tobytes()
        held, doc_ids, lengths, size = [], [], [], 0

        def flush():
            nonlocal k, size
            ids = np.frombuffer(b"".join(held), dtype)
            nulls = np.array([d is None for d in doc_ids], bool)
            name = f"shard-{part:07d}-{k:05d}-{attempt}.wm"
            put(folder, name, wavelet.encode(ids, np.array([d or 0 for d in doc_ids], np.int64), np.array(lengths, np.int64), nulls))
            files.append((part, k, name, len(doc_ids), len(ids)))
            k, size = k + 1, 0
            for x in (held, doc_ids, lengths):
                x.clear()

        for rows, ids in encoded(batches, tokenizer):
            for doc, raw in zip(rows.column(0).to_pylist(), ids, strict=True):
                m = len(raw) // dtype.itemsize + 1
                if doc_ids and size + m > shard_tokens:
                    flush()
                held += (raw, end)
                doc_ids.append(doc)
                lengths.append(m)
                size += m
        if doc_ids:
            flush()
        columns = list(zip(*files)) if files else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "k", "file", "docs", "tokens"])

    return common.saved(dealt.mapInArrow(to_files, MANIFEST))


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file into a folder given with its scheme (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The documents in the shard files that ``manifest`` names: file, doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32.  The files are decoded whole, one at a time."""
    if manifest.first() is None:
        return spark.createDataFrame([], "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    first = common.saved(common.offsets(manifest.select("part", "k", "file", "tokens"), "tokens").select("file", F.col("at").alias("first")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), "content").join(first, "file", "left_semi").select("file", "content")

    def from_files(batches):
        import numpy as np
        import pyarrow as pa

        from . import wavelet

        for batch in batches:
            for i in range(batch.num_rows):
                shard = wavelet.Shard(batch.column(1)[i].as_py())
                raw = shard.decode().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                before = ends - shard.lengths
                crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(before.tolist(), ends.tolist())]
                name = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(shard.doc_ids, mask=shard.nulls), pa.array(before), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["file", "doc_id", "before", "n_tokens", "ids_crc32"])

    return files.mapInArrow(from_files, ROWS).join(first, "file").select("file", "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the shard files."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark)
    manifest = write(docs, folder)
    return read(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
