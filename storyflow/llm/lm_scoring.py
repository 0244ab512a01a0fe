"""Language-model scores from an n-gram trie of Elias-Fano levels.

Texts are encoded once into chunks of half a million tokens, a table bucketed by chunk,
so that what comes back for a chunk meets it without moving it.  Three rounds follow: of
words, of pairs and of triples.  In each, a chunk deals its distinct n-grams, with how
often its training texts hold them, as sorted, packed blobs to ``parts``; each part sums
its counts up, writes its slice of the model, a trie file (elias_fano.py), maps it and
answers the blobs from it.  So no task holds more of the model than a part, and a word's
pairs are dealt over up to ``FAN`` parts, that of a word in every text too.

The model, with c for counts in training texts: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1));
after v, p(w | v) = (c(vw) + a p(w)) / (c(v) + a), in the trie where c(vw) > 0; after u and v,
(c(uvw) + b p(w | v)) / (K + b), in the trie where c(uvw), c(uv) and c(vw) are at least 2; K sums
these c(uvw) up.  What is not in the trie costs its context's share, a / (c(v) + a) or b /
(K + b), and is looked up after one word less.  So probabilities sum to 1, but for their
quantisation: base-10 logarithms are kept in steps of 1/2048 (``STEP``).

Defined cases: a null text is empty, the end alone; without training texts every token has
probability 1; repeated rows are texts of their own, and a null doc_id is not held out;
long texts are scored whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blobs import grouped, mixed, packed, ranks, runs, summed, unpacked

#: Every text whose id's crc32 leaves the remainder 0 is held out.
FOLDS = 10
#: Weights of the shorter context's probability: after one word, and after two.
PAIR_WEIGHT, TRIPLE_WEIGHT = 500.0, 50.0
ADDED = 0.1
#: Tokens of a chunk, about; a longer text is a chunk of its own.
CHUNK_TOKENS = 1 << 19
#: Bytes of text for which there is a part of the model, about.
PART_BYTES = 16 << 20
#: Parts that the pairs after one word are dealt over, at most.
FAN = 64
STEP = 2048
#: Codes from here on are a context's share; below, a probability.
SHARE = 1 << 15
NONE = (1 << 16) - 1
END = b"\n"

CHUNKS = "chunk long, doc_ids array<long>, lengths binary, train binary, words binary, word_parts binary, ids binary"
BLOBS = "chunk long, part int, blob binary"
ANSWERS = BLOBS + ", words long, tokens long, file string"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Whether a text's id keeps it out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities."""
    return np.clip(np.rint(-np.log10(p) * STEP), 0, SHARE - 1).astype(np.int64)


# -- chunks --------------------------------------------------------------------------------


def encoded(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """``docs`` (doc_id, text, held) as chunks (:data:`CHUNKS`), their words dealt to ``parts``."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        doc_ids, train, streams, held = [], [], [], 0

        def chunk():
            nonlocal number, known, held
            names = list(known)  # in the order of their numbers
            of = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
            squeeze = zstandard.ZstdCompressor(level=1).compress
            row = [part << 32 | number, list(doc_ids), np.array([len(s) for s in streams], "<u4").tobytes(), np.array(train, np.uint8).tobytes(), squeeze(b" ".join(names)), packed(of), packed(np.concatenate(streams))]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            number, held, known = number + 1, 0, {}
            for x in (doc_ids, train, streams):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r], t) for r, t in zip(row, types)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        from collections import defaultdict

        for batch in batches:
            for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                if not known:
                    known = defaultdict()
                    known.default_factory = known.__len__
                words = text.encode().lower().split()  # ASCII letters alone are lowered; ASCII whitespace alone parts words
                words.append(END)
                streams.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                doc_ids.append(doc_id)
                train.append(not out)
                held += len(words)
                if held >= size:
                    yield chunk()
        if streams:
            yield chunk()

    return docs.mapInArrow(cut, CHUNKS)


class Chunk:
    """A chunk's tokens and, as they come back, what the parts say of its n-grams."""

    def __init__(self, row: dict, parts: int):
        self.parts, self.doc_ids, self.words = parts, row["doc_ids"], row["words"]
        (self.word_part,) = unpacked(row["word_parts"])
        (self.ids,) = unpacked(row["ids"])
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(np.frombuffer(row["train"], np.uint8), self.lengths).astype(np.int64)
        #: How many tokens of its text lie before each.
        self.place = np.arange(len(self.ids)) - np.repeat(self.first, self.lengths)

    def word_blobs(self):
        names = zstandard.ZstdDecompressor().decompress(self.words).split(b" ")
        counts = np.bincount(self.ids, self.train, len(names)).astype(np.int64)
        order = np.argsort(self.word_part, kind="stable")
        for p, lo, hi in runs(self.word_part[order]):
            mine = order[lo:hi]
            texts = zstandard.ZstdCompressor(level=3).compress(b" ".join([names[i] for i in mine.tolist()]))
            yield p, struct.pack("<I", len(texts)) + texts + packed(counts[mine])

    def know_words(self, answers: dict[int, bytes]) -> None:
        """Each word's number in the model and its count."""
        self.number, self.count = np.zeros(len(self.word_part), np.int64), np.zeros(len(self.word_part), np.int64)
        order = np.argsort(self.word_part, kind="stable")
        for p, lo, hi in runs(self.word_part[order]):
            self.number[order[lo:hi]], self.count[order[lo:hi]] = unpacked(answers[p])

    def find_pairs(self) -> None:
        """Distinct pairs, in the order of their parts and words."""
        self.second = np.flatnonzero(self.place >= 1)  # where pairs end
        a, b = self.ids[self.second - 1], self.ids[self.second]
        v, w = self.number[a], self.number[b]
        part = (mixed(v, w % FAN) % np.uint64(self.parts)).astype(np.int64)
        order, first = grouped(part, v, w)
        self.pair_of = ranks(order, first)
        of = order[first]
        self.pair, self.pair_part = (a[of], b[of]), part[of]
        self.pair_count = summed(self.train[self.second][order], first)

    def pair_blobs(self):
        a, b = self.pair
        for p, lo, hi in runs(self.pair_part):
            v, w = a[lo:hi], b[lo:hi]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            head = v[starts]
            # Second words by their place among the blob's own, each with its count once.
            order, first = grouped(self.number[w])
            own = w[order[first]]
            yield p, packed(np.diff(self.number[head], prepend=0), np.diff(np.append(starts, len(v))), self.count[head], np.diff(self.number[own], prepend=0), self.count[own], ranks(order, first), self.pair_count[lo:hi])

    def know_pairs(self, answers: dict[int, bytes]) -> None:
        """Each pair's code and whether training texts hold it twice."""
        self.pair_code, self.often = np.zeros(len(self.pair_part), np.int64), np.zeros(len(self.pair_part), bool)
        for p, lo, hi in runs(self.pair_part):
            code, often = unpacked(answers[p])
            self.pair_code[lo:hi], self.often[lo:hi] = code, often.astype(bool)

    def find_triples(self) -> None:
        """Distinct contexts of two words seen twice, and the distinct triples after them that may be in the model."""
        third = np.flatnonzero(self.place[self.second] >= 2)  # index of pairs that end triples
        context, pair = self.pair_of[third - 1], self.pair_of[third]  # pairs next to each other in a text are so in `second`
        keep = np.flatnonzero(self.often[context])
        self.third, context, pair = third[keep], context[keep], pair[keep]
        u, v = self.pair
        order, first = grouped(context)
        self.contexts, at = context[order[first]], ranks(order, first)
        cu, cv = self.number[u[self.contexts]], self.number[v[self.contexts]]
        part = (mixed(cu, cv) % np.uint64(self.parts)).astype(np.int64)
        order, _ = grouped(part, cu, cv)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.contexts, self.context_part = self.contexts[order], part[order]
        self.context_of = rank[at]
        may = np.flatnonzero(self.often[pair])
        order, first = grouped(self.context_of[may], self.number[v[pair[may]]])
        self.triple_of = np.full(len(self.third), -1)
        self.triple_of[may] = ranks(order, first)
        rows = may[order][first]
        self.triple_context, self.triple_pair = self.context_of[rows], pair[rows]
        self.triple_count = summed(self.train[self.second][self.third[may]][order], first)

    def triple_blobs(self):
        u, v = self.pair
        bounds = np.searchsorted(self.triple_context, np.arange(len(self.contexts) + 1))
        for p, lo, hi in runs(self.context_part):
            c, a, b = self.contexts[lo:hi], bounds[lo], bounds[hi]
            yield p, packed(np.diff(self.number[u[c]], prepend=0), self.number[v[c]], np.diff(bounds[lo : hi + 1]), self.number[v[self.triple_pair[a:b]]], self.pair_code[self.triple_pair[a:b]], self.triple_count[a:b])

    def know_triples(self, answers: dict[int, bytes]) -> None:
        """Each context's share and each triple's code."""
        bounds = np.searchsorted(self.triple_context, np.arange(len(self.contexts) + 1))
        self.share, self.triple_code = np.zeros(len(self.contexts), np.int64), np.zeros(len(self.triple_context), np.int64)
        for p, lo, hi in runs(self.context_part):
            self.share[lo:hi], self.triple_code[bounds[lo] : bounds[hi]] = unpacked(answers[p])

    def scores(self, tokens: int, words: int):
        """(doc_ids, n_tokens, n_known, base_score, score) by text."""
        base = np.log10((self.count + ADDED) / (tokens + ADDED * (words + 1)))
        one = base[self.ids]
        best = one.copy()
        code = self.pair_code[self.pair_of]
        best[self.second] = np.where(code < SHARE, -code / STEP, -(code - SHARE) / STEP + one[self.second])
        at = self.second[self.third]
        triple = np.where(self.triple_of >= 0, self.triple_code[self.triple_of] if len(self.triple_code) else NONE, NONE)
        best[at] = np.where(triple != NONE, -triple / STEP, best[at] - self.share[self.context_of] / STEP)
        known = (self.count > 0)[self.ids].astype(np.int64)
        return self.doc_ids, self.lengths, *(np.add.reduceat(x, self.first) for x in (known, one, best))


# -- parts of the model --------------------------------------------------------------------


def mapped(folder: str, name: str, data: bytes) -> np.ndarray:
    """A file written to the shared folder and mapped; read whole where the folder is no mounted one."""
    from pyarrow import fs

    from .token_store import put

    put(folder, name, data)
    store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", np.uint8, "r")
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def serve_words(part: int, parts: int, blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Answers, and the words and tokens of the part's training texts."""
    total: dict[bytes, int] = {}
    asked = []
    for blob in blobs:
        (n,) = struct.unpack_from("<I", blob)
        words = zstandard.ZstdDecompressor().decompress(blob[4 : 4 + n]).split(b" ")
        for w, c in zip(words, unpacked(blob[4 + n :])[0].tolist()):
            total[w] = total.get(w, 0) + c
        asked.append(words)
    number = {w: i * parts + part for i, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}  # small numbers for words of many tokens
    answers = [packed(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), np.fromiter(map(total.__getitem__, ws), np.int64, len(ws))) for ws in asked]
    return answers, sum(c > 0 for c in total.values()), sum(total.values())


def serve_pairs(blobs: list[bytes], tokens: int, words: int, weight: float, write) -> list[bytes]:
    """Builds the trie of a part's pairs, hands its bytes to ``write`` and answers from what that returns."""
    from .elias_fano import Level, Trie, encode

    asked = []
    for blob in blobs:
        gaps, n, cv, own, counts, w, c = unpacked(blob)
        asked.append((np.cumsum(gaps), n, cv, np.cumsum(own)[w], counts[w], c))
    v = np.concatenate([np.repeat(q[0], q[1]) for q in asked])
    cv = np.concatenate([np.repeat(q[2], q[1]) for q in asked])
    w, cw, c = (np.concatenate([q[i] for q in asked]) for i in (3, 4, 5))
    order, first = grouped(v, w)
    at, of = ranks(order, first), order[first]
    v, w, cv, cw, c = v[of], w[of], cv[of], cw[of], summed(c[order], first)
    edges = np.append(True, v[1:] != v[:-1])
    heads = np.flatnonzero(edges)
    known = heads[cv[heads] > 0]
    kept = np.flatnonzero(c > 0)
    shorter = (cw[kept] + ADDED) / (tokens + ADDED * (words + 1))
    longer = (c[kept] + weight * shorter) / (cv[kept] + weight)
    trie = Trie(write(encode([
        Level(np.zeros(len(known), np.int64), v[known], quantised(weight / (cv[known] + weight))),
        Level(np.searchsorted(v[known], v[kept]), w[kept], quantised(longer)),
    ])))
    # Each distinct context and pair is asked for once, in order.
    there, node = trie.find(0, np.zeros(len(heads), np.int64), v[heads])
    share = np.full(len(heads), SHARE)
    share[there] += trie.codes(0, node[there])
    head = np.cumsum(edges) - 1
    found, child = trie.find(1, node[head], w)
    code = share[head]
    code[found] = trie.codes(1, child[found])
    often = (c >= 2).astype(np.int64)
    answers, begin = [], 0
    for q in asked:
        mine = at[begin : begin + len(q[3])]
        begin += len(q[3])
        answers.append(packed(code[mine], often[mine]))
    return answers


def serve_triples(blobs: list[bytes], weight: float, write) -> list[bytes]:
    """As :func:`serve_pairs`, for triples."""
    from .elias_fano import Level, Trie, encode

    asked = []
    for blob in blobs:
        gaps, v, n, w, code, c = unpacked(blob)
        asked.append((np.cumsum(gaps), v, n, w, code, c))
    u, v = (np.concatenate([np.repeat(q[i], q[2]) for q in asked]) for i in (0, 1))
    w, code, c = (np.concatenate([q[i] for q in asked]) for i in (3, 4, 5))
    order, first = grouped(u, v, w)
    at, of = ranks(order, first), order[first]
    u, v, w, code, c = u[of], v[of], w[of], code[of], summed(c[order], first)
    kept = np.flatnonzero(c >= 2)
    ku, kv, kw, c = u[kept], v[kept], w[kept], c[kept]
    edge = np.append(True, (ku[1:] != ku[:-1]) | (kv[1:] != kv[:-1])) if len(ku) else np.zeros(0, bool)
    edges, context = np.flatnonzero(edge), np.cumsum(edge) - 1
    k = summed(c, edges)
    tops = np.unique(ku[edges])
    # Only pairs seen twice lead here, and these are in the trie of pairs: their codes are probabilities.
    longer = (c + weight * 10.0 ** (-code[kept] / STEP)) / (k[context] + weight)
    trie = Trie(write(encode([
        Level(np.zeros(len(tops), np.int64), tops, np.zeros(len(tops), np.int64)),
        Level(np.searchsorted(tops, ku[edges]), kv[edges], quantised(weight / (k + weight))),
        Level(context, kw, quantised(longer)),
    ])))
    # Each distinct context and triple is asked for once, in order.
    cu, cv = (np.concatenate([q[i] for q in asked]) for i in (0, 1))
    order, first = grouped(cu, cv)
    of, place = order[first], ranks(order, first)
    _, top = trie.find(0, np.zeros(len(of), np.int64), cu[of])
    known, node = trie.find(1, top, cv[of])
    share = np.zeros(len(of), np.int64)
    share[known] = trie.codes(1, node[known])
    parent = np.zeros(len(u), np.int64)
    parent[at] = np.repeat(node[place], np.concatenate([q[2] for q in asked]))
    found, child = trie.find(2, parent, w)
    codes = np.full(len(u), NONE)
    codes[found] = trie.codes(2, child[found])
    answers, begin, context = [], 0, 0
    for q in asked:
        answers.append(packed(share[place[context : context + len(q[0])]], codes[at[begin : begin + len(q[3])]]))
        begin, context = begin + len(q[3]), context + len(q[0])
    return answers


# -- rounds --------------------------------------------------------------------------------


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written to the shared folder as a table of ``buckets`` buckets by chunk: such tables are joined
    by chunk without a shuffle."""
    name = f"storyflow_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk").option("path", common.shared_dir(df.sparkSession)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def _answered(blobs: DataFrame, serve, buckets: int) -> DataFrame:
    """The parts' answers to ``blobs``, a row a chunk (chunk, answers), and in a row without a chunk
    what the parts say of themselves (words, tokens, files): serve(part, blobs) gives (answers, words, tokens, file)."""

    def one(key, table):
        import pyarrow as pa

        part = key[0].as_py()
        answers, words, tokens, file = serve(part, table.column("blob").to_pylist())
        n = len(answers)
        return pa.table(
            [pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([*answers, None], pa.binary()), pa.array([None] * n + [words], pa.int64()), pa.array([None] * n + [tokens], pa.int64()), pa.array([None] * n + [file], pa.string())],
            names=[c.split()[0] for c in ANSWERS.split(", ")],
        )

    found = blobs.groupBy("part").applyInArrow(one, ANSWERS).repartition(buckets, "chunk")
    answer = F.when(F.col("chunk").isNotNull(), F.struct("part", "blob"))
    return bucketed(found.groupBy("chunk").agg(F.collect_list(answer).alias("answers"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.collect_list("file").alias("files")), buckets)


def score(docs: DataFrame, *, chunk_tokens: int = CHUNK_TOKENS, part_bytes: int = PART_BYTES, weights: tuple[float, float] = (PAIR_WEIGHT, TRIPLE_WEIGHT), folder: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (doc_id, text).

    ``folder`` keeps the model: the trie files of its parts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("held", held_out(F.col("doc_id")))
    folder = common.qualified(spark, folder or common.shared_dir(spark))
    parts = common.pieces(docs, part_bytes, 2 * spark.sparkContext.defaultParallelism, F.octet_length("text"))
    # Bucketed: answers come to the chunks, which stay where they are.
    chunks = bucketed(encoded(docs, chunk_tokens, parts), parts)

    def chunk_rows(batches, answers: int):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("chunk", "doc_ids", "lengths", "train", "words", "word_parts", "ids")}
                chunk = Chunk(row, parts)
                for j in range(answers):
                    known = {a["part"]: a["blob"] for a in batch.column(f"a{j}")[i].as_py() or []}
                    if j == 0:
                        chunk.know_words(known)
                        chunk.find_pairs()
                    elif j == 1:
                        chunk.know_pairs(known)
                        chunk.find_triples()
                    else:
                        chunk.know_triples(known)
                yield row["chunk"], chunk

    def with_answers(*rounds: DataFrame) -> DataFrame:
        out = chunks.withColumn("words", F.lit(None).cast("binary")) if rounds else chunks  # not read where they are not needed
        for j, a in enumerate(rounds):
            out = out.join(a.where(F.col("chunk").isNotNull()).select("chunk", F.col("answers").alias(f"a{j}")), "chunk", "left")  # a chunk without n-grams of a kind has no answer
        return out

    def dealt(rounds: list[DataFrame], what: str) -> DataFrame:
        n = len(rounds)

        def deal(batches):
            import pyarrow as pa

            for key, chunk in chunk_rows(batches, n):
                found = list(getattr(chunk, what)())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["chunk", "part", "blob"])

        return with_answers(*rounds).mapInArrow(deal, BLOBS)

    def writer(kind: str, part: int):
        """A function that writes and maps a part's file, and the list it leaves the file's name in."""
        names = []

        def write(data: bytes):
            names.append(f"{kind}-{part:07d}-{uuid.uuid4().hex}.trie")
            return mapped(folder, names[0], data)

        return write, names

    word_answers = _answered(dealt([], "word_blobs"), lambda part, blobs: (*serve_words(part, parts, blobs), None), parts)
    sums = word_answers.where(F.col("chunk").isNull()).agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    v, n = sums["v"] or 0, sums["n"] or 0

    def pairs(part, blobs):
        write, names = writer("pairs", part)
        return serve_pairs(blobs, n, v, weights[0], write), None, None, names[0]

    def triples(part, blobs):
        write, names = writer("triples", part)
        return serve_triples(blobs, weights[1], write), None, None, names[0]

    pair_answers = _answered(dealt([word_answers], "pair_blobs"), pairs, parts)
    triple_answers = _answered(dealt([word_answers, pair_answers], "triple_blobs"), triples, parts)

    def scored(batches):
        import pyarrow as pa

        for _, chunk in chunk_rows(batches, 3):
            columns = chunk.scores(n, v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCORES.split(", ")])

    found = with_answers(word_answers, pair_answers, triple_answers).mapInArrow(scored, SCORES)
    return found.withColumn("train_tokens", F.lit(n).cast("long"))


def op12_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores: of single words, and of the model."""
    found = score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
