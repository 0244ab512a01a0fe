"""Phrases whose words occur together more often than by chance.

Each task cuts its texts into shards of about ``SHARD`` word positions, a language each.  A
shard holds, for every word, the bitmap of the positions it stands at, compressed: 16
positions to a block, and blocks without a bit are left out.  A phrase's bitmap marks where
it ends.  A phrase grows by one word as in SPAM: its bitmap is shifted by a position, bits
that crossed into another piece are cleared, and it is ANDed with the bitmaps of the words
that share a block with it; a popcount counts what is left.  Phrases that begin with some
words are extended to their full length before those of the next words are begun.

Shards deal their counts to parts, by a hash of the phrase, as sorted and packed columns; a part
sums up what it gets.  Words and pairs that are rare over all shards are known before longer
phrases are looked for, and each shard is told which of its own words and pairs are
frequent, so nothing is broadcast and no rare phrase is built on.

Scores are exact: products are decimals of 38 digits.  A phrase lies inside a longer one of
the same count only if it lies inside one longer by a word of that count, so each candidate
is held against those alone.

Defined cases: a null text is empty; a null language is ``und``; phrases never leave a
piece; occurrences that overlap all count, repeated rows too; long texts are cut whole; an
empty table gives no row; ties are broken by score, count and phrase; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .blobs import grouped, mixed, packed, runs, summed, unpacked

#: Candidates: phrases of 2 to LONGEST words with LEAST occurrences.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Word positions of a shard, about; a longer text is not cut.
SHARD = 1 << 20
#: Bytes of text for which there is a part that sums counts up, about.
PART_BYTES = 16 << 20
#: Positions of a bitmap's block.
BLOCK = 16
#: Entries of bitmaps that are extended together.
FRONT = 1 << 18
UNKNOWN = "und"

SHARDS = "shard long, lang string, n long, words array<string>, counts binary, word binary, block binary, bits binary, starts binary"
#: Ends of pieces, every one of them a byte that no text holds.
_MARK = b"\xff"
_ENDS = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


@dataclass
class Bitmaps:
    """Compressed bitmaps, one for each key: entries of (key, block, bits)."""

    key: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def __getitem__(self, rows) -> Bitmaps:
        return Bitmaps(self.key[rows], self.block[rows], self.bits[rows])

    def __len__(self) -> int:
        return len(self.key)


def gathered(key: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
    """Bitmaps of entries in any order: those of one key and block are joined by OR."""
    code = key.astype(np.int64) << 32 | block
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
    code = code[first]
    return Bitmaps((code >> 32).astype(np.int64), code & 0xFFFFFFFF, np.bitwise_or.reduceat(bits[order], first) if len(first) else bits)


@dataclass
class Shard:
    """The words of a shard by block, and the positions at which pieces begin."""

    words: Bitmaps
    pointers: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: Bitmaps, starts: np.ndarray) -> Shard:
        order = np.argsort(words.block, kind="stable")
        return cls(words[order], np.searchsorted(words.block[order], np.arange(len(starts) + 1)), starts)

    def extended(self, front: Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each phrase of ``front`` with every word that follows it: (phrase, word, block, bits) entries."""
        # Shift; bits that leave a block go to the next one.
        over = np.flatnonzero(front.bits >> (BLOCK - 1))
        over = over[front.block[over] + 1 < len(self.starts)]
        key = np.concatenate((front.key, front.key[over]))
        block = np.concatenate((front.block, front.block[over] + 1))
        bits = np.concatenate(((front.bits << np.uint16(1)).astype(np.uint16), np.ones(len(over), np.uint16)))
        bits &= ~self.starts[block]
        left = np.flatnonzero(bits)
        key, block, bits = key[left], block[left], bits[left]
        # AND with each word of the block.
        many = self.pointers[block + 1] - self.pointers[block]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.pointers[block] - (ends - many), many)
        both = np.repeat(bits, many) & self.words.bits[at]
        hit = np.flatnonzero(both)
        at, of = at[hit], np.repeat(np.arange(len(block)), many)[hit]
        return key[of], self.words.key[at], block[of], both[hit]


def children(parent: np.ndarray, word: np.ndarray, block: np.ndarray, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
    """The phrases among entries of ``extended``: their parents, their last words, their counts
    and their bitmaps, whose keys number them."""
    code = parent * width + word
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return code[first] // width, code[first] % width, counts, Bitmaps(np.cumsum(new) - 1, block[order], bits[order])


def fronts(words: Bitmaps, size: int = FRONT):
    """The bitmaps of some keys at a time, those of one key together."""
    borders = np.flatnonzero(np.append(True, words.key[1:] != words.key[:-1])) if len(words) else np.zeros(0, int)
    a = 0
    while a < len(words):
        later = borders[np.searchsorted(borders, a + size)] if a + size <= (borders[-1] if len(borders) else 0) else len(words)
        yield words[a:later]
        a = later


def pairs(shard: Shard, words: Bitmaps, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of words that stand next to each other in a piece, and their counts."""
    out = []
    for front in fronts(words):
        first, second, n, _ = children(*shard.extended(front), width)
        out.append((first, second, n))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def longer(shard: Shard, words: Bitmaps, width: int, frequent: np.ndarray, longest: int):
    """Phrases of 3 to ``longest`` words all whose pairs are in ``frequent`` (sorted, first * width +
    second), and their counts, some at a time: (words by column, counts)."""

    def allowed(code):
        at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
        return frequent[at] == code

    def deeper(phrases: np.ndarray, front: Bitmaps):
        for part in fronts(front):
            entries = shard.extended(part)
            keep = np.flatnonzero(allowed(phrases[entries[0], -1] * width + entries[1]))
            parent, word, n, maps = children(*[e[keep] for e in entries], width)
            if not len(n):
                continue
            grown = np.column_stack((phrases[parent], word))
            if grown.shape[1] > 2:
                yield grown, n
            if grown.shape[1] < longest:
                yield from deeper(grown, maps)

    if len(frequent):
        yield from deeper(np.arange(width)[:, None], words)


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of ``docs`` (lang, text), written as a table (:data:`SHARDS`)."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        ids: dict[str, list[np.ndarray]] = defaultdict(list)
        known: dict[str, dict[bytes, int]] = {}

        def rows():
            nonlocal number
            for lang in sorted(ids):
                stream = np.concatenate(ids[lang])
                mark = known[lang][_MARK]
                at_mark = stream == mark
                word = stream[~at_mark]
                begins = np.append(True, at_mark[:-1])[~at_mark]  # a word after a mark begins a piece; texts end with one
                names = sorted(known[lang], key=known[lang].get)
                position = np.arange(len(word))
                maps = gathered(word, position // BLOCK, (np.uint16(1) << (position % BLOCK).astype(np.uint16)).astype(np.uint16))
                begin = np.flatnonzero(begins)
                starts = np.zeros(-(-len(word) // BLOCK), np.uint16)
                np.bitwise_or.at(starts, begin // BLOCK, (np.uint16(1) << (begin % BLOCK).astype(np.uint16)).astype(np.uint16))
                counts = np.bincount(word, minlength=len(names))
                yield part << 32 | number, lang, len(word), [w.decode() if i != mark else "" for i, w in enumerate(names)], counts.astype("<i8").tobytes(), maps.key.astype("<u4").tobytes(), maps.block.astype("<u4").tobytes(), maps.bits.astype("<u2").tobytes(), starts.astype("<u2").tobytes()
                number += 1
            ids.clear()
            known.clear()

        def batch_of(found):
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # bytes.lower() lowers A-Z alone, and split() parts at the whitespace of ASCII, of which spaces are left.
                words = (text.encode().lower().translate(_ENDS).replace(_MARK, b" \xff ") + b" \xff").split(b" ")
                if lang not in known:
                    numbers: defaultdict[bytes, int] = defaultdict()
                    numbers.default_factory = numbers.__len__
                    known[lang] = numbers
                stream = np.fromiter(map(known[lang].__getitem__, filter(None, words)), np.int64)
                ids[lang].append(stream)
                held += len(stream)
                if held >= size:
                    yield batch_of(list(rows()))
                    held = 0
        if ids:
            yield batch_of(list(rows()))

    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), common.text_of().alias("text"))
    return common.saved(docs.mapInArrow(cut, SHARDS), codec="zstd")


def _array(column, i: int, dtype: str) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), dtype).astype(np.int64 if dtype != "<u2" else np.uint16)


def phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): the frequent words (id, lang, word, f) and with them ``n``, the words of the
    language; the frequent phrases of 2 to ``longest`` words (lang, words, f)."""
    spark = docs.sparkSession
    parts = common.pieces(docs, PART_BYTES, 2 * spark.sparkContext.defaultParallelism, F.octet_length(common.text_of()))
    cut = shards(docs, size)

    def deal_words(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                counts = _array(batch.column("counts"), i, "<i8")
                words = [w.encode() for w in batch.column("words")[i].as_py()]
                part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
                part[counts == 0] = parts  # the mark is no word
                order = np.argsort(part, kind="stable")
                found = []
                for p, lo, hi in runs(part[order]):
                    if p < parts:
                        mine = order[lo:hi]
                        names = zstandard.ZstdCompressor(level=3).compress(b" ".join([words[k] for k in mine.tolist()]))
                        found.append((p, struct.pack("<I", len(names)) + names + packed(np.diff(mine, prepend=0), counts[mine])))
                head = [pa.array([batch.column(c)[i].as_py()] * len(found), t) for c, t in (("shard", pa.int64()), ("lang", pa.string()))]
                yield pa.RecordBatch.from_arrays([*head, pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "lang", "part", "blob"])

    def count_words(key, table):
        """The frequent words of a part, and which of them each shard has."""
        import pyarrow as pa

        part = key[0].as_py()
        total: dict[tuple[str, bytes], int] = defaultdict(int)
        asked = []
        for shard, lang, blob in zip(table.column("shard").to_pylist(), table.column("lang").to_pylist(), table.column("blob").to_pylist()):
            (n,) = struct.unpack_from("<I", blob)
            words = zstandard.ZstdDecompressor().decompress(blob[4 : 4 + n]).split(b" ")
            gaps, counts = unpacked(blob[4 + n :])
            for w, c in zip(words, counts.tolist()):
                total[lang, w] += c
            asked.append((shard, lang, words, np.cumsum(gaps)))
        often = sorted((k for k, c in total.items() if c >= least), key=lambda k: (-total[k], k))  # small numbers for many
        number = {k: i * parts + part + 1 for i, k in enumerate(often)}
        rows = [(None, None, number[k], k[0], k[1].decode(), total[k]) for k in often]
        for shard, lang, words, ks in asked:
            ids = np.fromiter((number.get((lang, w), 0) for w in words), np.int64, len(words))
            mine = np.flatnonzero(ids)
            if len(mine):
                rows.append((shard, packed(np.diff(ks[mine], prepend=0), ids[mine]), None, None, None, None))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "told", "id", "lang", "word", "f"])

    words = cut.select("shard", "lang", "words", "counts").mapInArrow(deal_words, "shard long, lang string, part int, blob binary")
    words = common.saved(words.groupBy("part").applyInArrow(count_words, "shard long, told binary, id long, lang string, word string, f long"))
    totals = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where("id IS NOT NULL").join(totals, "lang").select("id", "lang", "word", "f", "n")
    # Each shard's own frequent words: their numbers there and over all.
    told = words.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("told").alias("told"))
    ready = common.saved(cut.select("shard", "word", "block", "bits", "starts").join(told, "shard"), codec="zstd")

    def opened(batch, i):
        """A shard's frequent words, numbered anew, and their ids over all."""
        found = [unpacked(blob) for blob in batch.column("told")[i].as_py()]
        old, ids = np.concatenate([np.cumsum(g) for g, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(old)
        old, ids = old[order], ids[order]
        word = _array(batch.column("word"), i, "<u4")
        at = np.minimum(np.searchsorted(old, word), len(old) - 1)
        rows = np.flatnonzero(old[at] == word)
        maps = Bitmaps(at[rows], _array(batch.column("block"), i, "<u4")[rows], _array(batch.column("bits"), i, "<u2")[rows])
        return Shard.of(maps, _array(batch.column("starts"), i, "<u2")), maps, ids

    def blobs_of(shard: int, grams: np.ndarray, n: np.ndarray):
        """A shard's phrases (a column a word) and counts, dealt to parts: (shard, part, blob) rows."""
        import pyarrow as pa

        part = np.zeros(len(n), np.uint64)
        for column in grams:
            part = mixed(part, column)
        part = (part % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((*grams[::-1], part))
        found = [(p, packed(np.diff(grams[0][order[lo:hi]], prepend=0), *[g[order[lo:hi]] for g in grams[1:]], n[order[lo:hi]])) for p, lo, hi in runs(part[order])]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "part", "blob"])

    def find_pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, maps, ids = opened(batch, i)
                a, b, n = pairs(shard, maps, len(ids))
                yield blobs_of(batch.column("shard")[i].as_py(), np.stack((ids[a], ids[b])), n)

    columns = [f"w{j}" for j in range(1, longest + 1)]

    def count_phrases(tell: bool):
        """Sums a part's phrases up; with ``tell``, shards are told which of theirs are frequent."""

        def count(key, table):
            import pyarrow as pa

            asked = []
            for shard, blob in zip(table.column("shard").to_pylist(), table.column("blob").to_pylist()):
                first, *more = unpacked(blob)
                asked.append((shard, np.stack((np.cumsum(first), *more))))
            every = np.concatenate([g for _, g in asked], axis=1)
            order, first = grouped(*every[:-1])
            total = summed(every[-1][order], first)
            often = total[np.searchsorted(first, np.arange(len(order)), side="right") - 1] >= least
            kept = np.flatnonzero(total >= least)
            grams = np.zeros((longest, len(kept)), np.int64)
            grams[: len(every) - 1] = every[:-1, order[first[kept]]]
            shard, told = [None] * len(kept), [None] * len(kept)
            if tell:
                mark = np.zeros(every.shape[1], bool)
                mark[order] = often
                at = 0
                for s, g in asked:
                    mine = g[:-1, mark[at : at + g.shape[1]]]
                    at += g.shape[1]
                    if mine.shape[1]:
                        shard.append(s)
                        told.append(packed(np.diff(mine[0], prepend=0), *mine[1:]))
            more = [None] * (len(shard) - len(kept))
            rows = [pa.array([*g.tolist(), *more], pa.int64()) for g in (*grams, total[kept])]
            return pa.table([pa.array(shard, pa.int64()), pa.array(told, pa.binary()), *rows], names=["shard", "told", *columns, "f"])

        return count

    shape = "shard long, told binary, " + ", ".join(f"{c} long" for c in [*columns, "f"])
    two = ready.mapInArrow(find_pairs, "shard long, part int, blob binary")
    two = common.saved(two.groupBy("part").applyInArrow(count_phrases(True), shape))
    mine = two.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("told").alias("pairs"))

    def find_longer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, maps, ids = opened(batch, i)
                known = [unpacked(blob) for blob in batch.column("pairs")[i].as_py()]
                order = np.argsort(ids)
                a, b = (order[np.searchsorted(ids[order], np.concatenate(x))] for x in ([np.cumsum(g) for g, _ in known], [w for _, w in known]))
                found, counts = [], []
                for grams, n in longer(shard, maps, len(ids), np.sort(a * len(ids) + b), longest):
                    out = np.zeros((longest, len(n)), np.int64)
                    out[: grams.shape[1]] = ids[grams].T
                    found.append(out)
                    counts.append(n)
                if found:
                    yield blobs_of(batch.column("shard")[i].as_py(), np.concatenate(found, axis=1), np.concatenate(counts))

    every = two.where("shard IS NULL").select(*columns, "f")
    if longest > 2:
        more = ready.join(mine, "shard").mapInArrow(find_longer, "shard long, part int, blob binary")
        every = every.unionByName(more.groupBy("part").applyInArrow(count_phrases(False), shape).select(*columns, "f"))
    every = every.select(F.filter(F.array(*columns), lambda w: w > 0).alias("ids"), "f")
    each = every.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    named = each.groupBy("ids").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    return frequent, common.saved(named.select("lang", F.transform("words", lambda w: w["word"]).alias("words"), "f"))


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    words, many = phrases(docs, least=least, longest=longest, size=size)
    counted = many.unionByName(words.select("lang", F.array("word").alias("words"), "f"))
    size_of = F.size("words")
    # Within a longer candidate of the same count: its first words but one, or its last.
    inner = many.where(size_of > 2).select("lang", "f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    kept = many.join(inner, ["lang", "words", "f"], "left_anti")
    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size_of - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words))").alias("rest"))
    cuts = cuts.join(counted.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counted.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words.groupBy("lang").agg(F.first("n").alias("n")), "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r")}
    score = F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases by how much more often their words stand together than by chance."""
    return collocations(common.table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '')"
SQL = f"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered),
cut AS (SELECT lang, words FROM (SELECT lang, {_WORDS} AS words FROM pieces) WHERE len(words) > 0),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, k, words[i:i + k - 1] AS words
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)),
counted AS (SELECT lang, k, words, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, words HAVING count(*) >= 100),
inner_of AS (
  SELECT DISTINCT lang, f, words[s:s + m - 1] AS words
  FROM (SELECT lang, f, words, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM counted WHERE k > 2))),
kept AS (SELECT c.lang, c.k, c.words, c.f AS a FROM counted c WHERE c.k > 1 AND NOT EXISTS (SELECT 1 FROM inner_of i WHERE i.lang = c.lang AND i.words = c.words AND i.f = c.f)),
cuts AS (SELECT lang, words, k AS size, a, unnest(range(1, k)) AS j FROM kept),
scored AS (
  SELECT c.lang, c.words, c.a, c.j, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.words = c.words[1:c.j] JOIN counted y ON y.lang = c.lang AND y.words = c.words[c.j + 1:c.size] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
