"""Language identification by prediction by partial matching.

For each language a context tree over bytes is learned: how often each byte followed
each context of 0 to ``order`` bytes.  With these statistics frozen, a byte's code
length follows its longest known context; a byte not seen there costs an escape
(method C: as likely as the context has distinct followers) and is coded in the next
shorter context without the bytes already ruled out, at last evenly over all 256.  A
text's language is the one that codes it shortest.

Only n-grams that were seen are stored: a row of code lengths by language for each, in
sorted tables, one for each length.  A byte that no language saw in its context pays that
context's escape and is looked up in the next shorter one.  What an escape rules out there
depends on the context alone, so each context holds two escapes a language: one before a
byte that the shorter context knows, one before another escape.  This gives the exact code
length, and the model grows with the n-grams of the sample, not with all that could be.

The trees are learned from at most about ``train_docs`` labelled texts a language,
drawn by a hash of their ids with a threshold that each language's count sets; n-grams
are counted by Spark.  Only the model, whose size those texts bound, reaches the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language or text teach nothing; without any language all texts are ``und``;
repeated rows are judged alike; long texts are judged whole, piece by piece; a null doc_id
is not held out and, having no id to draw by, teaches nothing; an empty table gives no
row; other columns, whatever their names, are ignored or kept in a struct of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import common

ORDER = 3
#: Labelled texts that teach a language, about: the bound of the sample.
TRAIN_DOCS = 400
#: Every text whose id's crc32 leaves this remainder is held out.
FOLDS, HELD_OUT = 4, 2
#: Bytes that the score takes a text to have at most: beyond them it would be 1 always.
SCORE_BYTES = 24
UNKNOWN = "und"
#: Rows that a task hands back at once.
ROWS = 256


def held_out(doc_id: Column) -> Column:
    """Whether a text's id keeps it out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Level:
    """The n-grams of one length: ``grams`` (their bytes as one number, sorted), ``bits`` (a row
    of code lengths of the last byte after the others, by language) and ``seen`` (by which
    languages); and their contexts, ``contexts``, with both escapes by language."""

    grams: np.ndarray
    bits: np.ndarray
    seen: np.ndarray
    contexts: np.ndarray
    before_hit: np.ndarray
    before_miss: np.ndarray


@dataclass
class Model:
    """``levels[n - 1]``: the n-grams of length n.  ``unknown``: the code length of a byte
    that no language ever saw."""

    languages: list[str]
    levels: list[Level]
    unknown: np.ndarray

    def lengths(self, data: bytes) -> np.ndarray:
        """The code length of some text in each language, in bits."""
        total, order, step = np.zeros(len(self.languages)), len(self.levels) - 1, 1 << 15
        for at in range(0, len(data), step):
            lo = max(0, at - order)
            total += self._part(np.frombuffer(data[lo : at + step], np.uint8).astype(np.int64), at - lo)
        return total

    def _part(self, s: np.ndarray, first: int) -> np.ndarray:
        """The code length of the bytes of ``s`` from ``first`` on, those before being context."""
        total = np.zeros(len(self.languages))
        codes = [s]  # codes[n - 1][i]: the n bytes that end at i
        for n in range(1, len(self.levels)):
            c = codes[-1].copy()
            c[n:] += s[:-n] << (8 * n)
            codes.append(c)
        todo = np.arange(first, len(s))
        owed = None  # by each byte of todo: its two escapes of the longer context
        for n in range(len(self.levels), 0, -1):
            level = self.levels[n - 1]
            deep = todo >= n - 1
            early = None if deep.all() else todo[~deep]
            if early is not None:  # too near the start for this length: nothing is owed yet
                todo = todo[deep]
                owed = owed and tuple(e[deep] for e in owed)
            found, at = _find(level.grams, codes[n - 1][todo])
            hit = at[found]
            total += level.bits[hit].sum(axis=0, dtype=np.float64)
            if owed is not None:
                total += np.where(level.seen[hit], owed[0][found], owed[1][found]).sum(axis=0, dtype=np.float64)
                total += owed[1][~found].sum(axis=0, dtype=np.float64)
            todo = todo[~found]
            if n == 1:
                break
            known, c = _find(level.contexts, codes[n - 1][todo] >> 8)
            owed = tuple(np.where(known[:, None], e[c], 0) for e in (level.before_hit, level.before_miss))
            if early is not None:
                todo = np.concatenate((early, todo))
                owed = tuple(np.concatenate((np.zeros((len(early), e.shape[1])), e)) for e in owed)
        return total + len(todo) * self.unknown


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each number is in a sorted table, and where."""
    at = np.minimum(np.searchsorted(table, wanted), max(0, len(table) - 1))
    return (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool), at


def train(labelled: DataFrame, *, order: int = ORDER) -> Model:
    """The model of ``labelled`` (lang, text): its rows' n-grams are counted by Spark."""

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes = []
                for lg, text in zip(langs, texts):
                    if lg != lang:
                        continue
                    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                    for n in range(1, order + 2):
                        if len(b) >= n:
                            c = np.full(len(b) - n + 1, n, np.int64)
                            for j in range(n):
                                c = c * 256 + b[j : len(b) - n + 1 + j]
                            codes.append(c)
                if codes:
                    c, k = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c), pa.array(k)], names=["lang", "gram", "c"])

    counted = labelled.select("lang", "text").mapInArrow(grams, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    table = counted.toArrow()
    langs = table["lang"].to_pylist()
    languages = sorted(set(langs))
    index = {lg: i for i, lg in enumerate(languages)}
    return build(languages, order, np.array([index[x] for x in langs], np.int64), table["gram"].to_numpy(), table["c"].to_numpy())


def build(languages: list[str], order: int, lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """The model of counted n-grams (a code holds n, then n bytes)."""
    some = max(1, len(languages))
    log2 = lambda x: np.log2(np.where(x > 0, x, 1))
    levels: list[Level] = []
    n_all, n_kinds = np.zeros((1, some)), np.zeros((1, some))  # of each context of the level before
    contexts = counts = lower = None
    for n in range(1, order + 2):
        mine = np.flatnonzero(gram >> (8 * n) == n)
        code = gram[mine] & ((1 << (8 * n)) - 1)
        grams = np.unique(code)
        c = np.zeros((len(grams), some))
        c[np.searchsorted(grams, code), lang[mine]] = count[mine]
        ctx, of = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.zeros((len(ctx), some)), np.zeros((len(ctx), some))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        escape = log2(total + kinds) - log2(kinds)  # 0 where the language does not know the context
        hit = log2((total + kinds)[of]) - log2(c)
        if n == 1:
            unknown = escape[0] + np.log2(np.maximum(1, 256 - kinds[0])) if len(ctx) else np.full(some, 8.0)
            bits = np.where(c > 0, hit, unknown)
            before_hit = before_miss = np.zeros((len(ctx), some))
        else:
            shorter = np.searchsorted(lower, grams & ((1 << (8 * (n - 1))) - 1))  # each gram without its first byte
            same = np.zeros((len(ctx), some))
            np.add.at(same, of, np.where(c > 0, counts[shorter], 0))
            up = np.searchsorted(contexts, ctx & ((1 << (8 * max(0, n - 2))) - 1)) if n > 2 else np.zeros(len(ctx), int)
            left, kinds_left = n_all[up] - same, n_kinds[up] - kinds  # in the shorter context, without what is ruled out
            knows, some_left = kinds > 0, kinds_left > 0
            before_hit = np.where(knows, escape + log2(left + kinds_left) - log2(n_all[up] + n_kinds[up]), 0)
            plain = log2(n_all[up] + n_kinds[up]) - log2(n_kinds[up])
            before_miss = np.where(knows, escape - plain + np.where(some_left, log2(left + kinds_left) - log2(kinds_left), 0), 0)
            owed = np.where(counts[shorter] > 0, before_hit[of], before_miss[of])
            bits = np.where(c > 0, hit, owed + levels[-1].bits[shorter])
        levels.append(Level(grams, bits, c > 0, ctx, before_hit, before_miss))
        n_all, n_kinds, contexts, counts, lower = total, kinds, ctx, c, grams
    return Model(languages, levels, unknown)


def sample(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, keep: Column | None = None) -> DataFrame:
    """About ``train_docs`` labelled rows a language (lang, text), drawn by a hash of doc_id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id").cast("long")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (draw < train_docs / r["n"]))
    return rows.where(chosen).select("lang", "text")


def predict(docs: DataFrame, model: Model, *, keep: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``bits_per_byte`` of each row of ``docs`` (doc_id,
    text); with ``keep`` also ``row``, a struct of all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    head = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")]
    others = docs.drop("text").columns  # the text goes to the tasks once
    if keep:
        head.append(F.struct(*[common.named("d", c).alias(c) for c in others]).alias("row"))
    rows = docs.alias("d").select(*head)
    fields = [StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]
    fields += [StructField(c, rows.schema[c].dataType) for c in ("text", "row")] if keep else []

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            names, scores, rates = [], [], []
            for text in part.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                if not m.languages or not text or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rates.append(None)
                    continue
                bits = m.lengths(data)
                best = int(bits.argmin())
                odds = np.exp2((bits[best] - bits) * min(1.0, SCORE_BYTES / len(data)))
                names.append(m.languages[best])
                scores.append(float(1 / odds.sum()))
                rates.append(float(bits[best] / len(data)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), *(part.columns[1:] if keep else [])], names=[f.name for f in fields])

    found = rows.mapInArrow(run, StructType(fields))
    if not keep:
        return found
    row = F.struct(*[(F.col("row").getField(c) if c in others else F.col("text")).alias(c) for c in docs.columns])
    return found.select("doc_id", "lang_pred", "score", "bits_per_byte", row.alias("row"))


def identify(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, order: int = ORDER, keep: bool = False) -> DataFrame:
    """:func:`predict` with a model of the rows of ``docs`` that are not held out."""
    model = train(sample(docs, train_docs=train_docs, keep=~held_out(F.col("doc_id"))), order=order)
    return predict(docs, model, keep=keep)


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, whether it was held out, and how sure the choice is."""
    found = identify(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
