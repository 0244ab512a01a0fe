"""Packing documents into windows of tokens by non-negative least squares.

Documents are cut at whole windows; what is left of each, shorter than a window, is
counted in a histogram of lengths rounded up to ``unit`` tokens.  Repeat counts of the
combinations of at most ``depth`` such lengths that fill a window are solved against the
histogram by non-negative least squares.  Combinations are enumerated one by one as the
solver asks for them: the one whose residuals sum up highest is the best filling of a
knapsack of the window's size.  Counts are rounded down, so that no length is used more
often than it occurs.

What is left of the histogram is packed greedily: combinations of the longest lengths that
fit, as often as they can be had, if they leave at most one unit free.  Documents take the
slots of their length by rank.  What finds no slot is laid end to end and cut at the windows.

Only the histogram (window / unit numbers) reaches the driver.  Ranks and places are
sums over chunks of rows of the tasks that tokenised the documents (see
:func:`common.offsets`), so no task sees all documents, or all of a length.

Defined cases: a null text is empty (one token, its end); rows that repeat a doc_id are
documents of their own; a null doc_id stays null; an empty table gives no row; other
columns are ignored; a document over a window long spans several sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_store import END_ID, TOKENIZER, encoded

WINDOW = 4096
UNIT = 16
DEPTH = 12


def best_combination(worth: np.ndarray, depth: int) -> tuple[float, np.ndarray]:
    """The multiset of at most ``depth`` lengths (1 to the number of ``worth``) that sum to
    that number and whose worth is highest: that worth, and how often each length is in it."""
    parts = len(worth)
    best = np.full(parts + 1, -np.inf)
    best[0] = 0.0
    choices = []
    at = np.arange(parts + 1)
    back = at[:, None] - np.arange(1, parts + 1)[None, :]  # room before a length is added
    for _ in range(depth):
        with_one = np.where(back >= 0, best[np.maximum(back, 0)] + worth[None, :], -np.inf)
        pick = with_one.argmax(axis=1)
        more = with_one[at, pick]
        better = more > best
        choices.append(np.where(better, pick + 1, 0))
        best = np.where(better, more, best)
    counts, room = np.zeros(parts, int), parts
    for step in reversed(choices):
        if step[room]:
            counts[step[room] - 1] += 1
            room -= step[room]
    return float(best[parts]), counts


def nnls(offer, b: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): x > 0 that minimises |rows.T x - b|, the rows being those of ``offer`` that
    are used: active sets after Lawson and Hanson.  ``offer(r)`` gives the row whose inner
    product with r is highest, and that product."""
    rows, x = np.zeros((0, len(b))), np.zeros(0)
    small = 1e-7 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope, row = offer(b - x @ rows)
        if not slope > small or (rows == row).all(axis=1).any():
            break
        rows, x = np.vstack((rows, row)), np.append(x, 0.0)
        while len(rows):
            gram = rows @ rows.T
            z = np.linalg.solve(gram + 1e-12 * np.trace(gram) * np.eye(len(gram)), rows @ b)
            if (z > 0).all():
                x = z
                break
            low = z <= 0
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            on = x > 1e-12
            rows, x = rows[on], x[on]
    return rows, x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(combinations that are used, as rows of counts by length; how often each is)."""
    total = float(histogram.sum())
    absent = histogram == 0

    def offer(r: np.ndarray) -> tuple[float, np.ndarray]:
        return best_combination(np.where(absent, -np.inf, r), depth)

    rows, x = nnls(offer, histogram / total) if total else (np.zeros((0, len(histogram))), np.zeros(0))
    times = np.floor(x * total + 1e-6).astype(int)
    for i in range(len(histogram)):  # the fit may ask for more than there is
        over = int(rows[:, i] @ times - histogram[i])
        for j in np.argsort(-times * (rows[:, i] > 0), kind="stable"):
            if over <= 0:
                break
            if rows[j, i]:
                less = min(times[j], -(-over // int(rows[j, i])))
                times[j] -= less
                over -= less * int(rows[j, i])
    used = np.flatnonzero(times)
    return rows[used].astype(int), times[used]


def greedy(left: np.ndarray, slack: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Combinations of lengths of the histogram ``left``, the longest that fit first, that
    leave at most ``slack`` units of a window free, and how often each is used."""
    left, parts = left.astype(int).copy(), len(left)
    rows, times = [], []
    longest = parts
    while longest:
        if not left[longest - 1]:
            longest -= 1
            continue
        row, room = np.zeros(parts, int), parts
        while room:
            fits = np.flatnonzero(left[:room] > row[:room])
            if not len(fits):
                break
            i = int(fits[-1])
            row[i] += min(room // (i + 1), left[i] - row[i])
            room = parts - int(row @ np.arange(1, parts + 1))
        if room > slack:  # no shorter length fills it up: this one is laid end to end
            left[longest - 1] = 0
            continue
        n = int((left[row > 0] // row[row > 0]).min())
        left -= n * row
        rows.append(row)
        times.append(n)
    return np.array(rows, int).reshape(-1, parts), np.array(times, int)


def slots(rows: np.ndarray, times: np.ndarray) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length class the runs of its slots (first rank, count, first sequence,
    place in the sequence), and the number of sequences."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, first = np.zeros(rows.shape[1] if len(rows) else 0, int), 0
    for row, n in zip(rows, times.tolist(), strict=True):
        place = 0
        for i in np.flatnonzero(row)[::-1]:  # longest first
            for _ in range(row[i]):
                runs.setdefault(int(i) + 1, []).append((int(rank[i]), n, first, place))
                rank[i] += n
                place += 1
        first += n
    return runs, first


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, k, ids, n``: every document's ids (unsigned, little-endian, as wide as
    the vocabulary needs) with the end id, and the task and row that made them.  Written once."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokenizing import WordBpe, loaded

        dtype = loaded(WordBpe, tokenizer).dtype
        end, part, k = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId(), 0
        for rows, ids in encoded(batches, tokenizer):
            out = [raw + end for raw in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * len(out), pa.int64()), pa.array(range(k, k + len(out)), pa.int64()), pa.array(out, pa.binary()), pa.array([len(x) // dtype.itemsize for x in out], pa.int64())], names=["doc_id", "part", "k", "ids", "n"])
            k += len(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    with common.text_batches(docs.sparkSession):
        return common.saved(rows.mapInArrow(run, "doc_id long, part long, k long, ids binary, n long"), codec="zstd")


def place(lengths: DataFrame, *, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Where each piece goes: part, k, start, length, sequence_id, place, base.

    ``lengths``: part, k, n, a row for each document; (part, k) tells rows apart.  ``base``:
    the offset of a piece whose sequence is laid end to end or a window by itself; null
    where the pieces before it in its sequence say."""
    rest = F.col("n") % window
    rows = lengths.select("part", "k", "n", rest.alias("rest"), F.ceil(rest / unit).cast("int").alias("cls"), F.lit(1).alias("one"))
    histogram = np.zeros(window // unit)
    for r in rows.where("cls > 0").groupBy("cls").count().collect():  # window / unit rows at most
        histogram[r["cls"] - 1] = r["count"]
    fitted_rows, times = plan(histogram, depth)
    more, more_times = greedy(histogram - (times @ fitted_rows if len(times) else 0))
    runs, packed = slots(np.concatenate((fitted_rows, more)), np.concatenate((times, more_times)))
    tables = {c: tuple(np.array(x) for x in zip(*r)) for c, r in runs.items()}
    # The rank in a length class decides the seat.
    ranked = common.offsets(rows.where("cls > 0"), "one", ("cls",), chunk=4096).select("part", "k", "n", "rest", "cls", F.col("at").alias("rank"))

    def seats(frames):
        for pdf in frames:
            cls, rank = pdf["cls"].to_numpy(), pdf["rank"].to_numpy()
            seq, pos = np.full(len(pdf), -1), np.full(len(pdf), -1)
            for c in np.unique(cls):
                if int(c) in tables:
                    first, count, seq0, where = tables[int(c)]
                    at = np.flatnonzero((cls == c) & (rank < first[-1] + count[-1]))
                    run = np.searchsorted(first, rank[at], side="right") - 1
                    seq[at], pos[at] = seq0[run] + rank[at] - first[run], where[run]
            yield pdf.assign(seq=seq, pos=pos)[["part", "k", "n", "rest", "seq", "pos"]]

    seated = common.saved(ranked.mapInPandas(seats, "part long, k long, n long, rest long, seq long, pos long"))
    start = F.col("n") - F.col("rest")
    fitted = seated.where("seq >= 0").select("part", "k", start.alias("start"), F.col("rest").alias("length"), F.col("seq").alias("sequence_id"), F.col("pos").alias("place"), F.lit(None).cast("long").alias("base"))

    # Laid end to end and cut at the windows.
    laid = common.offsets(seated.where("seq < 0"), "rest")
    laid = laid.withColumn("w", F.explode(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + rest - 1) div {window}"))))
    lo, hi = F.greatest(F.col("at"), F.col("w") * window), F.least(F.col("at") + F.col("rest"), (F.col("w") + 1) * window)
    laid = laid.select("part", "k", (start + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), (F.col("w") + packed).alias("sequence_id"), F.lit(0).cast("long").alias("place"), (lo - F.col("w") * window).alias("base"))

    # Whole windows are sequences of their own, numbered after these.
    total = seated.where("seq < 0").agg(F.sum("rest").alias("s")).first()["s"] or 0
    shift = packed + -(-total // window)
    whole = common.offsets(rows.where(f"n >= {window}").withColumn("full", F.expr(f"n div {window}")), "full")
    whole = whole.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    whole = whole.select("part", "k", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (shift + F.col("at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("base"))
    return fitted.unionByName(laid).unionByName(whole)


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, start, length, ids (their token ids,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, tokenizer, end_id)
    pieces = place(tokens.select("part", "k", "n"), window=window, unit=unit, depth=depth)
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    shared = pieces.where("base is null").withColumn("base", ahead)
    pieces = shared.unionByName(pieces.where("base is not null"))
    cuts = pieces.groupBy("part", "k").agg(F.collect_list(F.struct("start", "length", "sequence_id", F.col("base").alias("offset"))).alias("cuts"))

    def slices(batches):
        import pyarrow as pa

        from .tokenizing import WordBpe, loaded

        dtype = loaded(WordBpe, tokenizer).dtype
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                docs_, ids, n, cut = (batch.slice(at, 512).column(i).to_pylist() for i in range(4))
                rows = [(d, c["start"], c["length"], np.frombuffer(raw, dtype)[c["start"] : c["start"] + c["length"]].astype("<u4").tobytes(), m, c["sequence_id"], c["offset"]) for d, raw, m, cs in zip(docs_, ids, n, cut) for c in cs]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(cuts, ["part", "k"]).select("doc_id", "ids", "n", "cuts").mapInArrow(slices, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place and checksum."""
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
