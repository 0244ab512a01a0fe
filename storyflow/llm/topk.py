"""Exact top-k by inner product, after Fagin, Lotem and Naor's no-random-access algorithm.

A block of vectors has one list for each dimension, sorted by component.  A query reads
the lists of its positive weights from the top and those of its negative ones from the
bottom, batch by batch, all to the same depth.  What it has read of a vector, with the
least (most) that the unread lists can still add, bounds the vector's score from below
(above); bounds are worked out only for vectors that may still be among the k best.
Reading stops when no other vector's upper bound reaches the k-th lower bound, and goes on
only until the vectors left have been met in every list, which resolves their scores.  A bit
an entry tells what has been read; no entry is looked up by its vector.

Vectors and queries are dealt into blocks of bounded size that meet in pairs: a stated
query set against all rows.  Each pair gives k rows a query, and those are merged by
query.

Defined cases: vectors that are null or hold a null or non-finite component, and rows of
a null id, take no part; vectors are compared with queries of their own number of
components only; ties go to the smaller id; rows that repeat an id are rows of their own,
and a query leaves out its own row alone; an empty table gives no row; other columns are
ignored; of components so large that scores leave 53 bits, bounds are kept as whole numbers
of any size, and a score is cut to 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
EVERY = 50
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024
#: The first batch of a list and the largest one, as parts of it; batches double in between.
FIRST_BATCH, LARGEST_BATCH = 1 / 32, 1 / 8


#: Leaders whose lower bounds give the k-th one, and vectors that are tried before all are bounded.
LEADERS, TRIED = 64, 128


class Lists:
    """The sorted lists of a block of vectors (rows of ``x``), one for each dimension."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        lists = np.ascontiguousarray(x.T)
        order = np.argsort(lists, axis=1, kind="stable")
        values = np.take_along_axis(lists, order, axis=1)
        #: By the order of reading: from the top, from the bottom.
        self.order, self.values = (np.ascontiguousarray(order[:, ::-1]), order), (np.ascontiguousarray(values[:, ::-1]), values)

    def best(self, weights: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The rows that are among the k best for ``weights``, with those that tie with the
        last, their scores, and how many entries of the lists were read.  ``own``: the row
        that is left out, or -1."""
        n, up, down = self.n, np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        alive = np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
        w = weights[np.concatenate((up, down))]
        m, depth, batch = len(w), 0, max(1, int(n * FIRST_BATCH))
        read = np.zeros(n, w.dtype)
        seen = np.zeros((n, m), bool)
        bits = seen.reshape(-1)
        last = w * np.concatenate((self.values[0][up, -1], self.values[1][down, -1])) if n else w

        def read_to(end: int) -> None:
            nonlocal depth
            wanted = None
            if len(alive) < n // 4:  # entries of vectors that are out are passed over
                wanted = np.zeros(n, bool)
                wanted[alive] = True
            for side, (dims, first) in enumerate(((up, 0), (down, len(up)))):
                at = self.order[side][dims, depth:end]
                gain = self.values[side][dims, depth:end] * weights[dims, None]
                bit = at * m + np.arange(first, first + len(dims))[:, None]
                if wanted is not None:
                    on = wanted[at]
                    at, bit, gain = at[on], bit[on], gain[on]
                else:
                    at, bit, gain = at.ravel(), bit.ravel(), gain.ravel()
                bits[bit] = True
                if gain.dtype == object:
                    np.add.at(read, at, gain)
                elif len(at):
                    read.__iadd__(np.bincount(at, gain, n))
            depth = end

        def bounds(of: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            unread = (~seen[of]).astype(w.dtype)
            return read[of] + unread @ last, read[of] + unread @ front

        while depth < n and len(alive) > k and m:
            read_to(min(n, depth + batch))
            batch = min(2 * batch, max(1, int(n * LARGEST_BATCH)))
            front = w * np.concatenate((self.values[0][up, depth - 1], self.values[1][down, depth - 1]))
            few = min(len(alive), max(LEADERS, 4 * k))
            leaders = alive[np.argpartition(read[alive], len(alive) - few)[-few:]]
            kth = np.sort(bounds(leaders, front)[0])[-k]
            tried = alive[:: max(1, len(alive) // TRIED)]
            if depth == n or 2 * np.count_nonzero(bounds(tried, front)[1] < kth) >= len(tried):
                alive = alive[bounds(alive, front)[1] >= kth]
        while depth < n and m and not seen[alive].all():
            read_to(min(n, depth + batch))
        return alive, read[alive], depth * m


def read_lists(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query (row of ``q``) the rows of ``x`` that may be among its k best, their exact
    scores, and the entries read.  ``own``: the row of ``x`` that a query leaves out, or -1."""
    biggest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    numbers = float if biggest < 2.0**53 else object
    lists = Lists(x.astype(numbers))
    found = [lists.best(w, int(o), k) for w, o in zip(q.astype(numbers), own)]
    return [(rows, np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], np.int64), count) for rows, scores, count in found]


def quantised(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(column, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors`` (vec_id, v: array of
    long) for each of its rows where ``is_query`` holds."""
    rows = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = common.saved(rows)
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    nv, nq = max(1, -(-n["n"] // vector_block)), max(1, -(-n["q"] // query_block))
    deal = F.xxhash64("row")
    right = rows.select("dim", F.pmod(deal, F.lit(nv)).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), "row", "vec_id", "v")
    left = rows.where("q").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("vb"), F.pmod(deal, F.lit(nq)).alias("qb"), "row", "vec_id", "v")

    def best(qs, vs):
        import pandas as pd

        cols = ["qrow", "query_id", "vec_id", "score"]
        if not len(qs) or not len(vs):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        where = {r: i for i, r in enumerate(vs["row"])}
        own = np.array([where.get(r, -1) for r in qs["row"]])
        ids = vs["vec_id"].to_numpy()
        wide = lambda s: np.stack(s.to_numpy()).reshape(len(s), -1)
        parts = []
        for (at, scores, _), qrow, qid in zip(read_lists(wide(vs["v"]), wide(qs["v"]), own, k), qs["row"], qs["vec_id"]):
            o = np.lexsort((ids[at], -scores))[:k]
            parts.append(np.column_stack((np.full(len(o), qrow), np.full(len(o), qid), ids[at][o], scores[o])))
        return pd.DataFrame(np.concatenate(parts), columns=cols)

    keys = ["dim", "vb", "qb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "qrow long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth one."""
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


#: The same rows by scoring every pair.
SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q, v AS c WHERE q.vec_id % {EVERY} = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
