"""Near copies by word shingles: what :mod:`simhash` does where its links are a similarity.

Words are those of :mod:`simhash`; a text is the set of its shingles of ``shingle`` words,
held as XXH64 hashes, and two texts are near copies if the Jaccard similarity of their
sets is ``similarity`` or more.

Fingerprints of the shingles link the closest texts first: pairs that meet under a pigeonhole
block and differ in at most two bits are candidates.  Most near copies are further apart, so
the other candidates come from an exact join with a prefix filter: in one order of all
shingles, two such sets share one of the first n - o + 1 of their n shingles, o being the
least overlap that n allows, so every pair meets under one of these keys.  Candidates are
verified on the whole sets.  No pair is lost, whatever the order: shingles seen often in a
part of the texts come last in it, so that common passages seldom are keys.

Under a key of at most ``crowd`` sets all pairs are verified that share enough keys.  Larger
groups are first compared with one of their sets, then all such pairs in them that are not
yet in one component are verified too.

Defined cases: as in :mod:`simhash`; wordless texts share the empty set; texts with the
same set are near copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: The least Jaccard similarity, as a fraction.
SIMILARITY = (4, 5)
CROWD = 64
#: Shingles are counted in one of so many texts (in about ``LEAST_TEXTS`` at least); so many are known to be common at most.
ONE_OF, LEAST_TEXTS, SEEN, COMMON = 16, 4096, 3, 200_000


def _hashes(text: str | None, shingle: int):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np

    return np.unique(simhash.hashed(text, shingle, simhash.SEED).view(np.int64))


def shingle_sets(texts: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """``th, items``: the shingles of each row of ``texts`` (th, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                items = pa.array([_hashes(t, shingle) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), items], names=["th", "items"])

    return texts.select("th", "text").mapInArrow(run, "th long, items array<long>")


def common_shingles(docs: DataFrame, *, shingle: int = SHINGLE) -> list[int]:
    """Shingles of several of the texts drawn by their hash, the commonest last; ``COMMON`` at most."""
    n = docs.count()
    share = max(1 / ONE_OF, min(1.0, LEAST_TEXTS / max(1, n)))
    draw = F.pmod(F.xxhash64(F.lit("common"), "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.where(draw < share).select(F.xxhash64("text").alias("th"), "text")
    seen = shingle_sets(drawn, shingle=shingle).select(F.explode("items").alias("v")).groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= SEEN)
    top = seen.orderBy(F.desc("c"), "v").limit(COMMON).collect()
    return [r["v"] for r in reversed(top)]


def prefixes(docs: DataFrame, last: list[int], *, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, th`` (the text's hash) ``, fp`` (its fingerprint) ``, s`` (its set's hash) ``, n``
    (the set's size) ``, keys`` of each row of ``docs`` (doc_id, text); ``last`` come last in
    the order of shingles."""
    import numpy as np

    hashes = np.array(last, np.int64)
    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], order))
    num, den = similarity

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        known, ranks = shared.value

        def keys(h):
            most = len(h) - -(-num * len(h) // den) + 1
            if not len(known):
                return h[:most]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            is_common = known[at] == h
            rare = h[~is_common][:most]
            if len(rare) == most:
                return rare
            often = h[is_common][np.argsort(ranks[at[is_common]])]
            return np.concatenate([rare, often[: most - len(rare)]])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [simhash.hashed(t, shingle, simhash.SEED) for t in part.column(2).to_pylist()]
                fps = pa.array(np.array([simhash.majority(h) for h in every], np.uint64).view(np.int64))
                sets = [np.unique(h.view(np.int64)) for h in every]
                s = pa.array(np.array([xxh64_intdigest(h.tobytes(), simhash.SEED) for h in sets], np.uint64).view(np.int64))
                firsts = pa.array([keys(h) if len(h) else h for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fps, s, pa.array([len(h) for h in sets], pa.int32()), firsts], names=["doc_id", "th", "fp", "s", "n", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long, s long, n int, keys array<long>")


class Measure:
    """When sets are near copies, by their sizes and what they share."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity

    def enough(self, shared: Column, n: Column, m: Column) -> Column:
        """Whether sets of these sizes are near copies if they share so many shingles."""
        return shared * (self.num + self.den) >= (n + m) * self.num

    def can_be(self, a: Column, b: Column, keys: Column) -> Column:
        """Whether two sets (s, n, ...) can be near copies that share ``keys`` keys at most.
        What the set whose keys end first has of the other is among the other's keys or in its
        own rest, which is one less than its least overlap."""
        n, m = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
        rest = F.floor((m * self.num + (self.den - 1)) / F.lit(self.den)) - 1
        return self.enough(F.least(n, keys + rest), n, m)


def verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame, measure: Measure, shingle: int) -> DataFrame:
    """The pairs ``a, b`` of set hashes whose sets are near copies."""
    pairs = common.saved(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    one = marked.join(ids, "s", "left_semi").groupBy("s").agg(F.min("th").alias("th"))
    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(one.select("th"), "th", "left_semi").dropDuplicates(["th"])
    with common.text_batches(docs.sparkSession):
        sets = common.saved(shingle_sets(texts, shingle=shingle).join(one, "th").select("s", "items"))
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("items").alias("y")), "b")
    return common.saved(both.where(measure.enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"))


def _pairs(met: DataFrame, other: str | None, measure: Measure) -> DataFrame:
    """``a, b`` of the rows of ``met`` (a, b: sets; w: the keys that they share there) that can
    be near copies; ``other`` names the count of the keys that ``met`` leaves out, if any."""
    a, b = F.col("a"), F.col("b")
    flat = met.select(a["s"].alias("s"), b["s"].alias("t"), "w", F.struct(a["n"].alias("n")).alias("a"), F.struct(b["n"].alias("n")).alias("b"), (F.least(a[other], b[other]) if other else F.lit(0)).alias("more"))
    # Of one pair, only the keys differ from row to row.
    sums = flat.groupBy("s", "t").agg(F.sum("w").alias("w"), F.max("more").alias("more"), F.max("a.n").alias("n"), F.max("b.n").alias("m"))
    sums = sums.select("s", "t", F.col("w") + F.col("more").alias("keys"), F.struct("n").alias("a"), F.struct(F.col("m").alias("n")).alias("b")).toDF("s", "t", "keys", "a", "b")
    return sums.where(measure.can_be(a, b, F.col("keys"))).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


def close_pairs(marked: DataFrame) -> DataFrame:
    """``a, b``: sets of one fingerprint, each with the least of them, and the least sets of
    fingerprints that pigeonhole blocks find within two bits."""
    sets = marked.select("fp", "s").distinct()
    least = common.saved(sets.groupBy("fp").agg(F.min("s").alias("r")))
    same = sets.join(least, "fp").select(F.col("r").alias("a"), F.col("s").alias("b"))
    near = simhash.links(least.select("fp"))
    apart = near.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(apart).where("a != b").distinct()


def links(marked: DataFrame, docs: DataFrame, measure: Measure, *, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """``s, root``: the least set of its component, of all near copies, for each set that has one."""
    keyed = marked.select(F.explode("keys").alias("v"), F.struct("s", "n").alias("m"))
    groups = common.saved(keyed.groupBy("v").agg(F.collect_set("m").alias("members")).where(F.size("members") > 1))
    held = groups.select("v", (F.size("members") > crowd).alias("large"), F.explode("members").alias("m")).select("v", "large", "m.s", "m.n")
    # Of each set: how many of its keys others have too, of the small groups and of the large.
    counts = held.groupBy("s").agg(F.count_if(~F.col("large")).alias("few"), F.count_if("large").alias("many"))
    held = common.saved(held.join(counts, "s").select("v", "large", F.struct("s", "n", "few", "many").alias("m")))
    a, b = F.col("a"), F.col("b")
    most = F.least(a["few"] + a["many"], b["few"] + b["many"])
    # Pairs that meet under any small key are decided there: in the large groups only those
    # are left to find that share keys of large groups alone.
    large = F.least(a["many"], b["many"])
    few = held.where("NOT large").groupBy("v").agg(F.collect_list("m").alias("members")).select("members", F.explode("members").alias("a"))
    few = few.select("a", F.explode(F.expr("filter(members, b -> b.s > a.s)")).alias("b")).where(measure.can_be(a, b, most)).withColumn("w", F.lit(1))
    pairs = close_pairs(marked).unionByName(_pairs(few, "many", measure))
    crowded = held.where("large").groupBy("v").agg(F.array_sort(F.collect_list("m")).alias("members"))
    # Keys that the same sets have (those of one passage) are one group, counted ``w`` times.
    crowded = crowded.groupBy(F.xxhash64("members").alias("v")).agg(F.first("members").alias("members"), F.count("*").alias("w"))
    crowded = common.saved(crowded.select("v", "w", F.explode("members").alias("m")))
    some = not crowded.isEmpty()
    if some:  # each group with two sets in it: the one that shares most keys, and the smallest, which is the most like what all share
        keys = -(F.col("m.few") + F.col("m.many"))
        hub = crowded.groupBy("v").agg(F.min(F.struct(keys, "m")).alias("p"), F.min(F.struct("m.n", keys, "m")).alias("q")).select("v", F.explode(F.array("p.m", "q.m")).alias("b"))
        met = crowded.select("v", F.col("m").alias("a")).join(hub, "v").where((a["s"] != b["s"]) & measure.can_be(a, b, large))
        pairs = pairs.unionByName(met.select(F.least("a.s", "b.s").alias("a"), F.greatest("a.s", "b.s").alias("b")))
    roots = common.saved(simhash.components(verified(pairs.distinct(), marked, docs, measure, shingle)).toDF("s", "root"))
    if not some:
        return roots
    # What is left of the groups: pairs of sets that are not in one component yet.
    rooted = crowded.withColumn("s", F.col("m.s")).join(roots, "s", "left").select("v", "w", "m", F.coalesce("root", "s").alias("root"))
    split = rooted.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("v")
    rooted = common.saved(rooted.join(split, "v", "left_semi"))
    if rooted.isEmpty():
        return roots
    mine = rooted.select("v", "w", F.col("m").alias("a"), F.col("root").alias("r"))
    theirs = rooted.select("v", F.col("m").alias("b"), F.col("root").alias("t"))
    more = verified(_pairs(mine.join(theirs, "v").where((F.col("r") < F.col("t")) & measure.can_be(a, b, large)), None, measure), marked, docs, measure, shingle)
    if more.isEmpty():
        return roots
    return simhash.components(more.unionByName(roots.where("s != root").toDF("a", "b"))).toDF("s", "root")


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """``doc_id, th, root`` of each row of ``docs`` (doc_id, text): ``root`` names its component."""
    last = common_shingles(docs, shingle=shingle)
    with common.text_batches(docs.sparkSession):
        marked = common.saved(prefixes(docs, last, shingle=shingle, similarity=similarity))
    roots = links(marked, docs, Measure(similarity), shingle=shingle, crowd=crowd)
    return common.saved(marked.select("doc_id", "th", "s").join(roots, "s", "left").select("doc_id", "th", F.coalesce("root", "s").alias("root")))
