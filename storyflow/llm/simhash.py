"""SimHash near-duplicates by pigeonhole blocks.

Words are runs of characters other than ASCII white space, with A-Z lower-cased; the
features are shingles of ``shingle`` words, repeats included.  A fingerprint bit is set
if it is set in over half of the shingles' XXH64 hashes.  Two texts whose fingerprints
differ in at most ``bits`` bits agree in at least ``blocks - bits`` of ``blocks``
blocks, so they meet under one of the keys made of that many blocks; pairs that meet
are verified by Hamming distance.

Only distinct fingerprints are joined.  A key under which more than ``crowd``
fingerprints meet is not paired at all: there, fingerprints within two bits of each
other are those that share a fingerprint within one bit of both, so each is linked to
that midpoint, 65 rows a fingerprint however large the crowd.  Links are merged into
components by stars (alternately linking each node's larger and smaller neighbours to
its least one), all of it in joins and aggregates over distinct fingerprints.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; a text of fewer words than a shingle has one shingle; repeated rows and copies
share their fingerprint and so a component; a null doc_id counts as larger than
every id (a component of null ids alone has a null id); an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
BITS = 2
BLOCKS = 5
CROWD = 64
SEED = 42


def hashed(text: str | None, shingle: int, seed: int):
    """The XXH64 of each of a text's shingles, in order, as little-endian unsigned numbers."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(ws) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(ws), seed)] if ws else [], "<u8")
    joined = map(b" ".join, zip(*(ws[i:] for i in range(shingle))))
    return np.fromiter((xxh64_intdigest(s, seed) for s in joined), "<u8", len(ws) - shingle + 1)


def majority(hashes) -> int:
    """The bits that are set in over half of ``hashes``; zero if there is none."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, th`` (the text's hash) ``, fp`` (the 64 bits as a signed long) of each row of
    ``docs`` (doc_id, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = np.array([majority(hashed(t, shingle, seed)) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def block_keys(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """The masks of the keys: every choice of ``blocks - bits`` blocks of the 64 bits, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def links(fps: DataFrame, *, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column fp) whose components are those
    of all pairs within ``bits`` bits.  With ``bits`` over 2 every key is paired in full."""
    masks = block_keys(bits, blocks)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.i", "k.v")
    sizes = keyed.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    few = keyed.join(sizes.where(F.col("c") <= crowd) if bits <= 2 else sizes, ["i", "v"]).select("i", "v", "fp")
    # Keys of at most `crowd` members: their members as one array each, paired within.
    groups = few.groupBy("i", "v").agg(F.collect_list("fp").alias("members"))
    pairs = groups.select("members", F.explode("members").alias("a")).select("a", F.explode(F.expr("filter(members, b -> b > a)")).alias("b")).where(near)
    if bits > 2:
        return pairs.distinct()
    crowded = keyed.join(sizes.where(F.col("c") > crowd), ["i", "v"], "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)]])
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    if bits == 2:
        # At most 65 fingerprints lie within one bit of a midpoint: linked to the least of them.
        stars = around.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        stars = stars.select("a", F.explode("members").alias("b")).where((F.col("a") != F.col("b")) & near)
    else:
        stars = around.where("fp != mid").select(F.col("fp").alias("a"), F.col("mid").alias("b")).join(fps.select(F.col("fp").alias("b")), "b", "left_semi").where(near).select("a", "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of its component, for every node of an edge (a, b).

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes.  Each
    round's edges are written to the shared folder; only their digest reaches the driver."""
    spark = edges.sparkSession
    edges = common.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = old = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        folder = common.shared_dir(spark)
        edges = common.saved(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder=folder)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
        if old:
            common.remove(spark, old)  # the round before the last is read no more
        if now == before:
            break
        before, old = now, folder
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` of each row of ``docs`` (doc_id, text): ``root``
    names its component, ``component_id`` is that component's smallest doc_id."""
    marked = common.saved(fingerprints(docs, shingle=shingle, seed=seed))
    per_fp = common.saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(per_fp.select("fp"), bits=bits, blocks=blocks, crowd=crowd)).withColumnRenamed("node", "fp")
    rooted = common.saved(per_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_first(docs: DataFrame, *, similarity: tuple[int, int] | None = None, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    With ``similarity`` (a fraction), links are pairs of texts whose sets of shingles have
    that Jaccard similarity or more.  Fingerprints find the closest of them by pigeonhole
    blocks; at 0.8, a pair differs in ten of 64 bits on average, which no choice of blocks
    can find, so :mod:`near_copies` finds the rest, exactly."""
    if similarity is None:
        return first_of(docs, near_duplicates(docs, **options))
    from . import near_copies

    return first_of(docs, near_copies.near_copies(docs, similarity=similarity, **options))


def first_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``found`` (doc_id, th, root, a row for each of
    ``docs``): that of the smallest doc_id.  Rows that repeat both id and text are one document."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    first = common.saved(first.select("k.doc_id", "k.th"))
    mine = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.th"))
    kept = docs.alias("d").join(first.alias("k"), mine, "left_semi")
    # Only where there are such rows at all are they told apart.
    again = common.saved(found.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))
    if again.first() is None:
        return kept
    repeats = kept.alias("d").join(again.alias("k"), mine, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.alias("d").join(again.alias("k"), mine, "left_anti").unionByName(repeats)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
