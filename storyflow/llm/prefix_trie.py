"""The prefix trie of conversations.

Turns are dealt by ranges of (conv_id, turn, role, text), so that no conversation, however
long, is one task's.  In each range a numpy scan rolls two polynomials modulo primes near
2^31 over the turns' hashes: the fingerprint of every prefix.  A range that begins inside
a conversation is carried on from the end of the one before (a row for each range reaches
the driver, no more).  Prefixes of one depth and fingerprint are one candidate group.

Every group is verified turn by turn: the turns of one hash are compared with each other
whole (other contents of that hash get numbers of their own), and at each depth each
member's turn with that of the group's representative, the smallest conv_id.  Both
polynomials can be undone turn by turn, so groups in which all turns agree at every depth
hold equal prefixes.  Members whose turn differs are split off, there and below.

The parent rollup needs no walk by level.  Each node belongs to its smallest member, so a
conversation owns the end of its own path: a chain.  What a chain holds in all is added to
every node its conversation goes through, and a node takes off what lies before it in the
chain it is part of.

Defined cases: null role or text is empty; a null turn comes first; ties of turn are
ordered by role, then text; repeated rows are turns of their own; rows without a conv_id
belong to no conversation and are left out; long texts are hashed and compared whole; an
empty table has no conversation and no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Two primes, and the multipliers of the polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Turns of another conversation that one may begin with.
MOST_LENT = 8
#: Bytes of turns that a task sorts, about.
RANGE_BYTES = 32 << 20
#: conv_ids joined to one text before they are hashed in order.
IDS_A_CHUNK = 4096

SCANNED = "part long, conv_id long, k long, v long, alt long, bytes long, f0 long, f1 long, p0 long, p1 long"
#: A turn's fingerprints: of the prefix that ends there (f) and of the one before (p).
PLACED = "conv_id long, at long, v long, alt long, bytes long, f0 long, f1 long, p0 long, p1 long"


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base^exponents modulo prime, by squaring."""
    out, b, e = np.ones(len(exponents), np.uint64), base % prime, exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & 1, out * np.uint64(b) % np.uint64(prime), out)
        b, e = b * b % prime, e >> 1
    return out


def value(v: np.ndarray, alt: np.ndarray, prime: int) -> np.ndarray:
    """The number that stands for a turn in a polynomial."""
    return (v.astype(np.uint64) + alt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(prime)


def scan(x: np.ndarray, starts: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Rolling fingerprints of ``x``, anew from each index in ``starts``, in one pass of sums:
    the sum of x_j / base^j, times base^i."""
    p = np.uint64(prime)
    j = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) + 1
    most = int(j.max())
    up = power(base, np.arange(most + 1), prime)
    down = power(pow(base, -1, prime), np.arange(most + 1), prime)
    sums = np.cumsum(x * down[j] % p)
    before = np.where(starts > 0, sums[starts - 1], 0).astype(np.uint64)
    return (sums - np.repeat(before, np.diff(np.append(starts, len(x))))) % p * up[j] % p


def contents(turns: DataFrame, bits: int = 64) -> DataFrame:
    """``turns`` with ``v``, a hash of role and text, and ``alt``, which tells apart contents of one hash.

    All turns of one hash are compared whole, by the least and the greatest of their
    contents; only where these differ are contents numbered."""
    v = F.xxhash64("role", "text")
    turns = turns.withColumn("v", v if bits == 64 else F.pmod(v, F.lit(1 << bits)))
    body = F.struct("role", "text")
    mixed = turns.groupBy("v").agg(F.min(body).alias("a"), F.max(body).alias("b")).where(F.col("a") != F.col("b")).select("v")
    mixed = common.saved(mixed)
    if mixed.isEmpty():
        return turns.withColumn("alt", F.lit(0).cast("long"))
    numbered = turns.join(mixed, "v", "left_semi").select("v", "role", "text").distinct()
    numbered = common.saved(numbered.withColumn("alt", F.row_number().over(Window.partitionBy("v").orderBy("role", "text")).cast("long") - 1))
    return turns.join(numbered, ["v", "role", "text"], "left").withColumn("alt", F.coalesce("alt", F.lit(0).cast("long")))


def prefixes(turns: DataFrame, *, primes: tuple[int, int] = PRIMES, bits: int = 64) -> DataFrame:
    """Each turn's place in its conversation (from 1) and the fingerprints of the prefixes
    that end there and before it (:data:`PLACED`)."""
    spark = turns.sparkSession
    turns = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", common.text_of("role").alias("role"), common.text_of("text").alias("text")
    )
    turns = contents(turns.withColumn("bytes", F.octet_length("text").cast("long")), bits)
    n = common.pieces(turns, RANGE_BYTES, spark.sparkContext.defaultParallelism, F.col("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("m")]
    dealt = turns.withColumn("m", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def scanned(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, k, ends = TaskContext.get().partitionId(), None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, v, alt, size = (c.to_numpy() for c in batch.columns)
            new = np.append(True, conv[1:] != conv[:-1])
            starts = np.flatnonzero(new)
            if last is None or conv[0] != last:
                k, ends = 0, [0, 0]
            first = np.append(starts, len(conv))[1]
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
            at[:first] += k
            found, befores = [], []
            for i, (base, prime) in enumerate(zip(BASES, primes)):
                p, x = np.uint64(prime), value(v, alt, prime)
                f = scan(x, starts, base, prime)
                if k:
                    f[:first] = (f[:first] + np.uint64(ends[i]) * power(base, np.arange(1, first + 1), prime)) % p
                b = np.append(np.uint64(ends[i] if k else 0), f[:-1])
                b[starts[1:] if k else starts] = 0
                found.append(f.astype(np.int64))
                befores.append(b.astype(np.int64))
                ends[i] = int(f[-1])
            last, k = conv[-1], int(at[-1])
            columns = [np.full(len(conv), part), conv, at, v, alt, size, *found, *befores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCANNED.split(", ")])

    rows = common.saved(dealt.select("conv_id", "v", "alt", "bytes").mapInArrow(scanned, SCANNED))

    # Conversations that lie in several ranges: at most one for each border between two.
    ends = rows.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by("f0", "k").alias("f0"), F.max_by("f1", "k").alias("f1"))
    cut = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "f0", "f1"))).alias("s")).where(F.size("s") > 1).collect()
    carried: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row in cut:
        n, f = 0, [0, 0]
        for s in row["s"]:
            carried[s["part"], row["conv_id"]] = (n, *f)
            f = [(f[i] * pow(BASES[i], s["n"], primes[i]) + s[f"f{i}"]) % primes[i] for i in (0, 1)]
            n += s["n"]

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            part, conv, k, v, alt, size, f0, f1, p0, p1 = (c.to_numpy() for c in batch.columns)
            at, fs, ps = k.copy(), [f0.copy(), f1.copy()], [p0.copy(), p1.copy()]
            borders = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (conv[1:] != conv[:-1]))) if len(part) else []
            for a, b in zip(borders, np.append(borders[1:], len(part)).astype(int) if len(part) else []):
                before = carried.get((int(part[a]), int(conv[a])))
                if before and before[0]:
                    at[a:b] += before[0]
                    for i, (base, prime) in enumerate(zip(BASES, primes)):
                        for xs, e in ((fs[i], k[a:b]), (ps[i], k[a:b] - 1)):
                            xs[a:b] = (xs[a:b].astype(np.uint64) + np.uint64(before[1 + i]) * power(base, e, prime)) % np.uint64(prime)
            columns = [conv, at, v, alt, size, *fs, *ps]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PLACED.split(", ")])

    return rows.mapInArrow(placed, PLACED)


def rebuilt(places: DataFrame, base: Column, lent: Column, *, primes: tuple[int, int] = PRIMES, most: int = MOST_LENT) -> DataFrame:
    """The turns of conversations that begin with the first ``lent`` (at most ``most``) turns
    of conversation ``base`` and go on with their own after as many: conv_id, d (from 0, a row
    of its own without a turn), f0, f1, p0, p1, v, alt, bytes and ``size``, the turns in all."""
    turn = F.struct("at", "f0", "f1", "p0", "p1", "v", "alt", "bytes")
    convs = places.groupBy("conv_id").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(F.when(F.col("at") <= most, turn))).alias("head"))
    convs = common.saved(convs.withColumn("base", base).withColumn("lent", F.least(lent, F.lit(most)).cast("long")))
    of = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("first"))
    plan = convs.join(of, "base", "left").withColumn("m", F.least("lent", F.coalesce(F.size("first"), F.lit(0)).cast("long")))
    end = lambda what, n, i: F.when((F.col(n) > 0) & (F.size(what) >= F.col(n)), F.element_at(what, F.col(n).cast("int"))[f"f{i}"]).otherwise(0)
    plan = common.saved(
        plan.select(
            "conv_id", "lent", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("lent"))).alias("size"), F.slice(F.coalesce("first", F.array().cast(plan.schema["head"].dataType)), 1, F.col("m").cast("int")).alias("first"),
            *[end("first", "m", i).alias(f"b{i}") for i in (0, 1)], *[end("head", "lent", i).alias(f"o{i}") for i in (0, 1)],
        )
    )
    zero = F.lit(0).cast("long")
    root = plan.select("conv_id", zero.alias("d"), *[zero.alias(c) for c in ("f0", "f1", "p0", "p1", "v", "alt", "bytes")], "size")
    lent_rows = plan.select("conv_id", "size", F.explode("first").alias("t")).select("conv_id", F.col("t.at").alias("d"), *[f"t.{c}" for c in ("f0", "f1", "p0", "p1", "v", "alt", "bytes")], "size")
    own = places.join(plan.select("conv_id", "lent", "m", "size", "b0", "b1", "o0", "o1"), "conv_id").where(F.col("at") > F.col("lent"))
    own = own.select("conv_id", "at", "lent", "m", "f0", "f1", "p0", "p1", "b0", "b1", "o0", "o1", "v", "alt", "bytes", "size")

    def moved(batches):
        import pyarrow as pa

        for batch in batches:
            c = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
            t = c["at"] - c["lent"]
            out = [c["conv_id"], c["m"] + t]
            for which, e in (("f", t), ("p", t - 1)):
                for i, (base, prime) in enumerate(zip(BASES, primes)):
                    p = np.uint64(prime)
                    change = (c[f"b{i}"].astype(np.uint64) + p - c[f"o{i}"].astype(np.uint64)) % p
                    out.append(((c[f"{which}{i}"].astype(np.uint64) + change * power(base, e, prime)) % p).astype(np.int64))
            out += [c["v"], c["alt"], c["bytes"], c["size"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["conv_id", "d", "f0", "f1", "p0", "p1", "v", "alt", "bytes", "size"])

    return common.saved(root.unionByName(lent_rows).unionByName(own.mapInArrow(moved, ", ".join(f"{c} long" for c in root.columns))))


def split_collisions(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """``rows`` with ``split`` and ``psplit``, which tell apart the prefixes of one depth and
    fingerprint, at their own depth and the one before; None where no group needs it."""
    bad = common.saved(groups.where((F.col("v0") != F.col("v1")) | (F.col("a0") != F.col("a1"))).select("d", "f0", "f1"))
    if bad.isEmpty():
        return None
    content = F.struct("v", "alt")
    bad_rows = rows.join(bad, ["d", "f0", "f1"], "left_semi")
    leader = bad_rows.groupBy("d", "f0", "f1").agg(F.min_by(content, "conv_id").alias("lead"))
    other = bad_rows.join(leader, ["d", "f0", "f1"]).where(content != F.col("lead"))
    labels = other.select("conv_id", F.struct("d", F.concat_ws(":", "d", "v", "alt").alias("name")).alias("x"))
    labels = labels.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("labels"))
    at = lambda depth: F.array_join(F.transform(F.filter(F.coalesce("labels", F.array().cast("array<struct<d:bigint,name:string>>")), lambda x: x["d"] <= depth), lambda x: x["name"]), ",")
    return common.saved(rows.join(labels, "conv_id", "left").select(*rows.columns, at(F.col("d")).alias("split"), at(F.col("d") - 1).alias("psplit")))


def digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """The SHA-256 of each group's conv_ids, ascending and comma-joined.

    Ids are sorted by ranges and joined to texts of some thousands first; only these meet in
    one task, which hashes them in order and holds none."""
    kinds = dict(ends.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def groups(batches, emit):
        """Calls emit(key, columns of the group's part in this batch) part by part."""
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            a = 0
            for b in range(1, batch.num_rows + 1):
                if b == batch.num_rows or any(cols[i][b] != cols[i][a] for i in range(len(keys))):
                    yield from emit(tuple(cols[i][a] for i in range(len(keys))), [c[a:b] for c in cols[len(keys) :]])
                    a = b

    def table(rows, names, types):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def types(*more):
        import pyarrow as pa

        return [pa.string() if kinds[k] == "string" else pa.int64() for k in keys] + [getattr(pa, m)() for m in more]

    def joined(batches):
        def emit(key, cols):
            ids = cols[0]
            rows = [(*key, ids[i], ",".join(map(str, ids[i : i + IDS_A_CHUNK]))) for i in range(0, len(ids), IDS_A_CHUNK)]
            yield table(rows, [*keys, "first", "ids"], types("int64", "string"))

        yield from groups(batches, emit)

    def hashed(batches):
        now, sha = None, None

        def emit(key, cols):
            nonlocal now, sha
            if key != now:
                if now is not None:
                    yield table([(*now, sha.hexdigest())], [*keys, "sha"], types("string"))
                now, sha = key, hashlib.sha256(cols[1][0].encode())
                rest = cols[1][1:]
            else:
                rest = cols[1]
            for ids in rest:
                sha.update(b"," + ids.encode())

        yield from groups(batches, emit)
        if now is not None:
            yield table([(*now, sha.hexdigest())], [*keys, "sha"], types("string"))

    order = [*keys, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{head}, first long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, f"{head}, sha string")


def trie(turns: DataFrame, *, base: Column | None = None, lent: Column | None = None, primes: tuple[int, int] = PRIMES, bits: int = 64) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, turn, role, text): conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes that need no second copy in its subtree) and ends_sha256 (of the members that end there).

    ``base`` and ``lent``, expressions of conv_id: conversations begin with the first ``lent``
    turns of ``base`` in place of as many of their own.  ``primes`` and ``bits`` narrow the
    fingerprints and hashes, as tests of collisions do."""
    base = F.col("conv_id") if base is None else base
    lent = F.lit(0) if lent is None else lent
    rows = rebuilt(prefixes(turns, primes=primes, bits=bits), base, lent, primes=primes)

    def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
        ends = F.col("d") == F.col("size")
        parents = [F.min(c).alias(c) for c in ("p0", "p1", *(["psplit"] if "split" in keys else []))]
        aggs = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("alt").alias("a0"), F.max("alt").alias("a1")]
        return rows.groupBy(*keys).agg(*aggs, *parents, F.sum(ends.cast("long")).alias("ends"), F.min(F.when(ends, F.col("conv_id"))).alias("end_id"))

    keys = ["d", "f0", "f1"]
    nodes = common.saved(grouped(rows, keys))
    divided = split_collisions(rows, nodes)
    if divided is not None:
        rows, keys = divided, [*keys, "split"]
        nodes = common.saved(grouped(rows, keys))
    up = {"d": F.col("d") - 1, "f0": F.col("p0"), "f1": F.col("p1"), "split": F.col("psplit") if "split" in keys else None}

    nodes = nodes.withColumn("weight", (F.col("n") - 1) * F.col("bytes"))
    chains = nodes.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.max((F.col("ends") == F.col("n")).cast("long")).alias("leaf"))
    through = rows.select("conv_id", *keys).join(chains, "conv_id").select(*keys, "weight", "leaf", F.lit(0).cast("long").alias("child"))
    zero = F.lit(0).cast("long")
    children = nodes.where("d > 0").select(*[up[k].alias(k) for k in keys], zero.alias("weight"), zero.alias("leaf"), F.lit(1).cast("long").alias("child"))
    sums = through.unionByName(children).groupBy(*keys).agg(F.sum("weight").alias("all"), F.sum("leaf").alias("leaves"), F.sum("child").alias("children"))
    shared = nodes.where("n > 1").select("conv_id", F.expr(f"d div {common.CHUNK * common.CHUNK}").alias("part"), F.col("d").alias("k"), "weight", *keys)
    before = common.offsets(shared, "weight", ("conv_id",)).select(*keys, F.col("at").alias("before"))
    parents = nodes.select(*[(F.col(k) + 1 if k == "d" else F.col(k)).alias({"d": "d", "f0": "p0", "f1": "p1", "split": "psplit"}[k]) for k in keys], F.col("conv_id").alias("parent"))
    many = nodes.where("ends > 1").select(*keys)
    hashes = digests(rows.where("d = size").join(many, keys, "left_semi").select(*keys, "conv_id"), keys)
    found = nodes.join(sums, keys, "left").join(before, keys, "left").join(hashes, keys, "left")
    found = found.join(parents, ["d", "p0", "p1", *(["psplit"] if "split" in keys else [])], "left")
    own = F.when(F.col("ends") == 0, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.sha2(F.col("end_id").cast("string").cast("binary"), 256))
    return found.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") > 0, F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("all") - F.col("before")).otherwise(0).cast("long").alias("saved_tokens"), F.coalesce("sha", own).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the start of the first of its five."""
    conv = F.col("conv_id")
    return trie(common.table(spark, sf_dir, "conversations"), base=conv - conv % 5, lent=F.crc32(conv.cast("string").cast("binary")) % 9)


#: A crc32 from its definition: a fold over bytes, eight shifts each.
_CRC = "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d FROM parts),
whole AS (
  SELECT c.conv_id, coalesce(list(struct_pack(r := r.role, t := r.text) ORDER BY r.d) FILTER (WHERE r.d IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, d, path[1:d] AS prefix, len(path) = d AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM steps GROUP BY d, prefix),
valued AS (
  SELECT n.*, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(prefix[d].t) ELSE 0 END AS weight,
         NOT EXISTS (SELECT 1 FROM nodes m WHERE m.d = n.d + 1 AND m.prefix[1:n.d] = n.prefix) AS leaf
  FROM nodes n),
above AS (SELECT prefix[1:k] AS prefix, d - k AS below, weight, leaf FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM valued)),
sums AS (SELECT prefix, sum(weight) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE below = 1) AS children FROM above GROUP BY prefix)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
"""
