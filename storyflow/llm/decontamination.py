"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's k-grams of words are hashed, and the least hash of every ``window - k + 1``
consecutive ones is kept.  Texts that share ``window`` words share the least hash of
that span, so the join of kept hashes finds every document with a shared span.  Hits
are then extended: in those documents alone the places of the k-grams that the items'
kept hashes hold are looked up, the windows around such a place are compared with the
items' windows by 128 bits of hash, and the words of equal windows are marked.

An item of fewer words is one window of its own length L.  For L >= k the documents'
hashes are kept over L - k + 1 positions, which keeps all that the wider windows keep;
for L < k all their L-grams are.  So every shared window is found, whatever its length.

No table is broadcast unless Spark finds its file smaller than its own threshold.

Defined cases: a null text has no words and is not contaminated; an item without words
is no window; a null item_id is an item whose id is the empty string; items that repeat
an id count once; rows that repeat a doc_id are judged by their own texts; long texts are
searched whole; with empty tables no row, or no hit, results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
GRAM = 5


def gram_hashes(words: Column, k: int, salt: Column | None = None) -> Column:
    """The hash of every ``k`` consecutive words, in order."""
    gram = lambda i: F.xxhash64(*([salt] if salt is not None else []), *[F.get(words, i + j) for j in range(k)])
    some = F.transform(F.sequence(F.lit(0), F.size(words) - k), gram)
    return F.when(F.size(words) >= k, some).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, span: int) -> Column:
    """The distinct least hashes of every ``span`` consecutive ones (of all, if fewer)."""
    if span == 1:
        return F.array_distinct(hashes)
    least = F.transform(F.sequence(F.lit(0), F.size(hashes) - span), lambda i: F.least(*[F.get(hashes, i + j) for j in range(span)]))
    return F.array_distinct(F.when(F.size(hashes) >= span, least).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes))


def _scheme(lengths: list[int], window: int, k: int) -> list[tuple[int, int]]:
    """(gram, span) of each set of kept hashes that windows of these lengths need."""
    longer = [n for n in [*lengths, window] if n >= k]
    return [(min(k, window), max(1, min(longer) - k + 1))] + [(n, 1) for n in sorted(set(lengths)) if n < min(k, window)]


def _kept(df: DataFrame, scheme: list[tuple[int, int]]) -> DataFrame:
    """Replaces the column words by fps: structs of gram length and kept hash."""
    df = df.withColumns({f"g{k}": gram_hashes(F.col("words"), k) for k, _ in scheme})
    kept = [winnowed(F.col(f"g{k}"), span) for k, span in scheme]
    if len(scheme) == 1:
        return df.withColumn("fps", kept[0])
    tagged = lambda k: lambda h: F.struct(F.lit(k).alias("k"), h.alias("h"))
    return df.withColumn("fps", F.concat(*[F.transform(c, tagged(k)) for c, (k, _) in zip(kept, scheme)]))


def _exploded(df: DataFrame, scheme: list[tuple[int, int]], *keep: str) -> DataFrame:
    rows = df.select(*keep, F.explode("fps").alias("f"))
    return rows.select(*keep, "f.k", "f.h") if len(scheme) > 1 else rows.select(*keep, F.lit(scheme[0][0]).alias("k"), F.col("f").alias("h"))


def _window(words: Column, i: Column, length: int) -> Column:
    """Start, length and two hashes of the window of ``length`` words at ``i``."""
    held = [F.get(words, i + j) for j in range(length)]
    return F.struct(i.alias("s"), F.lit(length).alias("length"), F.xxhash64(*held).alias("a"), F.xxhash64(F.lit(length), *held).alias("b"))


def _windows(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row for each window of ``length`` words: start, length and two hashes."""
    spans = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: _window(F.col("words"), i, length))
    return df.where(F.size("words") >= length).select(*keep, F.explode(spans).alias("w")).select(*keep, "w.*")


def _starts(grams: Column, n: int, g: int, last: Column) -> Column:
    """Where the windows of ``n`` words start, up to ``last``, that hold one of the ``grams`` of ``g`` words."""
    first = lambda x: F.greatest(F.lit(0), x["p"] - (n - g))
    around = lambda x: F.sequence(first(x), F.least(x["p"], last))
    hits = F.filter(grams, lambda x: (x["k"] == g) & (first(x) <= last))
    return F.array_distinct(F.flatten(F.transform(hits, around)))


def _around(places: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """The windows of ``places`` (words, grams: places of hits by gram length) that hold a hit."""
    words = F.col("words")
    window = lambda n: lambda i: _window(words, i, n)
    some = [F.transform(_starts(F.col("grams"), n, min(k, n), F.size(words) - n), window(n)) for n in lengths]
    return places.select("doc_id", "th", F.explode(F.concat(*some)).alias("w")).select("doc_id", "th", "w.*")


def find_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What ``docs`` (doc_id, text) share with ``benchmark`` (item_id, text): of every row
    ``doc_id, th`` (its text's hash) ``, n_words``, and of each text with a hit, once,
    ``doc_id, th, n_hit, items`` (ids as sorted strings)."""
    items = common.saved(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct())
    short = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect()]  # under `window` rows
    scheme = _scheme(short, window, k)

    spans = [_windows(items.where(F.size("words") >= window), window, "item")] + [_windows(items.where(F.size("words") == n), n, "item") for n in short]
    shared = spans[0]
    for s in spans[1:]:
        shared = shared.unionByName(s)
    shared = shared.groupBy("length", "a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
    shared = common.saved(shared.withColumn("items_key", F.sha2(F.array_join("items", ","), 256)))

    # An item's own windows: those of a long item hold `window` words, a short one's its own number.
    sides = []
    for n in [window, *short]:
        g = min(k, n)
        own = items.where(F.size("words") >= window) if n == window else items.where(F.size("words") == n)
        sides.append(own.withColumn("g", gram_hashes(F.col("words"), g)).select(F.lit(g).alias("k"), F.explode(winnowed(F.col("g"), n - g + 1)).alias("h")))
    fps = sides[0]
    for s in sides[1:]:
        fps = fps.unionByName(s)
    fps = common.saved(fps.distinct())

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), common.words(F.col("text")).alias("words"))
    marked = common.saved(_kept(keyed, scheme).select("doc_id", "th", F.size("words").cast("long").alias("n_words"), "fps"))
    found = common.saved(_exploded(marked, scheme, "doc_id", "th").join(fps, ["k", "h"], "left_semi").select("doc_id", "th").distinct())

    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.th = f.th"), "left_semi")
    again = common.saved(again.select("doc_id", "th", common.words(F.col("text")).alias("words")))
    grams = None
    for g, _ in scheme:
        rows = again.select("doc_id", "th", F.lit(g).alias("k"), F.posexplode(gram_hashes(F.col("words"), g)).alias("p", "h"))
        grams = rows if grams is None else grams.unionByName(rows)
    grams = grams.join(fps, ["k", "h"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "p")).alias("grams"))
    places = again.alias("a").join(grams.alias("g"), F.expr("a.doc_id <=> g.doc_id AND a.th = g.th")).select("a.doc_id", "a.th", "words", "grams")
    matched = _around(places, [window, *short], k).join(shared.select("length", "a", "b", "items_key"), ["length", "a", "b"])
    matched = common.saved(matched.select("doc_id", "th", "s", "length", "items_key"))

    # Words in the union of the spans: each span adds what lies beyond the end so far.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["s"] + x["length"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["s"] + x["length"]).alias("end"))
    hit = matched.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "length"))).alias("spans")).select("doc_id", "th", F.aggregate("spans", start, add, lambda acc: acc["n"]).cast("long").alias("n_hit"))
    sets = matched.select("doc_id", "th", "items_key").distinct().join(shared.select("items_key", "items").dropDuplicates(["items_key"]), "items_key")
    named = sets.select("doc_id", "th", F.explode("items").alias("item")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hit.alias("h").join(named.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.th = i.th")).select("h.doc_id", "h.th", "n_hit", "items")
    return marked.select("doc_id", "th", "n_words"), common.saved(both)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (ids as sorted strings) of each row of ``docs``."""
    marked, both = find_hits(docs, benchmark, **options)
    joined = marked.alias("m").join(both.alias("b"), F.expr("m.doc_id <=> b.doc_id AND m.th = b.th"), "left")
    return joined.select("m.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text shares a window with an item."""
    _, hits = find_hits(docs, benchmark, **options)
    return docs.alias("d").join(hits.alias("h"), (F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id"))) & (F.xxhash64("d.text") == F.col("h.th")), "left_anti")


def op2_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: The same rows by comparing every window of every document with every item's windows.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS sizes WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw USING (n, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
