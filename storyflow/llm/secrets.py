"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong parts are reported as they stand: assignments of a password, secret, token or API
key, access identifiers and long runs of hexadecimal digits.  Weak parts (user names,
mixed high-entropy keys and endpoints) are reported only when a complementary part lies
within ``scope`` characters: a name or an endpoint beside a secret, a key beside an
identifier or an endpoint.  Parts are joined on cells of ``scope`` characters of their
document and then by interval, so that a document full of parts makes no more pairs than
its cells hold.

Spans are code points, the end exclusive.  A regular expression's n matches and the n + 1
gaps between them give each match's start as a running sum; matches that fail a kind's
test are dropped only after that, so what they consumed stays consumed.

Defined cases: a null text is empty and has no span; rows that repeat a doc_id are judged
by their own texts; a null doc_id stays null; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters within which parts of one credential lie.
SCOPE = 256

#: Fixed patterns of the strong kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Patterns of the weak kinds.
IDENT = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
KEY = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]+|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
STRONG = 3
#: What a kind stands for in a credential.
ROLES = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "key": "secret", "endpoint": "endpoint"}


def _matches(text: Column, kind: str, pattern: str, maybe: Column | None, tests) -> Column:
    """The kind's matches in order: structs of kind, number, gap before, length, ok.
    ``maybe``: where it is false there is surely no match.  ``tests``: the group whose text
    decides, and the test of it."""
    group, test = tests
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("m"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), test).alias("t"), F.transform(gaps, F.char_length).alias("g"))
    some = F.filter(F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["g"].alias("gap"), x["m"].alias("size"), x["t"].alias("ok"))), lambda x: x["size"].isNotNull())
    there = F.regexp_like(text, F.lit(pattern))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
    return F.when(there if maybe is None else maybe & there, some).otherwise(none)


def _all_matches(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if len(words) > 8 else _any([F.contains(low, F.lit(w)) for w in words])
    # Runs of hexadecimal digits that are too short consume nothing that a longer one needs: runs are maximal.
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")
    return F.concat(
        _matches(text, "assign", ASSIGN, has("passw", "secret", "token", "api"), (2, lambda s: F.char_length(s) >= 6)),
        _matches(text, "access", ACCESS, F.contains(text, F.lit("AKIA")), (0, lambda s: F.char_length(s) >= 20)),
        _matches(text, "hex", HEX.replace("+", "{24,}"), None, (0, lambda s: F.lit(True))),
        _matches(text, "ident", IDENT, has("user", "login", "account", "client"), (1, lambda s: F.char_length(s) >= 3)),
        _matches(text, "key", KEY, None, (0, mixed)),
        _matches(text, "endpoint", ENDPOINT, F.contains(text, F.lit("://")), (0, lambda s: F.char_length(s) >= 10)),
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every row of ``docs`` (doc_id, text) ``doc_id, th`` (its text's hash), and the parts
    of each text once: doc_id, th, kind, start, end, role."""
    text = common.text_of()
    scanned = common.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), _all_matches(text).alias("parts")))
    own = ["doc_id", "th"]
    rows = scanned.where(F.size("parts") > 0).dropDuplicates(own).select(*own, F.explode("parts").alias("p")).select(*own, "p.*")
    ahead = Window.partitionBy(*own, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ahead)).where("ok")
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind") + 1)
    rows = common.saved(rows.select(*own, "kind", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), role.alias("role")))
    return scanned.select(*own), rows


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """Each weak part beside a complementary one, with the nearest of these as ``beside``
    (a struct gap, start, kind, end): joined on cells of their document, then by interval."""
    weak = rows.where(F.col("kind") >= STRONG).withColumn("cell", F.explode(F.sequence(F.expr(f"greatest(0, start - {scope}) div {scope}"), F.expr(f"(`end` + {scope}) div {scope}"))))
    others = rows.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"(`end` - 1) div {scope}"))))
    near = weak.alias("w").join(
        others.alias("o"),
        F.expr(f"w.doc_id <=> o.doc_id AND w.th = o.th AND w.cell = o.cell AND o.start < w.`end` + {scope} AND o.`end` > w.start - {scope}")
        & F.expr("CASE w.role WHEN 'secret' THEN o.role IN ('ident', 'endpoint') ELSE o.role = 'secret' END"),
    )
    gap = F.expr("greatest(0, o.start - w.`end`, w.start - o.`end`)").alias("gap")
    return near.groupBy("w.doc_id", "w.th", "w.start", "w.kind", "w.end").agg(F.min(F.struct(gap, "o.start", "o.kind", "o.end")).alias("beside"))


def find_spans(docs: DataFrame, *, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """Of every row of ``docs`` (doc_id, text) ``doc_id, th`` (its text's hash), and of each
    text with a reported span, once, ``doc_id, th, found``: an array of structs start, kind
    (its number in KINDS), end, in that order."""
    every, rows = _parts(docs)
    own = ["doc_id", "th"]
    reported = rows.where(F.col("kind") < STRONG).select(*own, "start", "kind", "end").unionByName(_linked(rows, scope).select(*own, "start", "kind", "end"))
    found = reported.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    return every, found


def credentials(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """The linked parts: doc_id, and of each weak part beside a complementary one kind, start,
    end and the same of its nearest complement (other_kind, other_start, other_end).  A text
    that repeats under one doc_id is reported once."""
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), F.col(c) + 1)
    found = _linked(_parts(docs)[1], scope)
    return found.select("doc_id", name("kind").alias("kind"), "start", "end", name("beside.kind").alias("other_kind"), F.col("beside.start").alias("other_start"), F.col("beside.end").alias("other_end"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, found`` of each row of ``docs``: see :func:`find_spans`."""
    rows, found = find_spans(docs, **options)
    joined = rows.alias("s").join(found.alias("f"), F.expr("s.doc_id <=> f.doc_id AND s.th = f.th"), "left")
    return joined.select("s.doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every reported span of its text replaced by ``mark``, spans that overlap
    by one.  A column n_chars, if there is one, follows a text that changes; rows without a
    span come back as they are."""
    _, found = find_spans(docs, **options)
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    add = lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] > x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last(acc)["s"], F.greatest(last(acc)["e"], x["end"]))))).otherwise(F.concat(acc, F.array(span(x["start"], x["end"]))))
    merged = common.saved(found.select("doc_id", "th", F.aggregate("found", empty, add).alias("cut")))
    text, cut = F.col("d.text"), F.col("f.cut")
    gap = lambda i: F.substring(text, (F.coalesce(F.get(cut, i - 1)["e"], F.lit(0)) + 1).cast("int"), (F.coalesce(F.get(cut, i)["s"], F.char_length(text)) - F.coalesce(F.get(cut, i - 1)["e"], F.lit(0))).cast("int"))
    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cut)), gap), mark)
    joined = docs.alias("d").join(merged.alias("f"), (F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id"))) & (F.xxhash64(text) == F.col("f.th")), "left")
    same = [common.named("d", c) for c in docs.columns]
    new = {"text": clean, "n_chars": F.char_length(clean).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*[F.when(cut.isNull(), old).otherwise(new[c]).alias(c) if c in new else old.alias(c) for c, old in zip(docs.columns, same)])


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of strong spans, their digest, and all spans."""
    found = scan(common.table(spark, sf_dir, "documents"))
    strong = F.filter("found", lambda x: x["kind"] < STRONG)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(strong), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql_kind(kind: str, pattern: str, group: int, test: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {KINDS.index(kind)} AS kind, '{ROLES[kind]}' AS role, ends - size AS start, ends AS "end" FROM (
        SELECT r, i, size, g, sum(size + gap) OVER (PARTITION BY r ORDER BY i) AS ends FROM (
            SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(g) AS g,
                   unnest(list_transform(s[1:len(m)], lambda x: length(x))) AS gap
            FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d) WHERE len(m) > 0))
        WHERE {test}"""


#: The same rows, every weak part compared with every part of its document.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join([_sql_kind("assign", ASSIGN, 2, "length(g) >= 6"), _sql_kind("access", ACCESS, 0, "size >= 20"), _sql_kind("hex", HEX, 0, "size >= 24"), _sql_kind("ident", IDENT, 1, "length(g) >= 3"), _sql_kind("key", KEY, 0, "regexp_matches(g, '[0-9]') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]')"), _sql_kind("endpoint", ENDPOINT, 0, "size >= 10")])}),
q AS (SELECT * FROM p WHERE kind < {STRONG} OR EXISTS (SELECT 1 FROM p AS o WHERE o.r = p.r AND o.start < p."end" + {SCOPE} AND o."end" > p.start - {SCOPE}
      AND CASE p.role WHEN 'secret' THEN o.role IN ('ident', 'endpoint') ELSE o.role = 'secret' END)),
n AS (SELECT *, concat_ws(':', [{", ".join(f"'{k}'" for k in KINDS)}][kind + 1], CAST(start AS BIGINT), CAST("end" AS BIGINT)) AS s FROM q),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {STRONG}) AS base, string_agg(s, ',' ORDER BY start, kind, "end") AS spans FROM n GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
