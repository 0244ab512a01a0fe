"""Queries of rendering, reports and the remaining filters and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..data.boilerplate import BOILERPLATE_LINES
from ..data.rules import BLOCKED_SUMMARIES, DECORATIONS, NOISE_PREFIXES, SCRAPE_NOISE
from ..functions import numbers
from ..functions.text import casefold, clean
from ..operators import articles, editing, filters, images, ordering, publish
from ..streaming import state
from .registry import query, stories, table
from .text_queries import c, fold, key

_PS = f"list_filter(list_transform(string_split(trim(body), chr(10)), lambda x: {c('x')}), lambda x: x <> '')"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"

#: What stories lack to exercise the rules: a prefix, repeated and noisy paragraphs, a quote first, the title as summary.
_NEWS = """news AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN 'Latest News – ' || title WHEN pos % 13 = 0 THEN ' - ' ELSE title END AS title, CASE WHEN pos % 11 = 0 THEN upper(title) WHEN pos % 17 = 0 THEN 'Sign up!' WHEN pos % 4 = 0 THEN '' ELSE summary END AS summary,
 CASE WHEN pos % 19 = 0 THEN '' ELSE CASE WHEN pos % 7 = 0 THEN '“It''s a quote,” <they> said & left.' || chr(10) ELSE '' END || body || CASE WHEN pos % 5 = 0 THEN chr(10) || 'a photo.JPG' || chr(10) || 'Subscribe to us' || chr(10) || body || chr(10) || 'He said "yes" then.' ELSE '' END END AS body,
 source, CASE WHEN pos % 2 = 0 THEN 'Lincoln' ELSE '' END AS location, lang AS category, CASE WHEN pos % 3 = 1 THEN strftime(published, '%Y-%m-%d') ELSE '' END AS published FROM stories)"""


def news(spark, sf):
    p, at = F.col("pos"), F.col("pos") % 5 == 0
    more = F.concat(F.lit("\na photo.JPG\nSubscribe to us\n"), "body", F.lit('\nHe said "yes" then.'))
    body = F.concat(F.when(p % 7 == 0, "“It's a quote,” <they> said & left.\n").otherwise(""), "body", F.when(at, more).otherwise(""))
    return stories(spark, sf).select(
        "pos",
        F.when(p % 3 == 0, F.concat(F.lit("Latest News – "), "title")).when(p % 13 == 0, " - ").otherwise(F.col("title")).alias("title"),
        F.when(p % 11 == 0, F.upper("title")).when(p % 17 == 0, "Sign up!").when(p % 4 == 0, "").otherwise(F.col("summary")).alias("summary"),
        F.when(p % 19 == 0, "").otherwise(body).alias("body"),
        "source",
        F.when(p % 2 == 0, "Lincoln").otherwise("").alias("location"),
        F.col("lang").alias("category"),
        F.when(p % 3 == 1, F.date_format("published", "yyyy-MM-dd")).otherwise("").alias("published"),
    )


def _noise(x: str) -> str:
    fixed = ", ".join(f"'{v}'" for v in SCRAPE_NOISE)
    return rf"({key(x)} = '' OR {key(x)} IN ({fixed}) OR regexp_full_match(trim({x}), '(?i)[^\n]*\.(jpg|jpeg|png|gif|webp|svg)') OR " + " OR ".join(f"starts_with({key(x)}, '{v}')" for v in NOISE_PREFIXES) + ")"


_ART = rf"""{_NEWS}, a1 AS (SELECT *, trim(regexp_replace({c('title')}, '(?i)^(?:news|latest news|press release)\s*[:\-–—]\s*', ''), ' -–—') AS t, {c('summary')} AS s0, {_PS} AS lines FROM news),
a2 AS (SELECT *, CASE WHEN {key('s0')} = {key('t')} OR {_noise('s0')} THEN '' ELSE s0 END AS s FROM a1),
a3 AS (SELECT *, list_filter(lines, lambda x: NOT {_noise('x')} AND {key('x')} <> {key('t')} AND {key('x')} <> {key('s')}) AS own FROM a2),
a4 AS (SELECT *, list_transform(own, lambda x: {key('x')}) AS keys FROM a3),
art AS (SELECT pos, CASE WHEN t = '' THEN 'Untitled story' ELSE t END AS t, s, list_filter(own, lambda x, i: list_position(keys, keys[i]) = i) AS ps,
 CASE WHEN source <> '' THEN ['Source: ' || source] ELSE [] END AS f1, CASE WHEN location <> '' THEN ['Area: ' || location] ELSE [] END AS f2, CASE WHEN category <> '' THEN ['Category: ' || category] ELSE [] END AS f3,
 CASE WHEN published <> '' THEN ['Published: ' || published] ELSE [] END AS f4 FROM a4)"""
_FALL = f"CASE WHEN s = '' AND len(ps) = 0 THEN '{publish.FALLBACK}' ELSE '' END"
_FOOT = "array_to_string(list_concat(f1, f2, f3, f4), ' | ')"


def _sections(x: str) -> str:
    return f"array_to_string(list_filter(list_transform({x}, lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10))"


@query("p2_articles", f", {_ART} SELECT pos, t AS title, s AS summary, len(ps) AS n, sha256(array_to_string(ps, '¶')) AS paragraphs FROM art")
def built(spark, sf):
    a = articles.build(news(spark, sf)).select("pos", "article.*")
    return a.select("pos", "title", "summary", F.size("paragraphs").cast("long").alias("n"), F.sha2(F.array_join("paragraphs", "¶"), 256).alias("paragraphs"))


@query("p3_plain_text", f", {_ART} SELECT pos, sha256({_sections(f'list_concat([t, s], ps, [{_FALL}, array_to_string(list_concat(f1, f2, f4), chr(32) || chr(124) || chr(32))])')}) AS plain FROM art")
def plain_text(spark, sf):
    return articles.build(news(spark, sf)).select("pos", F.sha2(publish.plain_text(F.col("article")), 256).alias("plain"))


@query("p4_html_and_markdown", f""", {_ART} SELECT pos, sha256({_sections(f"list_concat(['# ' || t, CASE WHEN s <> '' THEN '**' || s || '**' ELSE '' END], ps, [{_FALL}, CASE WHEN {_FOOT} <> '' THEN '*' || {_FOOT} || '*' ELSE '' END])")}) AS markdown,
 sha256(array_to_string(['<!DOCTYPE html>', '<html lang="en">', '<head>', '<meta charset="utf-8">', '<title>' || {_ESC.format('t')} || '</title>', '</head>', '<body>', '<article>', '<h1>' || {_ESC.format('t')} || '</h1>',
 CASE WHEN s <> '' THEN '<p><strong>' || {_ESC.format('s')} || '</strong></p>' ELSE '' END, CASE WHEN s = '' AND len(ps) = 0 THEN '<p>{publish.FALLBACK}</p>' ELSE array_to_string(list_transform(ps, lambda p: '<p>' || {_ESC.format('p')} || '</p>'), chr(10)) END,
 CASE WHEN {_FOOT} <> '' THEN '<p><small>' || {_ESC.format(_FOOT)} || '</small></p>' ELSE '' END, '</article>', '</body>', '</html>', ''], chr(10))) AS html FROM art""")
def html_and_markdown(spark, sf):
    a = F.col("article")
    return articles.build(news(spark, sf)).select("pos", F.sha2(publish.markdown(a), 256).alias("markdown"), F.sha2(publish.html_page(a), 256).alias("html"))


@query("p7_breaking", f""", {_ART} SELECT pos, {_sections("['🚨 BREAKING NEWS', t, CASE WHEN len(string_split(x, ' ')) <= 55 THEN x ELSE rtrim(array_to_string(string_split(x, ' ')[1:55], ' '), ' ,;:-') || '…' END]")} AS breaking FROM (SELECT *, CASE WHEN s <> '' THEN s ELSE coalesce(ps[1], '') END AS x FROM art)""")
def breaking(spark, sf):
    return articles.build(news(spark, sf)).select("pos", publish.breaking(F.col("article")).alias("breaking"))


_QUOTE = publish.QUOTE.replace("\\", "")
_LAST = lambda mark, back: f"CASE WHEN instr(reverse(h), {back}) > 0 THEN length(h) - instr(reverse(h), {back}) - {mark} + 1 ELSE -1 END"


@query("p5_newsletter", f""", {_ART}, n1 AS (SELECT *, CASE WHEN s <> '' THEN s ELSE coalesce(ps[1], '') END AS o FROM art), n2 AS (SELECT *, list_filter(ps, lambda x: {key('x')} <> {key('o')}) AS l FROM n1),
n3 AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{_QUOTE}')) AS q, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '{_QUOTE}'))[1:4] AS k FROM n2),
n4 AS (SELECT *, list_transform(CASE WHEN len(q) = 0 OR (len(k) = 4 AND q[1] > k[4]) THEN k WHEN len(k) = 4 THEN list_concat(k[1:3], q[1:1]) ELSE list_concat(k, q[1:1]) END, lambda i: l[i]) AS b FROM n3),
n5 AS (SELECT pos, {_sections(f"list_concat([t, o], b, [CASE WHEN s = '' AND len(ps) = 0 THEN '{publish.NEWSLETTER_FALLBACK}' ELSE '' END, array_to_string(list_concat(f2, f3, f1), ' | ')])")} AS w FROM n4),
n6 AS (SELECT *, substr(w, 1, 1799) AS h FROM n5), n7 AS (SELECT *, {_LAST(2, 'chr(10) || chr(10)')} AS gap, greatest({_LAST(2, "' .'")}, {_LAST(2, "' !'")}, {_LAST(2, "' ?'")}) AS stop FROM n6),
n8 AS (SELECT pos, CASE WHEN length(w) <= 1800 THEN w ELSE regexp_replace(CASE WHEN gap > 900 THEN substr(h, 1, gap) WHEN stop > 900 THEN substr(h, 1, stop + 1) ELSE h END, '\\s+$', '') || '…' END AS x FROM n7)
SELECT pos, length(x) AS n, sha256(x) AS text FROM n8""")
def newsletter(spark, sf):
    t = publish.newsletter(F.col("article"))
    return articles.build(news(spark, sf)).select("pos", t.alias("t")).select("pos", F.char_length("t").cast("long").alias("n"), F.sha2("t", 256).alias("text"))


@query("n50_cards", f"SELECT pos, CASE WHEN length({c('body')}) > 190 THEN substr({c('body')}, 1, 187) || '...' ELSE {c('body')} END AS card, CASE WHEN pos % 3 = 0 THEN 'no image' WHEN pos % 2 = 0 THEN 'approved' ELSE 'not reviewed' END AS rights FROM stories")
def cards(spark, sf):
    image = F.when(F.col("pos") % 3 == 0, "").otherwise("x.jpg")
    return stories(spark, sf).select("pos", publish.card("body").alias("card"), publish.rights_status(image, F.col("pos") % 2 == 0).alias("rights"))


@query("n51_change_labels", """SELECT module, day, CASE WHEN before IS NULL THEN 'Baseline established' WHEN n - before > 0 THEN '+' || (n - before) || ' since previous refresh' ELSE n || ' updates today' END AS label
 FROM (SELECT *, lag(n) OVER (PARTITION BY module ORDER BY day) AS before FROM (SELECT event_type AS module, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL))""")
def change_labels(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("module"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("module").orderBy("day")
    g = g.withColumn("before", F.lag("n").over(w))
    return g.select("module", "day", state.change_label(F.col("n"), F.col("before"), F.col("n") - F.col("before")).alias("label"))


def _blocked(x: str) -> str:
    return " OR ".join("starts_with({}, '{}')".format(f"trim({fold(x)}, ' :.-')", v.replace("'", "''")) for v in BLOCKED_SUMMARIES)


_SUMMARIES = "SELECT pos, CASE pos % 6 WHEN 0 THEN 'Image caption: ' || title WHEN 1 THEN ' – ' || title WHEN 2 THEN '“' || summary || '”' WHEN 3 THEN ': Please try again ' || summary WHEN 4 THEN chr(39) || title || chr(39) ELSE summary END AS summary FROM stories"


@query("f26_meaningful_summaries", f"""SELECT pos, CASE WHEN {_blocked('s')} OR (len(string_split(s, ' ')) <= 8 AND NOT regexp_matches(s, '[.!?]$')) OR (regexp_matches(s, '^["“‘'']') AND regexp_matches(s, '["”’'']$')) THEN '' ELSE s END AS summary FROM (SELECT pos, {c('summary')} AS s FROM ({_SUMMARIES}))""")
def meaningful_summaries(spark, sf):
    p, kind = F.col("pos"), F.col("pos") % 6
    summary = F.when(kind == 0, F.concat(F.lit("Image caption: "), "title")).when(kind == 1, F.concat(F.lit(" – "), "title")).when(kind == 2, F.concat(F.lit("“"), "summary", F.lit("”")))
    summary = summary.when(kind == 3, F.concat(F.lit(": Please try again "), "summary")).when(kind == 4, F.concat(F.lit("'"), "title", F.lit("'"))).otherwise(F.col("summary"))
    return stories(spark, sf).select(p, filters.meaningful_summary(summary).alias("summary"))


@query("o2_oldest_first", "SELECT pos, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang <> 'es' THEN published END ASC NULLS FIRST, pos) AS oldest, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang <> 'es' THEN published END ASC NULLS LAST, pos) AS oldest_last FROM stories")
def oldest_first(spark, sf):
    """The places that the sorts give: rows are numbered as they come out of them."""
    s = stories(spark, sf).withColumn("t", F.when(F.col("lang") != "es", F.col("published")))
    placed = lambda missing: ordering.sorted_stories(s, "oldest", "t", missing=missing).withColumn("m", F.monotonically_increasing_id())
    by = lambda missing, name: placed(missing).select("pos", F.row_number().over(Window.partitionBy("source").orderBy("m")).cast("long").alias(name))
    return by("oldest", "oldest").join(by("last", "oldest_last"), "pos")


@query("o4_title_order", f"SELECT pos, row_number() OVER (PARTITION BY source ORDER BY encode({fold('title')}), pos) AS rank FROM stories")
def title_order(spark, sf):
    return stories(spark, sf).select("pos", F.row_number().over(Window.partitionBy("source").orderBy(casefold("title"), "pos")).cast("long").alias("rank"))


@query("a7_run_statistics", """SELECT event_type, count(*) AS attempted, count(*) FILTER (value > 50) AS succeeded, CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (value > 50) / count(*) * 100, 2) ELSE 0 END AS success_rate, greatest(0, count(*) - 1000) AS over_limit FROM events GROUP BY event_type""")
def run_statistics(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("value") > 50).alias("succeeded"))
    return g.select("event_type", "attempted", "succeeded", numbers.rate(F.col("succeeded"), F.col("attempted")).alias("success_rate"), numbers.skipped(F.col("attempted"), F.lit(1000)).cast("long").alias("over_limit"))


@query("so1_union_all", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE lang = 'de' UNION ALL SELECT NULL FROM labels) GROUP BY source")
def union_all(spark, sf):
    d = table(spark, sf, "documents")
    rest = d.where("lang = 'de'").select("doc_id", "source")
    all_ = d.unionByName(rest, allowMissingColumns=True).unionByName(table(spark, sf, "labels").select("doc_id"), allowMissingColumns=True)
    return all_.groupBy("source").agg(F.count("*").alias("n"))


@query("n21_house_style")
def house_style(spark, sf):
    """Every body in house style, short paragraphs merged; tested by hand, there is no SQL."""
    from ..functions.text import paragraphs

    edited = F.transform(paragraphs("body"), lambda p: editing.without_repeats(editing.house_style(p)))
    return stories(spark, sf).select("pos", F.array_join(editing.merged(edited), "\n\n").alias("body"))


_BOILER = ", ".join(f"'{x}'" for x in BOILERPLATE_LINES)


#: A line before each text: furniture of every kind, and lines that only look like it.
_LINES = ["Subscribe to our newsletter", "sign up", "Read more about it", "Related content", "More from us", "Follow us!", "Share this", "share via mail", "LinkedIn", "PRINT", "Like this", "Loading...", "Advertisement", "Cookies are fine", "Comment", "Leave a reply", "Posted in News", "next story", "Tags:x", "Category: y", "Opens in a new window", "Copy link", "Author: A", "Sign upwards", "x", "X marks", "1 January 2024"]
_FURNITURE = r"^(?:(?:subscribe|sign up|read more|related (?:articles|stories|posts|content)|you may also like|more from|recommended for you|follow us|share this|share (?:on|via|to)|advertisement|cookie|comments?|leave a (?:reply|comment)|posted (?:in|on|by)|(?:previous|next) (?:article|post|story)|opens? in (?:a )?new window|copy link)(?:[^\p{L}\p{N}_]|$)|(?:facebook|twitter|x|linkedin|whatsapp|email|share|tweet|pin|send|print|like this:?|loading(?:\.\.\.)?)$|tags?:|categories?:)"


@query("x4_own_lines", f"""SELECT pos, array_to_string(list_filter(list_transform(string_split(list_extract({_LINES}, CAST(pos % {len(_LINES)} AS INTEGER) + 1) || chr(10) || body, chr(10)), lambda x: {c('x')}), lambda t: NOT (length(t) < 2 OR regexp_matches(t, '(?i){_FURNITURE}'))), chr(10)) AS body FROM stories""")
def own_lines(spark, sf):
    line = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("pos") % len(_LINES) + 1).cast("int"))
    return stories(spark, sf).select("pos", F.array_join(images.own_lines(F.concat(line, F.lit("\n"), "body")), "\n").alias("body"))


@query("n17_boilerplate_lines", rf"""SELECT pos, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: {c('x')}), lambda t: NOT (length(t) < 2 OR {fold('t')} IN ({_BOILER})
 OR regexp_matches(t, '(?i)^(published|updated|posted|date|author|by|category|tags?|location|share)\s*:') OR regexp_matches(t, '^\d{{1,2}}(st|nd|rd|th)? [A-Z][a-z]+ \d{{4}}$|^\d{{1,2}}/\d{{1,2}}/\d{{4}}$|^\d{{1,2}}:\d{{2}}( ?[ap]m)?$'))), chr(10)) AS body FROM stories""")
def boilerplate_lines(spark, sf):
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: clean(x)), lambda x: ~images.boilerplate_line(x))
    return stories(spark, sf).select("pos", F.array_join(lines, "\n").alias("body"))


#: Six candidates a story: two by address and size, one logo, one that differs from the first in case, one video, one from the root.
_CANDIDATES = """SELECT pos, unnest([{'i': 0, 'url': 'https://x.org/' || pos % 9 || '00x' || pos % 7 || '50/a.jpg', 'w': pos % 4 * 100, 'h': pos % 3 * 90, 'meta': pos % 5 = 0},
 {'i': 1, 'url': 'https://x.org/ace/standard/' || (pos % 6 + 1) || '20/b.jpg?width=' || (pos % 8 + 2) || '0&height=40', 'w': 0, 'h': 0, 'meta': pos % 11 = 0},
 {'i': 2, 'url': 'https://x.org/site-' || CASE WHEN pos % 2 = 0 THEN 'Crest' ELSE 'photo' END || '.png', 'w': pos % 10 * 60, 'h': 0, 'meta': FALSE},
 {'i': 3, 'url': 'https://X.org/' || pos % 9 || '00x' || pos % 7 || '50/A.jpg', 'w': 5000, 'h': 5000, 'meta': TRUE}, {'i': 4, 'url': CASE WHEN pos % 3 = 0 THEN 'data:image/png' ELSE 'https://x.org/Video/9000x9000.jpg' END, 'w': 0, 'h': 0, 'meta': TRUE},
 {'i': 5, 'url': CASE WHEN pos % 4 = 0 THEN 'https://site.org/r/900x' || pos % 80 + 10 || '.jpg' WHEN pos % 4 = 1 THEN 'https://site.org/c/900x' || pos % 80 + 10 || '.jpg' ELSE 'ftp://x' END, 'w': 0, 'h': 0, 'meta': FALSE}][CASE WHEN pos % 13 = 0 THEN 3 ELSE 1 END:CASE WHEN pos % 13 = 0 THEN 3 WHEN pos % 17 = 0 THEN 0 ELSE 6 END]) AS k FROM stories"""


@query("x8_best_images", rf"""SELECT s.pos, coalesce(first(k.url ORDER BY k.score DESC, k.i) FILTER (WHERE k.url IS NOT NULL), '') AS image FROM stories s LEFT JOIN (SELECT pos, i, url, CASE WHEN w > 0 AND h > 0 THEN w * h WHEN w > 0 THEN w * w ELSE 1 END + CASE WHEN meta THEN 2000000 ELSE 0 END
 - CASE WHEN regexp_matches(lower(url), '{"|".join(DECORATIONS)}') THEN 5000000 ELSE 0 END AS score FROM (SELECT pos, i, url, meta, greatest(w, CASE WHEN a[1] <> '' THEN CAST(a[1] AS BIGINT) WHEN b[1] <> '' THEN CAST(b[1] AS BIGINT) WHEN d <> '' THEN CAST(d AS BIGINT) ELSE 0 END) AS w,
 greatest(h, CASE WHEN a[1] <> '' THEN CAST(a[2] AS BIGINT) WHEN b[1] <> '' THEN CAST(b[2] AS BIGINT) WHEN d <> '' THEN CAST(d AS BIGINT) * 9 // 16 ELSE 0 END) AS h FROM (SELECT pos, k.i AS i, k.url AS url, k.w AS w, k.h AS h, k.meta AS meta,
 [regexp_extract(k.url, '(^|[^0-9])([0-9]{{2,4}})[xX]([0-9]{{2,4}})($|[^0-9])', 2), regexp_extract(k.url, '(^|[^0-9])([0-9]{{2,4}})[xX]([0-9]{{2,4}})($|[^0-9])', 3)] AS a,
 [regexp_extract(k.url, '[?&](?:width|w)=([0-9]{{2,4}}).*?[?&](?:height|h)=([0-9]{{2,4}})', 1), regexp_extract(k.url, '[?&](?:width|w)=([0-9]{{2,4}}).*?[?&](?:height|h)=([0-9]{{2,4}})', 2)] AS b, regexp_extract(k.url, '/(?:standard|news|ace)/([0-9]{{2,4}})/', 1) AS d
 FROM (SELECT * FROM ({_CANDIDATES}) WHERE regexp_matches(lower(k.url), '^https?://[^/]') AND NOT contains(lower(k.url), '/video/') QUALIFY row_number() OVER (PARTITION BY pos, lower(k.url) ORDER BY k.i) = 1)))) AS k ON k.pos = s.pos GROUP BY s.pos""")
def best_images(spark, sf):
    p = F.col("pos")
    text = lambda *parts: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts])
    long = lambda n: F.lit(n).cast("long")
    one = lambda url, w, h, meta: F.struct(url.alias("url"), w.alias("width"), h.alias("height"), meta.alias("metadata"))
    last = F.when(p % 4 == 0, text("/r/900x", p % 80 + 10, ".jpg")).when(p % 4 == 1, text("900x", p % 80 + 10, ".jpg")).otherwise("ftp://x")
    some = F.array(
        one(text("https://x.org/", p % 9, "00x", p % 7, "50/a.jpg"), p % 4 * 100, p % 3 * 90, p % 5 == 0),
        one(text(" https://x.org/ace/standard/", p % 6 + 1, "20/b.jpg?width=", p % 8 + 2, "0&amp;height=40"), long(0), long(0), p % 11 == 0),
        one(F.concat(F.lit("https://x.org/site-"), F.when(p % 2 == 0, "Crest").otherwise("photo"), F.lit(".png")), p % 10 * 60, long(0), F.lit(False)),
        one(text("https://X.org/", p % 9, "00x", p % 7, "50/A.jpg"), long(5000), long(5000), F.lit(True)),
        one(F.when(p % 3 == 0, "data:image/png").otherwise("https://x.org/Video/9000x9000.jpg"), long(0), long(0), F.lit(True)),
        one(last, long(0), long(0), F.lit(False)),
    )
    first = F.when(p % 13 == 0, 3).otherwise(1)
    some = F.slice(some, first, F.when(p % 13 == 0, 1).when(p % 17 == 0, 0).otherwise(6))
    return stories(spark, sf).select("pos", images.best_image(some, F.lit("https://site.org/c/page?x=/y/")).alias("image"))


@query("x16_without_attachment", """SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '|') AS lines FROM (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x NOT IN ('the', 'of', 'la')) AS l FROM conversations)""")
def without_attachment(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), " ")
    attachment = F.array(*map(F.lit, ("the", "of", "la")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(images.without_attachment(lines, attachment), "|").alias("lines"))


@query("t3_pending_items", """SELECT module, key, CASE WHEN complete THEN 'staged' ELSE 'pending' END AS state, CASE WHEN complete THEN done ELSE last END AS at FROM (
 SELECT event_type AS module, CAST(user_id AS VARCHAR) AS key, bool_or(value > 60) AS complete, min(event_id) FILTER (value > 60) AS done, max(event_id) AS last FROM events GROUP BY ALL)""")
def pending_items(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("module"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("at"), (F.col("value") > 60).alias("complete"))
    return state.pending(e)


@query("t11_deliveries", """SELECT user_id, CASE s WHEN 'queued' THEN 'sending' WHEN 'sending' THEN CASE WHEN ok THEN 'sent' ELSE 'failed' END ELSE s END AS state FROM (
 SELECT event_id AS user_id, ['queued', 'sending', 'sent', 'failed'][event_id % 4 + 1] AS s, value > 50 AS ok FROM events)""")
def deliveries(spark, sf):
    states = F.array(*map(F.lit, ("queued", "sending", "sent", "failed")))
    e = table(spark, sf, "events").select(F.col("event_id").alias("user_id"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("s"), (F.col("value") > 50).alias("ok"))
    return e.select("user_id", state.delivery_step(F.col("s"), F.col("ok")).alias("state"))
