"""Queries of single rules: dates with their null rules, ambiguous places, addresses, captions, orders, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import dedup, filters, ordering
from ..sources import feeds
from .registry import NOW, now, query, stories, table
from .text_queries import c, fold, key

_T = "CASE WHEN pos % 3 = 0 THEN NULL ELSE published END"
_OUT = lambda t, days: f"CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us({t}) > {days} * 86400000000 THEN 'too old' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us({t}) < -86400000000 THEN 'in the future' END"


def _dated():
    return F.when(F.col("pos") % 3 != 0, F.col("published"))


@query("f7_web_recency", f"SELECT pos FROM stories WHERE {_T} IS NULL OR {_OUT(_T, 7)} IS NULL")
def web_recency(spark, sf):
    """Seven days; missing dates stay."""
    return stories(spark, sf).where(dates.recent(_dated(), now(), days=7, null_policy="keep")).select("pos")


@query("f8_council_recency", f"""SELECT pos, coalesce(CASE WHEN l IS NOT NULL THEN {_OUT('l', 14)} END, CASE WHEN coalesce(d, l) IS NULL THEN 'no date' ELSE {_OUT('coalesce(d, l)', 14)} END, 'kept') AS outcome
 FROM (SELECT pos, {_T} AS l, CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 5 = 0 THEN published + INTERVAL 40 DAY ELSE published END AS d FROM stories)""")
def council_recency(spark, sf):
    """Fourteen days in two steps: the listing's date, then that of the detail."""
    p = F.col("pos")
    detail = F.when(p % 4 == 0, None).when(p % 5 == 0, F.col("published") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("published"))
    return stories(spark, sf).select("pos", F.coalesce(dates.two_step_recency(_dated(), detail, now(), days=14), F.lit("kept")).alias("outcome"))


@query("f10_stored_recency", f"SELECT pos FROM stories WHERE {_T} IS NULL OR {_T} >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def stored_recency(spark, sf):
    """Seven days back, any time ahead; missing dates stay."""
    return stories(spark, sf).where(dates.recent(_dated(), now(), days=7, future_hours=1e9, null_policy="keep")).select("pos")


_NEAR = "CASE CAST(pos % 5 AS INTEGER) WHEN 0 THEN repeat('x ', 60) || 'BOSTON  ' || repeat('y ', 44) || 'Council' WHEN 1 THEN 'Boston ' || repeat('z ', 50) || 'city Boston city' WHEN 2 THEN 'a village, Boston' WHEN 3 THEN 'Bostonians of the city' ELSE title END"


@query("f4_ambiguous_places", f"""SELECT pos, coalesce(at > 0 AND regexp_matches(substr(t, greatest(1, at - 90), least(at - 1, 90) + 96), '(?i)\\b(?:city|village|district|county|council)\\b'), FALSE) AS meant
 FROM (SELECT pos, t, CASE WHEN regexp_matches(t, '(?i)(^|[^A-Za-z0-9])boston($|[^A-Za-z0-9])') THEN instr(lower(t), 'boston') ELSE 0 END AS at FROM (SELECT pos, {_NEAR} AS t FROM stories))""".replace(" at ", ' "at" ').replace("(at ", '("at" ').replace("AS at", 'AS "at"'))
def ambiguous_places(spark, sf):
    p = F.col("pos") % 5
    t = F.when(p == 0, F.concat(F.repeat(F.lit("x "), 60), F.lit("BOSTON  "), F.repeat(F.lit("y "), 44), F.lit("Council"))).when(p == 1, F.concat(F.lit("Boston "), F.repeat(F.lit("z "), 50), F.lit("city Boston city"))).when(p == 2, "a village, Boston").when(p == 3, "Bostonians of the city").otherwise(F.col("title"))
    return stories(spark, sf).select("pos", "title", t.alias("t")).select("pos", filters.ambiguous_place("t", "Boston").alias("meant"))


_TWICE = "CASE CAST(pos % 4 AS INTEGER) WHEN 0 THEN {0} WHEN 1 THEN substr({0}, 1, length({0}) * 9 // 10) WHEN 2 THEN substr({0}, 1, 40) ELSE {0} || ' more' END"


@query("n18_substantially_same", f"""SELECT pos, k = o OR (least(length(k), length(o)) >= 55 AND least(length(k), length(o)) / greatest(length(k), length(o)) >= 0.88 AND (contains(k, o) OR contains(o, k))) AS same FROM (SELECT pos, k, {_TWICE.format('k')} AS o FROM (SELECT pos, {key('summary')} AS k FROM stories))""")
def substantially_same(spark, sf):
    p, k = F.col("pos") % 4, F.col("k")
    other = F.when(p == 0, k).when(p == 1, k.substr(F.lit(1), F.floor(F.char_length(k) * 9 / 10).cast("int"))).when(p == 2, F.substring(k, 1, 40)).otherwise(F.concat(k, F.lit(" more")))
    s = stories(spark, sf).select("pos", text.comparison_key("summary").alias("k"))
    return s.select("pos", text.substantially_same(k, other).alias("same"))


@query("n30_headline_once", f"""SELECT pos, CASE WHEN contains({fold('b')}, {fold('title')}) OR title = '' THEN b ELSE title || chr(10) || chr(10) || b END AS t FROM (SELECT pos, title, CASE WHEN pos % 2 = 0 THEN 'NOW: ' || title || '. ' || summary ELSE summary END AS b FROM stories)""")
def headline_once(spark, sf):
    b = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("NOW: "), "title", F.lit(". "), "summary")).otherwise(F.col("summary"))
    return stories(spark, sf).select("pos", text.after_once(b, "title").alias("t"))


@query("n32_page_keys", "SELECT pos, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') || rtrim(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/') AS k FROM stories")
def page_keys(spark, sf):
    return stories(spark, sf).select("pos", urls.page_key("url").alias("k"))


@query("n33_caption_credits", """SELECT pos, CASE CAST(pos % 4 AS INTEGER) WHEN 0 THEN 'J. Roe ' || source WHEN 1 THEN lang WHEN 2 THEN '' ELSE '' END AS credit FROM stories""")
def caption_credits(spark, sf):
    p = F.col("pos") % 4
    caption = F.when(p == 0, F.concat(F.lit("A view. Image CREDIT: J. Roe "), "source", F.lit(" "))).when(p == 1, F.concat(F.lit("x credit:"), "lang")).when(p == 2, "no such words").otherwise(F.lit(None))
    return stories(spark, sf).select("pos", text.caption_credit(caption).alias("credit"))


@query("n34_article_ids", "SELECT pos, CASE WHEN pos % 3 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END AS id FROM stories")
def article_ids(spark, sf):
    u = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://x.org/article/"), F.col("pos").cast("string"), F.lit("-x"))).otherwise(F.col("url"))
    return stories(spark, sf).select("pos", urls.article_id(u).alias("id"))


@query("m4_unique_values", f"""SELECT pos, list_reduce(list_filter([title, upper(title), source, ' ', lang, upper(source)], lambda v: trim(v) <> ''), lambda kept, v: CASE WHEN list_contains(list_transform(kept, lambda k: replace(lower(k), 'ß', 'ss')), replace(lower(v), 'ß', 'ss')) THEN kept ELSE list_append(kept, v) END, CAST([] AS VARCHAR[])) AS v FROM stories""")
def unique_values(spark, sf):
    values = F.array("title", F.upper("title"), "source", F.lit(" "), "lang", F.upper("source"))
    return stories(spark, sf).select("pos", text.unique_fold(values).alias("v"))


@query("d8_first_links", "SELECT min(pos) AS pos FROM stories GROUP BY url")
def first_links(spark, sf):
    return dedup.first_wins(stories(spark, sf), "url").select("pos")


_BY = "CASE WHEN lang <> 'es' THEN published END"


@query("o3_sport_order", f"SELECT pos, row_number() OVER (PARTITION BY source ORDER BY {_BY} DESC NULLS LAST, pos) AS newest, row_number() OVER (PARTITION BY source ORDER BY {_BY} ASC NULLS LAST, pos) AS oldest FROM stories")
def sport_order(spark, sf):
    s = stories(spark, sf).withColumn("t", F.when(F.col("lang") != "es", F.col("published")))
    place = lambda how: F.row_number().over(Window.partitionBy("source").orderBy(*ordering.story_order(how, "t", missing="last"))).cast("long")
    return s.select("pos", place("newest").alias("newest"), place("oldest").alias("oldest"))


@query("s12_listing_posts", f"""SELECT pos, CAST(pos AS VARCHAR) AS id, title, '/news/' || source AS url, summary, epoch_us(date_trunc('second', published)) AS published FROM (SELECT pos, source, published, title, CASE WHEN pos % 2 = 0 THEN summary ELSE '' END AS summary FROM stories) WHERE title <> ''""")
def listing_posts(spark, sf):
    one = F.struct(F.col("pos").cast("string").alias("id"), F.struct(F.col("title").alias("postTitle"), F.col("source").alias("postSlug"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("postDate"), F.when(F.col("pos") % 2 == 0, F.col("summary")).alias("postSummary")).alias("attributes"))
    untitled = F.struct(F.lit("x").alias("id"), F.struct(F.lit("").alias("postTitle"), F.lit("x").alias("postSlug"), F.lit("x").alias("postDate"), F.lit("x").alias("postSummary")).alias("attributes"))
    p = stories(spark, sf).select("pos", F.to_json(F.struct(F.array(one, untitled).alias("data"))).alias("payload"))
    return feeds.listing_posts(p).select("pos", "id", "title", "url", "summary", F.unix_micros("published").alias("published"))


@query("s11_embedded_messages", "SELECT pos, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'f' END AS key, source AS title, CASE WHEN pos % 2 = 0 THEN '/news/' || pos ELSE '/teams/7/match-centre/' || pos END AS url, CASE WHEN pos % 2 = 0 THEN lang ELSE '' END AS summary FROM stories")
def embedded_messages(spark, sf):
    """Every story as a page whose state holds an article or a fixture, and a message of no address."""
    n = F.col("pos").cast("string")
    article = F.format_string('"a": {"type": "article", "article_id": "%s", "title": "%s", "tagline": "%s"}', n, "source", "lang")
    fixture = F.format_string('"f": {"type": "fixture", "team_id": "7", "fixture": {"fixture_id": "%s"}, "title": "%s"}', n, "source")
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="x">{"props": {"initialReduxState": {"activityStream": {"messages": {"n": {"title": "none"}, '), F.when(F.col("pos") % 2 == 0, article).otherwise(fixture), F.lit("}}}}}</script></html>"))
    return feeds.embedded_messages(stories(spark, sf).select("pos", page.alias("html"))).select("pos", "key", "title", "url", "summary")


@query("n48_derived_ids", f"""SELECT page_id, trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(n || '|' || u), 1, 10) AS id FROM (SELECT page_id, 'Page ' || page_id AS n, lower(regexp_extract(url, '^([^:]*)', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS u FROM pages WHERE NOT contains(url, '?'))
 UNION ALL SELECT page_id, 'page-' || page_id || '-' || substr(sha256('Page ' || page_id || '|' || 'https://x.org/' || page_id || '?a=1'), 1, 10) FROM pages WHERE contains(url, '?')""")
def derived_ids(spark, sf):
    u = F.when(F.contains("url", F.lit("?")), F.concat(F.lit("HTTPS://X.org/"), F.col("page_id").cast("string"), F.lit("?utm_source=z&a=1&fbclid=9#x"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.derived_id(F.concat(F.lit("Page "), F.col("page_id").cast("string")), u).alias("id"))
