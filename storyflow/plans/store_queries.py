"""Queries of the paged source, packs, run logs and de-duplication by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, listings, lookup, phrases, runlog
from ..operators.lineage import folder
from ..sources import packs, paged
from .registry import query, stories, table
from .text_queries import ascii_, c, fold


@query("s20_paged_collection", """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END AS batch FROM events WHERE CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-17' AND CAST(ts AS TIMESTAMP) <= TIMESTAMP '2024-01-20 06:00:00'""")
def paged_collection(spark, sf):
    """All events served by pages: two runs of the collector, the second over its overlap too."""
    spark.dataSource.register(paged.PagedItems)
    served, store, checkpoint = folder(spark), folder(spark), folder(spark)
    # In the order of time, in small row groups whose footers tell their times, so that a page is found without the others.
    events = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created"), F.col("props").alias("payload"))
    events.repartitionByRange(F.desc("created")).sortWithinPartitions(F.desc("created"), F.desc("id")).write.option("parquet.block.size", 1 << 20).parquet(served)
    for now in ("2024-01-20T00:00:00Z", "2024-01-20T06:00:00Z"):
        paged.collect(spark.readStream.format("paged_items").options(pageSize=500, mostPages=1_000_000, now=now).load(served), store, checkpoint)
    return spark.read.schema("id string, batch long").parquet(f"{store}/items")


_SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CREDIT = "coalesce(nullif(trim(CASE WHEN pos % 3 = 0 THEN ' Jane Roe ' ELSE '' END), ''), source)"
_WITH = lambda t, line: f"CASE WHEN trim({t}) = '' OR contains(replace(lower(trim({t})), 'ß', 'ss'), replace(lower({_CREDIT}), 'ß', 'ss')) THEN trim({t}) ELSE trim({t}) || chr(10) || chr(10) || '{line}' || {_CREDIT} END"


@query("w7_story_packs", f"""SELECT substr(CASE WHEN {_SLUG} = '' THEN 'story' ELSE {_SLUG} END, 1, 60) || '-' || pos AS name, CAST(6 AS BIGINT) AS files, sha256({_WITH('body', 'Image credit: ')}) AS website, sha256({_WITH('title', '📷 Image: ')}) AS facebook,
 {_CREDIT} AS credit, title, 'Credit: ' || {_CREDIT} || chr(10) || 'Caption: A caption' || chr(10) || 'Alt text: ' || chr(10) || 'Source: https://x.org/' || pos || '.jpg' AS details FROM stories""")
def story_packs(spark, sf):
    """Every story's pack, written by the pack writer and read back."""
    spark.dataSource.register(packs.StoryPacks)
    none = F.lit(None).cast("string")
    s = stories(spark, sf).select(
        "pos", "title", "source", "url", F.col("published").cast("string").alias("published"), F.col("lang").alias("category"), F.array("source", "lang").alias("tags"), F.concat(F.lit("https://x.org/"), F.col("pos").cast("string"), F.lit(".jpg")).alias("image_url"),
        F.lit("A caption").alias("image_caption"), F.when(F.col("pos") % 3 == 0, " Jane Roe ").otherwise("").alias("image_credit"), none.alias("image_alt"), F.col("body").alias("website"), F.col("title").alias("facebook"), F.col("summary").alias("newsletter"),
    )
    where = folder(spark)
    packs.packs(s).write.format("story_packs").mode("append").save(where)
    of = lambda f: F.max(F.when(F.col("file") == packs.FILES[f], F.col("text")))
    meta = F.from_json(of("metadata"), "title string, image struct<credit:string>")
    return packs.read_packs(spark, where).groupBy("name").agg(F.count("*").alias("files"), F.sha2(of("website"), 256).alias("website"), F.sha2(of("facebook"), 256).alias("facebook"), meta["image"]["credit"].alias("credit"), meta["title"].alias("title"), of("image_details").alias("details"))


@query("w2_run_log", """, r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts, event_id % 4 = 0 AS start, event_type, value FROM events)
SELECT run_id, arg_max(event_type, CASE WHEN start THEN seq END) AS scope, arg_max(CASE WHEN start THEN 'running' ELSE 'success' END, seq) AS status, epoch_us(arg_max(CAST(ts AS TIMESTAMP), CASE WHEN start THEN seq END)) AS started_at, epoch_us(arg_max(CAST(ts AS TIMESTAMP), CASE WHEN NOT start THEN seq END)) AS completed_at,
 arg_max(CAST(floor(value) AS BIGINT), CASE WHEN NOT start THEN seq END) AS stored FROM r GROUP BY run_id""")
def run_log(spark, sf):
    """Every user's events as records of one run: each column's last value that was logged."""
    start, ts, none = F.col("event_id") % 4 == 0, F.col("ts").cast("timestamp"), F.lit(None)
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.when(start, ts).alias("started_at"), F.when(~start, ts).alias("completed_at"), F.when(start, F.col("event_type")).alias("scope"), none.cast("long").alias("discovered"),
        F.when(~start, F.floor("value").cast("long")).alias("stored"), F.when(start, "running").otherwise("success").alias("status"), none.cast("string").alias("message"), F.col("event_id").alias("seq"),
    )
    return runlog.latest(e).select("run_id", "scope", "status", F.unix_micros("started_at").alias("started_at"), F.unix_micros("completed_at").alias("completed_at"), "stored")


@query("d4_by_priority", f""", k AS (SELECT pos, ['u' || pos % 300 || source, 't' || {ascii_('title', ' ')}] AS keys, row_number() OVER (ORDER BY CASE WHEN source = 'src1' THEN 0 ELSE 1 END, length(body) DESC, pos) AS n FROM stories),
r AS (SELECT n, pos, TRUE AS kept, keys AS claimed FROM k WHERE n = 1
 UNION ALL SELECT k.n, k.pos, NOT list_has_any(r.claimed, k.keys), CASE WHEN list_has_any(r.claimed, k.keys) THEN r.claimed ELSE list_concat(r.claimed, k.keys) END FROM r JOIN k ON k.n = r.n + 1)
SELECT pos FROM r WHERE kept""")
def by_priority(spark, sf):
    """The own source first, then the longest: each story but those that share an address or a title with one kept before."""
    keys = F.array(F.concat(F.lit("u"), (F.col("pos") % 300).cast("string"), "source"), F.concat(F.lit("t"), text.ascii_key("title")))
    return dedup.by_priority(stories(spark, sf), keys, F.col("source") != "src1", F.desc(F.char_length("body")), F.asc("pos")).select("pos")


_YEAR = 2024
_CARDS = f"""cards AS (SELECT pos, source, CASE CAST(pos % 7 AS INTEGER) WHEN 0 THEN 'Latest  NEWS!' WHEN 1 THEN 'Fell-Running' WHEN 2 THEN 'Grand Prix' ELSE title END AS title, CASE WHEN pos % 3 = 0 THEN summary ELSE '' END AS summary, CASE WHEN pos % 5 = 0 THEN '1 May' ELSE '' END AS published,
 'https://x.org/' || list_extract(['a', 'blog/x', 'blog/2024/x', 'News/Archive/1', 'n/TAG/x', '2019/x', '1999/x', 'n?category=b', 'blog/2030', 'blog/3rd-May-2024'], CAST(pos % 10 AS INTEGER) + 1) AS url, pos % 13 = 0 AS meta, pos % 4 = 1 AS broad, pos % 3 AS n_links, body AS card_text, CASE WHEN pos % 8 = 0 THEN body ELSE title END AS link_text,
 CASE WHEN pos % 2 = 0 THEN 'x Tag-link' ELSE 'plain' END AS marker, CASE WHEN pos % 6 = 0 THEN 'i.jpg' ELSE '' END AS image FROM stories),
seg AS (SELECT *, list_filter(string_split(regexp_extract(url, '^https://x.org/([^?]*)', 1), '/'), lambda s: s <> '') AS s, trim(regexp_replace({{fold}}, '[^a-z0-9]+', ' ', 'g')) AS k, (published <> '' OR summary <> '') AS told FROM cards),
ev AS (SELECT *, told OR meta OR len(list_filter(s[1:len(s)], lambda y: regexp_matches(y, '^20[0-9]{{{{2}}}}$') AND TRY_CAST(y AS INTEGER) BETWEEN 2000 AND {_YEAR + 1})) > 0 OR (len(s) >= 3 AND s[1] = 'blog' AND coalesce(TRY_CAST(regexp_extract(s[2], '(?i)^(?:\\d{{{{1,2}}}}(?:st|nd|rd|th)?-[a-z]+-)?(\\d{{{{4}}}})$', 1) AS INTEGER), 0) BETWEEN 2000 AND {_YEAR + 1}) AS evidence FROM seg),
judged AS (SELECT *, CASE WHEN k IN ('latest news', 'news') THEN 'category-or-listing-page' WHEN contains(lower(url), '/archive/') THEN 'archive-page' WHEN contains(lower(url), '/tag/') OR contains(url, '?category=') THEN 'category-or-listing-page'
 WHEN k IN ('fell running', 'grand prix') AND NOT evidence THEN 'standalone-category-title' WHEN broad AND NOT evidence THEN 'category-or-listing-page'
 WHEN n_links >= 2 AND NOT told AND NOT meta AND length({{body}}) > 0 AND length({{link}}) >= 0.6 * length({{body}}) THEN 'navigation-first-page'
 WHEN len(s) = 2 AND s[1] = 'blog' AND NOT coalesce(TRY_CAST(regexp_extract(s[2], '(?i)^(?:\\d{{{{1,2}}}}(?:st|nd|rd|th)?-[a-z]+-)?(\\d{{{{4}}}})$', 1) AS INTEGER), 0) BETWEEN 2000 AND {_YEAR + 1} AND NOT evidence AND contains(lower(marker), 'tag') THEN 'undated-blog-filter' ELSE '' END AS reason FROM ev)"""
_CARDS = _CARDS.format(fold=fold("title"), body=c("card_text"), link=c("link_text"))


def _cards(spark, sf):
    p = F.col("pos")
    title = F.when(p % 7 == 0, "Latest  NEWS!").when(p % 7 == 1, "Fell-Running").when(p % 7 == 2, "Grand Prix").otherwise(F.col("title"))
    tails = ["a", "blog/x", "blog/2024/x", "News/Archive/1", "n/TAG/x", "2019/x", "1999/x", "n?category=b", "blog/2030", "blog/3rd-May-2024"]
    cards = stories(spark, sf).select(
        "pos", "source", title.alias("title"), F.when(p % 3 == 0, F.col("summary")).otherwise("").alias("summary"), F.when(p % 5 == 0, "1 May").otherwise("").alias("published"),
        F.concat(F.lit("https://x.org/"), F.element_at(F.array(*map(F.lit, tails)), (p % 10 + 1).cast("int"))).alias("url"), (p % 13 == 0).alias("has_metadata"), (p % 4 == 1).alias("broad_context"), (p % 3).alias("n_links"),
        F.col("body").alias("card_text"), F.when(p % 8 == 0, F.col("body")).otherwise(F.col("title")).alias("link_text"), F.when(p % 2 == 0, "x Tag-link").otherwise("plain").alias("marker"), F.when(p % 6 == 0, "i.jpg").otherwise("").alias("image"),
    )
    return listings.rejection(cards, F.lit(_YEAR))


@query("f19_listing_rejection", f", {_CARDS} SELECT pos, reason FROM judged")
def listing_rejection(spark, sf):
    return _cards(spark, sf).select("pos", "reason")


@query("a15_source_analysis", f""", {_CARDS}, per AS (SELECT source, least(count(*), 2000) AS links, count(*) - count(DISTINCT url) AS duplicates, count(*) AS candidates, count(*) FILTER (reason = '') AS accepted, count(*) FILTER (reason <> '') AS rejected, count(*) FILTER (reason = '' AND image <> '') AS i, count(*) FILTER (reason = '' AND summary <> '') AS s FROM judged GROUP BY source),
w AS (SELECT *, list_filter([CASE WHEN accepted = 0 THEN 'No stories survived the 3-day date rule.' END, CASE WHEN accepted > 0 AND i = 0 THEN 'Images are unavailable in detected cards.' END, CASE WHEN accepted > 0 AND s = 0 THEN 'Summaries are unavailable in detected cards.' END, CASE WHEN links > 1000 THEN 'The page contains an excessive number of links.' END], lambda x: x IS NOT NULL) AS warnings FROM per)
SELECT source, links, duplicates, candidates, accepted, rejected, array_to_string(warnings, '|') AS warnings, CASE WHEN accepted > 0 AND len(warnings) = 0 THEN 'Ready to save' WHEN accepted > 0 THEN 'Ready with warnings' ELSE 'Not ready' END AS status FROM w""")
def source_analysis(spark, sf):
    return listings.source_analysis(_cards(spark, sf)).withColumn("warnings", F.array_join("warnings", "|"))


@query("x14_block_texts", f"""SELECT pos, array_to_string(list_filter([{c('title')}, CASE WHEN pos % 3 = 0 THEN {c('summary')} END, 'none', CASE WHEN pos % 4 = 0 THEN 'Line one' END, CASE WHEN pos % 4 = 0 THEN 'line two' END, {c('source')}], lambda t: t IS NOT NULL AND t <> ''), chr(10) || chr(10)) AS text FROM stories""")
def block_texts(spark, sf):
    """Answers with blocks of several shapes: paragraphs, a quote, lines without block tags, numbers, lists, nothing."""
    p = F.col("pos")
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda x: F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(x.alias("v")))) - 6)
    html = F.concat(F.lit('<div><p class="a">'), escape("title"), F.lit("</p><P>Advertisement here</P>"), F.when(p % 3 == 0, F.concat(F.lit("<ul><li>"), escape("summary"), F.lit("</li></ul>"))).otherwise(""), F.lit("</div>"))
    blocks = F.concat(
        F.lit('{"content": [{"rowData": {"widgetData": {"content": '), quoted(html), F.lit(', "quote": 5}}}, 7, {"rowData": []}, null, {"rowData": {"widgetData": {"content": ["<p>no</p>"], "contentDouble": "<b>none</b", "quote": "plain"}}}'),
        F.when(p % 4 == 0, ', {"rowData": {"widgetData": {"content": "<b>Line one<br>Share via x</b><br/>line two"}}}').otherwise(""), F.lit(', {"rowData": {"widgetData": {"quote": '), quoted(F.concat(F.lit("<blockquote>"), escape("source"), F.lit("</blockquote>"))), F.lit("}}}]}"),
    )
    return stories(spark, sf).select("pos", listings.block_texts(blocks).alias("text"))


@query("j10_phrase_matches", f""", w AS (SELECT pos, ' ' || array_to_string(list_filter(regexp_split_to_array(replace(lower(body), 'ß', 'ss'), '[^a-z]+'), lambda x: x <> ''), ' ') || ' ' AS t, list_filter(regexp_split_to_array({fold('title')}, '[^a-z]+'), lambda x: x <> '')[1:3] AS p FROM stories),
p AS (SELECT DISTINCT array_to_string(p, ' ') AS phrase FROM w WHERE len(p) = 3)
SELECT pos, phrase FROM w JOIN p ON contains(t, ' ' || phrase || ' ')""")
def phrase_matches(spark, sf):
    """Which stories hold the first three words of any title: a table of phrases that grows with the stories."""
    words = lambda x: F.filter(F.split(text.casefold(x), "[^a-z]+"), lambda w: w != "")
    s = stories(spark, sf)
    table_ = s.select(F.slice(words("title"), 1, 3).alias("words")).where(F.size("words") == 3).distinct().withColumn("phrase", F.array_join("words", " "))
    return phrases.matches(s, "pos", words("body"), table_, 3)


@query("s23_newest_stories", "SELECT pos, source, title FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN lang <> 'fr' THEN published END DESC NULLS LAST, pos DESC) AS n FROM stories) WHERE n <= 100")
def newest_stories(spark, sf):
    """The hundred newest of all stories, from a store laid out by key and day."""
    store = lookup.KeyedStore(spark, folder(spark), "pos", "created_at", 16)
    store.write(stories(spark, sf).select("pos", "source", "title", F.when(F.col("lang") != "fr", F.col("published")).alias("created_at")))
    return store.newest(100).select("pos", "source", "title")


@query("s23_stories_by_key", "SELECT pos, source, title FROM stories WHERE pos IN (SELECT doc_id FROM labels)")
def stories_by_key(spark, sf):
    """The labelled stories, looked up by key: folders are met with folders."""
    store = lookup.KeyedStore(spark, folder(spark), "pos", "created_at", 16)
    store.write(stories(spark, sf).select("pos", "source", "title", F.col("published").alias("created_at")))
    return store.matching(table(spark, sf, "labels").select(F.col("doc_id").alias("pos"))).select("pos", "source", "title")
