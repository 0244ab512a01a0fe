"""Queries of clean-ups, run totals, queues, rights, feeds with media, and pages of videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import reports
from ..sources import cards, feeds
from .registry import NOW, now, query, stories, table

_OLD = lambda t, days: f"epoch_us({t}) < epoch_us(TIMESTAMP '{NOW}') - {days} * 86400000000"


@query("r3_cleanup_audit", f"""SELECT (SELECT count(*) FILTER (lang <> 'fr' AND {_OLD('published', 7)}) FROM stories) AS social_drafts_removed, (SELECT count(*) FILTER ({_OLD('ts', 30)}) FROM events) AS old_logs_removed,
 (SELECT count(*) FILTER (event_type <> 'click' AND {_OLD('ts', 14)}) FROM events) AS old_cached_images_removed, (SELECT count(*) FILTER (pos % 5 <> 0 AND {_OLD('published', 7)}) FROM stories) AS feed_snapshot_stories_removed, CAST(0 AS BIGINT) AS sync_runs_removed""")
def cleanup_audit(spark, sf):
    """Drafts with unreadable dates and undated snapshot stories stay, and so does one image's name; there are no sync runs."""
    s, e = stories(spark, sf), table(spark, sf, "events").withColumn("modified_at", F.col("ts").cast("timestamp"))
    name = F.when(F.col("event_type") == "click", "NewsDesk-image-placeholder.PNG").otherwise("a.png")
    frames = {
        "social_drafts": s.select(F.when(F.col("lang") == "fr", "soon").otherwise(F.col("published").cast("string")).alias("created_at")),
        "old_logs": e.select("modified_at"),
        "old_cached_images": e.select("modified_at", name.alias("name")),
        "feed_snapshot_stories": s.select(F.when(F.col("pos") % 5 != 0, F.col("published")).alias("published")),
    }
    return reports.cleanup_audit(frames, now())


@query("a7_run_totals", """, s AS (SELECT pos % 50 AS run_id, count(*) AS sources_requested, count(*) FILTER (pos % 7 > 1) AS sources_attempted, count(*) FILTER (pos % 7 > 1 AND pos % 3 = 0) AS sources_succeeded FROM stories GROUP BY 1),
i AS (SELECT user_id % 60 AS run_id, count(*) AS items_found, count(*) FILTER (event_id % 4 = 0) AS items_collected, count(*) FILTER (event_id % 4 = 1) AS items_duplicate, count(*) FILTER (event_id % 4 = 2) AS items_rejected, count(*) FILTER (event_id % 4 = 0 AND value > 50) AS items_newsworthy FROM events GROUP BY 1),
p AS (SELECT doc_id % 45 AS run_id, count(*) AS publish_attempted, count(*) FILTER (quality = 1) AS publish_succeeded FROM labels GROUP BY 1),
a AS (SELECT run_id, coalesce(sources_requested, 0) AS sources_requested, coalesce(sources_attempted, 0) AS sources_attempted, coalesce(sources_succeeded, 0) AS sources_succeeded, coalesce(sources_attempted - sources_succeeded, 0) AS sources_failed, coalesce(items_found, 0) AS items_found, coalesce(items_collected, 0) AS items_collected,
 coalesce(items_duplicate, 0) AS items_duplicate, coalesce(items_rejected, 0) AS items_rejected, coalesce(items_newsworthy, 0) AS items_newsworthy, coalesce(publish_attempted, 0) AS publish_attempted, coalesce(publish_succeeded, 0) AS publish_succeeded, coalesce(publish_attempted - publish_succeeded, 0) AS publish_failed FROM s FULL JOIN i USING (run_id) FULL JOIN p USING (run_id))
SELECT *, CASE WHEN sources_attempted > 0 THEN round_even(sources_succeeded / sources_attempted * 100, 2) ELSE 0 END AS source_success_rate, CASE WHEN publish_attempted > 0 THEN round_even(publish_succeeded / publish_attempted * 100, 2) ELSE 0 END AS publish_success_rate FROM a""")
def run_totals(spark, sf):
    p, e, d = F.col("pos"), F.col("event_id"), F.col("doc_id")
    sources = stories(spark, sf).select((p % 50).alias("run_id"), (p % 7 > 1).alias("attempted"), F.when(p % 2 == 0, p % 3 == 0).when(p % 3 == 0, True).alias("succeeded"))
    outcome = F.when(e % 4 == 0, "collected").when(e % 4 == 1, "duplicate").when(e % 4 == 2, "rejected")
    items = table(spark, sf, "events").select((F.col("user_id") % 60).alias("run_id"), outcome.alias("outcome"), (F.col("value") > 50).alias("newsworthy"))
    published = table(spark, sf, "labels").select((d % 45).alias("run_id"), (F.col("quality") == 1).alias("succeeded"))
    return reports.run_totals(sources, items, published)


@query("n50_queue_rows", """SELECT pos, CASE WHEN pos % 4 = 0 THEN 'story-' || (pos + 1) ELSE 'id' || pos END AS id, CASE WHEN trim(title) = '' THEN 'untitled' ELSE trim(title) END AS title, trim(summary) AS summary, CASE WHEN pos % 3 = 0 THEN '' ELSE 'high' END AS priority FROM stories""")
def queue_rows(spark, sf):
    s = stories(spark, sf).select("pos", F.when(F.col("pos") % 4 != 0, F.concat(F.lit("id"), F.col("pos").cast("string"))).alias("id"), F.when(F.trim("title") == "", "untitled").otherwise(F.concat(F.lit("  "), "title", F.lit(" "))).alias("title"), "summary", F.when(F.col("pos") % 3 != 0, " high ").alias("priority"), "source", F.lit(None).cast("string").alias("published"), F.lit("").alias("status"))
    return reports.queued(s).select("pos", "id", "title", "summary", "priority")


@query("n43_image_rights", f"""SELECT pos, image, CASE WHEN image = '' THEN 'no image' WHEN module = 'newsletter' OR contains(lower(credit), 'approved for use') OR contains(lower(credit), 'permission') THEN 'approved' ELSE 'not reviewed' END AS rights
 FROM (SELECT pos, source AS module, CASE CAST(pos % 4 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'https://x.org/' || pos || '.jpg' END AS image, CASE CAST(pos % 3 AS INTEGER) WHEN 0 THEN 'Approved for USE by all' WHEN 1 THEN 'By Permission of ' || source ELSE coalesce(lang, '') END AS credit FROM stories)""")
def image_rights(spark, sf):
    p = F.col("pos")
    image = F.when(p % 4 == 0, f"https://{reports.PLACEHOLDER.upper()}?x").when(p % 4 != 1, F.concat(F.lit(" https://x.org/"), p.cast("string"), F.lit(".jpg")))
    credit = F.when(p % 3 == 0, "Approved for USE by all").when(p % 3 == 1, F.concat(F.lit("By Permission of "), "source")).otherwise(F.col("lang"))
    s = stories(spark, sf).select("pos", reports.real_image(image).alias("image"), credit.alias("credit"), "source")
    return s.select("pos", "image", reports.image_rights("image", "credit", "source").alias("rights"))


@query("m8_first_populated", "SELECT pos, CASE WHEN pos % 2 = 0 AND title <> '' THEN title WHEN pos % 3 = 0 THEN 'x' || source WHEN pos % 5 = 0 THEN lang ELSE '' END AS headline FROM stories")
def first_populated(spark, sf):
    p = F.col("pos")
    extras = F.map_filter(F.create_map(F.lit("title"), F.when(p % 3 == 0, F.concat(F.lit("x"), "source")).otherwise(""), F.lit("intro"), F.when(p % 5 == 0, F.col("lang"))), lambda k, v: v.isNotNull())
    s = stories(spark, sf).select("pos", F.when(p % 2 == 0, F.col("title")).alias("headline"), extras.alias("extras"))
    return s.select("pos", reports.first_populated(("title", "headline", "intro"), s.columns).alias("headline"))


_ESCAPED = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("s5_atom_entries", """SELECT pos, source AS title, 'https://x.org/' || pos AS url, CASE WHEN pos % 2 = 0 THEN lang ELSE source END AS summary, epoch_us(date_trunc('second', published)) AS published, CASE WHEN pos % 4 = 0 THEN 'J. Roe' ELSE '' END AS author, lang || '|' || 'news' AS tags, CASE WHEN pos % 5 = 0 THEN 'https://x.org/i.png' ELSE '' END AS image FROM stories""")
def atom_entries(spark, sf):
    """Every story as a feed of its entry, and an entry without a link."""
    p = F.col("pos")
    when = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dated = F.when(p % 3 == 0, F.format_string("<published>%s</published><updated>2030-01-01</updated>", when)).otherwise(F.format_string("<updated>%s</updated>", when))
    said = F.when(p % 2 == 0, F.format_string('<summary type="html">&lt;p&gt;%s&lt;/p&gt;</summary><content>x</content>', "lang")).otherwise(F.format_string("<content>%s</content>", "source"))
    links = F.concat(F.lit('<link rel="self" href="https://x.org/self"/><link href="https://x.org/'), p.cast("string"), F.lit('"/>'), F.when(p % 5 == 0, '<link rel="enclosure" type="image/png" href="https://x.org/i.png"/>').otherwise(""))
    entry = F.concat(F.lit("<entry><title> "), "source", F.lit("</title>"), links, said, dated, F.when(p % 4 == 0, "<author><name>J. Roe</name></author>").otherwise(""), F.format_string('<category term="%s"/><category term="news"/><category term="news"/></entry>', "lang"))
    xml = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), entry, F.lit("<entry><title>no link</title><updated>2024-01-01</updated></entry></feed>"))
    a = feeds.atom_entries(stories(spark, sf).select("pos", xml.alias("xml")))
    return a.select("pos", "title", "url", "summary", F.unix_micros("published").alias("published"), "author", F.array_join("tags", "|").alias("tags"), "image")


@query("s5_rss_media", """SELECT pos, CASE CAST(pos % 4 AS INTEGER) WHEN 0 THEN 'https://x.org/m.jpg' WHEN 1 THEN 'https://x.org/t.jpg' WHEN 2 THEN 'https://x.org/e.jpg' ELSE '' END AS image, CASE WHEN pos % 2 = 0 THEN lang || '|a & b' ELSE '' END AS tags FROM stories""")
def rss_media(spark, sf):
    p = F.col("pos") % 4
    video = '<media:content url="https://x.org/v.mp4" type="video/mp4" medium="video"/>'
    media = F.when(p == 0, video + '<media:content url="https://x.org/m.jpg" medium="image"/>').when(p == 1, video + '<media:thumbnail url="https://x.org/t.jpg"/>').when(p == 2, '<enclosure url="https://x.org/a.mp3" type="audio/mpeg"/><enclosure url="https://x.org/e.jpg" type="image/jpeg"/>').otherwise("")
    tags = F.when(p % 2 == 0, F.format_string("<category>%s</category><category>a &amp; b</category><category> %s </category>", "lang", "lang")).otherwise("")
    xml = F.concat(F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title><item><title>t</title><link>https://x.org/1</link><pubDate>2024-01-01</pubDate>'), media, tags, F.lit("</item><item><title>no link</title></item></channel></rss>"))
    return feeds.rss_items(stories(spark, sf).select("pos", xml.alias("xml"))).select("pos", "image", F.array_join("tags", "|").alias("tags"))


@query("x9_video_stories", """SELECT pos, pos % 5 IN (0, 1, 3) AS story, pos % 4 IN (0, 1) AS page FROM stories""")
def video_stories(spark, sf):
    p, q = F.col("pos") % 5, F.col("pos") % 4
    path = F.when(p == 0, "/sport/AV/x").when(p == 1, "/news/videos/3").when(p == 2, "/news/video").when(p == 3, "/highlights/video-3").otherwise("/a?next=/video/")
    page = F.when(q == 0, "<META content='a VIDEO.other' property='og:type'>").when(q == 1, '<meta name="twitter:player:width" content="3">').when(q == 2, '<meta property="og:type" content="article"><p>og:video</p>').otherwise('<meta name="x" content="og:video">')
    return stories(spark, sf).select("pos", urls.video_story(F.concat(F.lit("https://x.org"), path)).alias("story"), urls.video_page(F.concat(F.lit("<html>"), page, "source")).alias("page"))


@query("s14_listing_cards", """SELECT CAST(pos AS VARCHAR) AS article_id, CASE WHEN pos % 3 = 0 THEN 'Advisory' ELSE 'Story' END AS content_type, 'T ' || source AS title, CASE WHEN pos % 4 = 0 THEN '' ELSE 'slug-' || pos END AS slug, CASE WHEN pos % 4 = 2 THEN lang || chr(10) || chr(10) || source ELSE '' END AS summary,
 'J. ' || source AS author, 'a@x.org' AS author_email, strftime(published, '%Y-%m-%dT%H:%M:00+00:00') AS created_at, CASE WHEN pos % 3 = 0 THEN strftime(published, '%Y-%m-%dT%H:%M:00+00:00') ELSE 'soon' END AS modified_at, 'Boston Borough Council|' || CASE WHEN pos % 3 = 0 THEN 'Lincoln City Council' ELSE source END AS authorities FROM stories""")
def listing_cards(spark, sf):
    """Every story as a card, each third one in the newer layout."""
    p, when = F.col("pos"), F.date_format("published", "EEE, MMM dd, yyyy HH:mm")
    head = F.concat(F.lit("\n T  "), "source", F.lit("\r\n"), F.when(p % 4 != 0, F.concat(F.lit("slug-"), p.cast("string"), F.lit(" V.3\n\n"))).otherwise(""), F.when(p % 4 == 2, F.concat_ws("\n", "lang", "source")).otherwise(""), F.lit("\n"))
    newer = F.concat(F.lit("Created at: "), when, F.lit(" (London GMT) Modified at: "), when, F.lit("\nBoston Borough Council Lincoln City Council\nAdvisory Author: J. "), "source", F.lit(" Author's email: a@x.org Last reviewed by email: r@x.org\nother"))
    older = F.concat(F.lit("Type: Advisory\nAuthor:\nAuthor: J. "), "source", F.lit("\nAUTHOR'S EMAIL: a@x.org\nAuthor: second\nCreated at: "), when, F.lit("\nmodified at: soon\nBoston Borough Council\n"), "source")
    s = stories(spark, sf).select(F.concat(F.lit("https://x.org/article/"), p.cast("string")).alias("url"), F.concat(head, F.when(p % 3 == 0, newer).otherwise(older)).alias("text"))
    return cards.listing_cards(s).select("article_id", "content_type", "title", "slug", "summary", "author", "author_email", "created_at", "modified_at", F.array_join("authorities", "|").alias("authorities"))
