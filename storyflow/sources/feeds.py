"""Feeds as tables: RSS, search APIs, embedded page data and catalogues of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import blank, plain_html
from ..functions.urls import part, query_free

_MEDIA = "array<struct<_url:string,_type:string,_medium:string>>"
ITEM = f"struct<title:string,link:string,description:string,pubDate:string,guid:string,creator:string,category:array<string>,content:{_MEDIA},thumbnail:{_MEDIA},enclosure:{_MEDIA}>"
_LINK = "array<struct<_href:string,_rel:string,_type:string>>"
ENTRY = f"struct<id:string,title:string,link:{_LINK},summary:string,content:string,published:string,updated:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>"


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each item of RSS documents that has a title, a link and a date; the item's
    description is the summary and the body.  The image is the first of its media, its thumbnails and its
    enclosures that is one."""
    channel = F.from_xml(F.regexp_replace(xml, r"<(/?)(?:dc|media|content):", "<$1"), f"channel struct<item:array<{ITEM}>>")
    items = feeds.withColumn("i", F.explode(channel["channel"]["item"]))
    keep = (F.trim(blank("i.title")) != "") & (F.trim(blank("i.link")) != "") & (F.trim(blank("i.pubDate")) != "")
    text = plain_html(F.col("i.description"), None)
    none = F.array().cast(_MEDIA)
    media = F.concat(*[F.coalesce(F.filter(f"i.{c}", of), none) for c, of in (("content", _is_image), ("thumbnail", lambda m: blank(m["_url"]) != ""), ("enclosure", lambda m: F.startswith(blank(m["_type"]), F.lit("image/"))))])
    return items.where(keep).select(*[c for c in feeds.columns if c != xml], F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), text.alias("summary"), text.alias("body"), dates.parsed(F.col("i.pubDate")).alias("published"), blank("i.creator").alias("author"), _tags(F.col("i.category")).alias("tags"), F.trim(blank(F.get(media, F.lit(0))["_url"])).alias("image"))


def _is_image(m: Column) -> Column:
    return (blank(m["_url"]) != "") & ((blank(m["_medium"]) == "image") | F.startswith(blank(m["_type"]), F.lit("image/")) | ((blank(m["_medium"]) == "") & (blank(m["_type"]) == "")))


def _tags(names: Column) -> Column:
    return F.coalesce(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(blank(n))), lambda n: n != "")), F.array().cast("array<string>"))


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each entry of Atom documents that has a title, a link and a date: the link to the page itself
    (the first without a relation, or an alternate), the summary or else the content, the date of publication
    or else of the last change."""
    e = feeds.withColumn("e", F.explode(F.from_xml(xml, f"entry array<{ENTRY}>")["entry"]))
    links = F.coalesce(F.col("e.link"), F.array().cast(_LINK))
    page = F.trim(blank(F.get(F.filter(links, lambda x: blank(x["_rel"]).isin("", "alternate") & (blank(x["_href"]) != "")), F.lit(0))["_href"]))
    image = F.trim(blank(F.get(F.filter(links, lambda x: (blank(x["_rel"]) == "enclosure") & F.startswith(blank(x["_type"]), F.lit("image/"))), F.lit(0))["_href"]))
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(blank(x)), F.lit("")) for x in c], F.lit(""))
    when, text = first("e.published", "e.updated"), plain_html(first("e.summary", "e.content"), None)
    keep = (F.trim(blank("e.title")) != "") & (page != "") & (when != "")
    return e.where(keep).select(*[c for c in feeds.columns if c != xml], F.trim("e.title").alias("title"), page.alias("url"), text.alias("summary"), text.alias("body"), dates.parsed(when).alias("published"), F.trim(blank(F.get("e.author.name", F.lit(0)))).alias("author"), _tags(F.col("e.category._term")).alias("tags"), image.alias("image"))


def search_results(pages: DataFrame, payload: str = "payload", base: str = "https://example.org") -> DataFrame:
    """A row for each result of a search API's JSON."""
    shape = "results array<struct<title:string,link:string,description:string,public_timestamp:string,content_id:string>>"
    r = pages.withColumn("r", F.explode(F.from_json(payload, shape)["results"]))
    url = F.when(F.startswith("r.link", F.lit("/")), F.concat(F.lit(base), F.col("r.link"))).otherwise(F.col("r.link"))
    return r.where((blank("r.title") != "") & (blank("r.link") != "")).select(*[c for c in pages.columns if c != payload], F.col("r.title").alias("title"), url.alias("url"), plain_html(F.col("r.description")).alias("summary"), dates.parsed(F.col("r.public_timestamp")).alias("published"), blank("r.content_id").alias("content_id"))


def embedded_messages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The messages in a page's embedded application state; two kinds have addresses of their own."""
    raw = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    message = "struct<type:string,article_id:string,title:string,tagline:string,published:string,team_id:string,fixture:struct<fixture_id:string>>"
    shape = f"props struct<initialReduxState:struct<activityStream:struct<messages:map<string,{message}>>>>"
    m = pages.withColumn("_state", F.from_json(raw, shape)).select(*[c for c in pages.columns if c != html], F.explode(F.col("_state.props.initialReduxState.activityStream.messages")).alias("key", "m"))
    url = F.when(F.col("m.article_id").isNotNull(), F.concat(F.lit("/news/"), F.col("m.article_id"))).when(F.col("m.fixture.fixture_id").isNotNull(), F.concat(F.lit("/teams/"), F.col("m.team_id"), F.lit("/match-centre/"), F.col("m.fixture.fixture_id")))
    return m.where(url.isNotNull()).select(*[c for c in pages.columns if c != html], "key", F.col("m.title").alias("title"), blank("m.tagline").alias("summary"), url.alias("url"), dates.parsed(F.col("m.published")).alias("published"))


def listing_posts(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The posts of a content API's listing."""
    shape = "data array<struct<id:string,attributes:struct<postTitle:string,postSlug:string,postDate:string,postSummary:string>>>"
    r = pages.withColumn("r", F.explode(F.from_json(payload, shape)["data"]))
    a = F.col("r.attributes")
    return r.where(blank(a["postTitle"]) != "").select(*[c for c in pages.columns if c != payload], F.col("r.id").alias("id"), a["postTitle"].alias("title"), F.concat(F.lit("/news/"), a["postSlug"]).alias("url"), blank(a["postSummary"]).alias("summary"), dates.parsed(a["postDate"]).alias("published"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON catalogue (a list, or an object that holds one as ``sources``) that are enabled, which is
    the default."""
    df = spark.read.json(path, multiLine=True)
    if "sources" in df.columns:
        df = df.select(F.explode("sources").alias("s")).select("s.*")
    return df.where(F.coalesce("enabled", F.lit(True))) if "enabled" in df.columns else df


def collector_route(url: Column | str) -> Column:
    """Which collector reads a website, by its host."""
    host = F.lower(part(url, 2))
    return F.when(host.rlike(r"(^|\.)fulltime\.thefa\.com$"), "fa-fulltime").when(host.rlike(r"(^|\.)pitchero\.com$"), "pitchero").when(host.rlike("club"), "club-cms").otherwise("official-website")


def social_posts(posts: DataFrame, text: str = "text") -> DataFrame:
    """A post's first line that is not blank as title, and its start as summary."""
    lines = F.filter(F.transform(F.split(blank(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return posts.withColumns({"title": F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 120), "summary": F.substring(F.trim(blank(text)), 1, 250)})


def candidates(items: DataFrame, now: Column, *, days: float = 14) -> DataFrame:
    """Recent items, the first of each address without its query, newest first."""
    from ..operators.dedup import first_wins

    recent = items.where(dates.recent("published", now, days=days))
    return first_wins(recent, query_free("url")).orderBy(F.desc("published"), "pos")


def matches_of_first(items: DataFrame, limit: int, keep: Column, pos: str = "pos") -> DataFrame:
    """The matches among the first ``limit`` records: the limit comes before the filter."""
    return items.orderBy(pos).limit(limit).where(keep)
