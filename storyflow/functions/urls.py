"""URL functions as Column expressions.  The four canonical forms differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(c: Column | str, i: int) -> Column:
    """Scheme (1), host (2), path (3), query with its mark (4) or fragment (5)."""
    return F.regexp_extract(blank(c), _PARTS, i)


def query_free(c: Column | str) -> Column:
    """Without query and fragment; scheme and host lower case, slashes of the path single."""
    path = F.regexp_replace(part(c, 3), "/+", "/")
    return F.concat(F.lower(part(c, 1)), F.lit("://"), F.lower(part(c, 2)), path)


def bare(c: Column | str) -> Column:
    """Lower case, without fragment, query and closing slashes."""
    return F.rtrim(F.split(F.split(F.lower(F.trim(blank(c))), "#")[0], r"\?")[0], F.lit("/"))


def fragment_free(c: Column | str) -> Column:
    """With its query, without fragment."""
    return F.regexp_replace(F.trim(blank(c)), "#.*$", "")


def tracking_free(c: Column | str) -> Column:
    """Without fragment and the parameters that only track: utm_*, fbclid, gclid."""
    pairs = F.filter(F.split(F.regexp_replace(part(c, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[^=]*|fbclid|gclid)(=|$)"))
    query = F.array_join(pairs, "&")
    return F.concat(F.lower(part(c, 1)), F.lit("://"), F.lower(part(c, 2)), part(c, 3), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def page_key(c: Column | str) -> Column:
    """Host without www., and path, both case-folded."""
    return F.concat(F.regexp_replace(F.lower(part(c, 2)), r"^www\.", ""), F.rtrim(F.lower(part(c, 3)), F.lit("/")))


def article_id(c: Column | str) -> Column:
    """The number after /article/."""
    return F.regexp_extract(blank(c), r"/article/(\d+)", 1)


def page_type(c: Column | str, html: Column | str) -> Column:
    """What an address and its page look like, first match first: no path, a listing's path, a
    feed's root, just one article element."""
    path, page = F.rtrim(part(c, 3), F.lit("/")), blank(html)
    return (
        F.when(path == "", "homepage")
        .when(path.rlike(r"(?i)/(news|latest|blog|articles?|stories)(/|$)"), "listing page")
        .when(page.rlike(r"(?i)<rss[\s>/]"), "feed")
        .when(F.regexp_count(page, F.lit(r"(?i)<article[\s>/]")) == 1, "article page")
        .otherwise("website page")
    )


def still_image(c: Column | str) -> Column:
    """Whether a URL may be a still image: no video marker, no decoration (a stricter gate than that of images.py)."""
    low = F.lower(blank(c))
    return (low != "") & ~low.rlike(r"/video/|/videos/|/av/|\.mp4|\.webm|\.m3u8|\.mov") & ~low.rlike(r"logo|icon|avatar|placeholder|sprite|tracking|1x1")


def video_story(c: Column | str) -> Column:
    """Whether an address is that of a video rather than of an article, by its path."""
    return F.lower(part(c, 3)).rlike(r"/videos/|/video/|/av/|/watch/|/highlights/video")


def video_page(html: Column | str) -> Column:
    """Whether a page's own description says that it is a video's."""
    meta = lambda has: rf"(?is)<meta\b(?=[^>]*{has})[^>]*>"
    typed = r"""\bproperty\s*=\s*["']og:type["'])(?=[^>]*\bcontent\s*=\s*["'][^"'>]*video"""
    return blank(html).rlike(meta(typed)) | blank(html).rlike(meta(r"""\b(?:property\s*=\s*["']og:video|name\s*=\s*["']twitter:player)"""))


def derived_id(name: Column | str, url: Column | str) -> Column:
    """The name's slug with ten hex digits for name and address."""
    from .text import slug

    return F.concat(slug(name), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", blank(name), tracking_free(url)), 256), 1, 10))


