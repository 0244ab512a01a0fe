"""Ranking of image candidates, and the lines around a text that are not its own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..data.boilerplate import ARTICLE_FURNITURE, BOILERPLATE_LINES, VIDEO_TERMS
from ..data.rules import DECORATIONS
from ..functions.text import blank, casefold, clean
from ..functions.urls import part


def url_dimensions(url: Column) -> tuple[Column, Column]:
    """Width and height that an address names, the first of: 900x600, width= and height=, /standard/900/ (16 to 9); else 0."""
    both = r"(?i)(?<![0-9])([0-9]{2,4})x([0-9]{2,4})(?![0-9])"
    asked = r"(?i)[?&](?:width|w)=([0-9]{2,4}).*?[?&](?:height|h)=([0-9]{2,4})"
    served = r"(?i)/(?:standard|news|ace)/([0-9]{2,4})(?=/)"
    number = lambda pattern, i: F.regexp_extract(blank(url), pattern, i).cast("int")
    there = lambda pattern: blank(url).rlike(pattern)
    width = F.when(there(both), number(both, 1)).when(there(asked), number(asked, 1)).when(there(served), number(served, 1)).otherwise(0)
    height = F.when(there(both), number(both, 2)).when(there(asked), number(asked, 2)).when(there(served), F.floor(number(served, 1) * 9 / 16).cast("int")).otherwise(0)
    return width, height


def feed_image_score(url: Column, width: Column, height: Column, metadata: Column) -> Column:
    """The area, the square of the width or 1, sizes also read from the address; much more from
    metadata, far less for decorations."""
    w, h = url_dimensions(url)
    width, height = F.greatest(width, w).cast("long"), F.greatest(height, h).cast("long")
    area = F.when((width > 0) & (height > 0), width * height).when(width > 0, width * width).otherwise(1)
    return area + F.when(metadata, 2_000_000).otherwise(0) - F.when(casefold(url).rlike("|".join(DECORATIONS)), 5_000_000).otherwise(0)


def still_image(url: Column | str) -> Column:
    """Whether an address can be that of a photograph: of the web, with a host, and of no video or its preview."""
    low = casefold(F.trim(blank(url)))
    return low.rlike(r"^https?://[^/?#]") & ~low.rlike("|".join(re.escape(t) for t in VIDEO_TERMS))


def absolute_url(url: Column | str, base: Column | str) -> Column:
    """An address as its page names it, made whole: from the root, from the page's scheme, or beside the page."""
    u, b = F.trim(F.replace(blank(url), F.lit("&amp;"), F.lit("&"))), blank(base)
    root = F.concat(part(b, 1), F.lit("://"), part(b, 2))
    beside = F.regexp_replace(F.regexp_extract(b, r"^([A-Za-z]+://[^/?#]*(?:/[^?#]*)?)", 1), r"(://[^/]*)/?$|/[^/]*$", "$1/")
    return F.when((u == "") | u.rlike("(?i)^(?:data|blob|javascript):"), "").when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(F.startswith(u, F.lit("//")), F.concat(part(b, 1), F.lit(":"), u)).when(F.startswith(u, F.lit("/")), F.concat(root, u)).otherwise(F.concat(beside, u))


def best_image(candidates: Column, base: Column | str = "") -> Column:
    """The address of the candidate (structs of url, width, height, metadata) of the highest score
    whatever it is, the first of equals; empty without one.

    Addresses are made whole from ``base``, the page's (none: as they are); only photographs count
    (:func:`still_image`), and of addresses that differ in case alone the first."""
    whole = (lambda u: absolute_url(u, base)) if not isinstance(base, str) or base else (lambda u: F.trim(blank(u)))
    named = F.transform(candidates, lambda c: F.struct(whole(c["url"]).alias("url"), c["width"].alias("width"), c["height"].alias("height"), c["metadata"].alias("metadata")))
    still = F.filter(named, lambda c: still_image(c["url"]))
    keys = F.transform(still, lambda c: casefold(c["url"]))
    once = F.filter(still, lambda c, i: F.array_position(keys, casefold(c["url"])) == i + 1)
    ranked = F.transform(once, lambda c, i: F.struct(feed_image_score(c["url"], c["width"], c["height"], F.coalesce(c["metadata"], F.lit(False))).alias("score"), (-i).alias("place"), c["url"].alias("url")))
    return blank(F.array_max(ranked)["url"])


def boilerplate_line(c: Column | str, lines: tuple[str, ...] = BOILERPLATE_LINES) -> Column:
    """A line that is page furniture: a fixed line, a label, a bare date or time, or one letter."""
    t = clean(c)
    label = t.rlike(r"(?i)^(published|updated|posted|date|author|by|category|tags?|location|share)\s*:")
    date = t.rlike(r"^\d{1,2}(st|nd|rd|th)? [A-Z][a-z]+ \d{4}$|^\d{1,2}/\d{1,2}/\d{4}$|^\d{1,2}:\d{2}( ?[ap]m)?$")
    return (F.char_length(t) < 2) | casefold(t).isin(*lines) | label | date


def article_furniture(text: Column) -> Column:
    """Whether a clean line of a page is no copy of its article: one of the fixed patterns, or one letter."""
    return (F.char_length(text) < 2) | text.rlike("(?Ui)" + "|".join(ARTICLE_FURNITURE))


def own_lines(c: Column | str) -> Column:
    """A text's lines but for page furniture."""
    return F.filter(F.transform(F.split(blank(c), "\n"), lambda x: clean(x)), lambda x: ~article_furniture(x))


def without_attachment(lines: Column, attachment: Column) -> Column:
    """Lines that the attachment does not hold, without repeats next to each other."""
    kept = F.filter(lines, lambda x: ~F.array_contains(attachment, x))
    return F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))
