"""Predicates: geography, completeness, validation, scores and searches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data.places import PLACES
from ..data.rules import ARTICLE_URL_PARTS, BLOCKED_SUMMARIES, EXCLUDED_TITLES, EXCLUDED_URL_ENDINGS, EXCLUDED_URL_PARTS, URL_PENALTIES
from ..functions.text import blank, bound, casefold, clean
from .phrases import branched


def place_pattern(place: str) -> str:
    """A place as a whole word without regard to case; its spaces match spaces and hyphens."""
    return r"(?<![A-Za-z0-9])" + re.sub(r"\\? ", r"[\\s-]+", re.escape(place)) + r"(?![A-Za-z0-9])"


def any_place(text: Column | str, places: tuple[str, ...] = PLACES) -> Column:
    """Whether a text names any place: one scan, longer names first."""
    names = sorted(set(places), key=lambda p: (-len(p), p))
    inner = "|".join(re.sub(r"\\? ", r"[\\s-]+", re.escape(p)) for p in names)
    return blank(text).rlike(rf"(?i)(?<![A-Za-z0-9])(?:{inner})(?![A-Za-z0-9])")


def matched_places(text: Column | str, places: tuple[str, ...] = PLACES) -> Column:
    """The places that a text names, longer names first, equal lengths by name, by one look through it.

    At each place the longest name is found; it is looked up for the names that it begins with."""
    names = sorted(set(places), key=lambda p: (-len(p), p))
    gap = lambda ch: r"[\s-]+" if ch == " " else re.escape(ch)
    key = lambda p: re.sub(r"[\s-]+", " ", p.lower())
    low = sorted({p.lower() for p in names})
    hits = F.array_distinct(F.regexp_extract_all(blank(text), F.lit(rf"(?i)(?<![A-Za-z0-9])(?=({branched(low, gap)})(?![A-Za-z0-9]))"), F.lit(1)))
    held = {key(p): [q for q in names if key(p) == key(q) or (key(p).startswith(key(q)) and not re.match("[A-Za-z0-9]", key(p)[len(key(q))]))] for p in names}
    table = F.create_map(*[x for k, qs in held.items() for x in (F.lit(k), F.array(*map(F.lit, qs)))])
    # A name with a hyphen of its own is not meant by one with a space.
    own = lambda h: F.filter(F.element_at(table, F.regexp_replace(F.lower(h), r"[\s-]+", " ")), lambda q: ~F.contains(q, F.lit("-")) | F.contains(F.lower(h), F.lower(q)))
    found = F.flatten(F.transform(hits, own))
    order = F.array(*map(F.lit, names))
    return F.when(F.size(hits) > 0, F.filter(order, lambda n: F.array_contains(found, n))).otherwise(F.array().cast("array<string>"))


def geographic(df: DataFrame, columns: list[str], places: tuple[str, ...] = PLACES) -> DataFrame:
    """Rows that name a place in any of the columns, with their places."""
    text = F.concat_ws(" ", *[blank(c) for c in columns])
    return df.where(any_place(text, places)).withColumn("geographic_matches", matched_places(text, places))


def geographic_where_required(df: DataFrame, columns: list[str], required: Column, places: tuple[str, ...] = PLACES) -> DataFrame:
    """Rows that need no evidence, or have it."""
    return df.where(~F.coalesce(required, F.lit(False)) | any_place(F.concat_ws(" ", *[blank(c) for c in columns]), places))


def ambiguous_place(text: Column | str, place: str, context: str = "city|village|district|county|council", reach: int = 90) -> Column:
    """Whether a place's first mention has a context word within ``reach`` characters."""
    t = blank(text)
    at = F.regexp_instr(t, F.lit("(?i)" + place_pattern(place)))
    around = t.substr(F.greatest(F.lit(1), at - reach), F.least(at - 1, F.lit(reach)) + len(place) + reach)
    return (at > 0) & around.rlike(rf"(?i)\b(?:{context})\b")


def materially_full(body: Column | str, summary: Column | str, least: int = 120, more: int = 40) -> Column:
    """A body of substance that goes beyond the summary."""
    b, s = clean(body), clean(summary)
    beyond = (s == "") | ((casefold(b) != casefold(s)) & (F.char_length(b) >= F.char_length(s) + more))
    return (F.char_length(b) >= least) & beyond


def verified_full(module: Column | str, body: Column | str, summary: Column | str, *, detail_complete: Column, content_status: Column, verified: Column, completeness: Column) -> Column:
    """Whether a story's text may be released, by module."""
    key, full = casefold(clean(module)), materially_full(body, summary)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(key == "content", yes(detail_complete) & full)
        .when(key == "sport", (casefold(content_status) == "complete") & full)
        .when(yes(verified), full)
        .when(blank(completeness) == "summary_only", False)
        .otherwise(key.isin("police", "fire", "council") & full)
    )


def needs_enrichment(url: Column, status: Column, body: Column, summary: Column, image_ok: Column, short: int = 350) -> Column:
    """Whether a story still holds only what its feed gave."""
    b, s, st = clean(body), clean(summary), blank(status)
    return (
        F.when(F.trim(blank(url)) == "", False)
        .when(st == "loading", False)
        .when(~F.coalesce(image_ok, F.lit(False)), True)
        .when(st == "complete", False)
        .when(b == "", True)
        .when((s != "") & (casefold(b) == casefold(s)), True)
        .otherwise(F.char_length(b) < short)
    )


def validation_errors(title: Column | str, body: Column | str, least_title: int = 8, least_body: int = 50) -> Column:
    """What is wrong with a title and a body, in order."""
    t, b = clean(title), clean(body)
    return F.array_compact(
        F.array(
            F.when(t == "", "Missing title.").when(F.char_length(t) < least_title, "Title is too short."),
            F.when(b == "", "Missing body.").when(F.char_length(b) < least_body, "Body is too short."),
        )
    )


def title_passes(title: Column | str, stop: tuple[str, ...] = EXCLUDED_TITLES, excluded: str | None = None) -> Column:
    """Eight characters and two words or more, no stop title (marks at its ends apart), not excluded."""
    t = clean(title)
    good = (F.char_length(t) >= 8) & (F.size(F.split(t, " ")) >= 2) & ~F.btrim(casefold(t), F.lit(" .:-–—")).isin(*stop)
    return good & ~t.rlike(f"(?i){excluded}") if excluded else good


def url_allowed(url: Column | str, base: Column | str, *, same_host: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), parts: tuple[str, ...] = EXCLUDED_URL_PARTS, endings: tuple[str, ...] = EXCLUDED_URL_ENDINGS) -> Column:
    """Whether an address may be an article's: no excluded part or ending of its path, the host of ``base``
    (www. apart), none of ``exclude`` and, if given, one of ``include``: patterns without regard to
    case, or plain text where one is no pattern."""
    u, low = blank(url), casefold(url)
    path = F.regexp_replace(F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")
    host = lambda c: F.regexp_replace(F.regexp_extract(casefold(c), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), r"^www\.", "")

    def any_of(patterns: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for p in patterns:
            try:
                found = found | u.rlike(f"(?i){re.compile(p).pattern}")
            except re.error:
                found = found | F.contains(low, casefold(F.lit(p)))
        return found

    whole = [p for p in parts if p.startswith("/")]
    bad = low.rlike(f"(?:{'|'.join(map(re.escape, whole))})(?![a-z0-9])") if whole else F.lit(False)
    for p in parts:
        bad = bad if p.startswith("/") else bad | F.contains(low, F.lit(p))
    for e in endings:
        bad = bad | F.endswith(F.rtrim(path, F.lit("/")), F.lit(e))
    if same_host:
        bad = bad | ((host(u) != "") & (host(u) != host(base)))
    good = (u != "") & ~bad & ~any_of(exclude)
    return good & any_of(include) if include else good


def url_score(url: Column | str, now: Column, parts: tuple[str, ...] = ARTICLE_URL_PARTS, penalties: tuple[tuple[str, int], ...] = URL_PENALTIES) -> Column:
    """40 for an article's address (a known part, or a year from 2000 to the next in its path), less the
    penalty of each word in it that speaks against one."""
    low = casefold(url)
    path = F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    years = F.regexp_extract_all(path, F.lit(r"(?:^|/)(20[0-9]{2})(?:/|$)"), F.lit(1))
    dated = F.exists(years, lambda y: y.cast("int") <= F.year(now) + 1)
    known = F.lit(False)
    for p in parts:
        known = known | F.contains(low, F.lit(p))
    points = F.when(known | dated, 40).otherwise(0)
    for word, less in penalties:
        points = points + F.when(low.rlike(f"(?<![a-z0-9]){word}(?![a-z0-9])"), less).otherwise(0)
    return points


def candidate_score(url: Column, title: Column, now: Column, *, has_date: Column, has_image: Column, has_schema: Column, has_json_ld: Column, has_open_graph: Column, has_paragraph: Column) -> Column:
    """A link's points as an article: its address's, and those of what its card shows."""
    points = url_score(url, now) + F.when(F.char_length(blank(title)).between(20, 120), 25).otherwise(0)
    for there, more in ((has_date, 30), (has_image, 20), (has_schema, 20), (has_json_ld, 15), (has_open_graph, 15), (has_paragraph, 10)):
        points = points + F.when(there, more).otherwise(0)
    return points


def media_decision(created: Column, status: Column, embargo: Column, kind: Column, text: Column, now: Column, hours: int = 72, places: tuple[str, ...] = PLACES) -> Column:
    """The first of five reasons that holds a media item back, or ``eligible``."""
    inside = (F.unix_micros(created) >= F.unix_micros(now) - F.lit(hours * 3_600_000_000)) & (created <= now)
    return (
        F.when(created.isNull() | ~inside, "outside_date_limit")
        .when(~blank(status).eqNullSafe("usable"), "not_published")
        .when(embargo > now, "embargoed")
        .when(~blank(kind).eqNullSafe("video"), "not_video")
        .when(any_place(text, places), "eligible")
        .otherwise("location_needs_review")
    )


def meaningful_summary(c: Column | str, blocked: tuple[str, ...] = BLOCKED_SUMMARIES) -> Column:
    """The summary, or nothing where it starts as boilerplate, is a few words without an end, or only quotes."""

    def judged(s: Column) -> Column:
        few = (F.size(F.split(s, " ")) <= 8) & ~s.rlike(r"[.!?]$")
        starts = bound(F.btrim(casefold(s), F.lit(" :.-")), lambda low: reduce(lambda a, b: a | F.startswith(low, F.lit(b)), blocked, F.lit(False)))
        return F.when(starts | few | (s.rlike("^[\"“‘']") & s.rlike("[\"”’']$")), "").otherwise(s)

    return bound(clean(c), judged)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, without regard to case."""
    return df.where(F.contains(F.concat_ws(" ", *[casefold(c) for c in columns]), casefold(F.lit(text)))) if text else df


def within_period(when: Column, now: Column, period: str) -> Column:
    """A named period: only "All dates" keeps missing dates."""
    days = {"7 days": 7, "30 days": 30, "90 days": 90}
    if period == "All dates":
        return F.lit(True)
    if period == "This year":
        return F.coalesce(F.year(when) == F.year(now), F.lit(False))
    return F.coalesce(F.unix_micros(when) >= F.unix_micros(now) - F.lit(days[period] * 86_400_000_000), F.lit(False))
