"""Posts from stories: clean text, tags, extracts, drafts mended, and the post with its marks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..data import social as values
from ..functions.text import blank, casefold, comparison_key, hashtags
from .articles import has_content

#: Shown where a story has neither summary nor paragraph.
NO_DETAILS = "Further details were not available in the supplied source material."

_TAG_END = r"""(?=[\s/>])[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
_ANY_TAG = r"""</?[A-Za-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
_NOTES = r"(?Uimsd)^\s*\[?\s*notes?\s+to\s+editors?\s*:.*\z"
_BARE_ADDRESS = r"(?Ui)(?<![\w@/:])(www\.[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s<]*)?)"
_WORD = r"(?U)\b[\w’'-]+\b"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """Entities read twice, as feeds escape them twice; only the library holds the table of their names."""
    from html import unescape

    return text.map(lambda t: unescape(unescape(t)) if t and "&" in t else t)


def social_text(c: Column | str, url: Column | str | None = None) -> Column:
    """Readable copy: block tags as line ends, other tags and comments gone, entities read; nothing
    from a note to editors on, nor the address ``url``; bare addresses with their scheme."""
    t = F.regexp_replace(blank(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(values.BLOCK_TAGS)}){_TAG_END}", "\n")
    t = F.regexp_replace(_unescaped(F.regexp_replace(t, _ANY_TAG, "")), _NOTES, "")
    if url is not None:
        t = F.replace(t, F.trim(blank(url)), F.lit(""))  # an empty address changes nothing
    t = F.regexp_replace(t, _BARE_ADDRESS, r"https://$1")
    for pattern, by in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    return F.btrim(t, F.lit(" \n-"))


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _names(folded: Column, names: list[str]) -> Column:
    """The names that stand in the text as whole words, found in one look through it; where two start together, the longer one."""
    longest = sorted(names, key=len, reverse=True)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"(?U)\b(?=({'|'.join(map(re.escape, longest))})\b)"), F.lit(1)))


def _held(names: list[str], name: str) -> Column:
    """A name and those that begin with it, as an array."""
    return F.array(*[F.lit(m) for m in names if re.match(rf"{re.escape(name)}\b", m)])


def suggested_hashtags(
    title: Column | str, text: Column | str, most: int = 8, *, places=values.PLACES, authorities=values.AUTHORITIES, topics=values.TOPICS, venues=values.VENUE_ENDINGS, closing=values.CLOSING_TAGS
) -> Column:
    """Tags of the venues in the title, the places in title and text, their authorities, the topics, and
    the closing ones; distinct without regard to case, the first ``most`` of them, with spaces between."""
    head = F.trim(blank(title))
    venue = F.regexp_extract_all(head, F.lit(rf"(?U)\b((?:[A-Z][A-Za-z0-9'’-]*\s+){{0,4}}(?:{'|'.join(venues)})\b)"), F.lit(1))
    named = F.filter(venue, lambda v: v.rlike(r"(?U)\S\s+\S"))
    low, subjects = [p.lower() for p in places], [w for words, _ in topics for w in words]

    def tags(found: Column) -> Column:
        here = [F.when(F.arrays_overlap(found, _held(low, p.lower())), p) for p in places]
        there = [F.when(F.arrays_overlap(found, _held(low, p.lower())), authorities[p.lower()]) for p in places if p.lower() in authorities]
        about = [F.when(F.arrays_overlap(found, F.array_distinct(F.concat(*[_held(subjects, w) for w in words]))), tag) for words, tag in topics]
        return F.array_compact(F.array(*here, *there, *about, *map(F.lit, closing)))

    none = F.array().cast("array<string>")
    found = _let(casefold(F.concat(head, F.lit("\n"), blank(text))), lambda t: F.concat(*[_names(t, n) if n else none for n in (low, subjects)]))
    return F.array_join(hashtags(F.concat(named, _let(found, tags)), max(1, most)), " ")


def normalised_hashtags(c: Column | str, most: int = 12) -> Column:
    """The tags of a field that an editor typed: marks and joining signs read, each once."""
    return F.array_join(hashtags(F.regexp_extract_all(blank(c), F.lit("([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(1)), most), " ")


def substantive(title: Column, article: Column, letters: int = 240, words: int = 40) -> Column:
    """Whether clean copy is more than a teaser: long enough, of enough words, and not the title."""
    enough = (F.char_length(article) >= letters) & (F.regexp_count(article, F.lit(_WORD)) >= words)
    return enough & ((title == "") | (casefold(article) != casefold(title)))


def short_post(df: DataFrame, limit: int = 300, least_words: int = 8, least_room: int = 40) -> DataFrame:
    """``df`` (title, body, url) with ``post``: the first that fits with the address of the title with a
    sentence, a sentence, or the title.  Null where the body is no full article, the address
    leaves too little room, or nothing fits whole.  Every word of it stands in the source."""
    staged = df.withColumns({"_title": social_text("title"), "_body": social_text("body", "url"), "_end": F.when(F.trim(blank("url")) == "", "").otherwise(F.concat(F.lit("\n\n"), F.trim(blank("url"))))})
    room = limit - F.char_length("_end")
    sentences = F.filter(F.transform(F.split("_body", r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.regexp_count(s, F.lit(_WORD)) >= least_words)
    staged = staged.withColumn("_said", sentences)
    led = F.transform(F.filter("_said", lambda s: casefold(s) != casefold("_title")), lambda s: F.concat("_title", F.lit("\n\n"), s))
    choices = F.when(F.col("_title") == "", F.col("_said")).otherwise(F.concat(led, "_said", F.array("_title")))
    first = F.get(F.filter(choices, lambda s: (s != "") & (F.char_length(s) <= room)), F.lit(0))
    # The test cleans its texts anew: an entity that was escaped thrice may leave a tag.
    staged = staged.withColumns({"_again": social_text("_title"), "_whole": social_text("_body")})
    staged = staged.withColumn("_full", substantive(F.col("_again"), F.col("_whole")))
    return staged.withColumn("post", F.when(F.col("_full") & (room >= least_room), F.concat(first, "_end"))).drop("_title", "_body", "_end", "_said", "_again", "_whole", "_full")


def mended_drafts(df: DataFrame, internal: str = "https://ldrs.org.uk/article/") -> DataFrame:
    """Drafts (text, source_url, internal_source_url, include_source_url, image_caption, image_credit) as they
    should be: an internal address is never public; a lead line that stands twice is the
    image's caption, with its credit; the text is clean.  Other columns stay as they are."""
    public, known = F.trim(blank("source_url")), F.trim(blank("internal_source_url"))
    inside = F.startswith(casefold(public), F.lit(internal))
    lines = F.filter(F.transform(F.split(blank("text"), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    out = df.withColumns({"_lines": lines, "_in": F.when(inside, public).otherwise(blank("internal_source_url")), "_public": F.when(inside | (known != ""), "").otherwise(blank("source_url"))})
    doubled = F.coalesce((F.size("_lines") > 1) & (casefold(F.get("_lines", F.lit(0))) == casefold(F.get("_lines", F.lit(1)))), F.lit(False))
    lead = F.get("_lines", F.lit(0))
    credit = F.regexp_extract(lead, r"(?U)(?i)\b(?:Credit:|Photo(?:graph)?(?:\s+credit)?:?)\s*(.+)$", 1)
    text = F.when(doubled, F.array_join(F.slice("_lines", F.lit(3), F.greatest(F.lit(0), F.size("_lines") - 2)), "\n\n")).otherwise(blank("text"))
    return out.withColumns(
        {
            "text": social_text(text, "_in"),
            "source_url": F.col("_public"),
            "internal_source_url": F.col("_in"),
            "include_source_url": F.lit(False),
            "image_caption": F.when(doubled, lead).otherwise(F.col("image_caption")),
            "image_credit": F.when(doubled & (credit != ""), F.trim(credit)).otherwise(F.col("image_credit")),
        }
    ).drop("_lines", "_in", "_public")


def _has(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def _flags(text: Column) -> Column:
    """Which terms a story has: sensitive ones, those of a community, and those of each change of marks."""
    return _let(casefold(text), lambda t: F.array(_has(t, values.SENSITIVE_TERMS), _has(t, values.COMMUNITY_TERMS), *[_has(t, terms) for terms, *_ in values.MARK_CHANGES]))


def marks(flags: Column, most: int = 8) -> dict[str, Column]:
    """The mark of each role for what :func:`_flags` tells of a story, null where it has none."""
    kinds = [dict(v[: max(0, min(most, 8))]) for v in (values.SENSITIVE_MARKS, values.COMMUNITY_MARKS, values.OTHER_MARKS)]

    def of(role: str, kind: dict[str, str]) -> Column:
        mark = F.lit(kind.get(role)).cast("string")
        for i, (_, first, other, sign) in enumerate(values.MARK_CHANGES):
            changed = first if first in kind else other if other in kind else None
            if changed == role:
                mark = F.when(F.get(flags, F.lit(i + 2)), sign).otherwise(mark)
        return mark

    roles = dict.fromkeys(r for kind in kinds for r in kind)
    return {r: F.when(F.get(flags, F.lit(0)), of(r, kinds[0])).when(F.get(flags, F.lit(1)), of(r, kinds[1])).otherwise(of(r, kinds[2])) for r in roles}


def marked_post(df: DataFrame, most_marks: int = 8, longest: int = 6500) -> DataFrame:
    """``df`` with ``post``, its ``article`` (see :mod:`articles`) as a post: headline, opening, the other
    paragraphs, place and source, each with its mark; cut between paragraphs beyond ``longest``."""
    a = F.col("article")
    staged = df.withColumn("_flags", _flags(F.concat_ws(" ", a["title"], a["summary"], a["paragraphs"])))
    role = marks(F.col("_flags"), most_marks)
    staged = staged.withColumn("_marks", F.struct(F.lit(0).alias("_"), *[v.alias(k) for k, v in role.items()]))
    mark = lambda r: F.col("_marks")[r] if r in role else F.lit(None).cast("string")
    before = lambda m, t: F.concat(F.when(m.isNotNull(), F.concat(m, F.lit(" "))).otherwise(""), t)
    opening = F.when(a["summary"] != "", a["summary"]).otherwise(blank(F.get(a["paragraphs"], F.lit(0))))
    staged = staged.withColumn("_opening", opening).withColumn("_own", comparison_key("_opening"))
    body = F.filter(a["paragraphs"], lambda p: (F.col("_own") == "") | (comparison_key(p) != F.col("_own")))
    fits = lambda t: F.array_compact(F.array(*[F.when(mark(r).isNotNull() & _has(t, terms), F.struct(F.lit(r).alias("role"), mark(r).alias("mark"))) for r, terms in values.PARAGRAPH_ROLES]))
    staged = staged.withColumn("_body", F.transform(body, lambda p: F.struct(p.alias("text"), _let(casefold(p), fits).alias("roles"))))

    def dealt(state: Column, p: Column) -> Column:
        """The next paragraph with the mark of the first of its roles that is free."""
        got = F.slice(F.filter(p["roles"], lambda r: ~F.array_contains(state["used"], r["role"])), 1, 1)
        return F.struct(F.concat(state["out"], F.array(before(F.get(got, F.lit(0))["mark"], p["text"]))).alias("out"), F.concat(state["used"], F.transform(got, lambda r: r["role"])).alias("used"))

    none = F.array().cast("array<string>")
    dealt_body = F.aggregate("_body", F.struct(none.alias("out"), none.alias("used")), dealt, lambda s: s["out"])
    place = F.when(a["location"] != "", before(mark("location"), a["location"]))
    source = F.when(a["source"] != "", before(mark("information"), F.concat(F.lit("Source: "), a["source"])))
    parts = F.concat(
        F.array(before(mark("headline"), F.when(a["title"] == "", "Police update").otherwise(a["title"])), F.col("_opening")),
        dealt_body,
        F.array(F.when(has_content(a), "").otherwise(NO_DETAILS), F.concat_ws("\n", place, source)),
    )
    staged = staged.withColumn("_post", F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), "\n\n"))
    # The last gap of the part that fits, counted from its end.
    short = F.substring("_post", 1, longest - 1)
    gap = F.instr(F.reverse(short), "\n\n")
    whole = F.rtrim(F.when(gap > 0, short.substr(F.lit(1), F.char_length(short) - gap - 1)).otherwise(short), F.lit(" \n"))
    cut = F.when(whole != "", whole).otherwise(F.rtrim(short, F.lit(" \n")))
    post = F.when(F.char_length("_post") <= longest, F.col("_post")).otherwise(F.concat(cut, F.lit("…")))
    return staged.withColumn("post", post).drop("_flags", "_marks", "_opening", "_own", "_body", "_post")
