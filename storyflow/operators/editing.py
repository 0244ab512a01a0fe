"""House style as Column expressions: rewrites outside quotations, repeats and short paragraphs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank, comparison_key

#: What counts as a quotation.
QUOTE = r"([\"“][^\"”]*[\"”]|‘[^’]*’)"

#: Press-release phrases and what is written instead.
REWRITES = (
    ("officers from Nottinghamshire Police", "Nottinghamshire Police officers"),
    ("officers attended", "Police attended"),
    ("officers discovered", "Police discovered"),
    ("officers found", "Police found"),
    ("officers searched", "Police searched"),
    ("officers seized", "Police seized"),
    ("officers arrested", "Police arrested"),
    ("enquiries remain ongoing", "enquiries are continuing"),
    ("enquiries are ongoing", "enquiries are continuing"),
    ("investigations remain ongoing", "the investigation is continuing"),
    ("investigations are ongoing", "the investigation is continuing"),
    ("a number of", "several"),
    ("at this moment in time", "currently"),
    ("at this stage", "currently"),
    ("subsequently", "later"),
    ("has now been jailed", "has been jailed"),
    ("have now been jailed", "have been jailed"),
    ("was subsequently arrested", "was later arrested"),
    ("were subsequently arrested", "were later arrested"),
    ("made their way to", "went to"),
    ("utilised", "used"),
    ("commenced", "began"),
)

#: Openings that are left out.
OPENINGS = (
    "Nottinghamshire Police has revealed that",
    "Nottinghamshire Police has confirmed that",
    "Police have confirmed that",
    "It has been confirmed that",
    "It has been revealed that",
)

#: Words that are not written twice in a row.
DOUBLED = (("Police police", "Police"), ("the the", "the"), ("that that", "that"))


def spaced(c: Column) -> Column:
    """Single spaces within lines, at most one blank line, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _replaced(c: Column, phrase: str, new: str) -> Column:
    """In capitals, with a capital or as given, after the text that is replaced."""
    p = re.escape(phrase).replace("\\ ", " ")
    c = F.regexp_replace(c, rf"\b{p.upper()}\b", new.upper())
    c = F.regexp_replace(c, rf"\b(?=[A-Z])(?i:{p})\b", new[0].upper() + new[1:])
    return F.regexp_replace(c, rf"(?i)\b{p}\b", new)


def unquoted(c: Column, rewrites=REWRITES, openings=OPENINGS) -> Column:
    """A text without quotations in house style."""
    for o in openings:
        c = F.regexp_replace(c, rf"(?i)^{o}\s+", "")
    any_ = "|".join(re.escape(p).replace("\\ ", " ") for p, _ in rewrites)
    new = c
    for phrase, instead in rewrites:
        new = _replaced(new, phrase, instead)
    c = F.when(c.rlike(rf"(?i)\b(?:{any_})\b"), new).otherwise(c)
    for twice, once in DOUBLED:
        c = F.regexp_replace(c, rf"(?i)\b{twice}\b", once)
    c = F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"([,.;:!?])([A-Za-z])", "$1 $2")
    return spaced(c)


def house_style(text: Column | str, **options) -> Column:
    """A text in house style, its quotations as they are."""
    t = spaced(blank(text))
    gaps = F.transform(F.split(t, QUOTE, -1), lambda g: unquoted(g, **options))
    quotes = F.regexp_extract_all(t, F.lit(QUOTE), F.lit(0))
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), quotes.alias("q")), lambda x: F.concat(x["g"], F.coalesce(x["q"], F.lit("")))), "")
    return F.trim(joined)


def without_repeats(paragraph: Column) -> Column:
    """A paragraph with each sentence once, the first."""
    sentences = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: comparison_key(s) != "")
    once = lambda kept, s: F.when(F.exists(kept, lambda k: comparison_key(k) == comparison_key(s)), kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(sentences, F.array().cast("array<string>"), once)
    return F.when(F.size(F.split(paragraph, r"(?<=[.!?])\s+")) < 2, paragraph).otherwise(F.array_join(kept, " "))


def merged(paragraphs: Column, longest: int = 180, together: int = 320) -> Column:
    """Neighbours joined, two at a time from the first, where both are short and quote nothing."""
    short = lambda p: (F.char_length(p) <= longest) & ~p.rlike(QUOTE)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc, p):
        one = acc["open"]
        fits = short(one) & short(p) & (F.char_length(one) + F.char_length(p) <= together)
        return (
            F.when(one.isNull(), F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(F.concat(acc["done"], F.array(F.concat_ws(" ", F.rtrim(one), F.ltrim(p)))).alias("done"), F.lit(None).cast("string").alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(one)).alias("done"), p.alias("open")))
        )

    return F.aggregate(paragraphs, start, add, lambda acc: F.concat(acc["done"], F.array_compact(F.array(acc["open"]))))
