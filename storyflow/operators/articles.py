"""The article of a story: what all renderings show, cleaned once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data.rules import NOISE_PREFIXES, SCRAPE_NOISE
from ..functions.text import blank, clean, comparison_key, paragraphs

UNTITLED = "Untitled story"


def clean_title(title: Column | str) -> Column:
    """Without the words that only say that it is news, and dashes at its ends."""
    plain = F.regexp_replace(clean(title), r"(?iU)^(?:news|latest news|press release)\s*[:\-–—]\s*", "")
    return F.btrim(plain, F.lit(" -–—"))


def is_noise(text: Column, key: Column) -> Column:
    """Whether a line (and its comparison key) is what a scraper leaves: nothing, a fixed line, the
    name of an image file, or the start of one."""
    starts = F.lit(False)
    for p in NOISE_PREFIXES:
        starts = starts | F.startswith(key, F.lit(p))
    return (key == "") | key.isin(*SCRAPE_NOISE) | F.trim(text).rlike(r"(?i)^[^\n]*\.(?:jpg|jpeg|png|gif|webp|svg)\z") | starts


def build(df: DataFrame) -> DataFrame:
    """``df`` (title, summary, body, source, location, category, published: texts) with ``article``,
    a struct of title, summary, paragraphs, source, location, category and published.

    A summary that is the title or noise is empty; so is, among the paragraphs, each that is
    noise, the title, the summary or one before it, by comparison keys.  A null text is empty."""
    title, summary = clean_title("title"), clean("summary")
    known = F.when(comparison_key(summary) == comparison_key(title), "").when(is_noise(summary, comparison_key(summary)), "").otherwise(summary)
    staged = df.withColumns({"_title": title, "_summary": known})
    keyed = F.transform(paragraphs("body"), lambda p: F.struct(comparison_key(p).alias("key"), p.alias("text")))
    staged = staged.withColumn("_keyed", keyed).withColumn("_own", F.filter("_keyed", lambda p: ~is_noise(p["text"], p["key"]) & (p["key"] != comparison_key("_title")) & (p["key"] != comparison_key("_summary"))))
    staged = staged.withColumn("_keys", F.transform("_own", lambda p: p["key"]))
    once = F.transform(F.filter("_own", lambda p, i: F.array_position("_keys", p["key"]) == i + 1), lambda p: p["text"])
    article = F.struct(
        F.when(F.col("_title") == "", UNTITLED).otherwise(F.col("_title")).alias("title"),
        F.col("_summary").alias("summary"),
        once.alias("paragraphs"),
        *[clean(c).alias(c) for c in ("source", "location", "category", "published")],
    )
    return staged.withColumn("article", article).drop("_title", "_summary", "_keyed", "_own", "_keys")


def footer(a: Column, *fields: str) -> Column:
    """What is known of these fields, each with its name, joined by bars; the place is the area."""
    names = {"source": "Source: ", "location": "Area: ", "category": "Category: ", "published": "Published: "}
    return F.array_join(F.array_compact(F.array(*[F.when(blank(a[f]) != "", F.concat(F.lit(names[f]), a[f])) for f in fields])), " | ")


def has_content(a: Column) -> Column:
    return (a["summary"] != "") | (F.size(a["paragraphs"]) > 0)
