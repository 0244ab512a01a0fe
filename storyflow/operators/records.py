"""Stories of stored records, their places, categories and paragraphs, packs' metadata, and the
health of a run's sources.

Texts are taken as read: entities are not resolved here.  A null text is the empty one, a null
list an empty one."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data.boilerplate import BOILERPLATE_LINES, FURNITURE_PHRASES, FURNITURE_WHOLE, NO_CATEGORIES, NO_PLACES
from ..functions.text import blank, casefold, clean, comparison_key, json_list, paragraphs, substantially_same
from . import desk

#: Marks that may stand about a label.
EDGES = " :–—-|"


def bare(c: Column | str) -> Column:
    """Case-folded, without the marks that may stand about a label."""
    return F.btrim(casefold(clean(c)), F.lit(EDGES))


def furniture(c: Column | str) -> Column:
    """Whether a paragraph is a page's furniture: nothing, a fixed line or phrase, or but a label, an image
    file's name, a date, a time, a network's name or a link to a neighbour."""
    t = clean(c)
    return (t == "") | bare(c).isin(*BOILERPLATE_LINES, *FURNITURE_PHRASES) | t.rlike("(?Ui)^(?:" + "|".join(FURNITURE_WHOLE) + ")$")


def first_fit(candidates: Sequence[Column | str], never: Sequence[str], longest: int = 100) -> Column:
    """The first candidate that says something: not empty, none of ``never``, no furniture, not too
    long; empty where there is none."""
    fits = [F.when(~furniture(c) & ~bare(c).isin(*never) & (F.char_length(clean(c)) <= longest), clean(c)) for c in candidates]
    return F.coalesce(*fits, F.lit(""))


def place(*candidates: Column | str) -> Column:
    """A story's place, from the best candidate to the worst."""
    return first_fit(candidates, NO_PLACES)


def category(*candidates: Column | str) -> Column:
    """A story's category, from the best candidate to the worst."""
    return first_fit(candidates, NO_CATEGORIES)


def own_paragraphs(body: Column | str, title: Column | str, summary: Column | str) -> Column:
    """A body's paragraphs in order, but for furniture, the title, the summary, and those that are
    substantially the same as one kept before."""
    keys = [F.nullif(comparison_key(c), F.lit("")) for c in (title, summary)]
    keyed = F.transform(paragraphs(body), lambda p: F.struct(comparison_key(p).alias("key"), p.alias("text")))
    said = F.filter(keyed, lambda p: ~furniture(p["text"]) & ~F.coalesce(p["key"] == keys[0], F.lit(False)) & ~F.coalesce(p["key"] == keys[1], F.lit(False)))
    same = lambda a, b: (a != "") & (b != "") & substantially_same(a, b)
    keep = lambda kept, p: F.when(F.exists(kept, lambda k: same(k["key"], p["key"])), kept).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(said, F.array().cast("array<struct<key:string,text:string>>"), keep, lambda kept: F.transform(kept, lambda k: k["text"]))


def _first(*texts: Column | str) -> Column:
    return F.coalesce(*[F.nullif(blank(c), F.lit("")) for c in texts], F.lit(""))


def stories_of_records(df: DataFrame, source: str = "Content Explorer", credit: str = "Agency", section: str = "Local Democracy") -> DataFrame:
    """Stored records (article_id, slug, title, summary, body, source_url, created_at, author, image_url,
    image_caption, image_credit, authorities_json, categories_json, content_type, detail_complete) as stories.

    The slug is the better title; the place is the councils, which with the categories are the tags; the body
    is the record's copy without the lines of its page; the caption with its rights wording is the credit
    where there is no other, and its subject describes the image."""
    text = _first("body", "summary", "slug")
    heading = _first("title", "slug")
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    staged = df.withColumns({"_lines": lines, "_authorities": json_list("authorities_json"), "_categories": json_list("categories_json")})
    staged = staged.withColumn("_body", F.array_join(desk.detail_lines(F.col("_lines"), heading, F.size("_lines")), "\n\n"))
    caption = F.trim(blank("image_caption"))
    subject = desk.image_subject("image_caption", F.coalesce(F.nullif(heading, F.lit("")), F.lit("Story image")))
    return staged.select(
        F.concat(F.lit("content:"), F.col("article_id").cast("string")).alias("story_id"),
        F.trim(_first("slug", "title")).alias("title"),
        F.trim(_first("summary", "_body")).alias("summary"),
        F.col("_body").alias("body"),
        F.lit(source).alias("source"),
        F.trim(blank("source_url")).alias("url"),
        F.trim(blank("created_at")).alias("published"),
        F.trim(blank("author")).alias("author"),
        F.array_join("_authorities", ", ").alias("location"),
        F.lit(section).alias("category"),
        F.trim(blank("image_url")).alias("image_url"),
        caption.alias("image_caption"),
        F.trim(_first("image_credit", caption, F.lit(credit))).alias("image_credit"),
        subject.alias("image_alt_text"),
        F.concat("_authorities", "_categories").alias("tags"),
        _first("content_type", F.lit("Story")).alias("content_type"),
        F.coalesce(F.col("detail_complete").cast("boolean"), F.lit(False)).alias("detail_complete"),
    )


def image_caption(title: Column | str, place: Column | str, source: Column | str) -> Column:
    """What stands under an image without a caption: the title, its place, and whose it is."""
    after = lambda mark, c: F.when(blank(c) != "", F.concat(F.lit(mark), blank(c))).otherwise("")
    return F.concat(blank(title), after(" — ", place), after(". Image/source: ", source))


def pack_metadata(credit: Column | str, quality: Column) -> Column:
    """The metadata of a story pack, as JSON, of a story (title, source, url, published, classification,
    editorial_decision, tags, image_url, image_caption, image_alt_text, image_is_fallback, extras: a map)."""
    known = ("priority_score", "priority_rating", "priority_level", "editorial_zone_label", "matched_place", "priority_reasons")
    texts = {"title": "title", "source": "source", "source_url": "url", "published": "published", "classification": "classification", "editorial_decision": "editorial_decision"}
    image = F.struct(
        blank("image_url").alias("source_url"),
        blank("image_caption").alias("caption"),
        blank(credit).alias("credit"),
        blank("image_alt_text").alias("alt_text"),
        F.coalesce("image_is_fallback", F.lit(False)).alias("is_fallback"),
        quality.alias("quality"),
    )
    editorial = F.struct(*[F.try_element_at("extras", F.lit(k)).alias(k.removesuffix("_label")) for k in known])
    whole = F.struct(*[blank(c).alias(k) for k, c in texts.items()], F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), image.alias("image"), editorial.alias("editorial"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def ascii_slugs(titles: Column | str) -> Column:
    """Slugs of compatibility-decomposed titles: accents go, so do letters without an ASCII form; what is left
    is joined by hyphens.  Spark has no decomposition, so this one step is an Arrow function."""
    @F.pandas_udf("string")
    def plain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    return F.btrim(F.regexp_replace(F.lower(plain(clean(titles))), "[^a-z0-9]+", "-"), F.lit("-"))


def health_summary(health: DataFrame) -> DataFrame:
    """The health of a run's sources (status, full_content_count, incomplete_content_count) in one row."""
    kinds = {"yielding": "yielding", "no_stories": "no-stories", "no_current_stories": "no-current-stories", "failed": "failed"}
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0)).cast("long")), F.lit(0))
    return health.agg(
        F.count("*").alias("sources"),
        *[F.count_if(F.col("status") == v).alias(k) for k, v in kinds.items()],
        total("full_content_count").alias("full_content"),
        total("incomplete_content_count").alias("incomplete_content"),
    )


def write_health(health: DataFrame, folder: str, now: Column) -> None:
    """The report of a run: ``summary`` (one line) and ``sources`` (a line each), as JSON; the summary, which
    says when, comes last, so that a report without one is not whole."""
    health.write.mode("overwrite").json(f"{folder}/sources")
    health_summary(health).select(now.alias("generated_at"), F.struct("*").alias("summary")).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def run_outcomes(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Whether each run's modules (success, completed_at) all came through, some or none, and when the last one did."""
    good = F.coalesce("success", F.lit(False))
    status = F.when(F.bool_and(good), "success").when(F.bool_or(good), "partial").otherwise("failure")
    return results.groupBy(run).agg(status.alias("status"), F.max(F.when(good, F.col("completed_at"))).alias("refreshed_at"))


def page_order(items: DataFrame, page: str = "page", pos: str = "pos", when: str = "published") -> DataFrame:
    """The newest and the oldest date of each page, and whether its dates never rise from one item to the
    next; undated items do not count."""
    dated = items.where(F.col(when).isNotNull())
    after = F.lead(when).over(Window.partitionBy(page).orderBy(pos))
    met = dated.select(page, when, after.alias("_next"))
    return met.groupBy(page).agg(F.max(when).alias("newest"), F.min(when).alias("oldest"), F.bool_and(F.coalesce(F.col(when) >= F.col("_next"), F.lit(True))).alias("falling"))
