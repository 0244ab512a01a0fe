"""Listings: why a candidate is no article, what a source yields, and copy from an interface's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..data.boilerplate import ANSWER_FURNITURE
from ..functions.text import ascii_key, blank, casefold, clean, plain_html

#: Titles of listings, and those of categories that stand alone.
LISTING_TITLES = ("all news", "archive", "archives", "blog", "latest", "latest news", "news", "news archive")
CATEGORY_TITLES = (
    "cross country", "fell running", "mini league", "road running", "track and field", "latest news", "grand prix", "summer league", "northern league", "local xc league", "county development league",
)
#: Path segments and query names of listings, and what marks a link to one.
LISTING_SEGMENTS = ("archive", "archives", "categories", "category", "filter", "filtered", "tag", "tags", "taxonomy")
LISTING_MARKS = ("archive", "category", "filter", "tag", "taxonomy")
#: The outcomes, in the order in which they are judged.
REASONS = ("category-or-listing-page", "archive-page", "standalone-category-title", "navigation-first-page", "undated-blog-filter")


def _segments(url: Column | str) -> Column:
    """The path's segments that are not empty."""
    return F.filter(F.split(F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/"), lambda s: s != "")


def _plausible(year: Column, this_year: Column) -> Column:
    return F.coalesce(year.try_cast("int").between(2000, this_year + 1), F.lit(False))


def _dated(segment: Column, this_year: Column) -> Column:
    """Whether a blog's segment is a year, or a date like 3rd-may-2024."""
    return _plausible(F.regexp_extract(blank(segment), r"(?i)^(?:\d{1,2}(?:st|nd|rd|th)?-[a-z]+-(?=20))?(\d{4})$", 1), this_year)


def listing_structure(url: Column | str) -> Column:
    """``archive``, ``listing`` or empty, by the segments of an address and the names in its query."""
    query = F.regexp_extract(blank(url), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda n: n != "")
    met = F.array_intersect(F.transform(F.concat(_segments(url), names), casefold), F.array(*map(F.lit, LISTING_SEGMENTS)))
    return F.when(F.arrays_overlap(met, F.array(F.lit("archive"), F.lit("archives"))), "archive").when(F.size(met) > 0, "listing").otherwise("")


def rejection(df: DataFrame, this_year: Column | None = None, name: str = "reason") -> DataFrame:
    """``df`` with the first reason why a candidate is no article, empty for those that may be one.

    ``df``: title, url, summary, published (texts), has_metadata, broad_context (truths), n_links, card_text,
    link_text (of the card it stands in) and marker (classes of its link and of what holds that)."""
    year = F.year(F.current_date()) if this_year is None else this_year
    key, segments = ascii_key("title"), _segments("url")
    told = (blank("published") != "") | (blank("summary") != "")
    meta = F.coalesce("has_metadata", F.lit(False))
    years = F.regexp_extract_all(F.concat(F.lit("/"), F.array_join(segments, "/"), F.lit("/")), F.lit(r"/(?=(20\d{2})/)"), F.lit(1))
    in_path = F.exists(years, lambda y: _plausible(y, year))
    blog = F.coalesce(casefold(F.get(segments, F.lit(0))) == "blog", F.lit(False))
    dated_blog = (F.size(segments) >= 3) & blog & _dated(F.get(segments, F.lit(1)), year)
    staged = df.withColumns({"_evidence": told | in_path | dated_blog | meta, "_structure": listing_structure("url")})
    words, linked = F.char_length(clean("card_text")), F.char_length(clean("link_text"))
    menu = (F.coalesce("n_links", F.lit(0)) >= 2) & ~told & ~meta & (words > 0) & (linked >= 0.6 * words)
    marked = casefold("marker").rlike("|".join(LISTING_MARKS))
    reason = (
        F.when(key.isin(*LISTING_TITLES), REASONS[0]).when(F.col("_structure") == "archive", REASONS[1]).when(F.col("_structure") != "", REASONS[0])
        .when(key.isin(*CATEGORY_TITLES) & ~F.col("_evidence"), REASONS[2]).when(F.coalesce("broad_context", F.lit(False)) & ~F.col("_evidence"), REASONS[0])
        .when(menu, REASONS[3]).when((F.size(segments) == 2) & blog & ~_dated(F.get(segments, F.lit(1)), year) & ~F.col("_evidence") & marked, REASONS[4]).otherwise("")
    )
    return staged.withColumn(name, reason).drop("_evidence", "_structure")


def counted(judged: DataFrame, name: str = "reason") -> tuple[DataFrame, Observation]:
    """``judged`` and an observation of how many rows each reason has (``accepted`` for none): the counts
    come from the same scan as the rows, once an action has run over them."""
    seen = Observation()
    return judged.observe(seen, F.count_if(F.col(name) == "").alias("accepted"), *[F.count_if(F.col(name) == r).alias(r) for r in REASONS]), seen


def source_analysis(judged: DataFrame, source: str = "source", most_links: int = 2000) -> DataFrame:
    """A row a source: links, duplicates among them, candidates, accepted, rejected, warnings and status.

    ``judged``: source, url, reason, image and summary."""
    ok = F.col("reason") == ""
    per = judged.groupBy(source).agg(
        F.least(F.count("*"), F.lit(most_links)).alias("links"), (F.count("*") - F.count_distinct(F.coalesce("url", F.lit("")))).alias("duplicates"), F.count("*").alias("candidates"), F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"), F.count_if(ok & (blank("image") != "")).alias("_images"), F.count_if(ok & (blank("summary") != "")).alias("_summaries"),
    )
    found = F.col("accepted") > 0
    warnings = F.array_compact(F.array(
        F.when((F.col("candidates") > 0) & ~found, "No stories survived the 3-day date rule."), F.when(found & (F.col("_images") == 0), "Images are unavailable in detected cards."),
        F.when(found & (F.col("_summaries") == 0), "Summaries are unavailable in detected cards."), F.when(F.col("links") > 1000, "The page contains an excessive number of links."),
    ))
    status = F.when(found & (F.size("warnings") == 0), "Ready to save").when(found, "Ready with warnings").otherwise("Not ready")
    return per.withColumn("warnings", warnings).withColumn("status", status).drop("_images", "_summaries")


#: Tags whose text is a paragraph.
_BLOCKS = "h2|h3|h4|p|blockquote|li"


def _kept(texts: Column) -> Column:
    """Clean texts but for empty ones and furniture."""
    return F.filter(F.transform(texts, lambda t: plain_html(t, None)), lambda t: (t != "") & ~t.rlike("(?Ui)" + "|".join(ANSWER_FURNITURE)))


def block_texts(payload: Column | str) -> Column:
    """The copy of an interface's answer: JSON whose ``content`` is a list of blocks of any shape.

    Of each block the texts with markup under rowData.widgetData (content, contentDouble, quote) give a
    paragraph for each of their block tags, or for each line where a block has none so far.  Blocks of
    another shape, values that are no texts and malformed JSON give nothing.  No Python runs:
    answers are Spark's variants."""
    blocks = F.try_variant_get(F.try_parse_json(payload), "$.content", "array<variant>")

    def value(block: Column, field: str) -> Column:
        v = F.try_variant_get(block, f"$.rowData.widgetData.{field}", "variant")
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.when(F.contains(text, F.lit("<")), text)

    def added(done: Column, text: Column) -> Column:
        tagged = _kept(F.regexp_extract_all(text, F.lit(rf"(?is)<({_BLOCKS})(?:\s[^>]*)?>(.*?)</\1\s*>"), F.lit(2)))
        lines = _kept(F.split(F.regexp_replace(text, "<[^>]*(?:>|$)", "\n"), r"\n"))
        more = F.concat(done, tagged)
        return F.when(text.isNull(), done).when(F.size(more) > 0, more).otherwise(lines)

    none = F.array().cast("array<string>")
    of = lambda b: F.aggregate(F.array(*[value(b, f) for f in ("content", "contentDouble", "quote")]), none, added)
    return F.array_join(F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<variant>")), of)), "\n\n")
