"""Rendering of articles as Column expressions, and the sinks that write them.

Renderings take the struct that :func:`articles.build` makes of a story."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, clean, comparison_key, statistics, truncate_words
from . import articles

#: What stands in the place of a text that is not there.
FALLBACK = "Further information was not available in the supplied source material."
NEWSLETTER_FALLBACK = "Further details were not available in the supplied source material."


def escaped(c: Column) -> Column:
    """Safe inside HTML."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def _sections(*parts: Column) -> Column:
    """The parts (arrays of texts) one after the other, blank ones left out, parted by blank lines."""
    return F.array_join(F.filter(F.transform(F.concat(*parts), lambda p: F.trim(p)), lambda p: p != ""), "\n\n")


def plain_text(a: Column) -> Column:
    """Title, summary, paragraphs and where they come from."""
    empty = F.when(~articles.has_content(a), FALLBACK).otherwise("")
    return _sections(F.array(a["title"], a["summary"]), a["paragraphs"], F.array(empty, articles.footer(a, "source", "location", "published")))


def markdown(a: Column) -> Column:
    """A heading, the summary in bold, paragraphs, and a footer in italics."""
    summary = F.when(a["summary"] != "", F.concat(F.lit("**"), a["summary"], F.lit("**"))).otherwise("")
    empty = F.when(~articles.has_content(a), FALLBACK).otherwise("")
    foot = articles.footer(a, "source", "location", "category", "published")
    return _sections(F.array(F.concat(F.lit("# "), a["title"]), summary), a["paragraphs"], F.array(empty, F.when(foot != "", F.concat(F.lit("*"), foot, F.lit("*"))).otherwise("")))


def html_page(a: Column) -> Column:
    """A whole page: heading, summary in bold, paragraphs, and a small footer."""
    text = lambda c: escaped(c)
    summary = F.when(a["summary"] != "", F.concat(F.lit("<p><strong>"), text(a["summary"]), F.lit("</strong></p>"))).otherwise("")
    body = F.array_join(F.transform(a["paragraphs"], lambda p: F.concat(F.lit("<p>"), text(p), F.lit("</p>"))), "\n")
    body = F.when(articles.has_content(a), body).otherwise(f"<p>{FALLBACK}</p>")
    foot = articles.footer(a, "source", "location", "category", "published")
    foot = F.when(foot != "", F.concat(F.lit("<p><small>"), text(foot), F.lit("</small></p>"))).otherwise("")
    title = text(a["title"])
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit("</title>\n</head>\n<body>\n<article>\n<h1>"), title, F.lit("</h1>"))
    return F.concat_ws("\n", head, summary, body, foot, F.lit("</article>\n</body>\n</html>\n"))


def breaking(a: Column, most: int = 55) -> Column:
    """A breaking notice: the title, and the summary or the first paragraph, cut to some words."""
    text = F.when(a["summary"] != "", a["summary"]).otherwise(blank(F.get(a["paragraphs"], F.lit(0))))
    return _sections(F.array(F.lit("🚨 BREAKING NEWS"), a["title"], truncate_words(text, most)))


#: A direct quote.
QUOTE = r"""[\"“‘][^\"”’]+[\"”’]"""


def newsletter(a: Column, most: int = 4, longest: int = 1800) -> Column:
    """Title, the summary or the first paragraph, the first paragraphs without a quote and one
    with, in the last place, and a footer; cut at a paragraph's or sentence's end."""
    ps = a["paragraphs"]
    opening = F.when(a["summary"] != "", a["summary"]).otherwise(blank(F.get(ps, F.lit(0))))
    numbered = F.transform(ps, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    others = F.filter(numbered, lambda x: comparison_key(x["p"]) != comparison_key(opening))
    plain = F.slice(F.filter(others, lambda x: ~x["p"].rlike(QUOTE)), 1, most)
    quote = F.get(F.filter(others, lambda x: x["p"].rlike(QUOTE)), F.lit(0))
    full = F.size(plain) == most
    used = quote.isNotNull() & (~full | (quote["i"] < F.get(plain, F.lit(most - 1))["i"]))
    texts = F.transform(plain, lambda x: x["p"])
    body = F.when(~F.coalesce(used, F.lit(False)), texts).when(full, F.concat(F.slice(texts, 1, most - 1), F.array(quote["p"]))).otherwise(F.concat(texts, F.array(quote["p"])))
    empty = F.when(~articles.has_content(a), NEWSLETTER_FALLBACK).otherwise("")
    return cut_cleanly(_sections(F.array(a["title"], opening), body, F.array(empty, articles.footer(a, "location", "category", "source"))), longest)


def cut_cleanly(text: Column, longest: int) -> Column:
    """A long text cut before its last blank line, or else after its last sentence, if over half of
    the length is kept; with an ellipsis."""
    short = F.substring(text, 1, longest - 1)
    back = F.reverse(short)
    last = lambda mark: F.when(F.instr(back, mark[::-1]) > 0, F.char_length(short) - F.instr(back, mark[::-1]) - len(mark) + 1).otherwise(-1)
    gap, stop = last("\n\n"), F.greatest(last(". "), last("! "), last("? "))
    cut = F.when(gap > longest // 2, F.substring(short, F.lit(1), gap)).when(stop > longest // 2, F.substring(short, F.lit(1), stop + 1)).otherwise(short)
    return F.when(F.char_length(text) <= longest, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit("…")))


def card(c: Column | str, longest: int = 190) -> Column:
    """A card's text: cut to its length with three dots."""
    t = clean(c)
    return F.when(F.char_length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def rights_status(image: Column | str, approved: Column) -> Column:
    return F.when(blank(image) == "", "no image").when(F.coalesce(approved, F.lit(False)), "approved").otherwise("not reviewed")


def rendered(df: DataFrame, strict: bool = False) -> DataFrame:
    """A story with its article, all its formats and statistics; ``errors`` says what keeps it from being published.
    ``strict``: a story with errors fails the run, which names them."""
    from .filters import validation_errors

    stats = {k: v for k, v in statistics("body").items()}
    a = F.col("article")
    formats = {"plain": plain_text(a), "markdown": markdown(a), "html": html_page(a), "breaking_text": breaking(a), "newsletter_text": newsletter(a)}
    out = articles.build(df).withColumns({**formats, "errors": validation_errors("title", "body"), **stats})
    return out.where((F.size("errors") == 0) | F.raise_error(F.concat(F.lit("Invalid story: "), F.array_join("errors", " "))).isNull()) if strict else out


def write_csv(df: DataFrame, folder: str, mark: bool = True) -> None:
    """CSV with a header line.  ``mark``: each file starts with a byte-order mark, by which spreadsheets know UTF-8."""
    named = [f"\ufeff{c}" if mark and i == 0 else c for i, c in enumerate(df.columns)]
    df.toDF(*named).write.mode("overwrite").option("header", True).csv(folder)


def write_text(df: DataFrame, column: str, folder: str, now: datetime | None = None) -> str:
    """A text column as text files in ``folder``, or, with ``now``, in a folder in it that is named by the time.  Returns where."""
    out = f"{folder}/{column}_{now:%Y%m%d_%H%M%S}" if now else folder
    df.select(column).write.mode("overwrite").text(out)
    return out


def append_audit(record: DataFrame, folder: str) -> None:
    """Appends records as JSON lines."""
    record.write.mode("append").json(folder)


def latest_audit(spark: SparkSession, folder: str, schema: str, when: str = "at") -> DataFrame:
    """The latest record of an audit (one row, or none), by its time; lines that are no record are passed over."""
    records = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).where(F.col(when).isNotNull())
    return records.orderBy(F.desc(when)).limit(1)


def allowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns that may be kept, those that are there."""
    return df.select(*[c for c in columns if c in df.columns])
