"""Cards of a listing as a browser shows them: lines of text with labels, in either of two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, casefold, clean
from ..functions.urls import article_id
from ..operators.desk import authorities, explorer_date

#: A card's labels and the fields they name; a type is only read from the combined line.
LABELS = {"type": None, "author": "author", "author's email": "author_email", "last reviewed by email": "reviewer_email", "created at": "created_at", "modified at": "modified_at"}

_DATE = r"([A-Z][a-z]{2},\s+[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}(?:\s+\([^)]*GMT\))?)"
_WHO = r"(?i)\b(Story|Advisory)\s+Author:\s*(.+?)\s+Author's email:\s*(\S+)\s+Last reviewed by email:\s*(\S+)"


def _label(line: Column) -> Column:
    """The label that a line starts with; null of another line."""
    out = F.lit(None).cast("string")
    for label in reversed(LABELS):
        out = F.when(F.startswith(casefold(line), F.lit(f"{label}:")), F.lit(label)).otherwise(out)
    return out


def listing_cards(cards: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """``cards`` with the fields of each one's text: title (the first line), slug (the second, without its version),
    summary (the lines from there to the first label), author, the two addresses, the two dates, content_type, and
    the councils named after the last label.

    The newer layout has several labels on one line and the councils before it: what it says of author, addresses,
    dates and type comes before the lines' own.  A null or empty text has empty fields."""
    tidy = F.filter(F.transform(F.split(blank(text), r"\R|[\x1c-\x1e]"), lambda x: clean(x)), lambda x: x != "")
    staged = cards.withColumn("_lines", F.transform(tidy, lambda x, i: F.struct(i.alias("i"), x.alias("x"), _label(x).alias("label"))))
    staged = staged.withColumns({"_flat": F.array_join(F.transform("_lines", lambda n: n["x"]), " "), "_labelled": F.filter("_lines", lambda n: n["label"].isNotNull()), "_n": F.size("_lines")})
    places = F.transform("_labelled", lambda n: n["i"])
    at = lambda pattern: F.coalesce(F.array_min(F.transform(F.filter("_lines", lambda n: n["x"].rlike(pattern)), lambda n: n["i"])), F.lit(-1))
    staged = staged.withColumns({"_from": F.coalesce(F.array_min(places), F.col("_n")), "_to": F.coalesce(F.array_max(places), F.col("_n") - 1), "_who": at(r"(?i)\b(?:Story|Advisory)\s+Author:"), "_changed": at(r"(?i)modified at:")})

    def said(label: str) -> Column:
        values = F.transform(F.filter("_labelled", lambda n: n["label"] == label), lambda n: F.trim(F.substring(n["x"], len(label) + 2, 1 << 30)))
        return blank(F.get(F.filter(values, lambda v: v != ""), F.lit(0)))

    def first(found: Column, label: str) -> Column:
        return F.when(found != "", found).otherwise(said(label))

    flat, who = F.col("_flat"), F.col("_flat").rlike(_WHO)
    part = lambda i: F.trim(F.regexp_extract(flat, _WHO, i))
    when = lambda name: explorer_date(first(F.regexp_extract(flat, rf"(?i)\b{name} at:\s*{_DATE}", 1), f"{name} at"))
    before = F.transform(F.filter("_lines", lambda n: (n["i"] >= 1) & (n["i"] < F.col("_from"))), lambda n: n["x"])
    between = F.filter("_lines", lambda n: (n["i"] > F.col("_changed")) & (n["i"] < F.col("_who")) & ~n["x"].rlike(r"(?i)\b(?:created|modified) at:"))
    after = F.filter("_lines", lambda n: n["i"] > F.col("_to"))
    own = F.when(who & (F.col("_changed") >= 0) & (F.col("_who") > F.col("_changed")), between).otherwise(after)
    fields = {
        "article_id": article_id(url),
        "content_type": F.when(who, F.initcap(part(1))).otherwise("Story"),
        "title": blank(F.get("_lines", F.lit(0))["x"]),
        "slug": F.trim(F.regexp_replace(blank(F.get(before, F.lit(0))), r"(?i)\s+v\.\d+$", "")),
        "summary": F.array_join(F.slice(before, 2, 1 << 30), "\n\n"),
        "author": first(part(2), "author"),
        "author_email": first(part(3), "author's email"),
        "reviewer_email": first(part(4), "last reviewed by email"),
        "created_at": when("created"),
        "modified_at": when("modified"),
        "authorities": authorities(F.transform(own, lambda n: n["x"])),
    }
    return staged.select(*[c for c in cards.columns if c != text and c not in fields], *[v.alias(k) for k, v in fields.items()])
