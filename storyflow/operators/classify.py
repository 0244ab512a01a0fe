"""Classification by a weighted lexicon, and the decisions that follow from it.

The lexicon is a table of category, priority and keyword weights, and a part of the plan: some
thousands of keywords, which one branched pattern finds in one look through a text.  Larger
tables are joined: :func:`phrases.matches`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import lexicon as default
from ..functions.text import blank, classifier_text
from .phrases import found_in

SECTIONS = (("title", 3), ("summary", 2), ("body", 1))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The distinct ``keywords`` that stand in a normalised text as whole words, by one look through it;
    those that begin or end with a mark, and so have no word's edge there, by one look each."""
    plain = [k for k in keywords if re.match(r"\w(?:.*\w)?\Z", k, re.S)]
    found = found_in(text, plain)
    odd = [F.when(has_any(text, (k,)), F.lit(k)) for k in keywords if k not in plain]
    return F.concat(found, F.array_compact(F.array(*odd))) if odd else found


def has_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a normalised text has a keyword as whole words."""
    return text.rlike(r"(?U)(?<!\w)(?:" + "|".join(re.escape(k) for k in keywords) + r")(?!\w)")


def scored(df: DataFrame, lexicon=default.LEXICON, columns: tuple[tuple[str, int], ...] = SECTIONS, keep_texts: bool = False) -> DataFrame:
    """Adds ``scores`` (category to points) and ``matched`` (keyword to points)."""
    weights: dict[str, list[tuple[str, int]]] = {}
    for category, _, words in lexicon:
        for w, n in words.items():
            weights.setdefault(w, []).append((category, n))
    table = F.array(*[F.lit(w) for w in weights])
    entry = lambda w: F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("n")) for c, n in weights[w]])
    lookup = F.map_from_arrays(table, F.array(*[entry(w) for w in weights]))
    # Through explode, so that the optimiser cannot copy the cleaning of the text into what reads it.
    texts = [classifier_text(name) for name, _ in columns]
    df = df.select("*", F.explode(F.array(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)]))).alias("_texts"))
    parts = [_weighted(keywords_in(F.col(f"_texts.t{i}"), list(weights)), lookup, times) for i, (_, times) in enumerate(columns)]
    hits = F.concat(*parts)
    df = df.select("*", F.explode(F.array(hits)).alias("_hits"))
    names = [c for c, _, _ in lexicon]
    total = lambda c: F.aggregate(F.filter("_hits", lambda h: h["category"] == c), F.lit(0), lambda s, h: s + h["points"])
    scores = F.filter(F.transform(F.array(*map(F.lit, names)), lambda c: F.struct(c.alias("key"), total(c).alias("value"))), lambda e: e["value"] > 0)
    hit = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["word"])))
    # A keyword counts as the most that any of its categories gives it over all sections.
    points = lambda w: F.array_max(F.transform(F.filter("_hits", lambda h: h["word"] == w), lambda h: F.aggregate(F.filter("_hits", lambda g: (g["word"] == w) & (g["category"] == h["category"])), F.lit(0), lambda s, g: s + g["points"])))
    matched = F.transform(hit, lambda w: F.struct(w.alias("key"), points(w).alias("value")))
    return df.withColumns({"scores": F.map_from_entries(scores), "matched": F.map_from_entries(matched)}).drop("_hits", *([] if keep_texts else ["_texts"]))


def _weighted(found: Column, lookup: Column, times: int) -> Column:
    one = lambda w: F.transform(F.element_at(lookup, w), lambda e: F.struct(w.alias("word"), e["category"].alias("category"), (e["n"] * times).alias("points")))
    return F.flatten(F.transform(found, one))


def classified(df: DataFrame, lexicon=default.LEXICON, breaking=default.BREAKING, *, minimum: int = default.MINIMUM_SCORE, most: int = 3) -> DataFrame:
    """Adds primary, secondary, score, confidence, priority and breaking."""
    priorities = F.create_map(*[x for c, p, _ in lexicon for x in (F.lit(c), F.lit(p))])
    df = scored(df, lexicon, keep_texts=True)
    entry = lambda e: F.struct(e["value"].alias("score"), F.element_at(priorities, e["key"]).alias("priority"), e["key"].alias("category"))
    ranked = F.reverse(F.array_sort(F.transform(F.map_entries("scores"), entry)))
    df = df.select("*", F.explode(F.array(ranked)).alias("_ranked"))
    top, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    won = F.coalesce(top["score"] >= minimum, F.lit(False))
    floor = F.greatest(F.lit(minimum), F.bround(top["score"] * 0.5).cast("int"))
    others = F.filter(F.slice("_ranked", 2, 1000), lambda e: e["score"] >= floor)
    share = F.least(F.lit(1.0), top["score"] / 40.0) * 0.65 + (top["score"] - F.coalesce(second["score"], F.lit(0))) / top["score"] * 0.35
    rank = F.least(F.lit(100), top["priority"] + F.when(top["score"] >= 40, 5).otherwise(0) + F.when(top["score"] >= 70, 5).otherwise(0))
    text = F.array_join(F.filter(F.array(*[F.col(f"_texts.t{i}") for i in range(len(SECTIONS))]), lambda t: t != ""), " ")
    return df.withColumns(
        {
            "primary": F.when(won, top["category"]).otherwise(default.DEFAULT_CATEGORY),
            "secondary": F.when(won, F.slice(F.transform(others, lambda e: e["category"]), 1, most)).otherwise(F.array().cast("array<string>")),
            "score": F.when(won, top["score"]).otherwise(0),
            "confidence": F.when(won, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 2)).otherwise(0.0),
            "priority": F.when(won, rank).otherwise(default.DEFAULT_PRIORITY),
            "breaking": has_any(text, breaking),
        }
    ).drop("_ranked", "_texts")


def decided(df: DataFrame) -> DataFrame:
    """Adds the publishing decisions of a classified story."""
    p = F.col("priority")
    return df.withColumns(
        {
            "publish_immediately": p >= default.IMMEDIATE,
            "homepage": p >= default.HOMEPAGE,
            "facebook": p >= default.SOCIAL,
            "newsletter": p >= default.NEWSLETTER,
            "breaking_banner": F.col("breaking") | F.col("primary").isin(*default.BREAKING_CATEGORIES),
            "editor_review": F.col("confidence") < default.REVIEW,
            "homepage_rank": F.when(p >= 90, 1).when(p >= 75, 2).when(p >= 60, 3).when(p >= 50, 4).otherwise(5),
        }
    )


def first_rule(rules: tuple[tuple[str, tuple[str, ...]], ...], *texts: Column | str, default_: str = "Other") -> Column:
    """The first rule, in order, with a term in the first text that meets any rule."""
    each = [F.when(has_any(classifier_text(t), terms), F.lit(name)) for t in texts for name, terms in rules]
    return F.coalesce(*each, F.lit(default_))


def locality(text: Column | str, location: Column | str, inner: tuple[str, ...], outer: tuple[str, ...], names: tuple[str, str]) -> Column:
    """Inner area, outer area, outside, or unknown."""
    both = classifier_text(F.concat_ws(" ", blank(location), blank(text)))
    return F.when(has_any(both, inner), names[0]).when(has_any(both, outer), names[1]).when(blank(location) != "", f"outside_{names[1]}").otherwise("unknown")
