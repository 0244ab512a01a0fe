"""Texts against tables of phrases: in the row, and as a join.

For a table that is part of the plan (some thousands of phrases), :func:`found_in` reads a text
once: one pattern, branched letter by letter, that looks ahead at every word's start.  For
tables of any size :func:`matches` parts texts into words once and joins runs of them with whole
phrases; Spark broadcasts the table if it is small and shuffles by run if not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written


def branched(phrases: list[str], text: str = re.escape) -> str:
    """A pattern for any of ``phrases``, the longest at a place, whose common beginnings are common branches.

    ``text`` gives the pattern of a character."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [text(ch) + pattern(sub) for ch, sub in sorted(node.items()) if ch]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return inner + "?" if "" in node else inner

    return pattern(tree)


def found_in(text: Column, phrases: list[str]) -> Column:
    """The distinct ``phrases`` that stand in ``text`` as whole words (Unicode), in no set order.

    At each word's start the longest phrase is found; those that it begins with, up to a word's
    end, stand there too and are looked up by it."""
    if not phrases:
        return F.array().cast("array<string>")
    # The end of a word is a part of the branches: a longer branch that fails there gives way to a shorter one.
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\w)(?=({branched(phrases)})(?!\w))"), F.lit(1)))
    nested = {p: [q for q in phrases if p == q or (p.startswith(q) and not re.match(r"\w", p[len(q)]))] for p in phrases}
    more = {p: qs for p, qs in nested.items() if len(qs) > 1}
    if not more:
        return hits
    table = F.create_map(*[x for p, qs in more.items() for x in (F.lit(p), F.array(*map(F.lit, qs)))])
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(table, h), F.array(h)))))


def _joined(words: list[Column]) -> Column:
    """Words as one text, different for different words; null where one is missing (:func:`_marked`)."""
    return F.concat(*[x for w in words for x in (F.lit("\0\1"), w)])


def _marked(words: Column) -> Column:
    """Words in which NUL is doubled, so that it can part them; a null word is NUL and 2."""
    return F.transform(words, lambda w: F.coalesce(F.replace(w, F.lit("\0"), F.lit("\0\0")), F.lit("\0\2")))


def matches(texts: DataFrame, key: str, words: Column, phrases: DataFrame, most: int | None = None) -> DataFrame:
    """``key, phrase`` once for each phrase that a text holds.

    ``words``: a text's words in order, as an array; ``phrases``: phrase, words; ``most``: of phrases with more
    words, if given, only so many count.  For each length that phrases have, each word of a text goes with those that follow, and
    is joined on all of them at once: no row is made for phrases that only begin alike.  A null or empty text holds none."""
    table = phrases.select("phrase", (F.slice("words", 1, most) if most else F.col("words")).alias("_p")).where(F.get("_p", F.lit(0)).isNotNull())
    table = written(table.select("phrase", F.size("_p").alias("_n"), F.aggregate(_marked(F.col("_p")), F.lit(""), lambda s, w: F.concat(s, F.lit("\0\1"), w)).alias("_g")))
    lengths = sorted(r["_n"] for r in table.select("_n").distinct().collect())
    if not lengths:
        return texts.select(F.col(key), F.lit(None).cast(phrases.schema["phrase"].dataType).alias("phrase")).limit(0)
    names = [f"w{i}" for i in range(lengths[-1])]
    lists = texts.select(F.col(key).alias("_key"), _marked(words).alias("_w"))
    shifted = [F.col("_w") if i == 0 else F.slice("_w", F.lit(i + 1), F.greatest(F.lit(0), F.size("_w") - i)) for i in range(len(names))]
    rows = lists.where(F.size("_w") > 0).select("_key", F.inline(F.arrays_zip(*[s.alias(n) for s, n in zip(shifted, names)])).alias(*names))
    grams = [_joined([F.col(w) for w in names[:n]]) for n in lengths]
    rows = rows.select("_key", (grams[0] if len(grams) == 1 else F.explode(F.array(*grams))).alias("_g")).where(F.col("_g").isNotNull())
    return rows.join(table.select("phrase", "_g"), "_g").select(F.col("_key").alias(key), "phrase").distinct()
