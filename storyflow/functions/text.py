"""Scalar text functions as Column expressions: no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it stands there: within other functions'
    lambdas Spark computes a common part anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(c: Column | str) -> Column:
    """A null text as the empty one."""
    return F.coalesce(_c(c), F.lit(""))


def clean(c: Column | str) -> Column:
    """White space collapsed to one space and trimmed; null is empty."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def casefold(c: Column | str) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(blank(c)), F.lit("ß"), F.lit("ss"))


def classifier_text(c: Column | str) -> Column:
    """Case-folded, with plain apostrophes and hyphens and single spaces."""
    return clean(F.translate(casefold(c), "’–—", "'--"))


def comparison_key(c: Column | str) -> Column:
    """Case-folded words, without punctuation."""
    return clean(F.regexp_replace(casefold(c), r"(?U)[^\w\s]", ""))


def ascii_key(c: Column | str, separator: str = " ") -> Column:
    """Case-folded runs of ASCII letters and digits, joined by a separator."""
    return F.btrim(F.regexp_replace(casefold(c), "[^a-z0-9]+", separator), F.lit(separator))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the comparison key of the parts."""
    return F.sha2(comparison_key(F.concat_ws(" ", *map(blank, parts))), 256)


def story_identity(*parts: Column | str) -> Column:
    """SHA-256 of the pipe-joined parts, each collapsed and case-folded."""
    return F.sha2(F.concat_ws("|", *[casefold(clean(p)) for p in parts]), 256)


def item_key(story_id: Column | str, url: Column | str, title: Column | str, source: Column | str) -> Column:
    """24 hex digits for the first of id, URL and title that is not empty, with the source."""
    value = F.coalesce(F.nullif(blank(story_id), F.lit("")), F.nullif(blank(url), F.lit("")), blank(title))
    return F.substring(F.sha2(F.concat_ws("|", value, blank(source)), 256), 1, 24)


def slug(c: Column | str, longest: int | None = None, default: str = "") -> Column:
    """Lower-case ASCII letters and digits joined by hyphens."""
    out = ascii_key(c, "-")
    out = F.rtrim(F.substring(out, 1, longest), F.lit("-")) if longest else out
    return F.when(out == "", default).otherwise(out)


def truncate_dots(c: Column | str, length: int) -> Column:
    """At most ``length`` characters, cut after a word where that keeps over half, and ``...``."""
    text = clean(c)
    if length <= 3:
        return F.when(F.char_length(text) <= length, text).otherwise("." * max(0, length))
    room = length - 3
    short = F.rtrim(F.substring(text, 1, room))
    space = F.char_length(short) - F.instr(F.reverse(short), " ")  # of the last space, from 0
    there = (F.instr(short, " ") > 0) & (space > max(0, room // 2))
    short = F.when(there, F.rtrim(short.substr(F.lit(1), space))).otherwise(short)
    return F.when(F.char_length(text) <= length, text).otherwise(F.concat(short, F.lit("...")))


def truncate_ellipsis(c: Column | str, length: int) -> Column:
    """At most ``length`` characters, cut before the last word begun, and an ellipsis."""
    text = clean(c)
    short = F.substring(text, 1, length - 1)
    space = F.char_length(short) - F.instr(F.reverse(short), " ")
    short = F.when(F.instr(short, " ") > 0, short.substr(F.lit(1), space)).otherwise(short)
    return F.when(F.char_length(text) <= length, text).otherwise(F.concat(F.rtrim(short, F.lit(" ,;:-")), F.lit("…")))


def truncate_words(c: Column | str, most: int) -> Column:
    """The first words, with an ellipsis where more follow."""
    words = F.split(clean(c), " ")
    return F.when(F.size(words) <= most, clean(c)).otherwise(F.concat(F.rtrim(F.array_join(F.slice(words, 1, most), " "), F.lit(" ,;:-")), F.lit("…")))


#: Words that are no tags.
STOP_WORDS = (
    "about", "after", "again", "against", "being", "could", "from", "have", "into", "more", "other", "over", "said", "that",
    "their", "there", "these", "they", "this", "through", "under", "until", "where", "which", "while", "with", "would",
)


def tags(c: Column | str, most: int = 10, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first distinct words of four letters or more, lower case, without stop words."""
    found = F.regexp_extract_all(clean(c), F.lit(r"([A-Za-z][A-Za-z'-]{3,})"), F.lit(1))
    plain = F.transform(found, lambda w: F.btrim(F.lower(w), F.lit("'-")))
    return F.slice(F.array_distinct(F.filter(plain, lambda w: (w != "") & ~w.isin(*stop_words))), 1, most)


def paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines, or lines where there is but one block; trimmed, none empty."""
    text = F.trim(F.regexp_replace(blank(c), r"\r\n?", "\n"))
    tidy = lambda a: F.filter(F.transform(a, lambda p: clean(p)), lambda p: p != "")
    blocks = tidy(F.split(text, r"\n\s*\n"))
    return F.when(F.size(blocks) > 1, blocks).otherwise(tidy(F.split(text, r"\n")))


def terminal_punctuation(c: Column | str) -> Column:
    """Adds a full stop unless the text ends with a mark."""
    text = F.trim(blank(c))
    return F.when((text == "") | text.rlike("[.!?:;”\"’]$"), text).otherwise(F.concat(text, F.lit(".")))


def substantially_same(a: Column, b: Column) -> Column:
    """Equal, or long, of like length, and one within the other (comparison keys)."""
    short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    return (a == b) | ((short >= 55) & (short / long >= 0.88) & (F.contains(a, b) | F.contains(b, a)))


def clean_paragraphs(c: Column | str, title: Column | str) -> Column:
    """Paragraphs in order but for those that are the title or substantially the same as one kept before."""
    key_title = comparison_key(title)
    keep = lambda kept, p: F.when((comparison_key(p) == "") | (comparison_key(p) == key_title) | F.exists(kept, lambda k: substantially_same(comparison_key(k), comparison_key(p))), kept).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(paragraphs(c), F.array().cast("array<string>"), keep)


def statistics(c: Column | str) -> dict[str, Column]:
    """Words, characters, paragraphs, sentences and reading minutes of a body.  A sentence ends with a mark, the quotes
    and brackets after it, and white space."""
    body = F.trim(F.regexp_replace(blank(c), r"\r\n?", "\n"), F.lit(" \t\n\x0b\f\r"))
    words = F.regexp_count(body, F.lit(r"(?U)[\w][\w’'-]*"))
    parts = F.size(F.filter(F.split(body, r"\n\s*\n+"), lambda p: F.trim(p) != ""))
    chunks = F.size(F.filter(F.split(body, r"""(?U)(?<=[.!?])["'’”)]*\s+|[.!?]+\z"""), lambda p: p.rlike(r"(?U)\S")))
    return {
        "word_count": words.cast("long"),
        "character_count": F.char_length(body).cast("long"),
        "paragraph_count": F.when(body == "", 0).otherwise(parts).cast("long"),
        "sentence_count": F.when(body == "", 0).otherwise(F.greatest(F.lit(1), chunks)).cast("long"),
        "reading_time": F.when(words > 0, F.greatest(F.lit(1), F.ceil(words / 200))).otherwise(0).cast("long"),
    }


def after_once(c: Column | str, prefix: Column | str) -> Column:
    """The prefix on a line before the text, unless the text holds it."""
    return F.when(F.contains(casefold(c), casefold(prefix)) | (blank(prefix) == ""), blank(c)).otherwise(F.concat_ws("\n\n", blank(prefix), blank(c)))


def composed(*parts: Column | str) -> Column:
    """The parts in order, each but those empty or held by what is there already."""
    out: Column = F.lit("")
    for p in parts:
        p = F.trim(blank(p))
        out = F.when((p == "") | F.contains(out, p), out).when(out == "", p).otherwise(F.concat(out, F.lit("\n\n"), p))
    return out


def hashtags(names: Column, most: int = 8, longest: int = 40) -> Column:
    """``#CamelCase`` of each name, distinct without regard to case, in order."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    tag = lambda n: F.concat(F.lit("#"), F.array_join(F.transform(F.filter(F.split(n, "[^A-Za-z0-9]+"), lambda w: w != ""), word), ""))
    made = F.filter(F.transform(names, tag), lambda t: (F.char_length(t) > 1) & (F.char_length(t) <= longest))
    once = lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t)))
    return F.slice(F.aggregate(made, F.array().cast("array<string>"), once), 1, most)


def caption_credit(c: Column | str) -> Column:
    """The credit at the end of a caption."""
    return F.trim(F.regexp_extract(blank(c), r"(?i)(?:image|photo|picture)?\s*credit:\s*(.+)$", 1))


def plain_html(c: Column | str, longest: int | None = 300) -> Column:
    """Tags as spaces, the common entities read, collapsed and cut (None: whole)."""
    text = F.regexp_replace(blank(c), "<[^>]+>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return clean(text) if longest is None else F.substring(clean(text), 1, longest)


def unique_fold(values: Column) -> Column:
    """Distinct values without regard to case, in order, in their first spelling."""
    once = lambda kept, t: F.when(F.exists(kept, lambda k: casefold(k) == casefold(t)), kept).otherwise(F.concat(kept, F.array(t)))
    return F.aggregate(F.filter(values, lambda v: F.trim(v) != ""), F.array().cast("array<string>"), once)


def json_list(c: Column | str) -> Column:
    """A JSON list of texts; anything else is an empty list."""
    read = F.from_json(blank(c), "array<string>")
    return F.coalesce(F.filter(read, lambda v: F.trim(v) != ""), F.array().cast("array<string>"))
