"""What an editor's desk does with stories and drafts: summaries, captions, filters, orders, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data.boilerplate import ANSWER_FURNITURE
from ..data.rules import DETAIL_PREFIXES, DETAIL_UI_LINES
from ..functions.text import blank, bound, casefold, clean
from .filters import meaningful_summary

#: Fixed pattern: a council's name.
AUTHORITY = (
    r"(?:[A-Z][A-Za-z&'’.-]*(?:\s+(?:of|the|upon|on|and|North|South|East|West|[A-Z][A-Za-z&'’.-]*))*?\s+"
    r"(?:County Council|City Council|District Council|Borough Council|Combined Authority|Council))"
)

#: Fixed patterns: what sharing buttons leave at a line's end.
SHARING = (
    r"\s*[•|]\s*Share on X(?:\s*\(Opens? in new window\))?\s*X",
    r"\s*[•|]\s*Share on Facebook(?:\s*\(Opens? in new window\))?\s*Facebook",
    r"\s*[•|]\s*Share on LinkedIn(?:\s*\(Opens? in new window\))?\s*LinkedIn",
    r"\s*[•|]\s*Share via Email",
    r"\s*Like this:",
    r"\s*Loading(?:\.\.\.)?",
)

#: Where a caption's rights wording starts, the first of these that occurs.
CREDIT_MARKS = (". Credit:", " Credit:", ". Permission for", " Permission for")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def trimmed_summary(c: Column | str, most: int = 70, least: int = 30) -> Column:
    """At most so many words: back to the last sentence's end if enough words remain, else with an ellipsis."""

    def trimmed(words: Column) -> Column:
        whole = lambda cut: F.trim(F.regexp_extract(cut, r"(?s)^(.*[.!?])(?=\s|\z)", 1))
        open_ = lambda cut: F.concat(F.regexp_replace(cut, r"[ ,;:-]+\z", ""), F.when(cut.rlike(r"[.!?]\z"), "").otherwise("…"))
        short = bound(F.array_join(F.slice(words, 1, most), " "), lambda cut: bound(whole(cut), lambda w: F.when((w != "") & (F.size(_words(w)) >= least), w).otherwise(open_(cut))))
        return F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(short)

    return bound(_words(clean(c)), trimmed)


def summary_from_body(c: Column | str, least: int = 30, most: int = 70) -> Column:
    """The opening paragraphs that say something, each once, until there are enough words; those behind are not read."""
    state = lambda kept, n, done: F.struct(kept.alias("kept"), n.alias("n"), done.alias("done"))
    start = state(F.array().cast("array<string>"), F.lit(0), F.lit(False))

    def said(a: Column, p: Column) -> Column:
        again = (p == "") | F.exists(a["kept"], lambda k: casefold(k) == casefold(p))
        more = bound(a["n"] + F.size(_words(p)), lambda n: state(F.concat(a["kept"], F.array(p)), n, n >= min(least, most)))
        return F.when(again, a).otherwise(more)

    add = lambda a, p: F.when(a["done"], a).otherwise(bound(meaningful_summary(p), lambda x: said(a, x)))
    opening = F.aggregate(F.split(blank(c), r"\n\s*\n|\r\n\s*\r\n"), start, add, lambda a: F.array_join(a["kept"], " "))
    return trimmed_summary(opening, most, least)


def ensured_summary(summary: Column | str, others: list[Column | str], body: Column | str) -> Column:
    """The first that says something: the story's own summary, one of the others, or the body's opening."""
    return F.coalesce(*[F.nullif(meaningful_summary(c), F.lit("")) for c in (summary, *others)], summary_from_body(body))


def generated_summary(body: Column | str, enough: int = 25, most: int = 60) -> Column:
    """The first paragraph of five words or more, with the next where it has too few; cut to some words."""
    parts = F.transform(F.split(blank(body), r"\n\s*\n"), lambda p: clean(p))
    said = F.filter(parts, lambda p: (F.size(_words(p)) >= 5) & ~p.rlike(r"(?i)\A(?:(?:first|second) half|match report|report)\z") & ~p.rlike("(?Ui)" + "|".join(ANSWER_FURNITURE)))
    first = _words(blank(F.get(said, F.lit(0))))
    both = F.when(F.size(first) >= enough, first).otherwise(F.concat(first, _words(blank(F.get(said, F.lit(1))))))
    return F.array_join(F.slice(both, 1, most), " ")


def laid_out(c: Column | str, least: int = 500) -> Column:
    """Paragraphs between blank lines; a long single block becomes paragraphs of two sentences."""
    raw = F.regexp_replace(blank(c), r"\r\n?", "\n")
    parts = F.filter(F.transform(F.split(raw, r"\n\s*\n"), lambda p: clean(p)), lambda p: p != "")

    def pairs(sentences: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(sentences) - 1, F.lit(2)), lambda i: F.trim(F.array_join(F.slice(sentences, i + 1, F.lit(2)), " "))), "\n\n")

    def single(one: Column) -> Column:
        return F.when(F.char_length(one) < least, one).otherwise(bound(F.split(one, r"(?<=[.!?])\s+(?=[A-Z0-9‘“])"), lambda s: F.when(F.size(s) < 3, one).otherwise(pairs(s))))

    return bound(parts, lambda p: F.when(F.size(p) > 1, F.array_join(p, "\n\n")).otherwise(bound(blank(F.get(p, F.lit(0))), single)))


def without_sharing(c: Column | str) -> Column:
    """Without what sharing buttons leave at the end, however often it stands there."""
    return F.trim(F.regexp_replace(clean(c), rf"(?Ui)(?:{'|'.join(SHARING)})+\s*\z", ""))


def detail_lines(lines: Column, title: Column | str, marker: Column) -> Column:
    """A record's copy from the lines of its page: the first ``marker`` of them, after the last "download
    text", without what belongs to the site, the title and the record's labels."""
    first = F.slice(lines, F.lit(1), F.greatest(F.lit(0), marker.cast("int")))
    back = F.array_position(F.reverse(F.transform(first, casefold)), "download text").cast("int")
    rest = F.when(back > 0, F.slice(first, F.size(first) - back + 2, F.greatest(F.lit(0), back - 1))).otherwise(first)
    own = F.trim(casefold(title))

    def kept(line: Column) -> Column:
        low = F.trim(casefold(line))
        labelled = reduce(lambda a, p: a | F.startswith(low, F.lit(p)), DETAIL_PREFIXES, F.endswith(low, F.lit(" log out")))
        return (low != "") & ~low.isin(*DETAIL_UI_LINES) & ~labelled & ((own == "") | (low != own)) & ~line.rlike(r"^[A-Z][a-z]{2},\s+[A-Z][a-z]{2}\s+\d")

    return F.filter(rest, kept)


def authorities(values: Column) -> Column:
    """The councils named in each value, or the value itself; each once, in order."""
    found = F.transform(values, lambda v: F.when(F.trim(blank(v)) == "", F.array().cast("array<string>")).when(v.rlike(AUTHORITY), F.regexp_extract_all(F.trim(v), F.lit(AUTHORITY), F.lit(0))).otherwise(F.array(F.trim(v))))
    return F.array_distinct(F.flatten(found))


def image_subject(caption: Column | str, fallback: Column | str) -> Column:
    """A caption up to its rights wording; the fallback where nothing is left."""
    t = clean(caption)
    cut = reduce(lambda later, m: F.when(F.instr(casefold(t), m.lower()) > 0, F.rtrim(F.trim(F.substring(t, F.lit(1), F.instr(casefold(t), m.lower()) - 1)), F.lit("."))).otherwise(later), reversed(CREDIT_MARKS), t)
    return F.when(cut != "", cut).otherwise(F.trim(blank(fallback)))


def caption_sentences(title: Column | str, body: Column | str, closing: str = "Read the full story") -> Column:
    """The title, the first three whole sentences of 20 to 150 characters that are not it, and a closing line."""
    sentences = F.split(F.trim(F.regexp_replace(blank(body), r"(?U)\s+", " ")), r"(?<=[.!?])\s+")
    chosen = F.filter(sentences, lambda s: F.char_length(s).between(20, 150) & (casefold(s) != casefold(title)))
    return F.concat(F.array(blank(title)), F.slice(chosen, 1, 3), F.array(F.lit(closing)))


def source_only(df: DataFrame, text: Column, title: Column, article: Column, url: Column, name: str = "own", limit: int = 300) -> DataFrame:
    """``df`` with ``name``: whether every block of a post (its last one may be the address) is the title or stands
    in the article.  Post, title and article are cleaned first, as posts are."""
    from .social import social_text

    staged = df.withColumns({"_post": social_text(text), "_title": social_text(title), "_article": social_text(article, url), "_address": F.trim(blank(url))})
    blocks = F.filter(F.transform(F.split("_post", r"\n{2,}"), lambda b: F.trim(b)), lambda b: b != "")
    staged = staged.withColumn("_blocks", blocks)
    last = F.get("_blocks", F.size("_blocks") - 1)
    own = F.when((F.col("_address") != "") & (last == F.col("_address")), F.slice("_blocks", F.lit(1), F.greatest(F.lit(0), F.size("_blocks") - 1))).otherwise(F.col("_blocks"))
    staged = staged.withColumn("_own", own)
    held = F.forall("_own", lambda b: (b == F.col("_title")) | F.contains("_article", b))
    return staged.withColumn(name, F.coalesce((F.char_length("_post") <= limit) & (F.size("_own") > 0) & held, F.lit(False))).drop("_post", "_title", "_article", "_address", "_blocks", "_own")


def needs_detail(complete: Column, body: Column | str, image: Column | str, credit: Column | str) -> Column:
    """Whether a record must be fetched again: not complete, no body, a doubled lead line, or an image of no real credit."""
    lines = F.filter(F.transform(F.split(blank(body), r"\r\n|[\n\r]"), lambda x: casefold(F.trim(x))), lambda x: x != "")
    doubled = F.coalesce((F.size(lines) > 1) & (F.get(lines, F.lit(0)) == F.get(lines, F.lit(1))), F.lit(False))
    weak = (F.trim(blank(image)) != "") & casefold(F.trim(blank(credit))).isin("", "ldrs")
    return ~F.coalesce(complete, F.lit(False)) | (F.size(lines) == 0) | doubled | weak


def desk_filter(df: DataFrame, *, search: str = "", searched: list[str] = (), equal: dict[str, str] | None = None, folded: dict[str, str] | None = None, within: dict[str, str] | None = None, member: dict[str, str] | None = None) -> DataFrame:
    """The rows that a desk shows: ``search`` in the text of the columns ``searched``, columns equal to a
    value (exactly, or case-folded), holding one, or having it among their values.  Choices that are
    not made are left out; nothing regards case but ``equal``."""
    if search.strip():
        df = df.where(F.contains(F.concat_ws(" ", *[casefold(c) for c in searched]), casefold(F.lit(search.strip()))))
    for c, v in (equal or {}).items():
        df = df.where(blank(c) == v)
    for c, v in (folded or {}).items():
        df = df.where(casefold(F.trim(blank(c))) == casefold(F.lit(v)))
    for c, v in (within or {}).items():
        df = df.where(F.contains(casefold(c), casefold(F.lit(v))))
    for c, v in (member or {}).items():
        df = df.where(F.exists(F.col(c), lambda x: casefold(F.trim(x)) == casefold(F.lit(v))))
    return df


def retained_stories(df: DataFrame, name: str, least: int = 160) -> DataFrame:
    """A source's stories that stand in while it cannot be read: not summaries alone, from no search index, no archive page, and long enough."""
    mine = (blank("source_key") == name) | (blank("source") == name)
    whole = ~blank("completeness").eqNullSafe("summary_only") & ~F.coalesce("from_index", F.lit(False))
    return df.where(mine & whole & ~F.endswith(casefold(F.trim(blank("title"))), F.lit(" archives")) & (F.char_length(F.trim(blank("body"))) >= least))


#: What a URL's check says.
URL_ERRORS = {
    "kind": "A valid HTTP or HTTPS URL is required.",
    "port": "The URL contains a malformed port.",
    "credentials": "URLs containing embedded credentials are prohibited.",
    "localhost": "Localhost URLs are prohibited.",
    "private": "Private, loopback and non-public network URLs are prohibited.",
}

#: IPv4 networks that are not global, as address and prefix length.
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))


def url_errors(url: Column | str) -> Column:
    """What makes an address unsafe to fetch; names are not looked up, and of numbers only IPv4 is judged."""
    u = F.trim(blank(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.regexp_extract(place, r"([^@]*)$", 1)
    host, port = F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(host_port, r":([^:\]]*)$", 1)
    bad_port = (port != "") & (~port.rlike("^[0-9]+$") | (F.length(port) > 5) | (port.try_cast("int") > 65535))
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    number = F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(octets, lambda x: x <= 255), F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
    inside = F.lit(False)
    for net, bits in PRIVATE:
        low = reduce(lambda a, x: a * 256 + int(x), net.split("."), 0)
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    errors = F.array_compact(
        F.array(
            F.when(F.contains(place, F.lit("@")) & (F.regexp_extract(place, r"^(.*)@", 1).rlike("[^:]")), URL_ERRORS["credentials"]),
            F.when((host == "localhost") | F.endswith(host, F.lit(".localhost")), URL_ERRORS["localhost"]),
            F.when(port.try_cast("int") == 0, URL_ERRORS["port"]),
            F.when(F.coalesce(inside, F.lit(False)), URL_ERRORS["private"]),
        )
    )
    return F.when(F.coalesce(bad_port, F.lit(False)), F.array(F.lit(URL_ERRORS["port"]))).when(~scheme.isin("http", "https") | (host == ""), F.array(F.lit(URL_ERRORS["kind"]))).otherwise(errors)


def address_key(c: Column | str) -> Column:
    """An address as drafts are found by: trimmed, without slashes at its end, case-folded."""
    return casefold(F.rtrim(F.trim(blank(c)), F.lit("/")))


def workflow_status(stories: DataFrame, drafts: DataFrame, order: str = "pos") -> DataFrame:
    """``stories`` (url) with ``stage``: whether the first draft (by ``order``) one of whose addresses, public
    or internal (source_url, internal_source_url, status, delivery_id), is the story's is on the
    desk or delivered; empty without a draft or an address.  No story is doubled."""
    sent = (F.trim(blank("delivery_id")) != "") | (casefold(F.trim(blank("status"))) == "sent to metricool as draft")
    d = drafts.select(F.explode(F.array_distinct(F.array(address_key("source_url"), address_key("internal_source_url")))).alias("_key"), sent.alias("_sent"), F.col(order).alias("_order"))
    first = d.where("_key <> ''").groupBy("_key").agg(F.min_by("_sent", "_order").alias("_sent"))
    stage = F.when(F.col("_sent"), "SENT TO METRICOOL").when(~F.col("_sent"), "SENT TO SOCIAL DESK").otherwise("")
    return stories.withColumn("_key", address_key("url")).join(first, "_key", "left").withColumn("stage", stage).drop("_key", "_sent")


def clashes(sources: DataFrame) -> DataFrame:
    """Sources (source_id, name, listing_key) with ``same_name`` and ``same_url``: whether another id has
    the name (case-folded) or the listing address (as a key).  Two aggregates; no pair is formed."""
    more = lambda by: sources.select(by.alias("_k"), "source_id").where(blank("_k") != "").groupBy("_k").agg(F.count_distinct("source_id").alias("_n")).where("_n > 1").select("_k")
    names, urls = more(casefold(F.trim(blank("name")))).withColumn("same_name", F.lit(True)), more(blank("listing_key")).withColumn("same_url", F.lit(True))
    out = sources.join(names.withColumnRenamed("_k", "_a"), casefold(F.trim(blank("name"))) == F.col("_a"), "left").join(urls.withColumnRenamed("_k", "_b"), blank("listing_key") == F.col("_b"), "left")
    return out.withColumns({"same_name": F.coalesce("same_name", F.lit(False)), "same_url": F.coalesce("same_url", F.lit(False))}).drop("_a", "_b")


def with_source(df: DataFrame, profile: str) -> DataFrame:
    """Stories (source, category, extras) joined with their source (source_name, source_category, source_meta,
    a map): what a story has itself stays; extras of its own win over the source's."""
    extras = F.coalesce("extras", F.create_map().cast("map<string,string>"))
    given = F.map_concat(F.coalesce("source_meta", F.create_map().cast("map<string,string>")), F.create_map(F.lit("module_profile"), F.lit(profile)))
    missing = F.map_filter(given, lambda k, v: ~F.map_contains_key(extras, k))
    own = lambda c, other: F.when(F.trim(blank(c)) != "", F.col(c)).otherwise(F.trim(blank(other)))
    return df.withColumns({"source": own("source", "source_name"), "category": own("category", F.coalesce("source_category", F.lit(profile))), "extras": F.map_concat(extras, missing)})


def definition_fingerprint(definition: Column) -> Column:
    """SHA-256 of a definition (a map of texts) as JSON with sorted keys, a space after each mark."""
    def quoted(s: Column) -> Column:
        """A text as JSON has it: backslash, quote and control characters escaped, all else as it is."""
        t = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
        escaped = reduce(lambda a, i: F.replace(a, F.lit(chr(i)), F.lit(named.get(i, f"\\u{i:04x}"))), range(32), t)
        return F.concat(F.lit('"'), F.when(t.rlike("[\\x00-\\x1f]"), escaped).otherwise(t), F.lit('"'))

    pairs = F.transform(F.array_sort(F.map_entries(definition)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256)


def retention_counts(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """What a clean-up would do to records (author_email, reviewer_email, created_at, fetched_at), in one row; nothing is changed."""
    stamp = F.coalesce("created_at", "fetched_at", now)
    emails = (blank("author_email") != "") | (blank("reviewer_email") != "")
    old = F.unix_micros(stamp) < F.unix_micros(now) - days * 86_400_000_000
    return df.agg(F.count_if(emails).alias("emails_removed"), F.count_if(old).alias("metadata_removed"))


def without_contacts(df: DataFrame) -> DataFrame:
    """Contact addresses are never stored."""
    return df.withColumns({c: F.lit("") for c in ("author_email", "reviewer_email") if c in df.columns})


def image_counts(df: DataFrame) -> DataFrame:
    """How many stories (image, fallback) have an image of their own, and how many a made one."""
    there = F.trim(blank("image")) != ""
    return df.agg(F.count_if(there & ~F.coalesce("fallback", F.lit(False))).alias("images"), F.count_if(there & F.coalesce("fallback", F.lit(False))).alias("fallback_images"))


def explorer_date(c: Column | str) -> Column:
    """``Mon, Jan 01, 2024 10:00`` or ``Mon, 01 Jan 2024 10:00``, a bracketed zone at the end left out, as ISO text in UTC; any other text as it is."""
    raw = F.trim(blank(c))
    t = F.trim(F.regexp_replace(raw, r"\s*\([^)]*GMT\)\s*$", ""))
    day = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "
    first = F.regexp_extract(t, rf"^{day}(\w{{3}} \d{{1,2}}, \d{{4}} \d{{1,2}}:\d{{2}})$", 1)
    other = F.regexp_extract(t, rf"^{day}(\d{{1,2}} \w{{3}} \d{{4}} \d{{1,2}}:\d{{2}})$", 1)
    read = F.coalesce(F.try_to_timestamp(F.nullif(first, F.lit("")), F.lit("MMM d, yyyy H:mm")), F.try_to_timestamp(F.nullif(other, F.lit("")), F.lit("d MMM yyyy H:mm")))
    return F.coalesce(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), raw)
