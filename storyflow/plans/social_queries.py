"""Queries of posts, each with SQL from its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import social as values
from ..operators import articles, social
from .publish_queries import _ART, _sections, news
from .registry import query, stories
from .text_queries import fold, key

_LETTERS = r"\p{L}\p{M}\p{N}\p{Pc}"

#: Stories with markup, entities escaped once and twice, a bare address, their own address and notes to editors.
_RAW = r"""raw AS (SELECT pos, title, url, '<h1 class="x">' || title || '</h1><DIV title=''a>b''>' || replace(body, chr(10), ' <br/> ') || '</div><!-- <p>no</p> --><b>see</b>&nbsp;(www.Example.com/' || pos || ') &amp;lt;b&amp;gt; &quot;q&quot; &#39;s&#39; ' || url || CASE WHEN pos % 3 = 0 THEN chr(13) || chr(10) || ' [Notes  to editor: call' || chr(10) || 'us' ELSE '<p>- end - ' END AS raw FROM stories)"""


def _raw(spark, sf):
    p = F.col("pos")
    end = F.when(p % 3 == 0, "\r\n [Notes  to editor: call\nus").otherwise("<p>- end - ")
    more = F.concat(F.lit("</div><!-- <p>no</p> --><b>see</b>&nbsp;(www.Example.com/"), p.cast("string"), F.lit(") &amp;lt;b&amp;gt; &quot;q&quot; &#39;s&#39; "), "url", end)
    raw = F.concat(F.lit('<h1 class="x">'), "title", F.lit("</h1><DIV title='a>b'>"), F.replace("body", F.lit("\n"), F.lit(" <br/> ")), more)
    return stories(spark, sf).select("pos", "title", "url", raw.alias("raw"))


def _clean(x: str, url: str | None = None) -> str:
    """Clean copy in SQL, for texts with these entities alone."""
    tag = r"""[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*>"""
    t = rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?i)</?(?:{'|'.join(values.BLOCK_TAGS)})(?:[\s/]{tag}|>)', chr(10), 'g'), '</?[A-Za-z]{tag}', '', 'g')"
    for _ in range(2):
        for name, mark in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
            t = f"replace({t}, '{name}', {mark})"
    t = rf"regexp_replace({t}, '(?ims)^\s*\[?\s*notes?\s+to\s+editors?\s*:.*\z', '')"
    t = f"replace({t}, {url}, '')" if url else t
    t = rf"regexp_replace({t}, '(?i)(^|[^{_LETTERS}@/:])(www\.[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?:/[^\s<]*)?)', '\1https://\2', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' -' || chr(10))"


@query("n25_social_text", f", {_RAW} SELECT pos, sha256({_clean('raw', 'url')}) AS text, length({_clean('raw', 'url')}) AS n FROM raw")
def clean_copy(spark, sf):
    r = _raw(spark, sf).select("pos", social.social_text("raw", "url").alias("t"))
    return r.select("pos", F.sha2("t", 256).alias("text"), F.char_length("t").cast("long").alias("n"))


def _camel(names: str, most: int) -> str:
    """Tags of the names (a list in SQL): CamelCase, each once without regard to case."""
    made = f"list_filter(list_transform({names}, lambda n: '#' || array_to_string(list_transform(list_filter(regexp_split_to_array(n, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || substr(w, 2)), '')), lambda t: length(t) BETWEEN 2 AND 40)"
    return f"array_to_string(list_reduce({made}, lambda kept, t: CASE WHEN list_contains(list_transform(kept, lambda k: lower(k)), lower(t)) THEN kept ELSE list_append(kept, t) END, []::VARCHAR[])[1:{most}], ' ')"


_AT = "CASE pos % 5 WHEN 0 THEN 'Market Rasen Town Hall ' WHEN 1 THEN 'the Usher Gallery, Lincoln''s Castle Museum; ' WHEN 2 THEN 'Boston and Barton upon Humber: ' WHEN 3 THEN 'Lincolnwards ' ELSE '' END || title"
_SEEN = lambda w: f"regexp_matches(f, '(^|[^{_LETTERS}]){w.lower()}($|[^{_LETTERS}])')"
_PLACES = ", ".join(f"CASE WHEN {_SEEN(p)} THEN '{p}' END" for p in values.PLACES)
_THERE = ", ".join(f"CASE WHEN {_SEEN(p)} THEN '{values.AUTHORITIES[p.lower()]}' END" for p in values.PLACES if p.lower() in values.AUTHORITIES)
_ABOUT = ", ".join(f"CASE WHEN {' OR '.join(map(_SEEN, words))} THEN '{tag}' END" for words, tag in values.TOPICS)


@query("n26_suggested_hashtags", f""", tagged AS (SELECT pos, trim(t) AS t, {fold("trim(t) || chr(10) || body")} AS f FROM (SELECT pos, {_AT} AS t, body FROM stories)),
 named AS (SELECT *, list_filter(regexp_extract_all(t, '\\b(?:[A-Z][A-Za-z0-9''’-]*\\s+){{0,4}}(?:{'|'.join(values.VENUE_ENDINGS)})\\b'), lambda v: regexp_matches(v, '\\S\\s+\\S')) AS v FROM tagged)
 SELECT pos, {_camel(f"list_filter(list_concat(v, [{_PLACES}], [{_THERE}], [{_ABOUT}], {list(values.CLOSING_TAGS)}), lambda x: x IS NOT NULL)", 8)} AS tags FROM named""")
def suggested(spark, sf):
    i = F.col("pos") % 5
    head = F.when(i == 0, "Market Rasen Town Hall ").when(i == 1, "the Usher Gallery, Lincoln's Castle Museum; ").when(i == 2, "Boston and Barton upon Humber: ").when(i == 3, "Lincolnwards ").otherwise("")
    return stories(spark, sf).select("pos", social.suggested_hashtags(F.concat(head, "title"), "body").alias("tags"))


@query("n45_normalised_hashtags", f"SELECT pos, {_camel('''list_transform(regexp_extract_all(f, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda x: replace(replace(x, '_', ' '), '-', ' '))''', 12)} AS tags FROM (SELECT pos, '#' || source || ' #local_news, local-news ##' || upper(source) || ' ' || title AS f FROM stories)")
def normalised(spark, sf):
    field = F.concat(F.lit("#"), "source", F.lit(" #local_news, local-news ##"), F.upper("source"), F.lit(" "), "title")
    return stories(spark, sf).select("pos", social.normalised_hashtags(field).alias("tags"))


_COUNT = lambda x: rf"len(regexp_extract_all({x}, '[{_LETTERS}’''-]*[{_LETTERS}][{_LETTERS}’''-]*'))"


@query("n27_short_posts", rf""", {_RAW}, s1 AS (SELECT pos, CASE WHEN pos % 4 = 0 THEN '' ELSE {_clean('title')} END AS t, {_clean('raw', 'url')} AS b, CASE WHEN pos % 5 = 0 THEN '' ELSE chr(10) || chr(10) || url END AS e FROM raw),
 s2 AS (SELECT *, {_clean('b')} AS bb, list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '([.!?])\s+', '\1¦', 'g'), '\n+', '¦', 'g'), '¦'), lambda x: trim(x)), lambda x: {_COUNT('x')} >= 8) AS l FROM s1),
 s3 AS (SELECT *, list_concat(CASE WHEN t = '' THEN [] ELSE list_transform(list_filter(l, lambda x: {fold('x')} <> {fold('t')}), lambda x: t || chr(10) || chr(10) || x) END, l, CASE WHEN t = '' THEN [] ELSE [t] END) AS choices FROM s2)
 SELECT pos, CASE WHEN length(bb) >= 240 AND {_COUNT('bb')} >= 40 AND (t = '' OR {fold('bb')} <> {fold('t')}) AND 300 - length(e) >= 40 THEN list_filter(choices, lambda x: x <> '' AND length(x) <= 300 - length(e))[1] || e END AS post FROM s3""")
def short_posts(spark, sf):
    r = _raw(spark, sf)
    # The address is cut out of the copy and, in a fifth of the stories, is not known.
    s = r.select("pos", F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.when(F.col("pos") % 5 == 0, F.replace("raw", F.col("url"), F.lit(""))).otherwise(F.col("raw")).alias("body"), F.when(F.col("pos") % 5 > 0, F.col("url")).alias("url"))
    return social.short_post(s).select("pos", "post")


@query("n44_mended_drafts", f"""SELECT pos, CASE WHEN pos % 4 = 0 THEN '' WHEN pos % 4 = 1 THEN '' ELSE url END AS source_url, CASE WHEN pos % 4 = 0 THEN 'https://LDRS.org.uk/article/' || pos WHEN pos % 4 = 1 THEN 'https://in.org/' || pos ELSE '' END AS internal_source_url,
 CASE WHEN pos % 3 = 0 THEN 'A lead. Photo credit: ' || source ELSE 'old' END AS image_caption, CASE WHEN pos % 3 = 0 THEN source ELSE 'none' END AS image_credit, sha256(trim(CASE WHEN pos % 3 = 0 THEN title || chr(10) || chr(10) || source ELSE title || ' ' || source END)) AS text FROM stories""")
def mended(spark, sf):
    p, s = F.col("pos"), stories(spark, sf)
    at = p.cast("string")
    inside = F.concat(F.lit("https://in.org/"), at)
    d = s.select(
        "pos",
        F.when(p % 4 == 0, F.concat(F.lit(" https://LDRS.org.uk/article/"), at)).otherwise(F.col("url")).alias("source_url"),
        F.when(p % 4 == 1, inside).alias("internal_source_url"),
        F.when(p % 3 == 0, F.concat(F.lit("A lead. Photo credit: "), "source", F.lit("\r\n \nA LEAD. photo credit: "), F.upper("source"), F.lit("\n"), "title", F.lit("\n"), "source")).otherwise(F.concat("title", F.when(p % 4 == 1, F.concat(F.lit(" "), inside)).otherwise(""), F.lit("  "), "source")).alias("text"),
        F.lit("old").alias("image_caption"),
        F.lit("none").alias("image_credit"),
        F.lit(True).alias("include_source_url"),
    )
    return social.mended_drafts(d).select("pos", "source_url", "internal_source_url", "image_caption", "image_credit", F.sha2("text", 256).alias("text"))


def _has(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({fold(x)}, '{t}')" for t in terms) + ")"


def _mark(role: str) -> str:
    """The mark of a role in SQL: the last change that meets it, else its own."""
    kinds = []
    for kind in (dict(values.SENSITIVE_MARKS), dict(values.COMMUNITY_MARKS), dict(values.OTHER_MARKS)):
        own = f"'{kind[role]}'" if role in kind else "CAST(NULL AS VARCHAR)"
        changes = [(i, sign) for i, (_, first, other, sign) in enumerate(values.MARK_CHANGES) if (first if first in kind else other) == role]
        kinds.append("CASE " + " ".join(f"WHEN h{i} THEN '{sign}'" for i, sign in reversed(changes)) + f" ELSE {own} END" if changes else own)
    return f"CASE WHEN sensitive THEN {kinds[0]} WHEN community THEN {kinds[1]} ELSE {kinds[2]} END"


_ROLES = [r for r, _ in values.PARAGRAPH_ROLES]
_HITS = ", ".join(f"CASE WHEN m_{r} IS NOT NULL AND {_has('x', terms)} THEN '{r}' END" for r, terms in values.PARAGRAPH_ROLES)
_SIGN = lambda x: "CASE {} {} END".format(x, " ".join(f"WHEN '{r}' THEN m_{r} || ' '" for r in _ROLES) + " ELSE ''")


@query("p6_marked_posts", rf""", {_ART}, w1 AS (SELECT pos, t, s, ps, list_transform(f1, lambda x: x) AS f1, list_transform(f2, lambda x: substr(x, 7)) AS place, CASE WHEN s <> '' THEN s ELSE coalesce(ps[1], '') END AS o, t || ' ' || s || CASE WHEN len(ps) > 0 THEN ' ' || array_to_string(ps, ' ') ELSE '' END AS w FROM art),
 w2 AS (SELECT *, {_has('w', values.SENSITIVE_TERMS)} AS sensitive, {_has('w', values.COMMUNITY_TERMS)} AS community, {", ".join(f"{_has('w', c[0])} AS h{i}" for i, c in enumerate(values.MARK_CHANGES))} FROM w1),
 w3 AS (SELECT *, {", ".join(f"{_mark(r)} AS m_{r}" for r in [*_ROLES, 'headline', 'location', 'information'])} FROM w2),
 w4 AS (SELECT *, list_transform(list_filter(ps, lambda x: {key('o')} = '' OR {key('x')} <> {key('o')}), lambda x: {{'t': x, 'r': list_filter([{_HITS}], lambda r: r IS NOT NULL)}}) AS l FROM w3),
 w5 AS (SELECT *, list_reduce(l, lambda a, x: {{'out': list_append(a.out, {_SIGN("list_filter(x.r, lambda r: NOT list_contains(a.used, r))[1]")} || x.t), 'used': list_concat(a.used, list_filter(x.r, lambda r: NOT list_contains(a.used, r))[1:1])}}, {{'out': []::VARCHAR[], 'used': []::VARCHAR[]}}).out AS b FROM w4),
 w6 AS (SELECT pos, {_sections(f"list_concat([coalesce(m_headline || ' ', '') || t, o], b, [CASE WHEN s = '' AND len(ps) = 0 THEN '{social.NO_DETAILS}' ELSE '' END, array_to_string(list_concat(list_transform(place, lambda y: coalesce(m_location || ' ', '') || y), list_transform(f1, lambda y: coalesce(m_information || ' ', '') || y)), chr(10))])")} AS x FROM w5)
 SELECT pos, sha256(CASE WHEN length(x) <= 6500 THEN x ELSE CASE WHEN contains(substr(x, 1, 6499), chr(10) || chr(10)) THEN regexp_replace(substr(x, 1, 6499), '(?s)^(.*)\n\n.*$', '\1') ELSE rtrim(substr(x, 1, 6499)) END || '…' END) AS post FROM w6""")
def marked_posts(spark, sf):
    return social.marked_post(articles.build(news(spark, sf))).select("pos", F.sha2("post", 256).alias("post"))
