"""Queries of the filters, joins, de-duplication, classification, store and state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..data import lexicon as default
from ..data.places import PLACES
from ..data.rules import ARTICLE_URL_PARTS, EXCLUDED_TITLES, URL_PENALTIES
from ..functions import dates, text, urls
from ..operators import classify, dedup, filters, joins, ordering, store
from ..streaming import state
from .registry import NOW, now, query, stories, table
from .text_queries import ascii_, c, fold

#: Places and keywords that do occur in the invented prose of the inputs.
FIXTURE_PLACES = ("Thea", "Enbe", "Anea on", "Los", "De la")
FIXTURE_LEXICON = (
    ("Alpha", 90, {"the": 2, "of": 1, "of the": 4, "was": 3}),
    ("Beta", 60, {"la": 3, "de": 2, "de la": 5, "que": 1}),
    ("Gamma", 70, {"der": 3, "und": 3, "die": 1, "the": 1}),
    ("Delta", 40, {"no": 6, "el": 3, "los": 4, "es": 1, "la": 1}),
    ("Omega", 40, {"no": 6, "se": 3}),
)
FIXTURE_BREAKING = ("scum", "reble", "de la")

def _classifier(t: str) -> str:
    return c("translate(" + fold(t) + ", '’–—', '''--')")


def _has(t: str, words) -> str:
    import re

    return rf"regexp_matches({t}, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])(" + "|".join(re.escape(w).replace("\\ ", " ").replace("'", "''") for w in words) + r")([^\p{L}\p{M}\p{N}\p{Pc}]|$)')"


def _place(p: str) -> str:
    return "(?i)(^|[^A-Za-z0-9])" + p.replace(" ", r"[\s-]+") + "([^A-Za-z0-9]|$)"


_ANY_PLACE = lambda t, places: "(" + " OR ".join(f"regexp_matches({t}, '{_place(p)}')" for p in places) + ")"
_LONGEST = sorted(set(FIXTURE_PLACES), key=lambda p: (-len(p), p))


# -- filters -------------------------------------------------------------------------------


@query("f2_geographic", f"""SELECT pos, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{_place(p)}') THEN '{p}' END" for p in _LONGEST)}], lambda x: x IS NOT NULL), ',') AS places
 FROM (SELECT pos, title || ' ' || summary || ' ' || body AS t FROM stories) WHERE {_ANY_PLACE('t', _LONGEST)}""")
def geographic(spark, sf):
    g = filters.geographic(stories(spark, sf), ["title", "summary", "body"], FIXTURE_PLACES)
    return g.select("pos", F.array_join("geographic_matches", ",").alias("places"))


@query("f1_default_gazetteer", f"SELECT pos, {_ANY_PLACE('body', sorted(set(PLACES)))} AS matched FROM stories")
def default_gazetteer(spark, sf):
    return stories(spark, sf).select("pos", filters.any_place("body").alias("matched"))


@query("f3_geographic_where_required", f"SELECT pos FROM stories WHERE source NOT IN ('src1', 'src2', 'src3') OR {_ANY_PLACE('body', FIXTURE_PLACES)}")
def geographic_where_required(spark, sf):
    return filters.geographic_where_required(stories(spark, sf), ["body"], F.col("source").isin("src1", "src2", "src3"), FIXTURE_PLACES).select("pos")


@query("f12_materially_full", f"""SELECT pos, length(b) >= 120 AND (s = '' OR ({fold('b')} <> {fold('s')} AND length(b) >= length(s) + 40)) AS full FROM (SELECT pos, {c('body')} AS b, {c('summary')} AS s FROM stories)""")
def materially_full(spark, sf):
    return stories(spark, sf).select("pos", filters.materially_full("body", "summary").alias("full"))


@query("f13_verified_full", f"""SELECT pos, CASE pos % 5 WHEN 0 THEN pos % 2 = 0 AND f WHEN 1 THEN pos % 3 = 0 AND f WHEN 2 THEN f WHEN 3 THEN f ELSE FALSE END AS verified
 FROM (SELECT pos, length(b) >= 120 AND (s = '' OR ({fold('b')} <> {fold('s')} AND length(b) >= length(s) + 40)) AS f FROM (SELECT pos, {c('body')} AS b, {c('summary')} AS s FROM stories))""")
def verified_full(spark, sf):
    m = F.element_at(F.array(*map(F.lit, ("Content", "sport", " police ", "council", "other"))), (F.col("pos") % 5 + 1).cast("int"))
    v = filters.verified_full(m, "body", "summary", detail_complete=F.col("pos") % 2 == 0, content_status=F.when(F.col("pos") % 3 == 0, "Complete").otherwise("feed"), verified=F.lit(None).cast("boolean"), completeness=F.lit(""))
    return stories(spark, sf).select("pos", v.alias("verified"))


@query("f14_needs_enrichment", f"""SELECT pos, CASE WHEN pos % 4 = 0 THEN FALSE WHEN pos % 5 = 0 THEN TRUE WHEN pos % 4 = 1 THEN FALSE WHEN b = '' THEN TRUE WHEN s <> '' AND {fold('b')} = {fold('s')} THEN TRUE ELSE length(b) < 350 END AS needed
 FROM (SELECT pos, {c('body')} AS b, {c('summary')} AS s FROM stories)""")
def needs_enrichment(spark, sf):
    status = F.when(F.col("pos") % 4 == 0, "loading").when(F.col("pos") % 4 == 1, "complete").otherwise("feed")
    return stories(spark, sf).select("pos", filters.needs_enrichment(F.col("url"), status, F.col("body"), F.col("summary"), F.col("pos") % 5 != 0).alias("needed"))


@query("f16_validation", f"""SELECT pos, array_to_string(list_filter([CASE WHEN t = '' THEN 'Missing title.' WHEN length(t) < 8 THEN 'Title is too short.' END, CASE WHEN b = '' THEN 'Missing body.' WHEN length(b) < 50 THEN 'Body is too short.' END], lambda x: x IS NOT NULL), '|') AS errors
 FROM (SELECT pos, {c('title')} AS t, {c('body')} AS b FROM stories)""")
def validation(spark, sf):
    return stories(spark, sf).select("pos", F.array_join(filters.validation_errors("title", "body"), "|").alias("errors"))


_TITLES = "SELECT pos, CASE pos % 5 WHEN 0 THEN '– Latest News: ' WHEN 1 THEN ' Privacy Policy...' ELSE title END AS title FROM stories"


@query("f17_title_gate", f"""SELECT pos FROM (SELECT pos, {c('title')} AS t FROM ({_TITLES})) WHERE length(t) >= 8 AND len(string_split(t, ' ')) >= 2 AND trim({fold('t')}, ' .:-–—') NOT IN ({", ".join(f"'{x}'" for x in EXCLUDED_TITLES)}) AND NOT regexp_matches(t, '(?i)^the')""")
def title_gate(spark, sf):
    title = F.when(F.col("pos") % 5 == 0, "– Latest News: ").when(F.col("pos") % 5 == 1, " Privacy Policy...").otherwise(F.col("title"))
    return stories(spark, sf).where(filters.title_passes(title, excluded="^the")).select("pos")


@query("f20_candidate_scores", rf"""SELECT page_id, CASE WHEN {" OR ".join(f"contains(lower(u), '{x}')" for x in ARTICLE_URL_PARTS)} OR len(list_filter(regexp_extract_all(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '(?:^|/)(20[0-9]{{2}})(?:/|$)', 1), lambda y: CAST(y AS INTEGER) <= 2025)) > 0 THEN 40 ELSE 0 END
 + {" + ".join(f"CASE WHEN regexp_matches(lower(u), '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN {n} ELSE 0 END" for w, n in URL_PENALTIES)}
 + CASE WHEN length(t) BETWEEN 20 AND 120 THEN 25 ELSE 0 END + CASE WHEN contains(h, '<time') THEN 30 ELSE 0 END + CASE WHEN contains(h, '<img') THEN 20 ELSE 0 END + CASE WHEN contains(h, 'articleBody') THEN 20 ELSE 0 END
 + CASE WHEN contains(h, 'ld+json') THEN 15 ELSE 0 END + CASE WHEN contains(h, 'og:type') THEN 15 ELSE 0 END + CASE WHEN contains(h, '<p') THEN 10 ELSE 0 END AS score
 FROM (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1) AS t, url || CASE page_id % 6 WHEN 0 THEN '/2023/08/policy' WHEN 1 THEN '/Shop/login-now' WHEN 2 THEN '/1999/2031/' WHEN 3 THEN '/2031/2024/' WHEN 4 THEN '/Match-Report/7' ELSE '' END AS u FROM pages)""")
def candidate_scores(spark, sf):
    i, h = F.col("page_id") % 6, F.coalesce("html", F.lit(""))
    tail = F.when(i == 0, "/2023/08/policy").when(i == 1, "/Shop/login-now").when(i == 2, "/1999/2031/").when(i == 3, "/2031/2024/").when(i == 4, "/Match-Report/7").otherwise("")
    there = lambda mark: F.contains(h, F.lit(mark))
    s = filters.candidate_score(F.concat("url", tail), F.regexp_extract(h, "<title>([^<]*)", 1), now(), has_date=there("<time"), has_image=there("<img"), has_schema=there("articleBody"), has_json_ld=there("ld+json"), has_open_graph=there("og:type"), has_paragraph=there("<p"))
    return table(spark, sf, "pages").select("page_id", s.alias("score"))


@query("f11_media_decisions", f"""SELECT pos, CASE WHEN published < TIMESTAMP '{NOW}' - INTERVAL '72 hours' OR published > TIMESTAMP '{NOW}' THEN 'outside_date_limit' WHEN pos % 7 = 0 THEN 'not_published'
 WHEN pos % 5 = 0 THEN 'embargoed' WHEN pos % 3 = 0 THEN 'not_video' WHEN {_ANY_PLACE('body', FIXTURE_PLACES)} THEN 'eligible' ELSE 'location_needs_review' END AS decision FROM stories""")
def media_decisions(spark, sf):
    p = F.col("pos")
    d = filters.media_decision(F.col("published"), F.when(p % 7 == 0, "held").otherwise("usable"), F.when(p % 5 == 0, now() + F.expr("INTERVAL 1 DAY")), F.when(p % 3 == 0, "audio").otherwise("video"), F.col("body"), now(), places=FIXTURE_PLACES)
    return stories(spark, sf).select("pos", d.alias("decision"))


@query("f21_story_search", f"""SELECT pos FROM stories WHERE contains({fold('title')} || ' ' || {fold('body')}, 'heit') AND lang = 'de' AND published >= TIMESTAMP '{NOW}' - INTERVAL '30 days'""")
def story_search(spark, sf):
    found = filters.search(stories(spark, sf), "HEIT", ["title", "body"])
    return found.where((F.col("lang") == "de") & filters.within_period(F.col("published"), now(), "30 days")).select("pos")


# -- classification ------------------------------------------------------------------------

_MULT = {"title": 3, "summary": 2, "body": 1}
_WEIGHTS = ", ".join(f"('{cat}', {p}, '{w}', {n})" for cat, p, ws in FIXTURE_LEXICON for w, n in ws.items())
_KEYWORDS = sorted({w for _, _, ws in FIXTURE_LEXICON for w in ws})
_MULT_SQL = " UNION ALL ".join(f"SELECT pos, '{w}' AS keyword, {' + '.join(f'CASE WHEN {_has(sec, [w])} THEN {n} ELSE 0 END' for sec, n in _MULT.items())} AS times FROM t" for w in _KEYWORDS)
_CLASS_SQL = f"""lx(category, priority, keyword, weight) AS (VALUES {_WEIGHTS}),
t AS MATERIALIZED (SELECT pos, {_classifier('title')} AS title, {_classifier('summary')} AS summary, {_classifier('body')} AS body, {_classifier("concat_ws(' ', title, summary, body)")} AS whole FROM stories),
m AS ({_MULT_SQL}),
h AS MATERIALIZED (SELECT pos, category, priority, keyword, weight * times AS points FROM m JOIN lx USING (keyword)),
sc AS (SELECT pos, category, priority, sum(points)::INT AS score FROM h GROUP BY ALL HAVING sum(points) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, priority DESC, category DESC) AS n FROM sc),
top AS (SELECT a.pos, a.category, a.priority, a.score, coalesce(b.score, 0) AS second FROM rk AS a LEFT JOIN rk AS b ON b.pos = a.pos AND b.n = 2 WHERE a.n = 1),
oth AS (SELECT rk.pos, string_agg(rk.category, ',' ORDER BY rk.n) AS secondary FROM rk JOIN top USING (pos) WHERE rk.n > 1 AND rk.score >= greatest(5, round_even(top.score * 0.5, 0)) AND rk.n <= 4 GROUP BY rk.pos),
cl AS MATERIALIZED (SELECT t.pos, coalesce(top.score >= 5, FALSE) AS won, coalesce(CASE WHEN top.score >= 5 THEN top.category END, 'Other') AS "primary",
 CASE WHEN top.score >= 5 THEN top.score ELSE 0 END AS score, coalesce(CASE WHEN top.score >= 5 THEN secondary END, '') AS secondary,
 CASE WHEN top.score >= 5 THEN round_even(least(1.0::DOUBLE, top.score / 40.0::DOUBLE) * 0.65::DOUBLE + (top.score - second) / top.score::DOUBLE * 0.35::DOUBLE, 2) ELSE 0 END AS confidence,
 CASE WHEN top.score >= 5 THEN least(100, top.priority + CASE WHEN top.score >= 40 THEN 5 ELSE 0 END + CASE WHEN top.score >= 70 THEN 5 ELSE 0 END) ELSE 25 END AS priority,
 {_has('whole', FIXTURE_BREAKING)} AS breaking FROM t LEFT JOIN top USING (pos) LEFT JOIN oth USING (pos))"""


def _classified(spark, sf) -> DataFrame:
    return classify.classified(stories(spark, sf), FIXTURE_LEXICON, FIXTURE_BREAKING)


@query("c3_classification", f""", {_CLASS_SQL} SELECT pos, "primary", secondary, score, confidence, priority, breaking FROM cl""")
def classification(spark, sf):
    return _classified(spark, sf).select("pos", "primary", F.array_join("secondary", ",").alias("secondary"), "score", "confidence", "priority", "breaking")


@query("a9_matched_keywords", f""", {_CLASS_SQL}, mk AS (SELECT pos, keyword, max(points)::INT AS points FROM h WHERE points > 0 GROUP BY ALL)
SELECT pos, string_agg(keyword || '=' || points, ',' ORDER BY keyword) AS matched FROM mk GROUP BY pos""")
def matched_keywords(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("matched")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return classify.scored(stories(spark, sf), FIXTURE_LEXICON).select("pos", F.array_join(pairs, ",").alias("matched")).where("matched <> ''")


@query("c9_decisions", f""", {_CLASS_SQL} SELECT pos, priority >= 90 AS publish_immediately, priority >= 50 AS homepage, priority >= 60 AS facebook, priority >= 20 AS newsletter, breaking OR "primary" IN ('Alpha') AND FALSE AS breaking_banner,
 confidence < 0.5 AS editor_review, CASE WHEN priority >= 90 THEN 1 WHEN priority >= 75 THEN 2 WHEN priority >= 60 THEN 3 WHEN priority >= 50 THEN 4 ELSE 5 END AS homepage_rank FROM cl""")
def decisions(spark, sf):
    return classify.decided(_classified(spark, sf)).select("pos", "publish_immediately", "homepage", "facebook", "newsletter", "breaking_banner", "editor_review", "homepage_rank")


@query("c1_default_lexicon", f"""SELECT pos, 'Other' AS "primary", 25 AS priority FROM stories WHERE NOT {_has(_classifier("concat_ws(' ', title, summary, body)"), [w for _, _, ws in default.LEXICON for w in ws])}""")
def default_lexicon(spark, sf):
    return classify.classified(stories(spark, sf)).where(F.size("scores") == 0).select("pos", "primary", "priority")


@query("c10_first_rule", f"""SELECT pos, CASE WHEN {_has(_classifier("title || ' ' || summary"), ['la', 'que'])} THEN 'Romance' WHEN {_has(_classifier("title || ' ' || summary"), ['the', 'und'])} THEN 'Germanic'
 WHEN {_has(_classifier('body'), ['la', 'que'])} THEN 'Romance' WHEN {_has(_classifier('body'), ['the', 'und'])} THEN 'Germanic' ELSE 'Other' END AS category FROM stories""")
def first_rule(spark, sf):
    rules = (("Romance", ("la", "que")), ("Germanic", ("the", "und")))
    return stories(spark, sf).select("pos", classify.first_rule(rules, F.concat_ws(" ", "title", "summary"), "body").alias("category"))


@query("c11_locality", f"""SELECT pos, CASE WHEN {_has(_classifier("concat_ws(' ', source, title)"), ['thea', 'los'])} THEN 'inner' WHEN {_has(_classifier("concat_ws(' ', source, title)"), ['the', 'la'])} THEN 'outer' WHEN source <> '' THEN 'outside_outer' ELSE 'unknown' END AS locality FROM stories""")
def locality(spark, sf):
    return stories(spark, sf).select("pos", classify.locality("title", "source", ("thea", "los"), ("the", "la"), ("inner", "outer")).alias("locality"))


@query("flagship_front_page", f""", {_CLASS_SQL}, fp AS MATERIALIZED (SELECT pos, sha256({c(rf"regexp_replace({fold("title || ' ' || body")}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]', '', 'g')")}) AS f FROM stories),
 kept AS (SELECT min(pos) AS pos FROM fp GROUP BY f)
SELECT "primary", CASE WHEN priority >= 90 THEN 1 WHEN priority >= 75 THEN 2 WHEN priority >= 60 THEN 3 WHEN priority >= 50 THEN 4 ELSE 5 END AS homepage_rank, count(*) AS stories, count(*) FILTER (breaking) AS breaking, sum(score)::BIGINT AS score
FROM cl JOIN kept USING (pos) GROUP BY ALL""")
def front_page(spark, sf):
    """Stories without repeats, classified and decided, counted by category and rank."""
    s = dedup.first_wins(stories(spark, sf), text.fingerprint("title", "body"))
    d = classify.decided(classify.classified(s, FIXTURE_LEXICON, FIXTURE_BREAKING))
    return d.groupBy("primary", "homepage_rank").agg(F.count("*").alias("stories"), F.count_if("breaking").alias("breaking"), F.sum("score").alias("score"))


# -- de-duplication ------------------------------------------------------------------------


@query("d1_first_wins", f"SELECT min(pos) AS pos FROM stories GROUP BY {ascii_('title', ' ')} HAVING {ascii_('title', ' ')} <> '' UNION ALL SELECT pos FROM stories WHERE {ascii_('title', ' ')} = ''".replace(f"GROUP BY {ascii_('title', ' ')} HAVING {ascii_('title', ' ')} <> ''", f"WHERE {ascii_('title', ' ')} <> '' GROUP BY {ascii_('title', ' ')}"))
def first_by_title(spark, sf):
    return dedup.first_wins(stories(spark, sf), text.ascii_key("title")).select("pos")


@query("d2_feed_first_wins", "SELECT min(pos) AS pos FROM stories GROUP BY rtrim(split_part(split_part(lower(trim(url)), '#', 1), '?', 1), '/')")
def feed_first_wins(spark, sf):
    return dedup.first_wins(stories(spark, sf), urls.bare("url"), drop_empty=True).select("pos")


_FOLD_SQL = f""", k AS (SELECT pos, ['u' || (pos % 700) || source, 't' || {ascii_('title', ' ')}, 'd' || CAST(floor(pos / 5) AS BIGINT) || lang] AS keys, row_number() OVER (ORDER BY pos) AS n FROM stories),
r AS (SELECT n, pos, TRUE AS kept, keys AS claimed FROM k WHERE n = 1
 UNION ALL SELECT k.n, k.pos, NOT list_has_any(r.claimed, k.keys), CASE WHEN list_has_any(r.claimed, k.keys) THEN r.claimed ELSE list_concat(r.claimed, k.keys) END FROM r JOIN k ON k.n = r.n + 1)
SELECT pos FROM r WHERE kept"""


@query("d3_multi_key_greedy", "SELECT 1".replace("SELECT 1", _FOLD_SQL))
def multi_key_greedy(spark, sf):
    keys = F.array(F.concat(F.lit("u"), (F.col("pos") % 700).cast("string"), "source"), F.concat(F.lit("t"), text.ascii_key("title")), F.concat(F.lit("d"), F.floor(F.col("pos") / 5).cast("string"), "lang"))
    return dedup.multi_key_greedy(stories(spark, sf), keys).select("pos")


@query("d5_near_duplicate_titles")
def near_duplicate_titles(spark, sf):
    """Titles like one kept before; there is no SQL for the measure."""
    return dedup.near_duplicates(stories(spark, sf), "title").select("pos", "duplicate_of", F.round("ratio", 6).alias("ratio"))


@query("d6_richest_by_title", f""", u AS (SELECT *, {ascii_('title', ' ')} AS t, CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS img FROM stories WHERE pos IN (SELECT min(pos) FROM stories GROUP BY source, pos % 700))
SELECT pos, place FROM (SELECT pos, min(pos) OVER (PARTITION BY t) AS place, row_number() OVER (PARTITION BY t ORDER BY img DESC, length(body) DESC, pos) AS n FROM u) WHERE n = 1""")
def richest_by_title(spark, sf):
    s = stories(spark, sf).withColumn("image", F.when(F.col("pos") % 3 == 0, "x"))
    return dedup.richest_by_title(s, "url", "title", "image", "body")[0].select("pos", "place")


@query("d7_distinct_spellings", f"SELECT arg_min(title, pos) AS title FROM stories WHERE trim(title) <> '' GROUP BY {fold('title')}")
def distinct_spellings(spark, sf):
    return dedup.distinct_spellings(stories(spark, sf), "title")


# -- joins, aggregates, order --------------------------------------------------------------


@query("j1_listing_join", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS stored FROM documents d LEFT JOIN labels l USING (doc_id)")
def listing_join(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("stored"))
    return table(spark, sf, "documents").join(lab, "doc_id", "left").select("doc_id", "quality", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("j2_overlay", "SELECT pos, CASE WHEN pos % 2 = 0 THEN CASE WHEN pos % 4 = 0 THEN '' ELSE reverse(title) END ELSE title END AS title, CASE WHEN pos % 2 = 0 AND pos % 6 <> 0 THEN 'd' ELSE lang END AS areas FROM stories")
def overlay(spark, sf):
    s = stories(spark, sf).select("pos", "title", F.array("lang").alias("areas"))
    d = s.where("pos % 2 = 0").select("pos", F.when(F.col("pos") % 4 == 0, "").otherwise(F.reverse("title")).alias("title"), F.when(F.col("pos") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d"))).alias("areas"))
    return joins.overlay(s, d, "pos", ("areas",)).select("pos", "title", F.array_join("areas", ",").alias("areas"))


@query("j3_fill_from_feed", "SELECT pos, CASE WHEN pos % 3 = 0 THEN CASE WHEN pos % 2 = 0 THEN upper(lang) ELSE '' END ELSE source END AS source FROM stories")
def fill_from_feed(spark, sf):
    s = stories(spark, sf).select("pos", F.concat(F.lit("https://www.x.org/n/"), "pos", F.lit("/")).alias("url"), F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("source")).alias("source"), "lang")
    feed = s.where("pos % 2 = 0").select(F.concat(F.lit("https://x.org/n/"), "pos", F.lit("?a=b")).alias("url"), F.upper("lang").alias("source"))
    return joins.fill_from(s, feed, urls.page_key("url"), ["source"]).select("pos", "source")


@query("j4_without_deleted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def without_deleted(spark, sf):
    return joins.without(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id")


@query("j6_find_draft", """, d AS (SELECT pos AS draft_id, CASE WHEN pos % 20 = 0 THEN title ELSE '' END AS identity, CASE WHEN pos % 10 = 0 THEN source || (pos % 50) ELSE 'x' || pos END AS url, CASE WHEN pos % 10 = 0 THEN lang || (pos % 50) ELSE '' END AS other FROM stories),
 i AS (SELECT identity, min(draft_id) AS n FROM d WHERE identity <> '' GROUP BY identity), u AS (SELECT url, min(draft_id) AS n FROM (SELECT draft_id, url FROM d UNION ALL SELECT draft_id, other FROM d) WHERE url <> '' GROUP BY url)
SELECT s.pos, coalesce(i.n, u.n) AS draft_id FROM stories s LEFT JOIN i ON i.identity = s.title LEFT JOIN u ON u.url = s.source || (s.pos % 50)""")
def find_draft(spark, sf):
    s = stories(spark, sf)
    near, tenth = (F.col("pos") % 50).cast("string"), F.col("pos") % 10 == 0
    drafts = s.select(
        F.col("pos").alias("draft_id"),
        F.when(F.col("pos") % 20 == 0, F.col("title")).otherwise("").alias("identity"),
        F.when(tenth, F.concat("source", near)).otherwise(F.concat(F.lit("x"), F.col("pos").cast("string"))).alias("url"),
        F.when(tenth, F.concat("lang", near)).otherwise("").alias("source_url"),
    )
    return joins.find_draft(s.select("pos", F.col("title").alias("identity"), F.concat("source", near).alias("url")), drafts).select("pos", "draft_id")


@query("j8_source_health", f"""SELECT source, CASE WHEN n % 5 = 0 THEN 'failed' WHEN kept > 0 THEN 'yielding' WHEN raw > 0 THEN 'no-current-stories' ELSE 'no-stories' END AS status, CASE WHEN n % 5 = 0 THEN 0 ELSE kept END AS story_count,
 CASE WHEN n % 5 <> 0 THEN raw END AS raw_story_count, CASE WHEN n % 5 = 0 THEN 0 ELSE f END AS full_content_count, CASE WHEN n % 5 = 0 THEN 0 ELSE kept - f END AS incomplete_content_count
 FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n, count(*) AS raw, count(*) FILTER (pos % 2 = 0 AND source <> 'src3') AS kept, count(*) FILTER (pos % 2 = 0 AND source <> 'src3' AND length(body) > 1000) AS f FROM stories GROUP BY source)""")
def source_health(spark, sf):
    s = stories(spark, sf)
    health = s.groupBy("source").agg(F.count("*").alias("story_count")).withColumn("status", F.when(F.substring("source", 4, 9).cast("int") % 5 == 0, "failed").otherwise("ok"))
    return joins.reconciled(health, s.where("pos % 2 = 0 AND source <> 'src3'").select(F.upper("source").alias("source"), (F.char_length("body") > 1000).alias("full")))


@query("j12_reindexed", "SELECT row_number() OVER (ORDER BY pos) - 1 AS story_index, source FROM stories WHERE pos % 3 <> 0")
def reindexed(spark, sf):
    s = stories(spark, sf).withColumnRenamed("pos", "story_index")
    return joins.reindexed(s, s.select("story_index", "source"), F.col("story_index") % 3 != 0)


@query("j14_previous_for_failed", "SELECT pos, source FROM stories WHERE pos % 2 = 0 UNION ALL SELECT pos, source FROM stories WHERE pos % 2 = 1 AND source IN ('src4', 'src7')")
def previous_for_failed(spark, sf):
    s = stories(spark, sf).select("pos", "source")
    health = s.select("source", F.when(F.col("source").isin("src4", "src7"), "failed").otherwise("ok").alias("status"))
    return joins.previous_for_failed(s.where("pos % 2 = 0"), s.where("pos % 2 = 1"), health)


_STORE = """, st AS (SELECT pos, 'a' || (pos % 600) AS article_id, CASE WHEN pos % 41 = 0 THEN '' ELSE title || '.' END AS title, source || pos AS url, CASE WHEN pos % 4 = 0 THEN '' ELSE summary END AS summary, body, CASE WHEN pos % 3 = 0 THEN '[]' ELSE '["' || lang || '","x"]' END AS categories_json,
 CASE WHEN pos % 7 = 0 THEN '[]' ELSE '["' || source || '"]' END AS authorities_json, CASE WHEN pos % 9 = 0 THEN ' ' ELSE source END AS author, lang AS content_type, CAST(pos % 2 AS INT) AS detail_complete, published AS fetched_at FROM stories)"""


def _store(spark, sf) -> DataFrame:
    p = F.col("pos")
    return stories(spark, sf).select(
        "pos", F.concat(F.lit("a"), p % 600).alias("article_id"), F.when(p % 41 == 0, "").otherwise(F.concat("title", F.lit("."))).alias("title"), F.concat("source", "pos").alias("url"), F.when(p % 4 == 0, "").otherwise(F.col("summary")).alias("summary"), "body",
        F.when(p % 3 == 0, "[]").otherwise(F.concat(F.lit('["'), "lang", F.lit('","x"]'))).alias("categories_json"), F.when(p % 7 == 0, "[]").otherwise(F.concat(F.lit('["'), "source", F.lit('"]'))).alias("authorities_json"),
        F.when(p % 9 == 0, " ").otherwise(F.col("source")).alias("author"), F.col("lang").alias("content_type"), (p % 2).cast("int").alias("detail_complete"), F.col("published").alias("fetched_at"),
    )


@query("w1_upsert", f"""{_STORE}, g AS (SELECT * FROM st WHERE title <> ''), o AS (SELECT * FROM st WHERE pos < 500), n AS (SELECT * FROM g WHERE pos >= 300),
b AS (SELECT article_id, arg_max(title, pos) AS title, coalesce(arg_max(summary, pos) FILTER (summary <> ''), '') AS summary, coalesce(arg_max(categories_json, pos) FILTER (categories_json <> '[]'), '[]') AS cats, max(detail_complete) AS dc FROM n GROUP BY article_id)
SELECT article_id, coalesce(b.title, o.title) AS title, coalesce(nullif(b.summary, ''), o.summary, '') AS summary, coalesce(nullif(b.cats, '[]'), o.categories_json, '[]') AS categories_json, greatest(o.detail_complete, b.dc) AS detail_complete FROM o FULL JOIN b USING (article_id)""")
def upserted(spark, sf):
    s = _store(spark, sf)
    old = s.where("pos < 500").drop("pos")
    return store.upsert(old, s.where("pos >= 300")).select("article_id", "title", "summary", "categories_json", "detail_complete")


@query("a1_dimension_counts", f"""{_STORE} SELECT dimension, label, count(*) AS count FROM (
 SELECT 'Author' AS dimension, coalesce(nullif(trim(author), ''), 'Unknown') AS label FROM st UNION ALL SELECT 'Type', coalesce(nullif(trim(content_type), ''), 'Unknown') FROM st
 UNION ALL SELECT 'Area', source FROM stories WHERE pos % 7 <> 0 UNION ALL SELECT 'Category', unnest(CASE WHEN pos % 3 = 0 THEN ['Not downloaded / uncategorised'] ELSE [lang, 'x'] END) FROM stories) GROUP BY ALL""")
def dimension_counts(spark, sf):
    return store.dimension_counts(_store(spark, sf))


@query("a3_store_summary", f"""{_STORE} SELECT (SELECT count(*) FROM st) AS stories, (SELECT epoch_us(max(fetched_at)) FROM st) AS latest_fetch, (SELECT epoch_us(max(CAST(ts AS TIMESTAMP))) FROM events WHERE event_type = (SELECT min(event_type) FROM events)) AS latest_success""")
def store_summary(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("first"))
    runs = e.join(F.broadcast(first), e["event_type"] == first["first"]).select(F.col("ts").cast("timestamp").alias("completed_at"), F.lit("success").alias("status"))
    s = store.summary(_store(spark, sf), runs)
    return s.select("stories", F.unix_micros("latest_fetch").alias("latest_fetch"), F.unix_micros("latest_success").alias("latest_success"))


@query("a4_health_pivot", "SELECT count(*) AS sources, count(*) FILTER (n > 60) AS busy, count(*) FILTER (n <= 60 AND n > 20) AS some, count(*) FILTER (n <= 20) AS few, sum(n)::BIGINT AS stories FROM (SELECT source, count(*) AS n FROM stories GROUP BY source)")
def health_pivot(spark, sf):
    g = stories(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("sources"), F.count_if(F.expr("n > 60")).alias("busy"), F.count_if(F.expr("n <= 60 AND n > 20")).alias("some"), F.count_if(F.expr("n <= 20")).alias("few"), F.sum("n").alias("stories"))


@query("a5_completeness", "SELECT source, count(*) FILTER (length(body) >= 1000) AS complete, count(*) FILTER (length(body) < 1000) AS incomplete, bool_and(length(body) > 5) AS every_, bool_or(length(body) > 9000) AS some_ FROM stories GROUP BY source")
def completeness(spark, sf):
    n = F.char_length("body")
    return stories(spark, sf).groupBy("source").agg(F.count_if(n >= 1000).alias("complete"), F.count_if(n < 1000).alias("incomplete"), F.bool_and(n > 5).alias("every_"), F.bool_or(n > 9000).alias("some_"))


@query("a10_page_order", "SELECT source, epoch_us(min(published)) AS oldest, epoch_us(max(published)) AS newest, coalesce(bool_and(ok), TRUE) AS monotonic FROM (SELECT source, published, published >= lead(published) OVER (PARTITION BY source ORDER BY pos % 97, pos) AS ok FROM stories) GROUP BY source")
def page_order(spark, sf):
    w = Window.partitionBy("source").orderBy(F.col("pos") % 97, "pos")
    s = stories(spark, sf).withColumn("ok", F.col("published") >= F.lead("published").over(w))
    return s.groupBy("source").agg(F.unix_micros(F.min("published")).alias("oldest"), F.unix_micros(F.max("published")).alias("newest"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotonic"))


@query("w_latest_runs", """SELECT module, started_at, found, previous, change, n FROM (SELECT event_type AS module, event_id AS started_at, CAST(user_id AS BIGINT) AS found, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS previous,
 user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS change, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5""")
def latest_runs(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("module"), F.col("event_id").alias("started_at"), F.col("user_id").alias("found"))
    return store.latest_runs(runs).withColumn("n", F.col("n").cast("long"))


@query("o1_newest_first", f"SELECT row_number() OVER (ORDER BY CASE WHEN lang = 'es' THEN NULL ELSE date_trunc('day', published) END DESC NULLS LAST, encode({fold('title')}) DESC, pos) AS rank, pos FROM stories")
def newest_first(spark, sf):
    s = stories(spark, sf).withColumn("day", F.when(F.col("lang") != "es", F.date_trunc("day", "published")))
    s = s.select("pos", "day", text.casefold("title").alias("title"))
    return ordering.ranked(s, F.desc_nulls_last("day"), F.desc("title"), F.asc("pos")).select("rank", "pos")


@query("o7_top_per_source", f"SELECT pos, source FROM (SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY length(body) DESC, pos) AS n FROM stories) WHERE n <= 3")
def top_per_source(spark, sf):
    return ordering.top_per_group(stories(spark, sf), "source", 3, F.char_length("body").desc(), F.asc("pos")).select("pos", "source")


@query("so2_key_changes", """SELECT k AS doc_id, CASE WHEN NOT known THEN 'new' WHEN NOT now THEN 'gone' ELSE 'kept' END AS state
 FROM (SELECT k, bool_or(now) AS now, bool_or(NOT now) AS known FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS k, true AS now FROM documents UNION ALL SELECT doc_id, false FROM labels) GROUP BY k)""")
def key_changes(spark, sf):
    moved = F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    return ordering.key_changes(table(spark, sf, "documents").select(moved.alias("doc_id")), table(spark, sf, "labels"), "doc_id")


# -- retention and state -------------------------------------------------------------------


@query("r1_content_retention", f"SELECT pos, '' AS email FROM stories WHERE (CASE WHEN lang = 'fr' THEN published + INTERVAL '5 days' ELSE published END) >= TIMESTAMP '{NOW}' - INTERVAL '7 days'")
def content_retention(spark, sf):
    s = stories(spark, sf).select("pos", F.when(F.col("lang") != "fr", F.col("published")).alias("created_at"), (F.col("published") + F.expr("INTERVAL 5 DAYS")).alias("fetched_at"))
    return store.content_retention(s, now()).select("pos", "email")


@query("r2_draft_retention", f"SELECT pos FROM stories WHERE lang = 'fr' OR published >= TIMESTAMP '{NOW}' - INTERVAL '7 days'")
def draft_retention(spark, sf):
    when = F.when(F.col("lang") != "fr", F.col("published"))
    return store.retained(stories(spark, sf), when, now(), 7, keep_missing=True).select("pos")


@query("t1_first_seen", """, e AS (SELECT DISTINCT event_type AS module, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS key FROM events),
f AS (SELECT module, key, min(day) AS day FROM e GROUP BY ALL), base AS (SELECT module, min(day) AS day FROM e GROUP BY module)
SELECT f.module, f.day, count(*) AS found, CASE WHEN f.day = base.day THEN 0 ELSE count(*) END AS new FROM f JOIN base USING (module) GROUP BY f.module, f.day, base.day""")
def first_seen(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("module"), F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("key"))
    return state.first_seen(e)


@query("t1_bounded_memory", """, e AS (SELECT event_type AS module, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS refresh, CAST(user_id AS VARCHAR) AS key, min(event_id) AS came FROM events GROUP BY ALL),
k1 AS (SELECT module, key, -row_number() OVER (PARTITION BY module ORDER BY came DESC) AS place FROM e WHERE refresh = 1 QUALIFY place >= -12),
n2 AS (SELECT module, key FROM e WHERE refresh = 2 EXCEPT SELECT module, key FROM k1),
k2 AS (SELECT module, key, -row_number() OVER (PARTITION BY module ORDER BY late DESC, p DESC, encode(key) DESC) AS place FROM (SELECT module, key, 0 AS late, place AS p FROM k1 UNION ALL SELECT module, key, 1, 0 FROM n2) QUALIFY place >= -12),
n3 AS (SELECT module, key FROM e WHERE refresh = 3 EXCEPT SELECT module, key FROM k2), began AS (SELECT module, min(refresh) AS first FROM e GROUP BY module)
SELECT module, refresh, count(*) AS found, count(*) FILTER (refresh > first AND ((refresh = 2 AND (module, key) IN (SELECT (module, key) FROM n2)) OR (refresh = 3 AND (module, key) IN (SELECT (module, key) FROM n3)))) AS new
 FROM e JOIN began USING (module) GROUP BY module, refresh""")
def bounded_memory(spark, sf):
    """Three refreshes over all events, with a memory of twelve keys a module, so that some fall out."""
    at = F.col("ts").cast("timestamp")
    refresh = F.when(at < F.lit("2024-01-11").cast("timestamp"), 1).when(at < F.lit("2024-01-21").cast("timestamp"), 2).otherwise(3)
    e = table(spark, sf, "events").select(F.col("event_type").alias("module"), refresh.alias("refresh"), F.col("user_id").cast("string").alias("key"), "event_id")
    known = spark.createDataFrame([], "module string, key string, place long")
    parts = []
    for i in (1, 2, 3):
        found, known = state.remembered(known, e.where(F.col("refresh") == i), most=12, pos="event_id")
        parts.append(found.groupBy("module").agg(F.count("*").alias("found"), F.count_if("new").alias("new")).withColumn("refresh", F.lit(i)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t2_updates_by_day", "SELECT event_type AS module, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS updates FROM events GROUP BY ALL")
def updates_by_day(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("module"), F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("updates"))


@query("t4_incremental_window", """SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) > greatest(TIMESTAMP '2024-01-20' - INTERVAL '72 hours', TIMESTAMP '2024-01-19' - INTERVAL '10 minutes') AND CAST(ts AS TIMESTAMP) <= TIMESTAMP '2024-01-20' AND event_id % 5 <> 0""")
def incremental_window(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ledger = e.where("event_id % 5 = 0").select("event_id")
    return state.incremental(e, "ts", "event_id", ledger, F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-19").cast("timestamp")).select("event_id")


@query("t5_staging", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'suppressed' WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'created' END AS action FROM documents LEFT JOIN labels USING (doc_id)")
def staging(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    deleted = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    return state.staged(d, d.where("doc_id % 2 = 0"), deleted, "doc_id", update_existing=True)
