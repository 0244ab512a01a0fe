"""Queries of the desk: summaries, captions, filters, orders and states, each with SQL from its rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..data.rules import BLOCKED_SUMMARIES, EXCLUDED_URL_ENDINGS, EXCLUDED_URL_PARTS
from ..functions import dates
from ..functions.text import casefold
from ..operators import desk, filters
from .registry import NOW, now, query, stories, table
from .social_queries import _clean as _social
from .text_queries import c, fold

#: Bodies with blank lines between their paragraphs, some blocked, some doubled, some of one short line.
_BODY = """(SELECT pos, title, source, lang, published, CASE WHEN pos % 9 = 0 THEN 'Image credit: x' WHEN pos % 4 = 0 THEN '' ELSE summary END AS summary, CASE WHEN pos % 5 = 0 THEN 'Share this page now.' || chr(10) || chr(10) ELSE '' END || summary || chr(10) || ' ' || chr(10) || body || chr(10) || chr(10) || summary AS body FROM stories)"""


def _bodies(spark, sf):
    p = F.col("pos")
    body = F.concat(F.when(p % 5 == 0, "Share this page now.\n\n").otherwise(""), "summary", F.lit("\n \n"), "body", F.lit("\n\n"), "summary")
    summary = F.when(p % 9 == 0, "Image credit: x").when(p % 4 == 0, "").otherwise(F.col("summary"))
    return stories(spark, sf).select("pos", "title", "source", "lang", "published", summary.alias("summary"), body.alias("body"))


def _meaningful(s: str) -> str:
    blocked = " OR ".join("starts_with(trim({}, ' :.-'), '{}')".format(fold(s), v.replace("'", "''")) for v in BLOCKED_SUMMARIES)
    return f"""CASE WHEN {blocked} OR (len(string_split({s}, ' ')) <= 8 AND NOT regexp_matches({s}, '[.!?]$')) OR (regexp_matches({s}, '^["“‘'']') AND regexp_matches({s}, '["”’'']$')) THEN '' ELSE {s} END"""


_SPLIT = r"list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda x: {}), lambda x: x <> '')"


@query("n14_n40_summaries", rf"""SELECT pos, CASE WHEN own <> '' THEN own WHEN other <> '' THEN other WHEN len(w) <= 70 THEN array_to_string(w, ' ') WHEN whole <> '' AND len(string_split(whole, ' ')) >= 30 THEN whole
 ELSE regexp_replace(cut, '[ ,;:-]+$', '') || CASE WHEN regexp_matches(cut, '[.!?]$') THEN '' ELSE '…' END END AS summary FROM (SELECT *, trim(regexp_extract(cut || ' ', '(?s)^(.*[.!?])\s', 1)) AS whole FROM (
 SELECT pos, own, other, w, array_to_string(w[1:70], ' ') AS cut FROM (SELECT pos, own, other, list_filter(string_split(array_to_string(list_filter(l, lambda x, i: i = 1 OR list_sum(list_transform(l[1:i - 1], lambda y: len(string_split(y, ' ')))) < 30), ' '), ' '), lambda x: x <> '') AS w
 FROM (SELECT pos, own, other, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {fold('y')}), {fold('x')}) = i) AS l FROM (
 SELECT pos, {_meaningful(c('summary'))} AS own, CASE WHEN pos % 8 = 0 THEN {_meaningful(c('title'))} ELSE '' END AS other, {_SPLIT.format(_meaningful(c('x')))} AS l FROM {_BODY})))))""")
def ensured_summaries(spark, sf):
    other = F.when(F.col("pos") % 8 == 0, F.col("title")).otherwise("")
    return _bodies(spark, sf).select("pos", desk.ensured_summary("summary", [other], "body").alias("summary"))


#: What the paragraphs of an answer begin with: furniture, words like it, or nothing.
_LEADS = ["", "Advertisement here are five words\n\n", "BUY  ticket now or never again\n\n", "Shared on a day like this\n\nShare via the old mail service\n\n", "Created by : someone at the desk\n\nSubscribers of ours may read on\n\n", "Second half\n\nPosted in: the news of today\n\n"]
_LEAD = "list_extract([" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in _LEADS) + f"], CAST(pos % {len(_LEADS)} AS INTEGER) + 1)"


@query("n37_generated_summaries", rf"""SELECT pos, array_to_string((CASE WHEN len(a) >= 25 THEN a ELSE list_concat(a, b) END)[1:60], ' ') AS summary FROM (SELECT pos, list_filter(string_split(coalesce(l[1], ''), ' '), lambda x: x <> '') AS a, list_filter(string_split(coalesce(l[2], ''), ' '), lambda x: x <> '') AS b
 FROM (SELECT pos, list_filter({_SPLIT.format(c('x'))}, lambda x: len(string_split(x, ' ')) >= 5 AND NOT regexp_matches(x, '(?i)^(?:(?:first|second) half|match report|report)$')
 AND NOT regexp_matches(x, '(?i)^(?:advertisement|(?:buy|book) tickets?|related (?:articles|stories|news)|(?:sign up|subscribe)|share (?:this|on|via))(?:[^\p{{L}}\p{{N}}_]|$)|^(?:created by|posted in)\s*:')) AS l FROM (SELECT pos, {_LEAD} || body AS body FROM {_BODY})))""")
def generated_summaries(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("pos") % len(_LEADS) + 1).cast("int"))
    return _bodies(spark, sf).select("pos", desk.generated_summary(F.concat(lead, "body")).alias("summary"))


@query("n36_layouts", rf"""SELECT pos, sha256(CASE WHEN length(o) < 500 OR len(s) < 3 THEN o ELSE array_to_string(list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i + 1], ' ')), chr(10) || chr(10)) END) AS body
 FROM (SELECT pos, o, string_split(regexp_replace(o, '([.!?]) ([A-Z0-9‘“])', '\1¦\2', 'g'), '¦') AS s FROM (SELECT pos, {c('body')} AS o FROM stories))""")
def layouts(spark, sf):
    return stories(spark, sf).select("pos", F.sha2(desk.laid_out(F.regexp_replace("body", r"\s*\n\s*", "\n")), 256).alias("body"))


#: Tails of one to nine sharing marks, as many as a story's number tells.
_TAILS = ["", " • Share on X (Opens in new window) X", " | Share via Email  Loading...", " Like this: Loading", " •Share on Facebook Facebook | share on linkedin LinkedIn", "• Share on X x like this: loading... LOADING | Share via Email", " Share on X X"]
_TAIL = f"list_extract([{', '.join(repr(t) for t in _TAILS)}], CAST(pos % {len(_TAILS)} AS INTEGER) + 1)"
_STRIP = "regexp_replace({}, '(?i)(?:\\s*[•|]\\s*Share on X(?:\\s*\\(Opens? in new window\\))?\\s*X|\\s*[•|]\\s*Share on Facebook(?:\\s*\\(Opens? in new window\\))?\\s*Facebook|\\s*[•|]\\s*Share on LinkedIn(?:\\s*\\(Opens? in new window\\))?\\s*LinkedIn|\\s*[•|]\\s*Share via Email|\\s*Like this:|\\s*Loading(?:\\.\\.\\.)?)\\s*$', '')"


@query("x3_inline_boilerplate", f""", t AS (SELECT pos, {c(f"title || repeat({_TAIL}, CAST(pos % 9 AS INTEGER) + 1)")} AS text, 0 AS n FROM stories),
loop AS (SELECT * FROM t UNION ALL SELECT pos, trim({_STRIP.format('text')}), n + 1 FROM loop WHERE trim({_STRIP.format('text')}) <> text)
SELECT pos, arg_max(text, n) AS text FROM loop GROUP BY pos""")
def inline_boilerplate(spark, sf):
    """Tails that stand up to nine times: taken off one by one in SQL, at once here."""
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("pos") % len(_TAILS) + 1).cast("int"))
    return stories(spark, sf).select("pos", desk.without_sharing(F.concat("title", F.repeat(tail, (F.col("pos") % 9 + 1).cast("int")))).alias("text"))


@query("n35_authorities", """SELECT pos, array_to_string(CASE pos % 4 WHEN 0 THEN ['South Kesteven District Council', 'Boston Borough Council'] WHEN 1 THEN ['Lincolnshire County Council', source] WHEN 2 THEN ['City of Lincoln Council'] ELSE [lang] END, '|') AS names FROM stories""")
def authority_lists(spark, sf):
    i = F.col("pos") % 4
    one = F.when(i == 0, "South Kesteven District Council Boston Borough Council").when(i == 1, "Lincolnshire County Council Lincolnshire County Council").when(i == 2, "City of Lincoln Council").otherwise(F.col("lang"))
    other = F.when(i == 0, "Boston Borough Council").when(i == 1, F.concat(F.lit(" "), "source")).when(i == 2, " ").otherwise(F.col("lang"))
    return stories(spark, sf).select("pos", F.array_join(desk.authorities(F.array(one, other)), "|").alias("names"))


_MARKS = "['. credit:', ' credit:', '. permission for', ' permission for']"
_CAPTION = c("CASE pos % 5 WHEN 0 THEN t || '. CREDIT: A. Person' WHEN 1 THEN t || ' credit: x. Permission for y' WHEN 2 THEN t || '. Permission for use Credit: no' WHEN 3 THEN t || '.x' ELSE '  ' END")


@query("n42_image_subjects", rf"""SELECT pos, CASE WHEN cut = '' THEN trim(source) ELSE cut END AS subject FROM (SELECT pos, source, CASE WHEN m IS NULL THEN v ELSE rtrim(trim(substr(v, 1, strpos({fold('v')}, m) - 1)), '.') END AS cut
 FROM (SELECT pos, source, v, list_filter({_MARKS}, lambda m: contains({fold('v')}, m))[1] AS m FROM (SELECT pos, source, {_CAPTION} AS v FROM (SELECT pos, source, regexp_replace({c('title')}, '\.+$', '') AS t FROM stories))))""")
def image_subjects(spark, sf):
    i, t = F.col("pos") % 5, F.regexp_replace(F.trim(F.regexp_replace("title", r"(?U)\s+", " ")), r"\.+$", "")
    caption = F.when(i == 0, F.concat(t, F.lit(". CREDIT: A. Person"))).when(i == 1, F.concat(t, F.lit(" credit: x. Permission for y"))).when(i == 2, F.concat(t, F.lit(". Permission for use Credit: no"))).when(i == 3, F.concat(t, F.lit(".x"))).otherwise("  ")
    return stories(spark, sf).select("pos", desk.image_subject(caption, "source").alias("subject"))


@query("n49_caption_sentences", rf"""SELECT pos, array_to_string(list_concat([title], list_filter(s, lambda x: length(x) BETWEEN 20 AND 150 AND {fold('x')} <> {fold('title')})[1:3], ['Read the full story']), '|') AS lines FROM (SELECT pos, title, string_split(regexp_replace({c('body')}, '([.!?]) ', '\1¦', 'g'), '¦') AS s FROM stories)""")
def caption_lines(spark, sf):
    return stories(spark, sf).select("pos", F.array_join(desk.caption_sentences("title", "body"), "|").alias("lines"))


_POST = """CASE CAST(pos % 5 AS INTEGER) WHEN 0 THEN '<p>' || title || '</p>' || chr(10) || chr(10) || url WHEN 1 THEN title || chr(10) || chr(10) || chr(10) || '<b>' || substr(trim(body), 1, 40) || '</b>'
 WHEN 2 THEN '<p>' || summary || '</p>' || chr(10) || chr(10) || 'Not there at all ¦' WHEN 3 THEN '- ' || title || '&amp;' ELSE body END"""


@query("n28_source_only", f""", cleaned AS (SELECT pos, url, {_social('p')} AS p, {_social('t')} AS t, {_social('a', 'url')} AS a FROM (SELECT pos, url, {_POST} AS p, '<h1>' || title || '</h1>' AS t, '<div>' || body || '&amp;</div>' AS a FROM stories)),
blocks AS (SELECT pos, url, p, t, a, list_filter(list_transform(regexp_split_to_array(p, '\\n{{2,}}'), lambda b: trim(b)), lambda b: b <> '') AS l FROM cleaned),
own AS (SELECT *, CASE WHEN l[len(l)] = url THEN l[1:len(l) - 1] ELSE l END AS o FROM blocks)
SELECT pos, length(p) <= 300 AND len(o) > 0 AND len(list_filter(o, lambda b: NOT (b = t OR contains(a, b)))) = 0 AS own FROM own""")
def source_only(spark, sf):
    i, gap = (F.col("pos") % 5).cast("int"), F.lit("\n\n")
    text = (
        F.when(i == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>"), gap, "url")).when(i == 1, F.concat("title", F.lit("\n\n\n<b>"), F.substring(F.trim("body"), 1, 40), F.lit("</b>")))
        .when(i == 2, F.concat(F.lit("<p>"), "summary", F.lit("</p>"), gap, F.lit("Not there at all ¦"))).when(i == 3, F.concat(F.lit("- "), "title", F.lit("&amp;"))).otherwise(F.col("body"))
    )
    s = stories(spark, sf)
    return desk.source_only(s, text, F.concat(F.lit("<h1>"), "title", F.lit("</h1>")), F.concat(F.lit("<div>"), "body", F.lit("&amp;</div>")), F.col("url")).select("pos", "own")


@query("f15_needs_detail", f"""SELECT pos, pos % 7 = 0 OR trim(body) = '' OR pos % 4 = 0 OR (pos % 3 = 0 AND pos % 2 = 0) OR (len(l) > 1 AND l[1] = l[2]) AS again FROM (SELECT pos, body, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim({fold('x')})), lambda x: x <> '') AS l FROM stories)""")
def needs_detail(spark, sf):
    p = F.col("pos")
    body = F.when(p % 4 == 0, F.concat(F.lit("Lead line\n \nLEAD line\n"), "body")).otherwise(F.col("body"))
    image, credit = F.when(p % 3 == 0, "x.jpg").otherwise(" "), F.when(p % 2 == 0, " LDRS ").otherwise("A. Person")
    return stories(spark, sf).select("pos", desk.needs_detail(p % 7 != 0, body, image, credit).alias("again"))


@query("f22_police_filter", f"""SELECT pos FROM stories WHERE contains({fold("title || ' ' || body || ' ' || source")}, 'the') AND {fold('source')} = (SELECT {fold('max(source)')} FROM stories) AND (lang = 'en' OR pos % 2 = 0)""")
def police_filter(spark, sf):
    s = stories(spark, sf)
    name = s.agg(F.upper(F.max("source")).alias("m")).scalar()
    s = s.withColumn("categories", F.array("lang", F.when(F.col("pos") % 2 == 0, " En ").otherwise("x")))
    return desk.desk_filter(s, search=" THE ", searched=["title", "body", "source"], folded={"source": name}, member={"categories": "EN"}).select("pos")


@query("f23_sport_filter", f"SELECT pos FROM stories WHERE contains({fold('body')}, 'an') AND {fold('lang')} = 'en' AND contains({fold('source')}, 'rc1') AND lower(trim(CASE WHEN pos % 2 = 0 THEN ' Club ONE ' ELSE 'two' END)) = 'club one'")
def sport_filter(spark, sf):
    s = stories(spark, sf).withColumn("organisation", F.when(F.col("pos") % 2 == 0, " Club ONE ").otherwise("two"))
    return desk.desk_filter(s, search="An", searched=["body"], folded={"lang": "EN", "organisation": "club one"}, within={"source": "RC1"}).select("pos")


@query("f24_council_filter", f"SELECT pos FROM stories WHERE lang = 'en' AND source = (SELECT min(source) FROM stories) AND contains({fold('title')}, 'a')")
def council_filter(spark, sf):
    s = stories(spark, sf)
    return desk.desk_filter(s, search="A", searched=["title"], equal={"lang": "en", "source": s.agg(F.min("source").alias("m")).scalar()}).select("pos")


@query("f25_unsafe_urls", """SELECT pos, CASE pos % 12 WHEN 0 THEN '' WHEN 1 THEN 'A valid HTTP or HTTPS URL is required.' WHEN 2 THEN 'URLs containing embedded credentials are prohibited.' WHEN 3 THEN 'Localhost URLs are prohibited.' WHEN 4 THEN 'Localhost URLs are prohibited.'
 WHEN 5 THEN 'The URL contains a malformed port.' WHEN 6 THEN 'The URL contains a malformed port.' WHEN 7 THEN CASE WHEN pos % 256 <= 255 THEN 'Private, loopback and non-public network URLs are prohibited.' END WHEN 8 THEN 'Private, loopback and non-public network URLs are prohibited.'
 WHEN 9 THEN '' WHEN 10 THEN 'URLs containing embedded credentials are prohibited.|Private, loopback and non-public network URLs are prohibited.' ELSE 'A valid HTTP or HTTPS URL is required.' END AS errors FROM stories""")
def unsafe_urls(spark, sf):
    p = F.col("pos").cast("string")
    octet = (F.col("pos") % 256).cast("string")
    url = F.element_at(
        F.array(
            F.concat(F.lit("HTTPS://news.example.com:443/"), p), F.concat(F.lit("ftp://example.com/"), p), F.concat(F.lit("https://me:pw@example.com/"), p), F.concat(F.lit("http://LocalHost:80/"), p), F.concat(F.lit("http://a.localhost/"), p),
            F.concat(F.lit("http://example.com:99999/"), p), F.concat(F.lit("http://example.com:8a/"), p), F.concat(F.lit("http://192.168.1."), octet, F.lit("/")), F.concat(F.lit("http://172.20."), octet, F.lit(".1:8080/")),
            F.concat(F.lit("http://8.8."), octet, F.lit(".8/")), F.concat(F.lit("http://me@127.0.0."), octet, F.lit("/")), F.concat(F.lit("nothing at all "), p),
        ),
        (F.col("pos") % 12 + 1).cast("int"),
    )
    return stories(spark, sf).select("pos", F.array_join(desk.url_errors(url), "|").alias("errors"))


@query("f27_retained_stories", f"""SELECT pos FROM stories WHERE (source = (SELECT min(source) FROM stories) OR pos % 10 = 1) AND pos % 5 <> 0 AND pos % 7 <> 0 AND pos % 3 <> 0 AND length(trim(body)) >= 160 AND NOT ends_with(trim({fold('title')}), ' archives')""")
def retained_stories(spark, sf):
    p, s = F.col("pos"), stories(spark, sf)
    name = s.agg(F.min("source").alias("m")).scalar()
    s = s.withColumns({"source_key": F.when(p % 10 == 1, name).otherwise(""), "completeness": F.when(p % 5 == 0, "summary_only"), "from_index": F.when(p % 7 == 0, True), "title": F.when(p % 3 == 0, F.concat("title", F.lit(" ARCHIVES "))).otherwise(F.col("title"))})
    return desk.retained_stories(s, name).select("pos")


@query("j7_workflow", """, s AS (SELECT pos, CASE WHEN pos % 6 = 5 THEN NULL ELSE ' https://X.org/' || pos % 300 || CASE WHEN pos % 2 = 0 THEN '//' ELSE '' END END AS url FROM stories),
d AS (SELECT pos, CASE WHEN pos % 4 < 2 THEN 'https://x.ORG/' || pos * 7 % 310 || ' ' WHEN pos % 4 = 2 THEN NULL ELSE '/' END AS a, CASE WHEN pos % 5 < 3 THEN 'HTTPS://x.org/' || pos * 3 % 290 || '/' ELSE '' END AS b,
 trim(CASE WHEN pos % 4 = 0 THEN ' id ' ELSE ' ' END) <> '' OR lower(trim(CASE WHEN pos % 3 = 0 THEN ' Sent to Metricool as DRAFT ' ELSE 'draft' END)) = 'sent to metricool as draft' AS sent FROM stories),
k AS (SELECT pos, sent, lower(rtrim(trim(u), '/')) AS u FROM (SELECT pos, sent, unnest([a, b]) AS u FROM d)), first AS (SELECT u, arg_min(sent, pos) AS sent FROM k WHERE u <> '' GROUP BY u)
SELECT s.pos, CASE WHEN first.sent THEN 'SENT TO METRICOOL' WHEN NOT first.sent THEN 'SENT TO SOCIAL DESK' ELSE '' END AS stage FROM s LEFT JOIN first ON first.u = lower(rtrim(trim(s.url), '/'))""")
def workflow(spark, sf):
    """Addresses that several stories and several drafts share, public and internal ones."""
    p = F.col("pos")
    t = lambda c: c.cast("string")
    s = stories(spark, sf).select("pos", F.when(p % 6 != 5, F.concat(F.lit(" https://X.org/"), t(p % 300), F.when(p % 2 == 0, "//").otherwise(""))).alias("url"))
    drafts = stories(spark, sf).select(
        "pos", F.when(p % 4 < 2, F.concat(F.lit("https://x.ORG/"), t(p * 7 % 310), F.lit(" "))).when(p % 4 == 3, "/").alias("source_url"), F.when(p % 5 < 3, F.concat(F.lit("HTTPS://x.org/"), t(p * 3 % 290), F.lit("/"))).otherwise("").alias("internal_source_url"),
        F.when(p % 3 == 0, " Sent to Metricool as DRAFT ").otherwise("draft").alias("status"), F.when(p % 4 == 0, " id ").otherwise(" ").alias("delivery_id"),
    )
    return desk.workflow_status(s, drafts).select("pos", "stage")


@query("j15_source_clashes", """SELECT page_id, EXISTS (SELECT 1 FROM s AS o WHERE o.n = s.n AND o.n <> '' AND o.page_id <> s.page_id) AS same_name, EXISTS (SELECT 1 FROM s AS o WHERE o.u = s.u AND o.u <> '' AND o.page_id <> s.page_id) AS same_url
 FROM (SELECT page_id, lower(trim(regexp_extract(html, '<title>([^<]*)', 1))) AS n, regexp_extract(url, '://([^/?#]*)', 1) AS u FROM pages) AS s""".replace("FROM s AS o", "FROM (SELECT page_id, lower(trim(regexp_extract(html, '<title>([^<]*)', 1))) AS n, regexp_extract(url, '://([^/?#]*)', 1) AS u FROM pages) AS o"))
def source_clashes(spark, sf):
    s = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.upper(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("name"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("listing_key"))
    return desk.clashes(s).select(F.col("source_id").alias("page_id"), "same_name", "same_url")


@query("m6_source_extras", """SELECT pos, CASE WHEN pos % 3 = 0 THEN 'Given' ELSE source END AS source, CASE WHEN pos % 2 = 0 THEN lang ELSE 'police' END AS category, CASE WHEN pos % 5 = 0 THEN 'own' ELSE 'police' END AS profile, CASE WHEN pos % 7 = 0 THEN 'own zone' WHEN pos % 3 = 0 THEN 'north' END AS zone FROM stories""")
def source_extras(spark, sf):
    p = F.col("pos")
    own = F.map_filter(F.create_map(F.lit("module_profile"), F.when(p % 5 == 0, "own"), F.lit("zone"), F.when(p % 7 == 0, "own zone")), lambda k, v: v.isNotNull())
    s = stories(spark, sf).withColumns({"source_name": F.when(p % 3 == 0, " Given "), "source_category": F.lit(None).cast("string"), "source_meta": F.when(p % 3 == 0, F.create_map(F.lit("zone"), F.lit("north"))), "extras": own})
    s = s.withColumns({"source": F.when(p % 3 == 0, " ").otherwise(F.col("source")), "category": F.when(p % 2 == 0, F.col("lang")).otherwise("")})
    return desk.with_source(s, "police").select("pos", "source", "category", F.col("extras")["module_profile"].alias("profile"), F.try_element_at("extras", F.lit("zone")).alias("zone"))


_MARKS = "list_extract(['', chr(10), chr(9) || 'x', chr(13) || chr(1), '\\ \"', chr(8) || chr(12) || chr(31), 'é ' || chr(127)], CAST(pos % 7 AS INTEGER) + 1)"
_JSON = "title || " + _MARKS
for _old, _new in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), *((f"chr({i})", {8: "'\\b'", 9: "'\\t'", 10: "'\\n'", 12: "'\\f'", 13: "'\\r'"}.get(i, f"'\\u{i:04x}'")) for i in range(1, 32))):
    _JSON = f"replace({_JSON}, {_old}, {_new})"


@query("m7_definition_fingerprints", f"""SELECT pos, sha256('{{"id": "' || pos || '", "name": "' || {_JSON} || '", "zone": "' || source || '"}}') AS print FROM stories""")
def definition_fingerprints(spark, sf):
    """Names with every kind of character that JSON escapes."""
    mark = F.element_at(F.array(*map(F.lit, ["", "\n", "\tx", "\r\x01", '\\ "', "\b\f\x1f", "é \x7f"])), (F.col("pos") % 7 + 1).cast("int"))
    definition = F.create_map(F.lit("zone"), F.col("source"), F.lit("name"), F.concat("title", mark), F.lit("id"), F.col("pos").cast("string"))
    return stories(spark, sf).select("pos", desk.definition_fingerprint(definition).alias("print"))


@query("a12_retention_counts", f"""SELECT count(*) FILTER (pos % 3 = 0 OR pos % 5 = 0) AS emails_removed, count(*) FILTER (CASE WHEN pos % 4 = 0 THEN NULL ELSE published END < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS metadata_removed FROM stories""")
def retention_counts(spark, sf):
    p = F.col("pos")
    s = stories(spark, sf).select(F.when(p % 3 == 0, "a@b").otherwise("").alias("author_email"), F.when(p % 5 == 0, "c@d").alias("reviewer_email"), F.when(p % 4 != 0, F.col("published")).alias("created_at"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return desk.retention_counts(s, now())


@query("a6_image_counts", "SELECT count(*) FILTER (pos % 3 > 0 AND pos % 2 > 0) AS images, count(*) FILTER (pos % 3 > 0 AND pos % 2 = 0) AS fallback_images FROM stories")
def image_counts(spark, sf):
    p = F.col("pos")
    return desk.image_counts(stories(spark, sf).select(F.when(p % 3 > 0, "x.jpg").otherwise(" ").alias("image"), F.when(p % 2 == 0, True).alias("fallback")))


@query("a2_dimension_order", f"SELECT source, n, row_number() OVER (ORDER BY n DESC, {fold('source')}, source) AS place FROM (SELECT source, count(*) AS n FROM stories GROUP BY source)")
def dimension_order(spark, sf):
    counts = stories(spark, sf).groupBy("source").agg(F.count("*").alias("n"))  # a row for each source
    return counts.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), casefold("source"), "source")).cast("long").alias("place"))


@query("dt7_explorer_dates", "SELECT pos, CASE WHEN pos % 4 = 3 THEN 'about ' || pos ELSE strftime(published, '%Y-%m-%dT%H:%M:00+00:00') END AS at FROM stories")
def explorer_dates(spark, sf):
    p = F.col("pos") % 4
    shown = F.when(p == 0, F.concat(F.date_format("published", "EEE, MMM dd, yyyy HH:mm"), F.lit(" (Local GMT) "))).when(p == 1, F.date_format("published", "EEE, MMM d, yyyy HH:mm")).when(p == 2, F.date_format("published", "EEE, dd MMM yyyy HH:mm")).otherwise(F.concat(F.lit("about "), F.col("pos").cast("string")))
    return stories(spark, sf).select("pos", desk.explorer_date(shown).alias("at"))


@query("o4_council_order", "SELECT pos, row_number() OVER (PARTITION BY source ORDER BY coalesce(CASE WHEN pos % 3 > 0 THEN epoch_us(published) END, 0) DESC, encode(title) DESC, pos) AS place FROM stories")
def council_order(spark, sf):
    from ..operators import ordering

    s = stories(spark, sf).withColumn("at", F.when(F.col("pos") % 3 > 0, F.col("published")))
    return s.select("pos", F.row_number().over(Window.partitionBy("source").orderBy(*ordering.council_order("at", "title"), "pos")).cast("long").alias("place"))


@query("o5_draft_order", f"SELECT pos, row_number() OVER (PARTITION BY source ORDER BY strftime(published, '%Y-%m-%d') DESC, encode({fold('title')}) DESC, pos) AS place FROM stories")
def draft_order(spark, sf):
    from ..operators import ordering

    s = stories(spark, sf).withColumn("at", F.date_format("published", "yyyy-MM-dd"))
    return s.select("pos", F.row_number().over(Window.partitionBy("source").orderBy(*ordering.draft_order("at", "title"), "pos")).cast("long").alias("place"))


@query("r5_no_contacts", "SELECT pos, '' AS author_email FROM stories")
def no_contacts(spark, sf):
    return desk.without_contacts(stories(spark, sf).select("pos", F.concat("source", F.lit("@x.org")).alias("author_email")))


@query("dt5_council_dates", f"""SELECT pos, epoch_us(CASE pos % 8 WHEN 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(pos % 40 AS INTEGER)) WHEN 6 THEN date_trunc('second', published) WHEN 7 THEN NULL ELSE date_trunc('day', published) END) AS at FROM stories""")
def council_dates(spark, sf):
    shaped = lambda form, before="", after="": F.concat(F.lit(before), F.date_format("published", form), F.lit(after))
    shown = F.element_at(
        F.array(
            F.concat(F.lit("Posted "), (F.col("pos") % 40).cast("string"), F.lit(" Days  ago, we think")), shaped("EEEE, MMMM d, yyyy", "Article posted on "), F.concat(shaped("d", "Published on x published on "), F.lit("TH "), shaped("MMMM yyyy")),
            shaped("d MMM yyyy"), shaped("EEEE, d MMMM yyyy", "It was ", " then"), shaped("MMMM d yyyy", "on "), shaped("yyyy-MM-dd'T'HH:mm:ss", "", "+00:00"), shaped("MMMM yyyy", "in "),
        ),
        (F.col("pos") % 8 + 1).cast("int"),
    )
    return stories(spark, sf).select("pos", F.unix_micros(dates.council(shown, now())).alias("at"))


_GATE = "CASE pos % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '#top', '') WHEN 2 THEN 'https://' || source || '.example.com/x/About/' WHEN 3 THEN 'https://other.org/news/' || pos WHEN 4 THEN 'https://WWW.' || source || '.example.com/shopping/' || pos ELSE '/news/tables/;v=1' END"


@query("f18_url_gate", rf"""SELECT pos, NOT ({" OR ".join(f"regexp_matches(u, '{p}($|[^a-z0-9])')" if p.startswith("/") else f"contains(u, '{p}')" for p in EXCLUDED_URL_PARTS)} OR regexp_matches(p, '({"|".join(EXCLUDED_URL_ENDINGS)})/*$')
 OR (h <> '' AND h <> source || '.example.com') OR regexp_matches(u, 'page=1$') OR contains(u, '/7(')) AND regexp_matches(u, 'news|shopping/\d*[02468]$') AS allowed
 FROM (SELECT pos, source, u, regexp_replace(regexp_extract(u, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS p, regexp_replace(regexp_extract(u, '//([^/?#]*)', 1), '^www\.', '') AS h FROM (SELECT pos, source, lower({_GATE}) AS u FROM stories))""")
def url_gate(spark, sf):
    i, at = F.col("pos") % 6, F.col("pos").cast("string")
    host = F.concat("source", F.lit(".example.com"))
    u = (
        F.when(i == 0, F.col("url"))
        .when(i == 1, F.replace("url", F.lit("#top"), F.lit("")))
        .when(i == 2, F.concat(F.lit("https://"), host, F.lit("/x/About/")))
        .when(i == 3, F.concat(F.lit("https://other.org/news/"), at))
        .when(i == 4, F.concat(F.lit("https://WWW."), host, F.lit("/shopping/"), at))
        .otherwise("/news/tables/;v=1")
    )
    base = F.concat(F.lit("https://www."), host, F.lit("/"))
    return stories(spark, sf).select("pos", filters.url_allowed(u, base, include=("NEWS", r"shopping/\d*[02468]$"), exclude=("PAGE=1$", "/7(")).alias("allowed"))


@query("n39_detail_lines", """SELECT pos, array_to_string(CASE WHEN pos % 3 = 0 THEN [title || ' again'] ELSE ['early', source] END || CASE WHEN pos % 2 = 0 THEN [lang || ' last'] ELSE [] END, '|') AS lines FROM stories WHERE length(trim(title)) > 0""")
def detail_lines(spark, sf):
    p = F.col("pos")
    s = stories(spark, sf).where("length(trim(title)) > 0")
    site = F.array(F.lit(" Advanced Search "), F.lit("A. Person Log out"), F.upper("title"), F.lit("Slug: x"), F.lit("Mon, Jan 1, 2024"), F.lit(" "))
    late = F.array(F.lit("early"), F.lit("Download Text"), F.lit("lost"), F.lit("DOWNLOAD TEXT"), F.concat("title", F.lit(" again")))
    early = F.array(F.lit("early"), F.col("source"))
    lines = F.concat(F.when(p % 3 == 0, late).otherwise(early), site, F.array(F.concat("lang", F.lit(" last"))), F.array(F.lit("beyond")))
    marker = F.size(lines) - F.when(p % 2 == 0, 1).otherwise(2)
    return s.select("pos", F.array_join(desk.detail_lines(lines, "title", marker), "|").alias("lines"))
