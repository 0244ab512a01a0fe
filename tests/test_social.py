"""Posts against plain Python over the same rows."""

import html
import re

from pyspark.sql import functions as F

from storyflow.data import social as v
from storyflow.operators import articles, social

LONG = "The council agreed to open the market hall again after a long fire in the town of Boston. " * 4
ROWS = [
    ("<b>Lincoln Castle</b> Market Hall show", "<p>One.</p><!-- no --><div title='a>b'>Two &amp;lt; 3 www.Example.com/a?b</div>\r\nNotes to Editors: gone", "https://x.org/a"),
    ("Boston Academy opens", LONG + "See https://x.org/a and me@www.x.org\n\n\n\nEnd -", " https://x.org/a "),
    ("T" * 280, LONG, "https://x.org/" + "a" * 280),
    ("T" * 295, "word " * 60, ""),
    ("", LONG + "<br>The court heard of a fatal crash.", None),
    (None, None, None),
    ("a < b & c", "x &#8217; &nbsp; y <p", ""),
    ("The Market Rasen and the Marketing", "films, councillors; Film. historic-match", ""),
    (LONG[:89], LONG[:89] + " " + "tiny. " * 60, "u"),
]
DRAFTS = [
    ("https://LDRS.org.uk/article/1", "", "Lead. Credit: A. Person\n \nLEAD. credit: a. person\nBody one\nBody two", "old", "none"),
    ("https://x.org", "https://in.org/1", "Photo credit: B\nBody https://in.org/1 end", "old", None),
    ("https://x.org", None, "same\nsame", None, None),
    (None, None, None, None, None),
    (" https://x.org ", " ", "a\nA", "c", "d"),
]


def strip_tags(t):
    inner = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
    t = re.sub(r"(?s)<!--.*?-->", "", (t or "").replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"</?([A-Za-z][^\s/>]*)" + inner, lambda m: "\n" if m[1].lower() in v.BLOCK_TAGS else "", t)


def clean(t, url=""):
    t = html.unescape(html.unescape(strip_tags(t)))
    at = re.search(r"(?im)^\s*\[?\s*notes?\s+to\s+editors?\s*:", t)
    t = t[: at.start()] if at else t
    t = t.replace(url.strip(), "") if url and url.strip() else t
    t = re.sub(r"(?i)(?<![\w@/:])www\.[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s<]*)?", lambda m: "https://" + m[0], t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", t))).strip(" \n-")


def camel(names, most):
    out = []
    for n in names:
        t = "#" + "".join(w[:1].upper() + w[1:] for w in re.findall("[A-Za-z0-9]+", n))
        if 1 < len(t) <= 40 and t.lower() not in [o.lower() for o in out]:
            out.append(t)
    return " ".join(out[:most])


def suggested(title, text):
    head = (title or "").strip()
    low = f"{head}\n{text or ''}".casefold()
    there = lambda w: re.search(rf"\b{w.lower()}\b", low)
    venue = [m[0] for m in re.finditer(rf"\b(?:[A-Z][A-Za-z0-9'’-]*\s+){{0,4}}(?:{'|'.join(v.VENUE_ENDINGS)})\b", head) if len(m[0].split()) > 1]
    places = [p for p in v.PLACES if there(p)]
    return camel([*venue, *places, *[v.AUTHORITIES[p.lower()] for p in places if p.lower() in v.AUTHORITIES], *[t for ws, t in v.TOPICS if any(map(there, ws))], *v.CLOSING_TAGS], 8)


def words(t):
    return len(re.findall(r"\b[\w’'-]+\b", t))


def short(title, body, url):
    t, b, end = clean(title), clean(body, url or ""), "\n\n" + url.strip() if (url or "").strip() else ""
    tt, bb = clean(t), clean(b)
    if len(bb) < 240 or words(bb) < 40 or (tt and bb.casefold() == tt.casefold()) or 300 - len(end) < 40:
        return None
    said = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", b) if words(s) >= 8]
    choices = [f"{t}\n\n{s}" for s in said if t and s.casefold() != t.casefold()] + said + [t] * bool(t)
    return next((s.strip() + end for s in choices if s.strip() and len(s.strip()) <= 300 - len(end)), None)


def test_text_tags_and_short_posts(spark, sf):
    docs = [(t.split("\n")[0], t, "https://x.org/b") for (t,) in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("text").collect()]
    rows = ROWS + docs
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, body string, url string")
    got = social.short_post(df).select("i", "post", social.social_text("body", "url").alias("text"), social.suggested_hashtags("title", "body").alias("tags"), social.normalised_hashtags("title").alias("own")).orderBy("i").collect()
    assert len(got) == len(rows)
    for g, (title, body, url) in zip(got, rows):
        assert g["text"] == clean(body, url or "")
        assert g["tags"] == suggested(title, body)
        assert g["own"] == camel([t.replace("_", " ").replace("-", " ") for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_-]*", title or "")], 12)
        assert g["post"] == short(title, body, url)
    assert any(g["post"] for g in got) and not all(g["post"] for g in got)


def test_names_that_hold_others(spark):
    df = spark.createDataFrame([("In Upton Spa.",), ("Upton, not the spa",), ("Uptonian",)], "t string")
    tags = social.suggested_hashtags(F.lit(""), "t", places=("Upton", "Upton Spa"), authorities={}, topics=(), closing=())
    assert [r[0] for r in df.select(tags).collect()] == ["#Upton #UptonSpa", "#Upton", ""]


def mend(source, internal, text, caption, credit):
    public, known = (source or "").strip(), (internal or "").strip()
    if public.casefold().startswith("https://ldrs.org.uk/article/"):
        source, internal = "", public
    elif known:
        source = ""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    if len(lines) > 1 and lines[0].casefold() == lines[1].casefold():
        text, caption = "\n\n".join(lines[2:]), lines[0]
        m = re.search(r"(?i)\b(?:Credit:|Photo(?:graph)?(?:\s+credit)?:?)\s*(.+)$", caption)
        credit = m[1].strip() if m else credit
    return clean(text, internal or ""), source or "", internal or "", False, caption, credit


def test_mended_drafts(spark):
    df = spark.createDataFrame([(i, *r, True, "kept") for i, r in enumerate(DRAFTS)], "i int, source_url string, internal_source_url string, text string, image_caption string, image_credit string, include_source_url boolean, other string")
    got = social.mended_drafts(df).orderBy("i").collect()
    for g, r in zip(got, DRAFTS, strict=True):
        assert (g["text"], g["source_url"], g["internal_source_url"], g["include_source_url"], g["image_caption"], g["image_credit"]) == mend(*r)
        assert g["other"] == "kept"


def post(a, most=8):
    text = " ".join([a["title"], a["summary"], *a["paragraphs"]])
    has = lambda t, terms: any(x in t.casefold() for x in terms)
    kind = v.SENSITIVE_MARKS if has(text, v.SENSITIVE_TERMS) else v.COMMUNITY_MARKS if has(text, v.COMMUNITY_TERMS) else v.OTHER_MARKS
    plan = dict(kind[:most])
    for terms, first, other, sign in v.MARK_CHANGES:
        at = first if first in plan else other
        if has(text, terms) and at in plan:
            plan[at] = sign
    before = lambda role, t: f"{plan[role]} {t}" if role in plan else t
    key = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.casefold()).split())
    opening = a["summary"] or (a["paragraphs"] or [""])[0]
    out, used = [before("headline", a["title"] or "Police update"), opening], set()
    for p in a["paragraphs"]:
        if key(opening) and key(p) == key(opening):
            continue
        role = next((r for r, terms in v.PARAGRAPH_ROLES if r in plan and r not in used and has(p, terms)), None)
        used.add(role)
        out.append(before(role, p))
    if not a["summary"] and not a["paragraphs"]:
        out.append(social.NO_DETAILS)
    out.append("\n".join(x for x in (before("location", a["location"]) if a["location"] else "", before("information", "Source: " + a["source"]) if a["source"] else "") if x))
    whole = "\n\n".join(x.strip() for x in out if x.strip())
    if len(whole) <= 6500:
        return whole
    cut = whole[:6499]
    return (cut.rsplit("\n\n", 1)[0].rstrip() or cut.rstrip()) + "…"


def test_marked_posts(spark, sf):
    docs = [(t.split("\n")[0], t.split("\n")[1] if i % 2 and "\n" in t else "", t, "s", "", "", "") for i, (t,) in enumerate(spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("text").collect())]
    rows = docs + [
        ("A fatal crash", "", "The court heard.\nA driver was arrested.\nCourt again, with cannabis.\nAn appeal for a witness.\nArrested too.", "S", "L", "", ""),
        ("A school event", "sum", "A patrol of the community.\nPolice arrested two.\nMore advice.", "S", "", "", ""),
        ("Road closed", "", "A van turned over.\nDrugs were found.\nAn arrest was made.", "", "L", "", ""),
        (None, None, None, None, None, None, None),
        ("T", "", "\n".join(f"Paragraph {i} of this text goes on for some while, really." for i in range(200)), "S", "L", "", ""),
        ("T", "", "x" * 7000, "", "", "", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, summary string, body string, source string, location string, category string, published string")
    built = articles.build(df)
    for most in (8, 3, 0):
        got = social.marked_post(built, most).orderBy("i").collect()
        assert len(got) == len(rows)
        for g in got:
            assert g["post"] == post(g["article"].asDict(), most)
