"""The article and its renderings against plain Python over the same rows."""

import html
import re

from pyspark.sql import functions as F

from storyflow.data import rules
from storyflow.operators import articles, publish

ROWS = [
    ("News: A title", "A title", "First line here.\nNEWS\n“Said so,” they said.\nphoto.png\nFirst line here!\nSecond line.", "BBC", "Boston", "crime", "today"),
    (None, None, None, None, None, None, None),
    ("  Press release - ", "Subscribe to us today", "A title\n\nTwo\n\nTwo\n\n<b> & 'c' \"d\"", "", "", "", ""),
    ("T", "", "\n".join(f"Paragraph {i} of this long text. It goes on for some while, really." for i in range(60)), "S", "", "", ""),
    ("T", "sum", "\n".join([f"Plain {i}" for i in range(3)] + ["‘q1’"] + [f"More {i}" for i in range(3)] + ["‘q2’"]), "S", "L", "", "p"),
    ("T", "sum", "\n".join([f"Plain {i}" for i in range(5)] + ["‘q1’"]), "S", "L", "c", "p"),
    ("T", "x" * 1790 + ". y z", "tail " * 30, "S", "L", "c", "p"),
    ("T", "word " * 80, "", "S", "L", "c", "p"),
]


def tidy(t):
    return " ".join((t or "").split())


def key(t):
    return " ".join(re.sub(r"[^\w\s]", "", t.casefold()).split())


def noise(t):
    return not key(t) or key(t) in rules.SCRAPE_NOISE or bool(re.fullmatch(r"[^\n]*\.(jpg|jpeg|png|gif|webp|svg)", t.strip(), re.I)) or key(t).startswith(rules.NOISE_PREFIXES)


def article(title, summary, body, source, location, category, published):
    name = re.sub(r"^(?:news|latest news|press release)\s*[:\-–—]\s*", "", tidy(title), flags=re.I).strip(" -–—")
    lead = tidy(summary)
    if key(lead) == key(name) or noise(lead):
        lead = ""
    blocks = [tidy(b) for b in re.split(r"\n\s*\n", (body or "").strip()) if tidy(b)]
    if len(blocks) < 2:
        blocks = [tidy(b) for b in (body or "").split("\n") if tidy(b)]
    seen, kept = {key(name), key(lead)}, []
    for b in blocks:
        if not noise(b) and key(b) not in seen:
            seen.add(key(b))
            kept.append(b)
    return {"title": name or "Untitled story", "summary": lead, "paragraphs": kept, "Source": tidy(source), "Area": tidy(location), "Category": tidy(category), "Published": tidy(published)}


def foot(a, *names):
    return " | ".join(f"{n}: {a[n]}" for n in names if a[n])


def joined(parts):
    return "\n\n".join(p.strip() for p in parts if p.strip())


def bare(a):
    return not a["summary"] and not a["paragraphs"]


def as_markdown(a):
    end = foot(a, "Source", "Area", "Category", "Published")
    return joined(["# " + a["title"], f"**{a['summary']}**" if a["summary"] else "", *a["paragraphs"], publish.FALLBACK if bare(a) else "", f"*{end}*" if end else ""])


def as_html(a):
    e = lambda t: html.escape(t)
    body = f"<p>{publish.FALLBACK}</p>" if bare(a) else "\n".join(f"<p>{e(p)}</p>" for p in a["paragraphs"])
    end = foot(a, "Source", "Area", "Category", "Published")
    lines = ["<!DOCTYPE html>", '<html lang="en">', "<head>", '<meta charset="utf-8">', f"<title>{e(a['title'])}</title>", "</head>", "<body>", "<article>", f"<h1>{e(a['title'])}</h1>"]
    return "\n".join([*lines, f"<p><strong>{e(a['summary'])}</strong></p>" if a["summary"] else "", body, f"<p><small>{e(end)}</small></p>" if end else "", "</article>", "</body>", "</html>", ""])


def as_plain(a):
    return joined([a["title"], a["summary"], *a["paragraphs"], publish.FALLBACK if bare(a) else "", foot(a, "Source", "Area", "Published")])


def as_breaking(a):
    words = (a["summary"] or (a["paragraphs"] or [""])[0]).split()
    text = " ".join(words) if len(words) <= 55 else " ".join(words[:55]).rstrip(" ,;:-") + "…"
    return joined(["🚨 BREAKING NEWS", a["title"], text])


def as_newsletter(a):
    opening = a["summary"] or (a["paragraphs"] or [""])[0]
    body, quote = [], ""
    for p in a["paragraphs"]:
        if key(p) == key(opening):
            continue
        if re.search(r"[\"“‘][^\"”’]+[\"”’]", p):
            quote = quote or p
            continue
        body.append(p)
        if len(body) == 4:
            break
    if quote:
        body = body + [quote] if len(body) < 4 else body[:3] + [quote]
    text = joined([a["title"], opening, *body, publish.NEWSLETTER_FALLBACK if bare(a) else "", foot(a, "Area", "Category", "Source")])
    if len(text) <= 1800:
        return text
    short = text[:1799]
    gap, stop = short.rfind("\n\n"), max(short.rfind(m) for m in (". ", "! ", "? "))
    short = short[:gap] if gap > 900 else short[: stop + 1] if stop > 900 else short
    return short.rstrip() + "…"


def test_renderings(spark, sf):
    docs = [(t.split("\n")[0], t.split("\n")[1] if "\n" in t else "", t, "s", "", "c", "") for (t,) in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("text").collect()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS + docs)], "i int, title string, summary string, body string, source string, location string, category string, published string")
    a = F.col("article")
    got = articles.build(df).select("i", a, publish.plain_text(a).alias("plain"), publish.markdown(a).alias("markdown"), publish.html_page(a).alias("html"), publish.breaking(a).alias("breaking"), publish.newsletter(a).alias("newsletter")).orderBy("i").collect()
    assert len(got) == len(ROWS) + len(docs)
    for r, row in zip(got, ROWS + docs):
        want = article(*row)
        assert [r["article"][k] for k in ("title", "summary", "paragraphs")] == [want["title"], want["summary"], want["paragraphs"]]
        assert r["plain"] == as_plain(want) and r["markdown"] == as_markdown(want) and r["html"] == as_html(want)
        assert r["breaking"] == as_breaking(want) and r["newsletter"] == as_newsletter(want)


def test_damaged_snapshot_is_passed_over(spark, tmp_path):
    import glob
    import os

    from storyflow.operators import store

    s = store.Snapshots(spark, str(tmp_path / "snap"))
    assert s.load() is None
    s.save(spark.range(3).toDF("a"))
    last = s.save(spark.range(5).toDF("a"))
    assert s.load().count() == 5
    for f in glob.glob(str(tmp_path / "snap" / last / "*.parquet")):
        with open(f, "r+b") as out:
            out.seek(4)
            out.write(b"\xff" * (os.path.getsize(f) - 4))
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert s.load().count() == 3
