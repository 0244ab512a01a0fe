"""Desk rules against plain Python over random inputs."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from storyflow.data import boilerplate
from storyflow.operators import desk, images, listings


def one(spark, rows, build, schema="s string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i long, {schema}")
    return [r["v"] for r in sorted(df.select("i", build().alias("v")).collect(), key=lambda r: r["i"])]


def clean(t):
    return re.sub(r"\s+", " ", t or "").strip()


def test_sharing_tails_to_the_end(spark):
    rnd = random.Random(1)
    parts = ["Copy", " ", "•", "| ", "Share on X", " X", "Share on Facebook (Opens in new window) Facebook", "Share via Email", "Like this:", "loading", "Loading...", " share on linkedin LinkedIn", "\n"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(500)] + [None, " | Share via Email" * 30]

    def fold(t):
        t, before = clean(t), None
        while before != t:
            before = t
            for p in desk.SHARING:
                t = re.sub(p + r"\s*$", "", t, flags=re.I).strip()
        return t

    assert one(spark, rows, lambda: desk.without_sharing("s")) == [fold(t) for t in rows]


def test_furniture_of_articles(spark):
    rnd = random.Random(2)
    parts = ["Subscribe", "sign up", "Read more", " about it", "Share", " on", "X", "Tags", ":", "Posted in", " News", "next story", "Loading", "...", "Comment", "s", "é", "cookie", " ", "copy link", "Like this"]
    rows = [clean("".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))) for _ in range(500)]
    want = [len(t) < 2 or any(re.search(p, t, re.I) for p in boilerplate.ARTICLE_FURNITURE) for t in rows]
    assert one(spark, rows, lambda: images.article_furniture(F.col("s"))) == want and len(boilerplate.ARTICLE_FURNITURE) == 22


def test_fingerprints_are_those_of_json(spark):
    rnd = random.Random(3)
    rows = ["".join(rnd.choice([*map(chr, range(1, 40)), "\\", '"', "é", "日", "\x7f", " "]) for _ in range(rnd.randrange(12))) for _ in range(300)] + [""]
    want = [hashlib.sha256(json.dumps({"b": t, "a": "x"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for t in rows]
    assert one(spark, rows, lambda: desk.definition_fingerprint(F.create_map(F.lit("b"), F.col("s"), F.lit("a"), F.lit("x")))) == want


def test_workflow_takes_the_first_draft_of_an_address(spark):
    rnd = random.Random(4)
    address = lambda: rnd.choice([None, "", " ", "/", *[f"{rnd.choice(['', ' '])}https://{h}/{n}{e}" for h in ("x.org", "X.org") for n in range(6) for e in ("", "/", "//", " ")]])
    stories = [(i, address()) for i in range(120)]
    drafts = [(i, address(), address(), rnd.choice(["draft", None, " Sent to Metricool as DRAFT"]), rnd.choice([None, "", " ", "7"])) for i in range(9)]
    key = lambda u: (u or "").strip().rstrip("/").casefold()

    def stage(url):
        for _, a, b, status, delivery in drafts:
            if key(url) and key(url) in (key(a), key(b)):
                return "SENT TO METRICOOL" if (delivery or "").strip() or (status or "").strip().casefold() == "sent to metricool as draft" else "SENT TO SOCIAL DESK"
        return ""

    d = spark.createDataFrame(drafts, "pos long, source_url string, internal_source_url string, status string, delivery_id string")
    got = desk.workflow_status(spark.createDataFrame(stories, "i long, url string"), d.repartition(3)).collect()
    assert sorted((r["i"], r["stage"]) for r in got) == [(i, stage(u)) for i, u in stories]


def test_the_best_photograph(spark):
    rnd = random.Random(5)
    urls = ["https://x.org/900x600.jpg", "HTTPS://X.org/900x600.JPG", "http://x.org/logo.png", "https://x.org/video/a.jpg", "ftp://x.org/a", "", "/r/300x200.jpg", "b.jpg?w=50&amp;h=40", "//c.org/p.jpg", "data:image/png", "https://", "https://youtu.be/x.jpg"]
    rows = [([(rnd.choice(urls), rnd.choice([0, 0, 300, 640]), rnd.choice([0, 200]), rnd.random() < 0.2) for _ in range(rnd.randrange(6))],) for _ in range(300)]

    def whole(u):
        u = u.replace("&amp;", "&")
        if not u or u.startswith("data:"):
            return ""
        if re.match("[A-Za-z]+:", u):
            return u
        return "https:" + u if u.startswith("//") else "https://s.org" + u if u.startswith("/") else "https://s.org/n/" + u

    def score(u, w, h, meta):
        m = re.search(r"(?<!\d)(\d{2,4})x(\d{2,4})(?!\d)", u, re.I) or re.search(r"[?&](?:width|w)=(\d{2,4}).*?[?&](?:height|h)=(\d{2,4})", u)
        w, h = max(w, int(m[1]) if m else 0), max(h, int(m[2]) if m else 0)
        return (w * h if w and h else w * w if w else 1) + 2_000_000 * meta - 5_000_000 * ("logo" in u.lower())

    def best(cands):
        seen, ranked = set(), []
        for u, w, h, meta in cands:
            u = whole(u)
            if not re.match("https?://[^/]", u, re.I) or any(t in u.lower() for t in boilerplate.VIDEO_TERMS) or u.lower() in seen:
                continue
            seen.add(u.lower())
            ranked.append((score(u, w, h, meta), u))
        return max(ranked, key=lambda x: x[0])[1] if ranked else ""

    got = one(spark, rows, lambda: images.best_image(F.col("s"), F.lit("https://s.org/n/page?a=/b/")), "s array<struct<url:string,width:int,height:int,metadata:boolean>>")
    assert got == [best(c) for (c,) in rows]


def test_posts_of_marked_up_sources(spark):
    rows = [("<p>Hello there</p>", "x", "Hello there you", ""), ("Hello &amp; bye", "Hello & bye", "", ""), ("Not it", "x", "Hello", ""), ("", "", "a", ""), (None, None, None, None), ("a\n\nhttps://x", "T", "<b>a</b>", " https://x "), ("a" * 301, "x", "a" * 400, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, p string, t string, a string, u string")
    got = desk.source_only(df, F.col("p"), F.col("t"), F.col("a"), F.col("u")).collect()
    assert [r["own"] for r in sorted(got, key=lambda r: r["i"])] == [True, True, False, False, False, True, False]


def test_blocks_and_counts(spark):
    rows = [None, "", "{", "[]", '{"content": 5}', '{"content": [1, null, {"rowData": {"widgetData": {"content": "<p>One</p><h2>Two</h2><p>Subscribe now</p>", "quote": "<b>x</b>"}}}]}', '{"content": [{"rowData": {"widgetData": {"quote": "<b>a<br>b</b>"}}}]}']
    assert one(spark, rows, lambda: listings.block_texts("s")) == ["", "", "", "", "", "One\n\nTwo", "a\n\nb"]
    card = "title string, url string, summary string, published string, has_metadata boolean, broad_context boolean, n_links int, card_text string, link_text string, marker string"
    cards = [("News", "https://x/a", "", "", False, False, 0, "", "", ""), ("T", "https://x/blog/y", "", "", None, None, None, None, None, "Category-1"), ("T", "https://x/2024/y", None, None, None, True, 0, "", "", ""), (None, None, None, None, None, None, None, None, None, None)]
    judged, seen = listings.counted(listings.rejection(spark.createDataFrame(cards, card), F.lit(2024)))
    assert [r["reason"] for r in judged.collect()] == ["category-or-listing-page", "undated-blog-filter", "", ""]
    assert {k: v for k, v in seen.get.items() if v} == {"accepted": 2, "category-or-listing-page": 1, "undated-blog-filter": 1}
