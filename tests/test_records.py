"""Records, slugs, notices, schedules and reports against plain Python, over random and odd values."""

import datetime as dt
import json
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from storyflow.data.boilerplate import BOILERPLATE_LINES, FURNITURE_PHRASES, FURNITURE_WHOLE, NO_PLACES
from storyflow.functions import dates, text
from storyflow.operators import publish, records

UTC = dt.timezone.utc


def one_line(t):
    return " ".join((t or "").split())


def is_furniture(t):
    t = one_line(t)
    low = t.casefold().strip(" :–—-|")
    return not t or low in BOILERPLATE_LINES + FURNITURE_PHRASES or any(re.fullmatch(p, t, re.I) for p in FURNITURE_WHOLE)


PARTS = ["News", "x", "12/3/24", "10:45", "pm", ":", "-", " ", "Published", "photo.jpg", "?w=2", "3 sept 2024", "3 September 2024", "previous", "article", "Follow us on X", "Boston", "Unknown", "n/a", "home |"]


def test_furniture_and_places(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(PARTS, k=rng.randint(0, 2))), rng.choice(PARTS + [None])) for i in range(600)]
    df = spark.createDataFrame(rows + [(600, None, "y" * 101), (601, "z" * 100, "Boston")], "i int, a string, b string")
    for r in df.select("i", "a", "b", records.furniture("a").alias("f"), records.place("a", "b").alias("p")).collect():
        assert r.f == is_furniture(r.a), r
        fits = [one_line(v) for v in (r.a, r.b) if not is_furniture(v) and one_line(v).casefold().strip(" :–—-|") not in NO_PLACES and len(one_line(v)) <= 100]
        assert r.p == (fits[0] if fits else ""), r


def test_own_paragraphs(spark):
    base = "the council said that it would mend the bridge before the end of the year"
    rows = [
        ("A title\n\n" + base + "\n\n" + base.upper() + "!\n\n" + base + " at last\n\n" + base + " and the road too and all that\n\nMenu\n\nA summary", "A Title!", "a summary", 2),
        (None, "t", None, 0),
        ("one\ntwo\nOne", "", "", 2),
        ("...\n???", "", "", 2),
    ]
    df = spark.createDataFrame(rows, "body string, title string, summary string, n int")
    for r in df.select("n", records.own_paragraphs("body", "title", "summary").alias("k")).collect():
        assert len(r.k) == r.n, r


def test_ascii_slugs(spark):
    titles = ["Café №5 – Straße", "ﬁne ½ Ångström", "日本 a", "", None, "  a  b  ", "İstanbul", "x" * 5000]
    got = [r.s for r in spark.createDataFrame([(t,) for t in titles], "t string").select(records.ascii_slugs("t").alias("s")).collect()]
    for t, s in zip(titles, got):
        plain = unicodedata.normalize("NFKD", one_line(t)).encode("ascii", "ignore").decode().lower()
        assert s == re.sub("[^a-z0-9]+", "-", plain).strip("-")


def test_sentences(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choices(["a", "b c", ". ", "! ", "?” ", "...", "\n\n", " ", '." ', ".5", ")"], k=rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for r in df.select("b", text.statistics("b")["sentence_count"].alias("n")).collect():
        body = r.b.strip()
        chunks = [p for p in re.split(r"(?<=[.!?])(?:[\"'’”)]*)\s+|[.!?]+$", body) if p.strip()]
        assert r.n == (max(1, len(chunks)) if body else 0), r


def test_police_dates(spark):
    t = dt.datetime(2024, 5, 3, 9, 7, 0, tzinfo=UTC)
    shown = {
        "Published: 09:07 03/05/2024": t, "published :3/5/2024 9:07": t, "03/05/2024 09:07:31": t.replace(second=31), "9:07 3 may 2024": t, "3 May 2024 09:07": t,
        "2024-05-03T09:07:00Z": t, "2024-05-03T10:07:00+01:00": t, "Fri, 03 May 2024 09:07:00 +0000": t, "Fri, 03 May 2024 10:07:00 +0100": t, "3 May 2024": t.replace(hour=0, minute=0),
        "31/02/2024": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in [*shown, None]], "d string").select("d", F.unix_micros(dates.police("d")).alias("t"))
    for r in df.collect():
        want = shown.get(r.d)
        assert r.t == (want and int(want.timestamp()) * 1_000_000), r


def plain_next(mode, times, last, now):
    if mode in dates.INTERVALS:
        return (last if last and last <= now else now) + dt.timedelta(minutes=dates.INTERVALS[mode])
    if mode != dates.FIXED_TIMES:
        return None
    for day in (0, 1):
        for v in sorted({v.strip() for v in times or [] if re.fullmatch(r"(?:[01]\d|2[0-3]):[0-5]\d", v.strip())}):
            at = now.replace(hour=int(v[:2]), minute=int(v[3:]), second=0, microsecond=0) + dt.timedelta(days=day)
            if at > now:
                return at
    return None


def test_schedules(spark):
    rng = random.Random(7)
    base = dt.datetime(2024, 2, 28, tzinfo=UTC)
    at = lambda: base + dt.timedelta(seconds=rng.randrange(200_000))
    modes = [*dates.INTERVALS, dates.FIXED_TIMES, dates.FIXED_TIMES, "Off", "Manual only", "other", None]
    rows = [(i, rng.choice(modes), rng.choice([None, [], ["25:00"], ["00:00", "23:59"], [" 07:30", "7:30", "07:30"]]), rng.choice([None, at()]), at()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, m string, t array<string>, l timestamp, n timestamp")
    n = F.col("n")
    got = {r.i: r for r in df.select("i", F.unix_seconds(dates.next_run("m", "t", "l", n)).alias("next"), dates.stale("m", "l", n).alias("stale"), F.unix_seconds(dates.due_at("m", "l", n)).alias("due")).collect()}
    for i, m, t, last, now in rows:
        want = plain_next(m, t, last, now)
        assert got[i].next == (want and int(want.timestamp())), (m, t, last, now)
        every = dates.INTERVALS.get(m) and dt.timedelta(minutes=dates.INTERVALS[m])
        idle = (m or "Manual only") in ("Off", "Manual only")
        assert got[i].stale == (not idle and (last is None or bool(every and now - last >= every)))
        due = None if not every else now if last is None else max(last + every, now)
        assert got[i].due == (due and int(due.timestamp()))


def test_path_dates(spark):
    paths = {"/news/3rd-may-2024/x": "2024-05-03", "/3-May-2024": "2024-05-03", "/a/31st-feb-2024/": None, "/x/2-foo-2024/": None, "/1st-jan-2031/": None, "/2024/05": "2024-05-01", "/a/2024-05-03": "2024-05-03", "/": None}
    df = spark.createDataFrame([("https://x.org" + p,) for p in [*paths]], "u string").select("u", F.to_date(dates.from_path("u", 2024)).cast("string").alias("d"))
    for r in df.collect():
        assert r.d == paths[r.u.removeprefix("https://x.org")], r


def test_reports(spark, tmp_path):
    empty = spark.createDataFrame([], "status string, full_content_count long, incomplete_content_count long")
    assert records.health_summary(empty).first().asDict() == dict(sources=0, yielding=0, no_stories=0, no_current_stories=0, failed=0, full_content=0, incomplete_content=0)
    rows = spark.createDataFrame([("yielding", 3, None), ("failed", None, 2), (None, 1, 1)], empty.schema)
    records.write_health(rows, str(tmp_path / "h"), F.lit("2024-02-01"))
    [line] = [x for f in (tmp_path / "h/summary").glob("*.json") for x in open(f)]
    assert json.loads(line) == {"generated_at": "2024-02-01", "summary": dict(sources=3, yielding=1, no_stories=0, no_current_stories=0, failed=1, full_content=4, incomplete_content=3)}
    assert spark.read.json(str(tmp_path / "h/sources")).count() == 3

    publish.append_audit(spark.sql("SELECT '2024-01-01' AS at, 1 AS n"), str(tmp_path / "a"))
    publish.append_audit(spark.sql("SELECT '2024-01-02' AS at, 2 AS n"), str(tmp_path / "a"))
    (tmp_path / "a/part-z.json").write_text("not json\n")
    assert publish.latest_audit(spark, str(tmp_path / "a"), "at string, n int").first().n == 2

    publish.write_csv(spark.sql("SELECT 'é' AS dimension, 2 AS `Story count`"), str(tmp_path / "c"))
    [f] = (tmp_path / "c").glob("*.csv")
    assert f.read_bytes() == "﻿dimension,Story count\né,2\n".encode()
    where = publish.write_text(spark.sql("SELECT 'x' AS plain"), "plain", str(tmp_path / "t"), dt.datetime(2024, 2, 1, 7, 30))
    assert os.path.basename(where) == "plain_20240201_073000" and spark.read.text(where).first().value == "x"


def test_strict_rendering(spark):
    schema = "title string, summary string, body string, source string, location string, category string, published string"
    good = ("A title long enough", "s", "word " * 20, "s", "", "", "")
    bad = ("", "s", "short", "s", "", "", "")
    assert publish.rendered(spark.createDataFrame([good], schema), strict=True).count() == 1
    both = spark.createDataFrame([good, bad], schema)
    assert publish.rendered(both).select("errors").collect()[1].errors == ["Missing title.", "Body is too short."]
    with pytest.raises(Exception, match="Missing title. Body is too short."):
        publish.rendered(both, strict=True).select("title").collect()
