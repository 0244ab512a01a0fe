"""Council dates, the gate of addresses and the lines of a record's page, case by case."""

from pyspark.sql import functions as F

from storyflow.functions import dates
from storyflow.operators import desk, filters

DATES = {
    "3 days ago": "2024-01-29 00:00:00",
    "Posted 1 HOUR ago by x": "2024-01-31 23:00:00",
    "90  minutes ago": "2024-01-31 22:30:00",
    "Monday, January 1st, 2024": "2024-01-01 00:00:00",
    "Monday 1 January 2024": "2024-01-01 00:00:00",
    "Tuesday, 1 January 2024": "2024-01-01 00:00:00",
    "Sunday January 7, 2024": "2024-01-07 00:00:00",
    "article POSTED on Published on 02nd March 2024": "2024-03-02 00:00:00",
    "March 5 2024": "2024-03-05 00:00:00",
    "Last Updated on March 5, 2024 at noon": "2024-03-05 00:00:00",
    "5 sep 2024": "2024-09-05 00:00:00",
    "so 5 Sep 2024": None,
    "2024-3-5": "2024-03-05 00:00:00",
    "2024-03-05T10:00:00+0100": "2024-03-05 09:00:00",
    "2024-03-05T10:00:00Z": "2024-03-05 10:00:00",
    "2024-03-05T10:00:00": "2024-03-05 10:00:00",
    "30 February 2024": None,
    "131 January 2024": "2024-01-31 00:00:00",
    "": None,
    None: None,
}


def test_council_dates(spark):
    df = spark.createDataFrame(list(DATES.items()), "t string, want string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = df.select("t", "want", F.date_format(dates.council("t", now), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    assert [r for r in got if r["at"] != r["want"]] == []


def test_url_gate(spark):
    cases = {
        "https://www.x.org/news/a": True, "https://X.org/news/a": True, "https://y.org/news/a": False, "/news/a": True, "": False, None: False,
        "https://x.org/about-us/a": False, "https://x.org/abouts/a": True, "https://x.org/a/results//": False, "https://x.org/results/a": True,
        "https://x.org/a#b": False, "mailto:a@x.org": False, "https://x.org/a/join;p=1": False,
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want boolean")
    got = df.select("u", "want", filters.url_allowed("u", F.lit("https://www.x.org/")).alias("ok")).collect()
    assert [r for r in got if r["ok"] != r["want"]] == []
    one = lambda u, **k: spark.range(1).select(filters.url_allowed(F.lit(u), F.lit("https://x.org"), **k)).first()[0]
    assert one("https://y.org/a", same_host=False) and one("https://x.org/A1", include=(r"a\d$",)) and not one("https://x.org/a", include=("b",))
    assert not one("https://x.org/a(", exclude=("a(",)) and one("https://x.org/a", exclude=("a(",))


def test_detail_lines(spark):
    rows = [
        (["x", "Download text", "y", "DOWNLOAD TEXT", "Title", "Body", " By: me", "Mon, Jan 1", "J Log out", "end"], "title ", 9, ["Body"]),
        (["download text"], "", 1, []),
        (["a", "b"], None, -1, []),
        (["a", "b"], None, 9, ["a", "b"]),
        ([], "t", 3, []),
        (["a", "download text"], "t", 2, []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, t string, n int, want array<string>")
    got = df.select("want", desk.detail_lines(F.col("l"), "t", F.col("n")).alias("own")).collect()
    assert [r for r in got if r["own"] != r["want"]] == []
