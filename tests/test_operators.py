"""Cases that the given inputs do not hold, against hand-made results and Python folds."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyflow.functions import dates, text, urls
from storyflow.operators import classify, dedup, filters, ordering, store
from storyflow.sources import feeds, html
from storyflow.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_casefold_keys_and_truncation(spark):
    assert one(spark, text.comparison_key(F.lit("Straße — «É» it's 5_x!"))) == "strasse é its 5_x"
    assert one(spark, text.truncate_dots(F.lit("one two three four"), 12)) == "one two..."
    assert one(spark, text.truncate_dots(F.lit("abcdefghijklmnop"), 10)) == "abcdefg..."
    assert one(spark, text.truncate_dots(F.lit("abcdef"), 2)) == ".."
    assert one(spark, text.slug(F.lit("  Hello, World!  "))) == "hello-world"
    assert one(spark, text.paragraphs(F.lit("a\nb\n\nc  d\n \n\ne"))) == ["a b", "c d", "e"]
    assert one(spark, text.paragraphs(F.lit("a\n b"))) == ["a", "b"]
    assert one(spark, text.unique_fold(F.array(*map(F.lit, ("B", "b", "a", " ", "A"))))) == ["B", "a"]
    assert one(spark, text.json_list(F.lit("not json"))) == [] and one(spark, text.json_list(F.lit('["a", " ", "b"]'))) == ["a", "b"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("2024-01-05T10:11:12Z", "2024-01-05 10:11:12"), ("2024-01-05T10:11:12+02:00", "2024-01-05 08:11:12"), ("2024-01-05", "2024-01-05 00:00:00"),
        ("Fri, 05 Jan 2024 10:11:12 GMT", "2024-01-05 10:11:12"), ("Fri, 5 Jan 2024 10:11:12 +0100", "2024-01-05 09:11:12"),
        ("Published: 5th January 2024", "2024-01-05 00:00:00"), ("5 Jan 2024", "2024-01-05 00:00:00"), ("05/01/2024", "2024-01-05 00:00:00"), ("09:30 05/01/2024", "2024-01-05 09:30:00"),
        ("soon", None), ("", None), (None, None), ("32 January 2024", None),
    ],
)
def test_dates(spark, given, want):
    got = one(spark, F.date_format(dates.parsed(F.lit(given).cast("string")), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


def test_windows_of_time(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    at = lambda h: now + F.make_dt_interval(F.lit(0), F.lit(h))
    reason = lambda t, **k: one(spark, dates.recency(t, now, days=14, **k))
    assert reason(at(23)) is None and reason(at(24)) is None and reason(at(25)) == "in the future"
    assert reason(at(-14 * 24)) is None and reason(at(-14 * 24 - 1)) == "too old"
    none = F.lit(None).cast("timestamp")
    assert reason(none) == "no date" and reason(none, null_policy="keep") is None
    assert str(one(spark, dates.relative(F.lit("3 days ago"), now))) == "2024-01-29 00:00:00"
    assert str(one(spark, dates.relative(F.lit("Yesterday"), now))) == "2024-01-31 00:00:00"
    assert one(spark, dates.relative(F.lit("sometime"), now)) is None


def test_urls(spark):
    u = F.lit("HTTPS://WWW.Example.com//a//b/?utm_source=x&id=1&GCLID=2#top")
    assert one(spark, urls.query_free(u)) == "https://www.example.com/a/b/"
    assert one(spark, urls.bare(u)) == "https://www.example.com//a//b"
    assert one(spark, urls.tracking_free(u)) == "https://www.example.com//a//b/?id=1"
    assert one(spark, urls.page_key(u)) == "example.com//a//b"
    assert one(spark, urls.article_id(F.lit("https://x/article/123/y"))) == "123"


def test_places_match_words_spaces_and_hyphens(spark):
    found = lambda t, p: one(spark, filters.matched_places(F.lit(t), p))
    assert found("in New-Holland and bostonian", ("Boston", "New Holland")) == ["New Holland"]
    assert found("BOSTON, new  holland", ("Boston", "New Holland")) == ["New Holland", "Boston"]
    assert one(spark, filters.ambiguous_place(F.lit("The village of Ashby is small"), "Ashby")) is True
    assert one(spark, filters.ambiguous_place(F.lit("Ashby " + "x " * 80 + "village"), "Ashby")) is False


def test_multi_key_is_greedy_not_connected(spark):
    rows = [(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, []), (5, ["c", None]), (6, ["c"])]
    df = spark.createDataFrame(rows, "pos long, keys array<string>")
    assert sorted(r["pos"] for r in dedup.multi_key_greedy(df, F.col("keys")).collect()) == [1, 3, 4, 5]


def test_multi_key_is_the_sequential_fold(spark):
    rnd = random.Random(3)
    rows = [(i, [f"{k}{rnd.randint(0, 25)}" for k in "xyz"]) for i in range(120)]
    claimed, want = set(), []
    for p, keys in rows:
        if not claimed & set(keys):
            claimed |= set(keys)
            want.append(p)
    df = spark.createDataFrame(rows, "pos long, keys array<string>").repartition(3)
    assert sorted(r["pos"] for r in dedup.multi_key_greedy(df, F.col("keys")).collect()) == want


def test_near_duplicates_are_the_sequential_fold(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (30, 60, 250)]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, len(t) // 6)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefgh ")
        rows.append((i, "".join(t)))
    rows += [(100, rows[0][1]), (101, rows[5][1])]
    kept, want = [], {}
    for p, t in rows:
        same = next((k for k, u in kept if u == t), None)
        scores = [(SequenceMatcher(None, t, u).ratio(), -k) for k, u in kept]
        best = max(scores, default=(0, 0))
        if same is not None:
            want[p] = same
        elif best[0] >= 0.88:
            want[p] = -best[1]
        else:
            want[p] = None
            kept.append((p, t))
    got = {r["pos"]: r["duplicate_of"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "pos long, t string"), "t").collect()}
    assert {p: v is None for p, v in got.items()} == {p: v is None for p, v in want.items()}
    assert all(got[p] == want[p] for p in range(60))


def test_upsert_keeps_what_is_new_and_empty(spark):
    cols = "article_id string, title string, url string, summary string, categories_json string, detail_complete int"
    old = spark.createDataFrame([("a", "t", "u", "old", '["x"]', 1), ("b", "t", "u", "s", "[]", 0)], cols)
    new = spark.createDataFrame([("a", "T", "u", "", "[]", 0, 1), ("c", "n", "u", "", "[]", 1, 2), ("", "n", "u", "x", "[]", 0, 3), ("d", "", "u", "x", "[]", 0, 4)], cols + ", pos long")
    got = sorted(tuple(r) for r in store.upsert(old, new).collect())
    assert got == [("a", "T", "u", "old", '["x"]', 1), ("b", "t", "u", "s", "[]", 0), ("c", "n", "u", "", "[]", 1)]
    assert sorted(store.upsert(old, new.limit(0)).collect()) == sorted(old.collect())


def test_snapshots_fall_back(spark, tmp_path):
    import shutil

    s = store.Snapshots(spark, str(tmp_path / "snap"))
    assert s.load() is None
    s.save(spark.range(3))
    s.save(spark.range(4))
    newest = s.save(spark.range(5))
    assert s.load().count() == 5
    shutil.rmtree(tmp_path / "snap" / newest)
    assert s.load().count() == 4


def test_classifier_by_hand(spark):
    lex = (("A", 50, {"crown court": 10, "court": 8}), ("B", 60, {"car": 4}))
    df = spark.createDataFrame([(1, "Crown Court", "", "The career of a court."), (2, "car", "car", "car"), (3, "x", "", "")], "pos long, title string, summary string, body string")
    got = {r["pos"]: r for r in classify.classified(df, lex, ("court",)).collect()}
    assert got[1]["scores"] == {"A": 62} and got[1]["primary"] == "A" and got[1]["priority"] == 55 and got[1]["breaking"]
    assert got[1]["confidence"] == 1.0 and got[1]["matched"] == {"crown court": 30, "court": 32}
    assert got[2]["scores"] == {"B": 24} and got[2]["confidence"] == 0.74
    assert (got[3]["primary"], got[3]["priority"], got[3]["confidence"]) == ("Other", 25, 0.0)


def test_orders_of_missing_dates(spark):
    rows = [(1, "b", dt.datetime(2024, 1, 1)), (2, "a", None), (3, "C", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "pos long, title string, published timestamp")
    order = lambda *a, **k: [r["pos"] for r in ordering.sorted_stories(df, *a, **k).collect()]
    assert order("newest") == [3, 1, 2] and order("oldest") == [2, 1, 3] and order("oldest", missing="last") == [1, 3, 2]
    assert order("a-z") == [2, 1, 3] and order("z-a") == [3, 1, 2]


PAGE = """<html><head><title>T</title><meta property="og:title" content="Open"><link rel=canonical href="https://x/a">
<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "author": [{"name": "Ann"}], "datePublished": "2024-01-05"}]}</script></head>
<body><nav><p>Home page text</p></nav><article class=story><h1>Head</h1><p>First <b>bold<p>Second &amp; last</p><blockquote>Said</blockquote><ul><li>Item<li>Item</ul><p>First bold</p></article><footer><p>Foot</p></footer></body></html>"""


def test_pages(spark):
    root = html.parse(PAGE)
    assert html.blocks(root) == ["First bold", "Second & last", "“Said”", "• Item"]
    assert html.metadata(root) == {"title": "Open", "author": "Ann", "published": "2024-01-05", "canonical": "https://x/a", "image": ""}
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")
    assert [len(r["b"]) for r in df.select(html.article("html")["blocks"].alias("b")).collect()] == [4, 0, 0]


def test_embedded_state(spark):
    state_ = '{"props": {"initialReduxState": {"activityStream": {"messages": {"m1": {"article_id": "9", "title": "N"}, "m2": {"team_id": "4", "title": "M", "fixture": {"fixture_id": "7"}}, "m3": {"title": "x"}}}}}}'
    page = f'<script id="__NEXT_DATA__" type="application/json">{state_}</script>'
    got = feeds.embedded_messages(spark.createDataFrame([(1, page), (2, "none")], "id long, html string")).collect()
    assert sorted((r["id"], r["title"], r["url"]) for r in got) == [(1, "M", "/teams/4/match-centre/7"), (1, "N", "/news/9")]


def test_streams_agree_with_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("module"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.stream_first_seen(s, "60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == e.select("module", "key").distinct().count() == got.select("module", "key").distinct().count()


def test_ranks_across_ranges(spark):
    from pyspark.sql import functions as F

    from storyflow.operators import ordering

    rows = [(i, None if i % 3 == 0 else i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "pos int, k int").repartition(5)
    got = ordering.ranked(df, F.desc_nulls_last("k"), F.asc("pos")).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted((r["rank"], r["pos"]) for r in got) == [(i + 1, r[0]) for i, r in enumerate(want)]
    assert ordering.ranked(df.where("pos < 0"), F.asc("pos")).count() == 0


def test_bounded_memory(spark):
    from storyflow.streaming import state

    known = spark.createDataFrame([], "module string, key string, place long")
    memory = {}
    for keys in (["c", "a", "b", None, "a"], ["d", "a"], ["a", "b", "e"], [], ["c", "d", "e", "a", "b"]):
        rows = [(m, k, i) for m in ("x", "y") for i, k in enumerate(keys) if m == "x" or k != "e"] + [(None, "a", 0)]
        found, known = state.remembered(known, spark.createDataFrame(rows, "module string, key string, at int"), most=3, pos="at")
        known = spark.createDataFrame(known.collect(), known.schema)
        want = set()
        for m in ("x", "y"):
            came = list(dict.fromkeys(k for n, k, _ in rows if n == m and k))
            now = set(came)
            fresh = now - set(memory.get(m, []))
            want |= {(m, k, m in memory and k in fresh) for k in now}
            if now or m in memory:
                memory[m] = [*memory.get(m, []), *(sorted(fresh) if m in memory else came)][-3:]
        assert {tuple(r) for r in found.collect()} == want
        kept = [(r["module"], r["key"]) for r in known.orderBy("module", "place").collect()]
        assert kept == [(m, k) for m in sorted(memory) for k in memory[m]]
