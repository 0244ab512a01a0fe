"""Clean-ups, run totals, queues and catalogues on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storyflow.functions import urls
from storyflow.operators import reports
from storyflow.sources import feeds

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def frames(spark):
    days = lambda *ds: [(None if d is None else NOW - dt.timedelta(days=d),) for d in ds]
    return {
        "social_drafts": spark.createDataFrame([("2024-01-01",), ("soon",), (None,), ("2024-01-25T00:00:00Z",), ("2024-01-24T23:59:59Z",)], "created_at string"),
        "old_logs": spark.createDataFrame(days(31, 30, 29, None), "modified_at timestamp"),
        "old_cached_images": spark.createDataFrame([(NOW - dt.timedelta(days=20), n) for n in ("a.png", "Newsdesk-Image-Placeholder.PNG", None)], "modified_at timestamp, name string"),
        "feed_snapshot_stories": spark.createDataFrame([], "published timestamp"),
        "own": spark.createDataFrame(days(999), "t timestamp"),
    }


def test_audit_counts_what_a_cleanup_removes(spark):
    before, now = frames(spark), F.lit(NOW)
    audit = reports.cleanup_audit(before, now).first().asDict()
    assert audit == {"social_drafts_removed": 2, "old_logs_removed": 1, "old_cached_images_removed": 2, "feed_snapshot_stories_removed": 0, "sync_runs_removed": 0}
    for kind, left in reports.cleaned(before, now).items():
        assert before[kind].count() - left.count() == audit.get(f"{kind}_removed", 0)
    with pytest.raises(ValueError):
        reports.cleanup_audit({"own": before["own"]}, now)


def test_run_totals(spark):
    sources = spark.createDataFrame([(1, True, True), (1, True, None), (1, None, True), (2, False, False)], "run_id int, attempted boolean, succeeded boolean")
    items = spark.createDataFrame([(1, "collected", True), (1, "duplicate", True), (1, None, None), (3, "rejected", False)], "run_id int, outcome string, newsworthy boolean")
    published = spark.createDataFrame([(1, True), (1, True), (1, None)], "run_id int, succeeded boolean")
    got = {r.run_id: r for r in reports.run_totals(sources, items, published).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one.sources_requested, one.sources_attempted, one.sources_succeeded, one.sources_failed, one.source_success_rate) == (3, 2, 1, 1, 50.0)
    assert (one.items_found, one.items_collected, one.items_duplicate, one.items_rejected, one.items_newsworthy) == (3, 1, 1, 0, 1)
    assert (one.publish_attempted, one.publish_succeeded, one.publish_failed, one.publish_success_rate) == (3, 2, 1, 66.67)
    assert (got[2].source_success_rate, got[3].items_rejected, got[3].publish_attempted) == (0.0, 1, 0)


def test_queue_needs_titles(spark):
    schema = "pos int, id string, title string, summary string, priority string, source string, published string, status string"
    good = spark.createDataFrame([(0, None, " a ", None, None, None, None, None), (1, "x", "b", " s ", None, None, None, None)], schema)
    assert [(r.id, r.title, r.summary) for r in reports.queued(good).orderBy("pos").collect()] == [("story-1", "a", ""), ("x", "b", "s")]
    with pytest.raises(Exception, match="non-empty title: 2"):
        reports.queued(good.unionByName(spark.createDataFrame([(2, "y", "  ", *[None] * 5)], schema))).collect()


def test_names_and_rights(spark):
    df = spark.createDataFrame([("", {"standfirst": "s", "intro": "i"}), (None, None), ("own", {"intro": "i"})], "summary string, extras map<string,string>")
    assert [r.s for r in df.select(reports.first_populated(("summary", "standfirst", "intro"), df.columns).alias("s")).collect()] == ["s", "", "own"]
    rows = spark.createDataFrame([("u", "PERMISSION given", None), ("u", None, "newsletter"), ("u", "", "police"), (None, "permission", "newsletter")], "i string, c string, m string")
    assert [r.r for r in rows.select(reports.image_rights("i", "c", "m").alias("r")).collect()] == ["approved", "approved", "not reviewed", "no image"]


def test_catalogue_shapes(spark, tmp_path):
    rows = [{"name": "a"}, {"name": "b", "enabled": False}, {"name": "c", "enabled": True}]
    for name, shape in (("list", rows), ("object", {"version": 2, "sources": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
        assert [r.name for r in feeds.catalogue(spark, str(tmp_path / f"{name}.json")).orderBy("name").collect()] == ["a", "c"]


def test_odd_feeds(spark):
    atom = "<feed><entry><title type='html'>t</title><link href='https://x.org/1' rel='alternate'/><updated>2024-01-01T00:00:00Z</updated></entry></feed>"
    got = feeds.atom_entries(spark.createDataFrame([(1, atom), (2, "<feed/>"), (3, "no xml"), (4, None)], "n int, xml string")).collect()
    assert [(r.n, r.title, r.url, r.summary, r.author, r.tags, r.image) for r in got] == [(1, "t", "https://x.org/1", "", "", [], "")]
    rss = "<rss><channel><item><title>t</title><link>https://x.org/1</link><pubDate>2024-01-01</pubDate></item></channel></rss>"
    got = feeds.rss_items(spark.createDataFrame([(1, rss), (2, "<rss/>"), (3, None)], "n int, xml string")).collect()
    assert [(r.n, r.tags, r.image) for r in got] == [(1, [], "")]


def test_video_pages(spark):
    pages = {"<meta property='og:type' content='video.movie'>": True, "<meta content=\"video\" property=\"og:type\">": True, "<meta property='og:video:url' content='x'>": True, "<meta property='og:title' content='video'>": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in pages], "h string")
    for r in df.select("h", urls.video_page("h").alias("v")).collect():
        assert r.v == pages[r.h], r
