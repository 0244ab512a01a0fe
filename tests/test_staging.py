"""The state machines of staging and delivery: stream against batch, and against a plain fold."""

import datetime
import random

from storyflow.streaming import staging, tracking

DAY = datetime.datetime(2024, 1, 1)
VERSION = "module string, identity string, refresh long, at timestamp, complete boolean, drafted boolean, untouched boolean, deleted boolean"


def made():
    rnd = random.Random(4)
    rows = []
    for story in range(40):
        drafted = rnd.random() < 0.5
        fixed = (drafted, drafted and rnd.random() < 0.6, rnd.random() < 0.3)
        for refresh in range(1, 21):
            if rnd.random() < 0.45 or (story % 5 == 0 and 4 < refresh < 14):
                rows.append(("sport", f"s{story}", refresh, DAY + datetime.timedelta(days=refresh), rnd.random() < 0.4, *fixed))
    return rows


def fold(rows, horizon):
    """Refresh by refresh, as a desk keeps its sets: what is known, what is pending, what was upgraded."""
    seen, pending, upgraded, out = {}, set(), set(), []
    for refresh in sorted({r[2] for r in rows}):
        waiting = set()
        for _, story, _, at, complete, drafted, untouched, deleted in [r for r in rows if r[2] == refresh]:
            if story in seen and (at - seen[story]).days > horizon:
                del seen[story]
                upgraded.discard(story)
            new = story not in seen or story in pending
            if refresh == 1:
                action = "baseline"
            elif not complete:
                action = "pending" if new else "ignored"
            elif untouched and story not in upgraded:
                action = "upgraded"
                upgraded.add(story)
            elif not new:
                action = "ignored"
            else:
                action = "suppressed" if deleted else "unchanged" if drafted else "created"
            if action == "pending":
                waiting.add(story)
            seen[story] = at
            out.append((story, refresh, action))
        pending = waiting
    return sorted(out)


def actions(df):
    return sorted((r["identity"], r["refresh"], r["action"]) for r in df.collect())


def test_windows_and_stream_are_the_fold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = made()
    want = fold(rows, 6)
    assert {a for _, _, a in want} == {"baseline", "pending", "created", "unchanged", "upgraded", "suppressed", "ignored"}
    assert actions(staging.staging_actions(spark.createDataFrame(rows, VERSION), 6)) == want
    source = spark.readStream.schema(VERSION).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    where = {"into": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state"), "mode": "append"}
    for part, refreshes in enumerate(((1, 2, 3), (4,), range(5, 15), range(15, 21))):
        spark.createDataFrame([r for r in rows if r[2] in refreshes], VERSION).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        if part in (1, 3):  # the second call starts from the checkpoint of the first
            got = tracking.finished(staging.stream_staging(source, 6), [], **where)
            assert actions(got) == [x for x in want if x[1] <= max(refreshes)]


def test_versions_with_drafts_and_odd_rows(spark):
    items = spark.createDataFrame([("sport", "a", 2, DAY, True, "The teaser"), ("sport", "b", 2, DAY, None, None), ("sport", None, 2, DAY, True, ""), (None, "a", 2, DAY, True, ""), ("sport", "c", 2, DAY, True, "x")], "module string, identity string, refresh long, at timestamp, complete boolean, teaser string")
    drafts = spark.createDataFrame([("a", " the\n TEASER ", staging.DRAFT_STATUS, ""), ("c", "x", staging.DRAFT_STATUS, "77")], "identity string, text string, status string, delivery_id string")
    deleted = spark.createDataFrame([("a",), ("a",)], "identity string")
    rows = staging.versions(items, drafts, deleted)
    assert sorted((r["identity"], r["complete"], r["drafted"], r["untouched"], r["deleted"]) for r in rows.collect()) == [("a", True, True, True, True), ("b", False, False, False, False), ("c", True, True, False, False)]
    assert actions(staging.staging_actions(rows)) == [("a", 2, "upgraded"), ("b", 2, "pending"), ("c", 2, "unchanged")]
    assert staging.staging_actions(rows.limit(0)).count() == 0


EVENT = "draft_id string, at timestamp, event string"


def test_a_delivery_is_started_once_and_times_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda minutes: DAY + datetime.timedelta(minutes=minutes)
    first = [("a", at(0), "queue"), ("a", at(1), "start"), ("a", at(2), "start"), ("a", at(3), "sent"), ("a", at(4), "queue"), ("b", at(0), "queue"), ("b", at(1), "start"), ("c", at(0), "start"), ("d", at(0), "queue"), ("d", at(1), "start"), ("d", at(2), "failed"), ("d", at(3), "queue"), (None, at(1), "queue")]
    later = [("b", at(50), "start"), ("b", at(51), "sent"), ("e", at(200), "queue")]
    source = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    where = {"into": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state"), "mode": "append"}
    spark.createDataFrame(first, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    tracking.finished(staging.stream_deliveries(source, 30), [], **where)
    spark.createDataFrame([*later, ("f", at(60), "queue"), ("f", at(61), "start")], EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    got = tracking.finished(staging.stream_deliveries(source, 30), [], **where)
    steps = {}
    for r in sorted(got.collect(), key=lambda r: (r["draft_id"], r["at"])):
        steps.setdefault(r["draft_id"], []).append((r["event"], r["state"], r["accepted"]))
    assert steps["a"] == [("queue", "queued", True), ("start", "sending", True), ("start", "sending", False), ("sent", "sent", True), ("queue", "sent", False)]
    assert steps["b"] == [("queue", "queued", True), ("start", "sending", True), ("timeout", "uncertain", True), ("start", "uncertain", False), ("sent", "sent", True)]
    assert steps["c"] == [("start", "", False)]
    assert steps["d"][-1] == ("queue", "queued", True)
    assert steps["f"] == [("queue", "queued", True), ("start", "sending", True), ("timeout", "uncertain", True)]  # by the timer alone
