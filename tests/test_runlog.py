"""The log of runs, and saves that are refused when another writer was first."""

import datetime

import pytest

from storyflow.operators import runlog

AT = datetime.datetime(2024, 1, 1, 12)


def runs(log):
    return sorted((r["scope"], r["status"], r["discovered"], r["stored"], r["message"], r["completed_at"]) for r in log.runs().collect())


def test_runs_start_end_and_survive_compaction(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path))
    assert log.runs().count() == 0 and log.compact() == 0
    a, b = log.start("all", AT), log.start("sport", AT)
    log.finish(a, discovered=5, stored=3, status="success", when=AT)
    want = [("all", "success", 5, 3, "", AT), ("sport", "running", None, None, "", None)]
    assert sorted(runs(log), key=str) == sorted(want, key=str)
    assert log.compact() == 3 and sorted(runs(log), key=str) == sorted(want, key=str)
    later = AT + datetime.timedelta(hours=1)
    log.finish(b, discovered=1, stored=0, status="failed", message="timeout", when=AT)
    log.finish(b, discovered=2, stored=2, status="success", when=later)
    want = [("all", "success", 5, 3, "", AT), ("sport", "success", 2, 2, "", later)]
    assert runs(log) == want
    assert log.compact() == 2 and runs(log) == want and log.compact() == 0


def test_records_left_twice_by_a_crash_change_nothing(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path))
    log.finish(log.start("all", AT), discovered=1, stored=1, status="success", when=AT)
    log.whole.save(spark.read.schema(runlog.RUN).parquet(f"{tmp_path}/log"))  # committed, and then the crash
    assert runs(log) == [("all", "success", 1, 1, "", AT)]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = runlog.Guarded(spark, str(tmp_path)), runlog.Guarded(spark, str(tmp_path))
    city, town = {"name": "City", "listing_url": "https://c.example/news"}, {"name": "Town", "listing_url": "https://t.example/"}
    _, v1 = one.read()
    _, v2 = two.read()
    assert one.save(city, one.fingerprint(city), v1) == 1
    with pytest.raises(runlog.Conflict):
        two.save(town, two.fingerprint(town), v2)
    rows, v2 = two.read()
    assert [r["name"] for r in rows.collect()] == ["City"]
    assert two.save(town, two.fingerprint(town), v2) == 2
    # The race itself: both have passed the check of the version, and write the same number.
    with pytest.raises(runlog.Conflict):
        one._replace(one.read()[0], 1)
    assert sorted(r["name"] for r in one.read()[0].collect()) == ["City", "Town"]


def test_what_is_not_saved_or_deleted(spark, tmp_path):
    t = runlog.Guarded(spark, str(tmp_path))
    city = {"name": "City", "listing_url": "https://c.example/news", "source_id": "c", "managed_by": "built-in"}
    v = t.save(city, t.fingerprint(city), 0)
    with pytest.raises(RuntimeError, match="must succeed"):
        t.save({**city, "sport": "Football"}, t.fingerprint(city), v, current_id="c")
    with pytest.raises(ValueError, match="same name.*same listing URL"):
        same = {"name": " city ", "listing_url": "https://C.example/news/"}
        t.save(same, t.fingerprint(same), v)
    with pytest.raises(ValueError, match="required"):
        t.save({"name": " "}, t.fingerprint({"name": " "}), v)
    other = {"name": "X", "listing_url": "https://x.example"}
    with pytest.raises(KeyError):
        t.save(other, t.fingerprint(other), v, current_id="gone")
    with pytest.raises(PermissionError):
        t.delete("c", v)
    with pytest.raises(KeyError):
        t.delete("gone", v)
    v = t.save({**other, "source_id": "x"}, t.fingerprint(other), v)
    v = t.save({**city, "sport": "Football"}, t.fingerprint({**city, "sport": "Football"}), v, current_id="c")
    assert t.delete("x", v) == 4
    assert [(r["source_id"], r["definition"]["sport"]) for r in t.read()[0].collect()] == [("c", "Football")]
