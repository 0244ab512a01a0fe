"""Look-ups in a store by key and by time: right rows, from few files."""

import datetime

from storyflow.operators import lookup

AT = datetime.datetime(2024, 1, 1)


def scanned(df):
    """How many files the plan's scans read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]


def test_rows_come_from_few_files(spark, tmp_path):
    rows = [(f"a{i:03d}", AT + datetime.timedelta(hours=i * 5) if i % 10 else None, f"t{i}") for i in range(300)] + [(None, AT, "x")]
    store = lookup.KeyedStore(spark, str(tmp_path), buckets=16)
    store.write(spark.createDataFrame(rows, "article_id string, created_at timestamp, title string"))
    one = store.get("a042")
    assert [r["title"] for r in one.collect()] == ["t42"] and scanned(store.get("a042")) == [1]
    assert sorted(r["title"] for r in store.get("a001", "a002", "no").collect()) == ["t1", "t2"]
    assert store.get().count() == 0 and store.get("zzz").count() == 0
    by_time = sorted((r for r in rows if r[0]), key=lambda r: (r[1] is not None, r[1] or AT, r[0]), reverse=True)
    for most in (1, 7, 290, 299, 1000):
        got = store.newest(most, whole=False).collect()
        assert [r["article_id"] for r in got] == [r[0] for r in by_time[:most]]
    assert {r["title"] for r in store.newest(5).collect()} == {r[2] for r in by_time[:5]}
    assert sum(scanned(store.newest(5, whole=False))) <= 3  # of 63 days


def test_an_empty_store(spark, tmp_path):
    store = lookup.KeyedStore(spark, str(tmp_path))
    store.write(spark.createDataFrame([("a", None, "t")], "article_id string, created_at timestamp, title string"))
    assert [r["article_id"] for r in store.newest(3).collect()] == ["a"]
