"""The paged source and its ledger: windows, failures in the middle, restarts."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException

from storyflow.sources import paged

NOW = datetime.datetime(2024, 1, 20, 12, tzinfo=datetime.UTC)
ITEM = "id string, created timestamp, payload string"


def hours(n):
    return NOW - datetime.timedelta(hours=n)


def put(spark, folder, rows, mode="overwrite"):
    spark.createDataFrame([(i, t.replace(tzinfo=None), f"p{i}") for i, t in rows], ITEM).coalesce(1).write.mode(mode).parquet(folder)


def flaky(root, lower, upper, offset, limit):
    """An interface whose third page fails while a file stands beside the table."""
    import os

    if offset == 2 * limit and os.path.exists(f"{root}.broken"):
        raise OSError("page 3 cannot be read")
    return paged.parquet_pages(root, lower, upper, offset, limit)


@pytest.fixture()
def source(spark, tmp_path):
    spark.dataSource.register(paged.PagedItems)
    clock = tmp_path / "clock"
    clock.write_text(NOW.isoformat())
    table = str(tmp_path / "table")
    put(spark, table, [(f"a{i}", hours(i * 10)) for i in range(10)] + [("future", hours(-1)), ("same", hours(5)), ("same", hours(5))])

    def stream(**options):
        return spark.readStream.format("paged_items").options(pageSize=2, now=str(clock), fetch="tests.test_paged:flaky", **options).load(table)

    return stream, table, clock, tmp_path


def ids(spark, store):
    return sorted((r["id"], r["batch"]) for r in spark.read.parquet(f"{store}/items").collect())


def test_a_run_cut_in_the_middle_loses_and_doubles_nothing(spark, source):
    stream, table, clock, tmp_path = source
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    open(f"{table}.broken", "w").close()
    with pytest.raises(StreamingQueryException):
        paged.collect(stream(), store, state)
    import os

    assert not os.path.exists(f"{store}/items")  # a page failed: nothing was taken, no offset committed
    os.remove(f"{table}.broken")
    clock.write_text((NOW + datetime.timedelta(hours=2)).isoformat())
    paged.collect(stream(), store, state)
    first = [(f"a{i}", 0) for i in range(8)] + [("same", 0)]  # 72 hours back from the time of the window that failed
    assert ids(spark, store) == first
    # The overlap reads the last minutes again; what came late is taken, what is known is not.
    put(spark, table, [("late", NOW - datetime.timedelta(minutes=5)), ("too late", NOW - datetime.timedelta(minutes=15)), ("new", hours(-2))], "append")
    paged.collect(stream(), store, state)
    assert ids(spark, store) == sorted([*first, ("future", 1), ("late", 1), ("new", 1)])
    # A batch whose commit was lost is run again: it replaces itself.
    newest = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").split(".")[0] == str(newest):  # with its checksum
            os.remove(f"{state}/commits/{name}")
    paged.collect(stream(), store, state)
    got = ids(spark, store)
    assert len({i for i, _ in got}) == len(got) and {i for i, _ in got} >= {"late", "new", "future"}


def test_too_large_a_window_fails_whole(spark, source):
    stream, _, _, tmp_path = source
    with pytest.raises(StreamingQueryException, match="more than 2 pages"):
        paged.collect(stream(mostPages=2), str(tmp_path / "s"), str(tmp_path / "c"))


def test_batch_read_has_the_same_window(spark, source):
    _, table, _, _ = source
    read = lambda **o: sorted(r["id"] for r in spark.read.format("paged_items").options(pageSize=3, now=NOW.isoformat(), **o).load(table).collect())
    assert read() == sorted([*[f"a{i}" for i in range(8)], "same", "same"])
    assert read(last=hours(12).isoformat()) == ["a0", "a1", "same", "same"]
    assert read(last=hours(-5).isoformat()) == read()  # a last run in the future is none
    assert read(hours=1) == ["a0"]


def test_times_without_a_zone_are_none():
    assert paged.instant("2024-01-01T00:00:00") is None and paged.instant("x") is None and paged.instant("2024-01-01T01:00:00+01:00") == datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def test_a_page_reads_the_row_groups_that_it_is_in(tmp_path, monkeypatch):
    import random
    from datetime import UTC, datetime, timedelta

    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    from storyflow.sources import paged

    rnd, zero = random.Random(3), datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(str(i), None if i % 50 == 0 else zero + timedelta(minutes=rnd.randrange(2000)), "p") for i in range(3000)]
    for name, given, kind in (("mixed", rows, pa.timestamp("us")), ("sorted", sorted(rows, key=lambda r: (r[1] or zero, r[0]), reverse=True), pa.timestamp("us", "UTC"))):
        (tmp_path / name).mkdir()
        for f in range(3):
            part = given[f * 1000 : f * 1000 + 1000]
            t = pa.table({"id": [r[0] for r in part], "created": pa.array([r[1] and (r[1] if kind.tz else r[1].replace(tzinfo=None)) for r in part], kind), "payload": [r[2] for r in part]})
            pq.write_table(t, str(tmp_path / name / f"{f}.parquet"), row_group_size=100, write_statistics=name == "sorted")
        for lower, upper in ((0, 2000), (300, 1500), (700, 701), (5000, 6000)):
            low, up = zero + timedelta(minutes=lower), zero + timedelta(minutes=upper)
            want = [r[0] for r in sorted((r for r in rows if r[1] and low <= r[1] <= up), key=lambda r: (r[1], r[0]), reverse=True)]
            got = []
            for at in range(0, len(want) + 1, 70):
                page = paged.parquet_pages(str(tmp_path / name), low, up, at, 70)
                assert page["total"] == len(want)
                got += [r["id"] for r in page["item"]]
            assert got == want
    seen = []
    table = pa.concat_tables
    monkeypatch.setattr(pa, "concat_tables", lambda ts: (seen.extend(t.num_rows for t in ts), table(ts))[1])
    paged.parquet_pages(str(tmp_path / "sorted"), zero, zero + timedelta(days=9), 1500, 70)
    assert 70 <= sum(seen) <= 500
