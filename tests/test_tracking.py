"""Refreshes as a stream against the batch form, refresh by refresh, restarts included."""

import datetime
import random

from storyflow.operators.lineage import written
from storyflow.streaming import state, tracking

ITEM = "module string, refresh long, day date, key string, pos long"
DAY = datetime.date(2024, 1, 1)


def made(seed=3):
    rnd = random.Random(seed)
    rows = []
    for module in ("sport", "police", "council"):
        for refresh in range(1, 13):
            if module == "council" and refresh in (4, 5):
                continue
            keys = [f"k{rnd.randrange(40):02d}" for _ in range(rnd.choice([3, 8, 14]))]
            rows += [(module, refresh, DAY + datetime.timedelta(days=refresh // 4), k, i) for i, k in enumerate(keys + keys[:2])]
    return rows


def in_batch(spark, rows, most):
    """``remembered`` refresh by refresh, and the sets of each day."""
    known = spark.createDataFrame([], "module string, key string, place long")
    today, out = {}, {}
    for refresh in sorted({r[1] for r in rows}):
        items = spark.createDataFrame([r for r in rows if r[1] == refresh], ITEM)
        found, known = state.remembered(known, items, most, "pos")
        known = written(known)
        day = next(r[2] for r in rows if r[1] == refresh)
        for r in found.collect():
            n = out.setdefault((r["module"], refresh), [0, 0])
            n[0] += 1
            n[1] += r["new"]
            if r["new"]:
                today.setdefault((r["module"], day), set()).add(r["key"])
        for m in {r[0] for r in rows if r[1] == refresh}:
            out[m, refresh].append(len(today.get((m, day), ())))
    return sorted((m, r, *v) for (m, r), v in out.items())


def reports(df):
    return sorted((r["module"], r["refresh"], r["found"], r["new"], r["updates_today"]) for r in df.collect())


def put(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))


def stream(spark, tmp_path, most):
    items = spark.readStream.schema(ITEM).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return tracking.stream_refreshes(items, most)


def test_stream_is_the_batch_refresh_by_refresh(spark, tmp_path):
    rows = made()
    most = 12  # keys fall out and are new again
    for refresh in range(1, 7):
        mine = [r for r in rows if r[1] == refresh]
        put(spark, tmp_path, f"{refresh:02d}a", mine[: len(mine) // 2])  # a refresh over two micro-batches
        put(spark, tmp_path, f"{refresh:02d}b", mine[len(mine) // 2 :])
    where = {"into": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}
    keys = ["module", "refresh"]
    first = reports(tracking.finished(stream(spark, tmp_path, most), keys, **where))
    assert first == in_batch(spark, [r for r in rows if r[1] <= 6], most)
    assert any(new and found for _, _, found, new, _ in first)
    # A new query from the checkpoint, with several refreshes in one micro-batch.
    put(spark, tmp_path, "later", [r for r in rows if r[1] > 6])
    assert reports(tracking.finished(stream(spark, tmp_path, most), keys, **where)) == in_batch(spark, rows, most)


def test_late_and_empty_rows(spark, tmp_path):
    put(spark, tmp_path, "1", [("m", 1, DAY, "a", 0), ("m", 3, DAY, "b", 0), ("m", 3, DAY, None, 0), (None, 3, DAY, "x", 0), ("m", None, DAY, "x", 0)])
    put(spark, tmp_path, "2", [("m", 2, DAY, "c", 0)])
    got = tracking.finished(stream(spark, tmp_path, 5), ["module", "refresh"], into=str(tmp_path / "o"), checkpoint=str(tmp_path / "s"))
    assert sorted((r["refresh"], r["found"], r["new"], r["late"]) for r in got.collect()) == [(1, 1, 0, 0), (3, 1, 1, 1)]
