"""State over refreshes: first-seen keys, incremental windows and staging, in batch form, and
the same over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(items: DataFrame) -> DataFrame:
    """``module, day, found, new``: keys first seen on each day of a module.  The first day sets
    the baseline and counts nothing as new.  ``items``: module, day, key."""
    first = items.groupBy("module", "key").agg(F.min("day").alias("day"))
    found = first.groupBy("module", "day").agg(F.count("*").alias("found"))
    base = found.groupBy("module").agg(F.min("day").alias("base"))
    return found.join(base, "module").select("module", "day", "found", F.when(F.col("day") == F.col("base"), 0).otherwise(F.col("found")).cast("long").alias("new"))


def remembered(known: DataFrame, items: DataFrame, most: int = 5000, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One refresh against a bounded memory: each (module, key) of ``items`` once, with ``new``, and the memory after it.

    ``known`` holds module, key and place, which rises with arrival.  A key is new if its
    module has a memory without it; the first refresh of a module only fills it, in order of
    ``pos`` if that is given.  Later new keys come after the known ones, sorted; the last
    ``most`` stay, so a key that fell out is new again.  A null key is no key."""
    arrival = F.min(pos) if pos else F.lit(0)
    seen = items.where(F.col("module").isNotNull() & F.col("key").isNotNull()).groupBy("module", "key").agg(arrival.cast("long").alias("_pos"))
    old = known.select("module", "key", F.lit(True).alias("_old"))
    begun = known.select("module").distinct().withColumn("_begun", F.lit(True))
    marked = seen.join(old, ["module", "key"], "left").join(begun, "module", "left")
    found = marked.select("module", "key", (F.col("_begun").isNotNull() & F.col("_old").isNull()).alias("new"))
    added = marked.where("_old IS NULL").select("module", "key", F.lit(1).alias("_late"), F.when(F.col("_begun").isNull(), F.col("_pos")).otherwise(0).alias("place"))
    both = known.select("module", "key", F.lit(0).alias("_late"), F.col("place").cast("long").alias("place")).unionByName(added)
    back = Window.partitionBy("module").orderBy(F.desc("_late"), F.desc("place"), F.desc("key"))
    kept = both.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most)
    return found, kept.select("module", "key", (-F.col("_n")).cast("long").alias("place"))


def change_label(count: Column, previous: Column, new: Column) -> Column:
    """What a refresh shows: the baseline, what is new, or the updates of today."""
    return F.when(previous.isNull(), "Baseline established").when(new > 0, F.concat(F.lit("+"), new.cast("string"), F.lit(" since previous refresh"))).otherwise(F.concat(count.cast("string"), F.lit(" updates today")))


def incremental(items: DataFrame, when: str, key: str, ledger: DataFrame, now: Column, last: Column, *, hours: int = 72, overlap_minutes: int = 10) -> DataFrame:
    """Items after the later of ``hours`` before now and the last checkpoint with its overlap,
    up to now, but for those in the ledger."""
    low = F.greatest(now - F.expr(f"INTERVAL {hours} HOURS"), last - F.expr(f"INTERVAL {overlap_minutes} MINUTES"))
    return items.where((F.col(when) > low) & (F.col(when) <= now)).join(ledger.select(key).distinct(), key, "left_anti")


def staged(items: DataFrame, drafts: DataFrame, deleted: DataFrame, key: str, *, update_existing: bool = False) -> DataFrame:
    """What staging does with each item: nothing for deleted ones; an existing draft is left
    as it is unless told; others are created.  Staging twice does no more than once."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = items.select(key).distinct().join(mark(drafts, "_d"), key, "left").join(mark(deleted, "_x"), key, "left")
    action = F.when(F.col("_x"), "suppressed").when(F.col("_d"), "updated" if update_existing else "unchanged").otherwise("created")
    return out.select(key, action.alias("action"))


def stream_first_seen(items: DataFrame, watermark: str = "30 days") -> DataFrame:
    """The stream form: each (module, key) once within the watermark.  ``items``: module, key, ts."""
    return items.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["module", "key"])


def stream_daily_updates(items: DataFrame, watermark: str = "1 day", future_hours: int = 24, now: Column | None = None) -> DataFrame:
    """The stream form of updates by day: late items go by the watermark, those too far ahead of
    the clock by a bound of their own."""
    clock = F.current_timestamp() if now is None else now
    near = items.where(F.col("ts") <= clock + F.expr(f"INTERVAL {future_hours} HOURS")).withWatermark("ts", watermark)
    return near.groupBy(F.window("ts", "1 day"), "module").agg(F.approx_count_distinct("key", 0.01).alias("updates"))


def to_store(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips empty batches; the write must be idempotent by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)

    return run


def pending(items: DataFrame) -> DataFrame:
    """``module, key, state, at``: an item is staged when its first complete version came, and
    pending, as of its latest version, until then.  ``items``: module, key, at, complete."""
    g = items.groupBy("module", "key").agg(F.bool_or("complete").alias("c"), F.min(F.when(F.col("complete"), F.col("at"))).alias("done"), F.max("at").alias("last"))
    return g.select("module", "key", F.when(F.col("c"), "staged").otherwise("pending").alias("state"), F.when(F.col("c"), F.col("done")).otherwise(F.col("last")).alias("at"))


def delivery_step(current: Column, succeeded: Column) -> Column:
    """The next state of a delivery: queued, sending, then sent or failed, which stay."""
    return F.when(current == "queued", "sending").when(current == "sending", F.when(succeeded, "sent").otherwise("failed")).otherwise(current)
