"""Modules' refreshes as a stream: keys first seen, a bounded memory of them, and updates of the day.

The state of a module is what a module remembers between refreshes: its last keys in order of
arrival, the keys of the refresh that is under way, and those that were new today.  A refresh may
come in one micro-batch or in several, and a micro-batch may hold several refreshes: a
refresh is closed, and its new keys remembered, when a later one of its module begins.  Until
then each micro-batch that adds to it reports it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import folder

#: Keys of its own that a module remembers.
MOST = 5000
REPORT = "module string, refresh long, day date, found long, new long, updates_today long, late long"
_MEMORY = "refresh long, day date, begun boolean, known array<string>, found array<string>, places array<long>, fresh array<string>, today array<string>, late long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame of a schema, texts as plain objects, also where there are none."""
    kinds = dict(c.split() for c in schema.split(", "))
    types = {"long": "int64", "boolean": "bool", "timestamp": "datetime64[ns]"}
    out = pd.DataFrame(rows, columns=list(kinds), dtype=object)
    return out.astype({c: types.get(k, object) for c, k in kinds.items()})


class Refreshes(StatefulProcessor):
    """The state machine of a module's refreshes; see :func:`stream_refreshes`."""

    def __init__(self, most: int = MOST):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.memory.get() if self.memory.exists() else None
        refresh, day, begun, known, found, places, fresh, today, late = state if state else (None, None, False, [], [], [], [], [], 0)
        known, today = list(known), list(today)
        place = dict(zip(found, places))  # the keys of the open refresh and where they first stood
        new = set(fresh)
        old, of_today = set(known), set(today)
        reports = {}

        def report():
            reports[refresh] = (key[0], refresh, day, len(place), len(new), len(of_today | new), late)

        for number, part in pd.concat(rows).sort_values("refresh", kind="stable").groupby("refresh", sort=True):
            if refresh is not None and number < refresh:
                late += len(part)
                report()
                continue
            if number != refresh:
                if refresh is not None:
                    # Close the open refresh: a first one fills the memory in its own order, later ones add what was new, sorted.
                    known += sorted(new) if begun else sorted(place, key=lambda k: (place[k], k))
                    known, begun, of_today = known[-self.most :], begun or bool(place), of_today | new
                    old = set(known)
                refresh, place, new = int(number), {}, set()
                now = part["day"].iloc[0]
                if now != day:
                    day, of_today = now, set()
            for k, at in zip(part["key"], part["pos"]):
                if k not in place or at < place[k]:
                    place[k] = int(at)
                if begun and k not in old:
                    new.add(k)
            report()
        self.memory.update((refresh, day, begun, known, list(place), list(place.values()), sorted(new), sorted(of_today), late))
        yield frame(list(reports.values()), REPORT)


def stream_refreshes(items: DataFrame, most: int = MOST) -> DataFrame:
    """What each refresh of a module found: ``module, refresh, day, found, new, updates_today, late``.

    ``items``, a stream: module, refresh (a number that rises), day, key, pos.  ``found`` counts
    distinct keys; ``new`` those that the module's memory, its last ``most`` keys, did not hold
    when the refresh began, so that a key that fell out is new again; ``updates_today`` the
    distinct keys that were new on the day.  The first refresh with a key only fills the
    memory.  Rows of a refresh that is closed are not looked at, but counted as ``late`` (over
    all refreshes so far).  Rows without module, refresh or key are no items."""
    rows = items.where("module IS NOT NULL AND refresh IS NOT NULL AND key IS NOT NULL").select("module", F.col("refresh").cast("long").alias("refresh"), F.col("day").cast("date").alias("day"), F.col("key").cast("string").alias("key"), F.coalesce(F.col("pos").cast("long"), F.lit(0).cast("long")).alias("pos"))
    return rows.groupBy("module").transformWithStateInPandas(Refreshes(most), REPORT, "Update", "None")


def finished(stream: DataFrame, keys: list[str], *, mode: str = "update", into: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns its last row for each of ``keys``.

    Each micro-batch replaces a folder of its own, so one that is run again after a failure
    writes nothing twice.  With ``into`` and ``checkpoint`` given, a later call goes on from where
    this one stopped."""
    spark: SparkSession = stream.sparkSession
    into, checkpoint = into or folder(spark), checkpoint or folder(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKSDB)
    try:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    rows = spark.read.schema(stream.schema).parquet(f"{into}/batch=*").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)/", 1).cast("long"))
    if not keys:
        return rows.drop("_batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("r")).select("r.*")
