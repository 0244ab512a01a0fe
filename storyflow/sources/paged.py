"""A paged interface as a data source, and the ledger that keeps each of its items once.

``spark.readStream.format("paged_items")`` reads a window of time with every batch: from the
end of the last one, less an overlap for items that came late, but no further back than some
hours; up to now.  The pages of a window are read by tasks of their own.  A page that fails
fails its batch, whose offset is then not committed: the next run reads the same window
again.  :func:`collect` lets each item through once, whatever was read twice.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
ITEM = "id string, created timestamp, payload string"


def instant(text: str) -> datetime | None:
    """ISO text as a time in UTC; None if it is no time or has no zone."""
    try:
        found = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return found.astimezone(UTC) if found.tzinfo else None


@lru_cache(maxsize=4)
def _groups(root: str, files: tuple[str, ...]) -> list[tuple]:
    """Latest and earliest time, number of rows with a time and reader of each row group of a Parquet table."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    utc, moment, out = pa.timestamp("us", "UTC"), timedelta(microseconds=1), []
    for f in ds.dataset(root, format="parquet").get_fragments():
        f.ensure_complete_metadata()
        for group in f.row_groups:
            part, meta = f.subset(row_group_ids=[group.id]), f.metadata.row_group(group.id)
            found = next((c.statistics for c in map(meta.column, range(meta.num_columns)) if c.path_in_schema == "created"), None)
            if found is not None and found.has_min_max and found.has_null_count and isinstance(found.max, datetime):
                least, most, n = found.min, found.max, meta.num_rows - found.null_count
            else:
                times = part.to_table(columns={"created": pc.field("created").cast(utc)}).column(0)
                span, n = pc.min_max(times), len(times) - times.null_count
                least, most = span["min"].as_py(), span["max"].as_py()
            if n:
                aware = lambda t: t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
                out.append((aware(most) + moment, aware(least) - moment, n, part))
    return sorted(out, key=lambda g: g[0], reverse=True)


def parquet_pages(root: str, lower: datetime, upper: datetime, offset: int, limit: int) -> dict:
    """The built-in interface: a Parquet table (id, created, payload), newest first, as if it were served by pages.

    The footers tell how many rows each row group holds and of what times, so how many rows come before it at least and
    at most; a page reads only the groups that these allow to hold a row of it.  Of a table that is written in the order of time
    these are two or three, also where rows of one time lie in several."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    created = pc.field("created").cast(pa.timestamp("us", "UTC"))
    within = (created >= lower) & (created <= upper)
    groups = [g for g in _groups(root, tuple(ds.dataset(root, format="parquet").files)) if g[0] >= lower and g[1] <= upper]
    n = np.array([g[2] if lower <= g[1] and g[0] <= upper else g[3].count_rows(filter=within) for g in groups], np.int64)
    latest, earliest = (np.array([(g[i] - EPOCH) // timedelta(microseconds=1) for g in groups], np.int64) for i in (0, 1))

    def rows_after(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows of the groups whose bound is greater than each of ``at``."""
        order = np.argsort(bounds)
        sums = np.concatenate([[0], np.cumsum(n[order])])
        return sums[-1] - sums[np.searchsorted(bounds[order], at, "right")]

    total = int(n.sum())
    first = rows_after(earliest, latest)  # groups wholly later
    last = total - rows_after(-latest, -earliest)  # all but groups wholly earlier
    chosen = np.nonzero((first < offset + limit) & (last > offset) & (n > 0))[0]
    before = int(n[last <= offset].sum())
    rows = []
    if len(chosen):
        found = pa.concat_tables([groups[i][3].to_table(filter=within, columns=["id", "created", "payload"]) for i in chosen])
        rows = found.sort_by([("created", "descending"), ("id", "descending")]).slice(offset - before, limit).to_pylist()
    return {"item": [{"id": r["id"], "created": r["created"].replace(tzinfo=UTC).isoformat(), "payload": r["payload"]} for r in rows], "total": total}


@dataclass
class Page(InputPartition):
    """A page of a window."""

    lower: datetime
    upper: datetime
    offset: int


class _Pages:
    """What batch and stream have in common; see :class:`PagedItems`."""

    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", options.get("root", ""))
        self.fetcher = options.get("fetch", "storyflow.sources.paged:parquet_pages")
        self.size, self.most = int(options.get("pagesize", 50)), int(options.get("mostpages", 100))
        self.window, self.overlap = timedelta(hours=float(options.get("hours", 72))), timedelta(minutes=float(options.get("overlapminutes", 10)))
        self.clock, self.since = options.get("now", ""), options.get("last", "")

    def now(self) -> datetime:
        """The clock; ``now`` may name a time, or a file that holds one."""
        if not self.clock:
            return datetime.now(UTC)
        found = instant(self.clock)
        if found is None:
            with open(self.clock) as f:
                found = instant(f.read().strip())
        if found is None:
            raise ValueError(f"no time with a zone: {self.clock!r}")
        return found

    def fetch(self, page: Page) -> dict:
        module, _, name = self.fetcher.partition(":")
        found = getattr(importlib.import_module(module), name)(self.root, page.lower, page.upper, page.offset, self.size)
        if not isinstance(found, dict) or not isinstance(found.get("item"), list):
            raise ValueError("the interface's answer has no list of items")
        return found

    def pages(self, last: datetime | None, now: datetime) -> list[Page]:
        """The pages from ``last`` to ``now``; a ``last`` later than now is none."""
        lower = now - self.window
        if last is not None and last <= now:
            lower = max(lower, last - self.overlap)
        total = self.fetch(Page(lower, now, 0)).get("total")
        if not isinstance(total, int):
            raise ValueError("the interface does not tell how many items there are")
        if total > self.size * self.most:
            raise ValueError(f"{total} items are more than {self.most} pages of {self.size} hold: nothing is read, and no offset committed")
        return [Page(lower, now, at) for at in range(0, total, self.size)]

    def read(self, page: Page) -> Iterator[tuple]:
        for item in self.fetch(page)["item"]:
            created = instant(item.get("created", "")) if isinstance(item, dict) else None
            if created is None or not str(item.get("id") or "").strip() or not page.lower <= created <= page.upper:
                continue
            payload = item.get("payload")
            yield (str(item["id"]).strip(), created, payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False))


class _Batch(_Pages, DataSourceReader):
    def partitions(self):
        return self.pages(instant(self.since), self.now())


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": ""}

    def latestOffset(self) -> dict:
        return {"until": self.now().isoformat()}

    def partitions(self, start: dict, end: dict):
        return self.pages(instant(start["until"]), instant(end["until"]))

    def commit(self, end: dict) -> None:
        pass


class PagedItems(DataSource):
    """``id, created, payload`` of a paged interface's items.

    Options: ``path`` (handed to the interface), ``fetch`` (module:function of the interface, which takes
    path, from, to, offset and limit and gives {"item": [...], "total": n}), ``pageSize`` (50), ``mostPages``
    (100; a larger window fails), ``hours`` (72), ``overlapMinutes`` (10), ``now`` and, for a batch, ``last``.
    Items without an id or a time, or of a time outside the window, are passed over."""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def collect(stream: DataFrame, store: str, checkpoint: str, outcome=None) -> None:
    """Runs ``stream`` (:class:`PagedItems`) up to now: items that the ledger does not hold go to
    ``store``/items, and with ``outcome`` (a column; else ``new``) to ``store``/ledger.

    Both are folders by batch.  A batch that is run again after a failure replaces its own,
    and is held against the others' alone, so nothing is lost and nothing kept twice."""
    spark = stream.sparkSession
    ledger_schema = "id string, created timestamp, outcome string, batch long"

    def write(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        once = batch.groupBy("id").agg(F.max(F.struct("created", "payload")).alias("v")).select("id", "v.*")
        if fs.exists(path):
            known = spark.read.schema(ledger_schema).parquet(f"{store}/ledger").where(F.col("batch") < number).select("id")
            once = once.join(known, "id", "left_anti")
        once = once.withColumn("outcome", F.lit("new") if outcome is None else outcome)
        once.write.mode("overwrite").parquet(f"{store}/items/batch={number}")
        spark.read.schema(once.schema).parquet(f"{store}/items/batch={number}").select("id", "created", "outcome").write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(once=True).foreachBatch(write).start().awaitTermination()
