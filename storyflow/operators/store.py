"""The content store: upserts, dimensions, run logs and retention.

Tables are versioned folders: a new version is written whole, then a pointer names it, and
the one before stays as a backup."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, json_list

#: What an empty new value leaves as it was; and the same for lists as JSON.
KEEP_IF_EMPTY = ("summary", "body", "image_url", "image_caption", "image_credit")
KEEP_IF_NO_LIST = ("categories_json", "authorities_json")


def upsert(old: DataFrame, new: DataFrame, key: str = "article_id") -> DataFrame:
    """``old`` with the rows of ``new``: non-empty values win, ``detail_complete`` only rises,
    other columns are overwritten.  Rows of ``new`` without key, title or url are skipped; of
    several for one key, those of larger ``pos`` come later and win in turn."""
    good = new.where((blank(key) != "") & (blank("title") != "") & (blank("url") != ""))
    columns = [c for c in old.columns if c != key]
    order = F.struct("pos")
    last: dict[str, Column] = {}
    for c in columns:
        if c in KEEP_IF_EMPTY:
            last[c] = F.coalesce(F.max_by(F.when(blank(c) != "", F.col(c)), F.when(blank(c) != "", order)), F.lit(""))
        elif c in KEEP_IF_NO_LIST:
            last[c] = F.coalesce(F.max_by(F.when(blank(c) != "[]", F.col(c)), F.when(blank(c) != "[]", order)), F.lit("[]"))
        elif c == "detail_complete":
            last[c] = F.max(c)
        else:
            last[c] = F.max_by(c, order)
    batch = good.groupBy(key).agg(*[v.alias("_" + c) for c, v in last.items()], F.lit(True).alias("_new"))
    out = old.join(batch, key, "full_outer")
    is_new = F.coalesce("_new", F.lit(False))

    def merged(c: str) -> Column:
        if c in KEEP_IF_EMPTY:
            return F.coalesce(F.nullif(F.col("_" + c), F.lit("")), F.col(c), F.lit(""))
        if c in KEEP_IF_NO_LIST:
            return F.coalesce(F.nullif(F.col("_" + c), F.lit("[]")), F.col(c), F.lit("[]"))
        if c == "detail_complete":
            return F.greatest(c, "_" + c)
        return F.when(is_new, F.col("_" + c)).otherwise(F.col(c))

    return out.select(key, *[merged(c).alias(c) for c in columns])


def dimension_counts(store: DataFrame) -> DataFrame:
    """``dimension, label, count`` by author, type, area and category."""
    named = lambda c: F.coalesce(F.nullif(F.trim(blank(c)), F.lit("")), F.lit("Unknown"))
    cats = json_list("categories_json")
    cats = F.when(F.size(cats) > 0, cats).otherwise(F.array(F.lit("Not downloaded / uncategorised")))
    pair = lambda d, c: F.struct(F.lit(d).alias("dimension"), c.alias("label"))
    all_ = F.concat(
        F.array(pair("Author", named("author")), pair("Type", named("content_type"))),
        F.transform(json_list("authorities_json"), lambda a: pair("Area", a)),
        F.transform(cats, lambda a: pair("Category", a)),
    )
    return store.select(F.explode(all_).alias("d")).groupBy("d.dimension", "d.label").agg(F.count("*").alias("count"))


def summary(store: DataFrame, runs: DataFrame) -> DataFrame:
    """Number of stories, the latest fetch, and the latest successful run."""
    latest = runs.where("status = 'success'").agg(F.max("completed_at").alias("latest_success"))
    return store.agg(F.count("*").alias("stories"), F.max("fetched_at").alias("latest_fetch")).crossJoin(latest)  # one row each


def retained(rows: DataFrame, when: Column, now: Column, days: int, *, keep_missing: bool) -> DataFrame:
    """Rows not older than ``days``; those of a missing date as told."""
    young = F.unix_micros(when) >= F.unix_micros(now) - F.lit(days * 86_400_000_000)
    return rows.where(F.coalesce(young, F.lit(keep_missing)))


def content_retention(store: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Stories not older than ``days`` by creation, else by fetching, their e-mail blanked."""
    when = F.coalesce("created_at", "fetched_at", now)
    return retained(store, when, now, days, keep_missing=True).withColumn("email", F.lit(""))


def latest_runs(runs: DataFrame, most: int = 5, by: str = "module") -> DataFrame:
    """The last runs of each module, with the count before and the change.

    The runs needed are chosen first, one more than are shown, so that Spark limits each
    partition before the shuffle; a module's whole history is never sorted."""
    back = Window.partitionBy(by).orderBy(F.desc("started_at"))
    last = runs.withColumn("n", F.row_number().over(back)).where(F.col("n") <= most + 1)
    return last.withColumn("previous", F.lead("found").over(back)).withColumn("change", F.col("found") - F.col("previous")).where(F.col("n") <= most).select(*runs.columns, "previous", "change", "n")


class Snapshots:
    """Versioned snapshots of a table in a folder: the newest whole one, or the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _pointers(self) -> list[str]:
        """The pointer files, newest first: each has a number higher than those before."""
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted((n for n in names if n.startswith("current-") and n.endswith(".json")), reverse=True)

    def _pointer(self) -> list[str]:
        """The versions that the newest readable pointer names."""
        for name in self._pointers():
            text = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()
            try:
                return list(json.loads(text["value"])["versions"])
            except (ValueError, KeyError, TypeError):
                continue
        return []

    def version(self) -> int:
        """The number of the latest pointer; 0 where nothing was saved."""
        pointers = self._pointers()
        return int(pointers[0][8:-5]) if pointers else 0

    def save(self, df: DataFrame) -> str:
        """Writes a version whole, then a new pointer that names it; a crash at any time leaves the
        pointer before.  At most the version before is kept beside the new one."""
        return self._save(df, None)

    def save_as(self, df: DataFrame, number: int) -> int:
        """As :meth:`save`, but under this number alone: FileExistsError if it, or a later one, is taken."""
        self._save(df, number)
        return number

    def _save(self, df: DataFrame, number: int | None) -> str:
        import uuid

        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        old, pointers = self._pointer(), self._pointers()
        last = int(pointers[0][8:-5]) if pointers else 0
        if number is not None and number <= last:
            self._fs.delete(self._path(name), True)
            raise FileExistsError(f"version {last} of {self.folder} was saved meanwhile")
        number = last + 1 if number is None else number
        draft = self._path(f".draft-{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"versions": [name, *old[:1]]}).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"current-{number:012d}.json")):
            self._fs.delete(draft, False)
            raise FileExistsError(f"another writer has saved version {number} of {self.folder}")
        for gone in pointers:
            self._fs.delete(self._path(gone), False)
        for gone in old[1:]:
            self._fs.delete(self._path(gone), True)
        return name

    def load(self) -> DataFrame | None:
        """The newest version that can be read whole; one that is damaged inside is passed over."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException

        for name in self._pointer():
            try:
                df = self.spark.read.parquet(f"{self.folder}/{name}")
                df.write.format("noop").mode("overwrite").save()
                return df
            except (PySparkException, Py4JJavaError):
                continue
        return None
