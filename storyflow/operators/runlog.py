"""The log of runs, and tables that are saved only by those who have read their latest version."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, casefold
from .desk import definition_fingerprint
from .store import Snapshots

RUN = "run_id string, started_at timestamp, completed_at timestamp, scope string, discovered long, stored long, status string, message string, seq long"


class RunLog:
    """Runs in an append-only folder: a record when one starts and another when it ends; the later one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.whole = Snapshots(spark, f"{self.folder}/whole")

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def start(self, scope: str, when: datetime | None = None) -> str:
        """Logs a run as ``running`` and returns its id."""
        run = uuid.uuid4().hex
        self._append(run, when or datetime.now(UTC), None, scope, None, None, "running", "", 0)
        return run

    def finish(self, run_id: str, *, discovered: int, stored: int, status: str, message: str = "", when: datetime | None = None) -> None:
        """Logs how a run ended.  Of several endings the last one counts."""
        when = when or datetime.now(UTC)
        self._append(run_id, None, when, None, discovered, stored, status, message, int(when.timestamp() * 1_000_000))

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def records(self) -> DataFrame:
        """All records, compacted ones included."""
        none = self.spark.createDataFrame([], RUN)
        log = self.spark.read.schema(RUN).parquet(f"{self.folder}/log") if self._there("log") else none
        whole = self.whole.load()
        return log if whole is None else log.unionByName(whole)

    def runs(self) -> DataFrame:
        """The runs as they stand: what was logged at the start, overlaid with the last ending."""
        return latest(self.records())

    def compact(self) -> int:
        """Merges the small files that are there now into one version; returns how many there were.

        The version is committed before they are deleted; a crash between leaves records twice,
        which changes no run."""
        if not self._there("log"):
            return 0
        files = self.spark.read.schema(RUN).parquet(f"{self.folder}/log").inputFiles()
        if not files:
            return 0
        merged = self.spark.read.schema(RUN).parquet(*files)
        whole = self.whole.load()
        self.whole.save((merged if whole is None else merged.unionByName(whole)).distinct())
        for f in files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        return len(files)


def latest(records: DataFrame) -> DataFrame:
    """One row a run of records (:data:`RUN`): the start's values, and those of the ending with the highest ``seq``."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return records.groupBy("run_id").agg(*[last(c) for c in ("started_at", "completed_at", "scope", "discovered", "stored", "status", "message")])


class Conflict(Exception):
    """Another writer has saved since the table was read."""


class Guarded:
    """Source definitions (source_id, name, listing_url, managed_by, definition: a map) in versions.

    Every change names the version it was made from, and is refused if that is no longer
    the latest; of two writers who read the same version, one is refused."""

    SCHEMA = "source_id string, name string, listing_url string, managed_by string, definition map<string,string>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Snapshots(spark, folder)

    def read(self) -> tuple[DataFrame, int]:
        """The definitions and their version."""
        version = self.store.version()
        found = self.store.load() if version else None
        return (self.spark.createDataFrame([], self.SCHEMA) if found is None else found), version

    def _replace(self, df: DataFrame, version: int) -> int:
        try:
            return self.store.save_as(df.select("source_id", "name", "listing_url", "managed_by", "definition"), version + 1)
        except FileExistsError as e:
            raise Conflict(str(e)) from e

    def save(self, definition: dict[str, str], tested: str, version: int, *, current_id: str = "") -> int:
        """Adds a definition, or replaces that of ``current_id``; returns the new version.

        ``tested`` is the fingerprint of the definition that was tested: another one is not saved.
        Name and listing address must be no other source's."""
        rows, now = self.read()
        if now != version:
            raise Conflict(f"version {now} was saved after {version} was read")
        name, url = definition.get("name", "").strip(), definition.get("listing_url", "").strip()
        if not name:
            raise ValueError("Source name is required.")
        bare = {k: v for k, v in definition.items() if k != "source_id" and v}
        if self.fingerprint(bare) != tested:
            raise RuntimeError("Test Source must succeed before saving changes.")
        others = rows.where(F.col("source_id") != current_id)
        key = lambda c: F.rtrim(casefold(F.trim(blank(c))), F.lit("/"))
        clash = others.agg(F.bool_or(casefold(F.trim(blank("name"))) == casefold(F.lit(name))).alias("n"), F.bool_or((key("listing_url") == key(F.lit(url))) & (key("listing_url") != "")).alias("u")).first()
        errors = [m for m, bad in (("Another source has the same name.", clash["n"]), ("Another source has the same listing URL.", clash["u"])) if bad]
        if errors:
            raise ValueError("; ".join(errors))
        if current_id and rows.where(F.col("source_id") == current_id).isEmpty():
            raise KeyError(f"Source {current_id!r} no longer exists.")
        source_id = current_id or definition.get("source_id") or uuid.uuid4().hex
        mine = self.spark.createDataFrame([(source_id, name, url, definition.get("managed_by", "newsroom"), bare)], self.SCHEMA)
        return self._replace(others.where(F.col("source_id") != source_id).unionByName(mine), version)

    def delete(self, source_id: str, version: int) -> int:
        """Deletes a definition that the newsroom manages; built-in ones are refused."""
        rows, now = self.read()
        if now != version:
            raise Conflict(f"version {now} was saved after {version} was read")
        target = rows.where(F.col("source_id") == source_id).select("managed_by").first()
        if target is None:
            raise KeyError(source_id)
        if target["managed_by"] != "newsroom":
            raise PermissionError("Built-in and preconfigured sources can be disabled but not deleted.")
        return self._replace(rows.where(F.col("source_id") != source_id), version)

    def fingerprint(self, definition: dict[str, str]) -> str:
        """The fingerprint of a definition, for those who test it."""
        bare = {k: v for k, v in definition.items() if k != "source_id" and v}
        return self.spark.createDataFrame([(bare,)], "d map<string,string>").select(definition_fingerprint(F.col("d")).alias("f")).first()["f"]
