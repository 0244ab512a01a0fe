"""A store laid out for its look-ups: rows by key, and the newest first, from few files.

Rows lie in folders by a hash of their key, sorted by it within a file, so that a look-up opens one
folder and skips row groups by their statistics.  Beside them lies an index by day (key and
time alone): the newest rows are found in the last days that hold enough, and then looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """The rows of a folder by key (unique) and by time; see the module."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "article_id", when: str = "created_at", buckets: int = 64):
        self.spark, self.folder, self.key, self.when, self.buckets = spark, folder.rstrip("/"), key, when, buckets

    def _bucket(self, c):
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame) -> None:
        """Replaces the store with ``df``: rows without a key are left out."""
        rows = df.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket(F.col(self.key)))
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows")
        days = df.where(F.col(self.key).isNotNull()).select(self.key, self.when, F.to_date(self.when).alias("day"))
        days.repartitionByRange("day", self.key).sortWithinPartitions("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/days")

    def get(self, *keys) -> DataFrame:
        """The rows of some keys: only the folders that can hold them are listed as read."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        places = self.spark.range(1).select(*[self._bucket(F.lit(k)).alias(f"b{i}") for i, k in enumerate(keys)]).first() if keys else ()
        return rows.where(F.col("bucket").isin(*sorted(set(places))) & F.col(self.key).isin(*keys)).drop("bucket")

    def newest(self, most: int, *, whole: bool = True) -> DataFrame:
        """The ``most`` newest rows by time, then key, both descending; those without a time last.

        Days are counted from the index's folders (a number a day comes to the driver); then the last
        days that hold enough are read, and with ``whole`` their rows looked up."""
        index = self.spark.read.parquet(f"{self.folder}/days")
        chosen, held = [], 0
        for row in index.groupBy("day").count().orderBy(F.desc_nulls_last("day")).toLocalIterator():
            if held >= most:
                break
            chosen.append(row["day"])
            held += row["count"]
        dated = [d for d in chosen if d is not None]
        of = F.col("day").isin(*dated) if dated else F.lit(False)
        found = index.where(of | F.col("day").isNull() if None in chosen else of)
        found = found.orderBy(F.desc_nulls_last(self.when), F.desc(self.key)).limit(most).select(self.key, self.when)
        if not whole:
            return found
        return self.matching(found)

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows of a table of keys, joined by folder and key: where the keys are few, Spark reads only their folders."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket(F.col(self.key)))
        return rows.join(wanted, ["bucket", self.key]).select(*[c for c in rows.columns if c != "bucket"])
