"""The registry of queries, the inputs they read, and the SQL of those inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its SQL over the views below."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {VIEWS}\n{sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All queries take the time from here.
NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories: the first line is the title, the second the summary."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        F.coalesce(lines[0], F.lit("")).alias("title"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("summary"),
        F.coalesce("text", F.lit("")).alias("body"),
        "source",
        "lang",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("published"),
        F.concat(F.lit("https://www."), "source", F.lit(".Example.com//news/"), (F.col("doc_id") % 700).cast("string"), F.lit("/?utm_source=feed&page="), (F.col("doc_id") % 3).cast("string"), F.lit("#top")).alias("url"),
    )


VIEWS = r"""stories AS MATERIALIZED (SELECT doc_id AS pos, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(string_split(text, chr(10))[2], '') AS summary,
  coalesce(text, '') AS body, source, lang, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published,
  'https://www.' || source || '.Example.com//news/' || CAST(doc_id % 700 AS VARCHAR) || '/?utm_source=feed&page=' || CAST(doc_id % 3 AS VARCHAR) || '#top' AS url FROM documents)"""
