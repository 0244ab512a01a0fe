"""Queries over streams: each is run over all that is there, and compared with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import staging, tracking
from .registry import query, table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: Spark's file source lists its folder, and takes the files of this table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if fs.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: Keys that a module remembers here: few enough that keys fall out at the smallest size.
REMEMBERED = 40

_REFRESH = "CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 21600) AS BIGINT) - 78888"


@query("t1_stream_refreshes", f"""
, e AS (SELECT event_type AS module, {_REFRESH} AS refresh, CAST(min(ts) AS DATE) AS day, CAST(user_id AS VARCHAR) AS key, min(event_id) AS pos FROM events GROUP BY event_type, {_REFRESH}, user_id),
lists AS (SELECT module, refresh, min(day) AS day, list(key ORDER BY encode(key)) AS keys, list(key ORDER BY pos, encode(key)) AS arrived, row_number() OVER (PARTITION BY module ORDER BY refresh) AS r FROM e GROUP BY module, refresh),
step AS (
  SELECT module, refresh, day, r, arrived[greatest(1, len(arrived) - {REMEMBERED - 1}):] AS known, CAST([] AS VARCHAR[]) AS fresh, len(keys) AS found FROM lists WHERE r = 1
  UNION ALL
  SELECT module, refresh, day, r, everything[greatest(1, len(everything) - {REMEMBERED - 1}):], fresh, found FROM (
    SELECT l.module, l.refresh, l.day, l.r, len(l.keys) AS found, list_filter(l.keys, lambda k: NOT list_contains(s.known, k)) AS fresh, list_concat(s.known, list_filter(l.keys, lambda k: NOT list_contains(s.known, k))) AS everything
    FROM step s JOIN lists l ON l.module = s.module AND l.r = s.r + 1)),
new_keys AS (SELECT module, day, refresh, unnest(fresh) AS key FROM step)
SELECT s.module, s.refresh, s.day, CAST(s.found AS BIGINT) AS found, CAST(len(s.fresh) AS BIGINT) AS new,
  (SELECT count(DISTINCT n.key) FROM new_keys n WHERE n.module = s.module AND n.day = s.day AND n.refresh <= s.refresh) AS updates_today, CAST(0 AS BIGINT) AS late FROM step s""")
def stream_refreshes(spark, sf):
    """Refreshes of six hours over all events, through the stateful stream."""
    ts = F.col("ts").cast("timestamp")
    e = _stream(spark, sf, "events")
    items = e.select(F.col("event_type").alias("module"), (F.floor(F.unix_timestamp(ts) / 21600) - 78888).alias("refresh"), F.to_date(ts).alias("day"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("pos"))
    return tracking.finished(tracking.stream_refreshes(items, REMEMBERED), ["module", "refresh"])


_VERSIONS = """, v AS (SELECT event_type AS module, CAST(user_id AS VARCHAR) AS identity, CAST(CAST(ts AS DATE) - DATE '2023-12-31' AS BIGINT) AS refresh, max(value) > 60 AS complete FROM events GROUP BY ALL),
d AS (SELECT CAST(doc_id AS VARCHAR) AS identity, any_value(quality) = 0 AS untouched, any_value(toxic) = 1 AS deleted FROM labels GROUP BY doc_id),
rows_ AS (SELECT v.*, d.identity IS NOT NULL AS drafted, coalesce(d.untouched, false) AS untouched, coalesce(d.deleted, false) AS deleted,
  row_number() OVER (PARTITION BY module, v.identity ORDER BY refresh) AS n FROM v LEFT JOIN d ON d.identity = v.identity),
step AS (
  SELECT *, CASE WHEN refresh = 1 THEN 'baseline' WHEN NOT complete THEN 'pending' WHEN untouched THEN 'upgraded' WHEN deleted THEN 'suppressed' WHEN drafted THEN 'unchanged' ELSE 'created' END AS action, refresh > 1 AND complete AND untouched AS upgraded FROM rows_ WHERE n = 1
  UNION ALL
  SELECT module, identity, refresh, complete, drafted, untouched, deleted, n,
    CASE WHEN NOT complete THEN CASE WHEN fresh THEN 'pending' ELSE 'ignored' END WHEN untouched AND NOT had THEN 'upgraded' WHEN NOT fresh THEN 'ignored' WHEN deleted THEN 'suppressed' WHEN drafted THEN 'unchanged' ELSE 'created' END, had OR (complete AND untouched)
  FROM (SELECT r.*, r.refresh - s.refresh > 5 OR (s.action = 'pending' AND s.refresh = r.refresh - 1) AS fresh, s.upgraded AND r.refresh - s.refresh <= 5 AS had FROM step s JOIN rows_ r ON r.module = s.module AND r.identity = s.identity AND r.n = s.n + 1))
SELECT module, identity, refresh, action FROM step"""


def _versions(spark: SparkSession, sf: str, events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("identity")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drafts = labels.select("identity", F.when(F.col("quality") == 0, "The  teaser").otherwise("Edited").alias("text"), F.lit(staging.DRAFT_STATUS).alias("status"), F.lit("").alias("delivery_id"))
    items = events.select(F.col("event_type").alias("module"), F.col("user_id").cast("string").alias("identity"), F.datediff(F.to_date(ts), F.lit("2023-12-31").cast("date")).alias("refresh"), F.to_date(ts).cast("timestamp").alias("at"), (F.col("value") > 60).alias("complete"), F.lit("the teaser").alias("teaser"))
    return staging.versions(items, drafts, labels.where("toxic = 1"))


@query("t3_staging_actions", _VERSIONS)
def staging_actions(spark, sf):
    """Every version of every story, a refresh a day: by windows."""
    return staging.staging_actions(_versions(spark, sf, table(spark, sf, "events")), 5)


@query("t3_stream_staging", _VERSIONS)
def stream_staging(spark, sf):
    """The same through the state machine of a stream."""
    return tracking.finished(staging.stream_staging(_versions(spark, sf, _stream(spark, sf, "events")), 5), [], mode="append")


_EVENT = "CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'queue' WHEN 1 THEN 'start' WHEN 2 THEN 'sent' ELSE 'failed' END"


@query("t11_stream_deliveries", f"""
, e AS (SELECT CAST(user_id AS VARCHAR) AS draft_id, date_trunc('milliseconds', CAST(ts AS TIMESTAMP)) AS "at", {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('milliseconds', CAST(ts AS TIMESTAMP)), {_EVENT}) AS n FROM events),
step AS (
  SELECT draft_id, n, "at", event, CASE WHEN event = 'queue' THEN 'queued' ELSE '' END AS state, "at" AS since, event = 'queue' AS accepted, CAST(NULL AS TIMESTAMP) AS timed FROM e WHERE n = 1
  UNION ALL
  SELECT draft_id, n, "at", event, coalesce(step_to, state), CASE WHEN step_to IS NOT NULL THEN "at" ELSE since END, step_to IS NOT NULL, timed FROM (
    SELECT *, CASE WHEN event = 'queue' AND state IN ('', 'failed') THEN 'queued' WHEN event = 'start' AND state = 'queued' THEN 'sending' WHEN event IN ('sent', 'failed') AND state IN ('sending', 'uncertain') THEN event END AS step_to FROM (
      SELECT e.draft_id, e.n, e."at", e.event, CASE WHEN late THEN 'uncertain' ELSE s.state END AS state, CASE WHEN late THEN s.since + INTERVAL 3 DAYS ELSE s.since END AS since, CASE WHEN late THEN s.since + INTERVAL 3 DAYS END AS timed
      FROM (SELECT step.*, e.n AS m, step.state = 'sending' AND e."at" > step.since + INTERVAL 3 DAYS AS late FROM step JOIN e ON e.draft_id = step.draft_id AND e.n = step.n + 1) s JOIN e ON e.draft_id = s.draft_id AND e.n = s.m))),
last AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY n DESC) = 1)
SELECT draft_id, epoch_us("at") AS moment, event, state, accepted FROM step
UNION ALL SELECT draft_id, epoch_us(timed), 'timeout', 'uncertain', true FROM step WHERE timed IS NOT NULL
UNION ALL SELECT draft_id, epoch_us(since + INTERVAL 3 DAYS), 'timeout', 'uncertain', true FROM last WHERE state = 'sending' AND epoch_ms(since) + 3 * 86400000 + 1 < (SELECT epoch_ms(max("at")) FROM e)""")
def stream_deliveries(spark, sf):
    """Delivery events of all users' drafts, with a timer of three days."""
    kind = F.element_at(F.array(*map(F.lit, ("queue", "start", "sent", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("draft_id"), at.alias("at"), kind.alias("event"))
    return tracking.finished(staging.stream_deliveries(events, 3 * 24 * 60), [], mode="append").withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "moment")
