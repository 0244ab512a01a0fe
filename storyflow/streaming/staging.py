"""Staging and delivery as state machines: what each version of a story, and each delivery event, leads to.

A story that is new after its module's first refresh is staged as soon as a version of it is
complete; until then it is pending, and stays so only while every refresh brings it again.
A draft that was staged from a teaser is brought up to the complete text only if no editor
has touched it and it has not been sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import blank, casefold
from .tracking import frame

#: A story that no refresh brought for so long is new when it comes again.
HORIZON_DAYS = 30
DRAFT_STATUS = "Sport draft"
ACTION = "module string, identity string, refresh long, action string"
VERSION = ("module", "identity", "refresh", "at", "complete", "drafted", "untouched", "deleted")

#: A delivery that has not ended by then is of uncertain outcome.
TIMEOUT_MINUTES = 30
STEP = "draft_id string, at timestamp, event string, state string, accepted boolean"


def untouched(text: Column | str, teaser: Column | str, status: Column | str, delivery_id: Column | str, expected: str = DRAFT_STATUS) -> Column:
    """Whether a draft is still the teaser it was made from, and was not sent: spaces and case aside."""
    plain = lambda c: casefold(F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " ")))
    return (F.trim(blank(delivery_id)) == "") & (blank(status) == expected) & (plain(text) == plain(teaser))


def versions(items: DataFrame, drafts: DataFrame, deleted: DataFrame) -> DataFrame:
    """``items`` (module, identity, refresh, at, complete, teaser), a stream or not, with what is known of
    their drafts (identity, text, status, delivery_id; one an identity) and deletions (identity)."""
    d = drafts.select("identity", F.col("text").alias("_text"), F.col("status").alias("_status"), F.col("delivery_id").alias("_delivery"), F.lit(True).alias("_d"))
    x = deleted.select("identity").distinct().withColumn("_x", F.lit(True))
    out = items.where("module IS NOT NULL AND identity IS NOT NULL").join(d, "identity", "left").join(x, "identity", "left")
    there = F.coalesce("_d", F.lit(False))
    return out.select(
        "module", F.col("identity").cast("string").alias("identity"), F.col("refresh").cast("long").alias("refresh"), F.col("at").cast("timestamp").alias("at"), F.coalesce("complete", F.lit(False)).alias("complete"),
        there.alias("drafted"), (there & untouched("_text", "teaser", "_status", "_delivery")).alias("untouched"), F.coalesce("_x", F.lit(False)).alias("deleted"),
    )


def staging_actions(rows: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """What each version leads to (``module, identity, refresh, action``), from :func:`versions`.

    ``refresh`` numbers a module's refreshes from 1 without gaps; a story comes once in one, or its
    latest row counts.  Actions: ``baseline`` in the first refresh, ``pending``, ``created``,
    ``unchanged`` (there was a draft), ``upgraded``, ``suppressed`` (an editor deleted it) and
    ``ignored``.  Windows over a story's versions alone; no state is folded."""
    rows = rows.groupBy("module", "identity", "refresh").agg(F.max_by(F.struct(*VERSION[3:]), F.struct("at", "complete")).alias("v")).select("module", "identity", "refresh", "v.*")
    story = Window.partitionBy("module", "identity").orderBy("refresh")
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(story)) > horizon_days * 86_400_000_000
    rows = rows.withColumn("island", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(story))
    island = Window.partitionBy("module", "identity", "island").orderBy("refresh")
    sofar = island.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(island)).withColumn("first", F.first("refresh").over(sofar))
    # Pending: new, never complete since, and brought by every refresh.
    waits = ~F.max("complete").over(sofar) & (F.col("refresh") - F.col("first") == F.col("n") - 1) & (F.col("first") > 1)
    rows = rows.withColumn("pending", waits)
    could = F.col("complete") & F.col("untouched") & (F.col("refresh") > 1)
    rows = rows.withColumn("upgrade", could & (F.sum(could.cast("int")).over(sofar) == 1))
    before = F.coalesce(F.lag("pending").over(island), F.lit(False)) & (F.lag("refresh").over(island) == F.col("refresh") - 1)
    fresh = (F.col("n") == 1) | F.coalesce(before, F.lit(False))
    action = (
        F.when(F.col("refresh") == 1, "baseline").when(F.col("pending"), "pending").when(~F.col("complete"), "ignored").when(F.col("upgrade"), "upgraded")
        .when(~fresh, "ignored").when(F.col("deleted"), "suppressed").when(F.col("drafted"), "unchanged").otherwise("created")
    )
    return rows.select("module", "identity", "refresh", action.alias("action"))


class Staging(StatefulProcessor):
    """The state machine of a story; see :func:`stream_staging`."""

    def __init__(self, horizon_days: int):
        self.horizon_ms = horizon_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.story = handle.getValueState("story", "refresh long, at long, pending boolean, upgraded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.story.get()) if self.story.exists() else None
        last = known[1] if known else None
        out = []
        judged = pd.concat(rows).sort_values(["refresh", "at", "complete"], kind="stable").drop_duplicates("refresh", keep="last")
        for r in judged.itertuples(index=False):
            at = int(r.at.timestamp() * 1000)
            if known and r.refresh <= known[0]:
                continue  # the refresh has been judged
            if known and at - known[1] > self.horizon_ms:
                known = None
            fresh = known is None or (known[2] and known[0] == r.refresh - 1)
            upgraded = bool(known and known[3])
            upgrade = bool(r.refresh > 1 and r.complete and r.untouched and not upgraded)
            if r.refresh == 1:
                action = "baseline"
            elif not r.complete:
                action = "pending" if fresh else "ignored"
            elif upgrade:
                action = "upgraded"
            else:
                action = "ignored" if not fresh else "suppressed" if r.deleted else "unchanged" if r.drafted else "created"
            known = (int(r.refresh), at, action == "pending", upgraded or upgrade)
            out.append((*key, int(r.refresh), action))
        if known:
            self.story.update(known)
            if last is not None:
                self.handle.deleteTimer(last + self.horizon_ms + 1)
            self.handle.registerTimer(known[1] + self.horizon_ms + 1)
        yield frame(out, ACTION)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Beyond the horizon a story is as good as never seen: its state goes.
        if self.story.exists() and self.story.get()[1] + self.horizon_ms < expiredTimerInfo.getExpiryTimeInMs():
            self.story.clear()
        yield frame([], ACTION)


def stream_staging(rows: DataFrame, horizon_days: int = HORIZON_DAYS, watermark: str = "0 seconds") -> DataFrame:
    """The stream form of :func:`staging_actions`: equal to it if a module's refreshes come in order.

    A version is judged once, when its refresh comes; timers free the state of stories that the
    watermark has left ``horizon_days`` behind."""
    rows = rows.withWatermark("at", watermark)
    return rows.groupBy("module", "identity").transformWithStateInPandas(Staging(horizon_days), ACTION, "Append", "EventTime")


class Deliveries(StatefulProcessor):
    """The state machine of a draft's delivery; see :func:`stream_deliveries`."""

    def __init__(self, timeout_minutes: int):
        self.timeout_ms = timeout_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.delivery = handle.getValueState("delivery", "state string, since long")

    def _row(self, key, ms, event, state, accepted):
        return (key[0], pd.Timestamp(ms, unit="ms"), event, state, accepted)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, since = tuple(self.delivery.get()) if self.delivery.exists() else ("", 0)
        began = since if state == "sending" else None
        out = []
        for r in pd.concat(rows).sort_values(["at", "event"], kind="stable").itertuples(index=False):
            at = int(r.at.timestamp() * 1000)
            if state == "sending" and at - since > self.timeout_ms:
                state, since = "uncertain", since + self.timeout_ms
                out.append(self._row(key, since, "timeout", state, True))
            to = {"queue": "queued" if state in ("", "failed") else None, "start": "sending" if state == "queued" else None, "sent": "sent" if state in ("sending", "uncertain") else None, "failed": "failed" if state in ("sending", "uncertain") else None}.get(r.event)
            if to:
                state, since = to, at
            out.append(self._row(key, at, r.event, state, to is not None))
        self.delivery.update((state, since))
        now = since if state == "sending" else None
        if began != now:
            if began is not None:
                self.handle.deleteTimer(began + self.timeout_ms + 1)
            if now is not None:
                self.handle.registerTimer(now + self.timeout_ms + 1)
        yield frame(out, STEP)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since = tuple(self.delivery.get()) if self.delivery.exists() else ("", 0)
        out = []
        if state == "sending" and since + self.timeout_ms < expiredTimerInfo.getExpiryTimeInMs():
            self.delivery.update(("uncertain", since + self.timeout_ms))
            out.append(self._row(key, since + self.timeout_ms, "timeout", "uncertain", True))
        yield frame(out, STEP)


def stream_deliveries(events: DataFrame, timeout_minutes: int = TIMEOUT_MINUTES, watermark: str = "0 seconds") -> DataFrame:
    """What each event of a delivery leads to: ``draft_id, at, event, state, accepted``.

    ``events``, a stream: draft_id, at, event (queue, start, sent or failed).  A draft is queued unless
    it waits, is being sent, was sent or may have been; it is started once; an outcome is taken
    only of a delivery that was started.  One without an outcome after ``timeout_minutes``
    becomes ``uncertain`` by a timer (event ``timeout``), and is never started again by itself."""
    rows = events.where("draft_id IS NOT NULL AND at IS NOT NULL").select(F.col("draft_id").cast("string").alias("draft_id"), F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", watermark)
    return rows.groupBy("draft_id").transformWithStateInPandas(Deliveries(timeout_minutes), STEP, "Append", "EventTime")
