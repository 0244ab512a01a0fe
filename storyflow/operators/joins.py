"""Joins of stories with what is stored, known or reported about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, casefold


def filled(primary: Column | str, other: Column | str) -> Column:
    """The primary text, or the other where the primary is null or empty."""
    return F.coalesce(F.nullif(blank(primary), F.lit("")), blank(other))


def overlay(listing: DataFrame, detail: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Listing rows with the columns of their detail, which win even when empty; of ``lists``,
    an empty detail falls back to the listing."""
    d = detail.select(key, *[F.col(c).alias("_" + c) for c in detail.columns if c != key], F.lit(True).alias("_there"))
    out = listing.join(d, key, "left")
    shared = [c for c in detail.columns if c != key and c in listing.columns]
    new = {c: F.when(F.col("_there") & (F.size("_" + c) > 0 if c in lists else F.lit(True)), F.col("_" + c)).otherwise(F.col(c)) for c in shared}
    added = {c: F.col("_" + c) for c in detail.columns if c != key and c not in listing.columns}
    return out.withColumns(new | added).select(*listing.columns, *added)


def fill_from(cards: DataFrame, feed: DataFrame, key: Column | str, columns: list[str]) -> DataFrame:
    """Cards with their empty columns filled from the feed's row of the same key."""
    k = F.col(key) if isinstance(key, str) else key
    f = feed.select(k.alias("_k"), *[F.col(c).alias("_" + c) for c in columns]).dropDuplicates(["_k"])
    out = cards.withColumn("_k", k).join(f, "_k", "left")
    return out.withColumns({c: filled(c, "_" + c) for c in columns}).select(*cards.columns)


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known: of deleted identities, or of keys met before."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def find_draft(stories: DataFrame, drafts: DataFrame) -> DataFrame:
    """Each story's draft by identity, else by either of the draft's addresses; the first draft
    of several.  ``stories``: identity, url; ``drafts``: draft_id, identity, url, source_url."""
    by_id = drafts.where("identity <> ''").groupBy("identity").agg(F.min("draft_id").alias("by_identity"))
    urls = drafts.select("draft_id", F.explode(F.array("url", "source_url")).alias("url")).where("url <> ''").groupBy("url").agg(F.min("draft_id").alias("by_url"))
    out = stories.join(by_id, "identity", "left").join(urls, "url", "left")
    return out.select(*stories.columns, F.coalesce("by_identity", "by_url").alias("draft_id"))


def reconciled(health: DataFrame, stories: DataFrame) -> DataFrame:
    """Each source's outcome after the final filters.  ``health``: source, status, story_count;
    ``stories``: source, full."""
    counts = stories.where(F.trim(blank("source")) != "").groupBy(casefold("source").alias("_k")).agg(F.count("*").alias("kept"), F.count_if("full").alias("full"))
    out = health.withColumn("_k", casefold("source")).join(counts, "_k", "left").na.fill(0, ["kept", "full"])
    failed, raw = F.col("status") == "failed", F.coalesce("story_count", F.lit(0))
    return out.select(
        "source",
        F.when(failed, "failed").when(F.col("kept") > 0, "yielding").when(raw > 0, "no-current-stories").otherwise("no-stories").alias("status"),
        F.when(failed, 0).otherwise(F.col("kept")).cast("long").alias("story_count"),
        F.when(~failed, raw).cast("long").alias("raw_story_count"),
        F.when(failed, 0).otherwise(F.col("full")).cast("long").alias("full_content_count"),
        F.when(failed, 0).otherwise(F.col("kept") - F.col("full")).cast("long").alias("incomplete_content_count"),
    )


def reindexed(stories: DataFrame, results: DataFrame, keep: Column, pos: str = "story_index") -> DataFrame:
    """Results of the stories that are kept, under their new numbers in order."""
    kept = stories.where(keep).select(pos)
    # Numbers by parts: how many are kept in the thousands before, and before within one.
    part = F.floor(F.col(pos) / 1000).alias("part")
    counts = kept.groupBy(part).agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("b"))
    numbered = kept.select(pos, part).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(pos)) - 1).join(before, "part")
    return results.join(numbered.select(pos, (F.col("n") + F.col("b")).alias("new_index")), pos).drop(pos).withColumnRenamed("new_index", pos)


def previous_for_failed(current: DataFrame, previous: DataFrame, health: DataFrame) -> DataFrame:
    """Current stories and, for failed sources, those of the snapshot before."""
    failed = health.where("status = 'failed'").select("source").distinct()
    return current.unionByName(previous.join(failed, "source", "left_semi"), allowMissingColumns=True)
