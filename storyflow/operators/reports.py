"""Reports of runs and clean-ups: what a run collected and published, and what a retention policy removes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import blank, casefold


@dataclass(frozen=True)
class Rule:
    """Rows of a kind go when their time (the column ``when``) lies over ``days`` back; those of a missing or
    unreadable time stay, and so do those whose ``name`` is protected."""

    when: str
    days: int
    name: str | None = None
    protected: tuple[str, ...] = ()

    def gone(self, now: Column) -> Column:
        stamp = F.col(self.when).try_cast("timestamp")
        old = F.unix_micros(stamp) < F.unix_micros(now) - self.days * 86_400_000_000
        kept = casefold(self.name).isin(*[p.casefold() for p in self.protected]) if self.name and self.protected else F.lit(False)
        return F.coalesce(old, F.lit(False)) & ~kept


#: How long each kind is kept.
POLICY = {
    "social_drafts": Rule("created_at", 7),
    "old_logs": Rule("modified_at", 30),
    "old_cached_images": Rule("modified_at", 14, "name", ("newsdesk-image-placeholder.png",)),
    "feed_snapshot_stories": Rule("published", 7),
    "sync_runs": Rule("started_at", 7),
}


def cleaned(frames: dict[str, DataFrame], now: Column, policy: dict[str, Rule] = POLICY) -> dict[str, DataFrame]:
    """What is left of each kind; a kind without a rule stays whole."""
    return {k: df.where(~policy[k].gone(now)) if k in policy else df for k, df in frames.items()}


def cleanup_audit(frames: dict[str, DataFrame], now: Column, policy: dict[str, Rule] = POLICY) -> DataFrame:
    """How many rows of each kind of the policy :func:`cleaned` removes, in one row and one pass; nothing is changed.
    A kind without a table has lost nothing."""
    named = [df.select(F.lit(k).alias("kind"), policy[k].gone(now).alias("gone")) for k, df in frames.items() if k in policy]
    counts = [F.count_if(F.col("gone") & (F.col("kind") == k)).alias(f"{k}_removed") for k in policy]
    if not named:
        raise ValueError("No table of a kind in the policy.")
    rows = named[0]
    for df in named[1:]:
        rows = rows.unionByName(df)
    return rows.agg(*counts)


def run_totals(sources: DataFrame, items: DataFrame, publishing: DataFrame) -> DataFrame:
    """The statistics of each run, of its sources (run_id, attempted, succeeded), items (run_id, outcome:
    collected, duplicate or rejected; newsworthy) and publishing (run_id, succeeded).

    All are counted before they meet, so that one narrow row a run and task is shuffled.  A run that is missing
    in one of them has none there; a null is no.  A failed source is one that was tried."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    collected = F.col("outcome") == "collected"
    of = [
        (sources, {"sources_requested": F.lit(True), "sources_attempted": yes("attempted"), "sources_succeeded": yes("attempted") & yes("succeeded"), "sources_failed": yes("attempted") & ~yes("succeeded")}),
        (items, {"items_found": F.lit(True), "items_collected": collected, "items_duplicate": F.col("outcome") == "duplicate", "items_rejected": F.col("outcome") == "rejected", "items_newsworthy": collected & yes("newsworthy")}),
        (publishing, {"publish_attempted": F.lit(True), "publish_succeeded": yes("succeeded"), "publish_failed": ~yes("succeeded")}),
    ]
    names = [n for _, cs in of for n in cs]
    rows = None
    for df, cs in of:
        part = df.groupBy("run_id").agg(*[F.count_if(c).alias(n) for n, c in cs.items()])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    total = rows.groupBy("run_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.withColumns({"source_success_rate": rate(F.col("sources_succeeded"), F.col("sources_attempted")), "publish_success_rate": rate(F.col("publish_succeeded"), F.col("publish_attempted"))})


def first_populated(names: tuple[str, ...], columns: list[str], extras: Column | str = "extras") -> Column:
    """The first text that is there under one of several names: among a row's own ``columns``, then in its
    ``extras`` (a map); empty where there is none."""
    own = [F.nullif(blank(n), F.lit("")) for n in names if n in columns]
    held = [F.nullif(F.try_element_at(F.col(extras) if isinstance(extras, str) else extras, F.lit(n)), F.lit("")) for n in names]
    return F.coalesce(*own, *held, F.lit(""))


def queued(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Stories (id, title, summary, priority, source, published, status, and the place in the queue from 0) as
    rows of a queue: texts trimmed, a missing id made of the place.  A story without a title fails the run."""
    title = F.trim(blank("title"))
    told = df.where((title != "") | F.raise_error(F.concat(F.lit("Each story requires a non-empty title: "), F.col(pos).cast("string"))).isNull())
    texts = {c: F.trim(blank(c)) for c in ("title", "summary", "priority", "source", "published", "status")}
    return told.withColumns({**texts, "id": F.coalesce("id", F.concat(F.lit("story-"), (F.col(pos) + 1).cast("string")))})


#: Fixed value: the address of an image that stands for none.
PLACEHOLDER = "ldrs.org.uk/assets/images/placeholder.png"


def real_image(c: Column | str) -> Column:
    """An image's address; empty where it is the one that stands for none."""
    return F.when(F.contains(casefold(c), F.lit(PLACEHOLDER)), "").otherwise(F.trim(blank(c)))


def image_rights(image: Column | str, credit: Column | str, module: Column | str) -> Column:
    """Whether an image may be used: the newsletter's may, and those whose credit says so."""
    said = F.contains(casefold(credit), F.lit("approved for use")) | F.contains(casefold(credit), F.lit("permission")) | (blank(module) == "newsletter")
    return F.when(blank(image) == "", "no image").when(said, "approved").otherwise("not reviewed")
