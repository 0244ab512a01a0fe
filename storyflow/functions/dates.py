"""Date functions: texts in several formats to timestamps, and the windows that keep them.

Texts that no format fits give null.  A text without a zone is UTC, which the session's
time zone must be.  ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

#: Formats after the weekday is taken off and ordinals are plain.
ISO = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[XXX]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd")
RFC = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")
DISPLAY = ("d MMMM yyyy", "d MMM yyyy", "d/M/yyyy", "HH:mm d/M/yyyy", "d MMMM yyyy HH:mm", "d/M/yyyy HH:mm")


def parsed(c: Column | str, formats: tuple[str, ...] = ISO + RFC + DISPLAY) -> Column:
    """The timestamp of a date text by the first format that fits."""
    text = F.trim(F.regexp_replace(F.trim(blank(c)), r"(?i)^(published|updated|posted)( on)?:?\s+", ""))
    text = F.regexp_replace(text, r"(?i)^(mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*,?\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1"), r"\bGMT$", "+0000")
    text = F.nullif(text, F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: A police notice's formats, in the order in which they are tried.
POLICE = ("H:m d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "d/M/yyyy", "H:m d MMMM yyyy", "H:m d MMM yyyy", "d MMMM yyyy H:m", "d MMM yyyy H:m", "d MMMM yyyy", "d MMM yyyy")


def police(c: Column | str) -> Column:
    """The timestamp that a police notice shows: ISO, one of its own formats, or that of mail."""
    text = F.nullif(F.trim(F.regexp_replace(F.trim(blank(c)), r"(?i)^published\s*:\s*", "")), F.lit(""))
    whole = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(text, "z$", "Z"), F.lit(f)) for f in ISO])
    return F.coalesce(whole, *[F.try_to_timestamp(text, F.lit(f)) for f in POLICE], parsed(text, RFC))


def relative(c: Column | str, now: Column) -> Column:
    """The timestamp of "3 days ago", "yesterday" and the like."""
    text = F.lower(F.trim(blank(c)))
    n = F.regexp_extract(text, r"^(\d+|an?)\s+(minute|hour|day|week)s?\s+ago$", 1)
    unit = F.regexp_extract(text, r"^(\d+|an?)\s+(minute|hour|day|week)s?\s+ago$", 2)
    count = F.when(n.rlike("^a"), 1).otherwise(F.expr("1") * F.try_to_number(F.nullif(n, F.lit("")), F.lit("999999")).cast("int"))
    minutes = count * F.when(unit == "minute", 1).when(unit == "hour", 60).when(unit == "day", 1440).when(unit == "week", 10080)
    back = F.when(text == "today", 0).when(text == "yesterday", 1440).otherwise(minutes)
    return F.timestamp_seconds(F.unix_timestamp(now) - back * 60)


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTH_NAMES = "^(?:" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS.lower().split("|")) + ")$"
_DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
#: Where a council's page names a day, the first of these that occurs: with the weekday or without, month or day first.
COUNCIL_DAYS = (
    rf"(?:{_DAYS})[, ]+(?<month>{_MONTHS})\s+(?<day>\d{{1,2}}),\s+(?<year>\d{{4}})",
    rf"(?:{_DAYS})[,]?\s+(?<day>\d{{1,2}})\s+(?<month>{_MONTHS})\s+(?<year>\d{{4}})",
    rf"(?<day>\d{{1,2}})\s+(?<month>{_MONTHS})\s+(?<year>\d{{4}})",
    rf"(?<month>{_MONTHS})\s+(?<day>\d{{1,2}}),?\s+(?<year>\d{{4}})",
)
#: After the last of each of these stands a page's date.
COUNCIL_PREFIXES = ("Article posted on ", "Published on ", "Last Updated on ")


def council(c: Column | str, now: Column) -> Column:
    """The date that a council's page shows: so long ago, a whole date, or a day named within other text."""
    t = F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))
    ago = r"(?i)\b(\d+)\s+(day|hour|minute)s?\s+ago\b"
    unit = F.lower(F.regexp_extract(t, ago, 2))
    seconds = F.regexp_extract(t, ago, 1).try_cast("long") * F.when(unit == "day", 86_400).when(unit == "hour", 3_600).when(unit == "minute", 60)
    text = F.regexp_replace(t, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    for p in COUNCIL_PREFIXES:
        text = F.trim(F.regexp_replace(text, f"(?is)^.*{p}", ""))
    read = lambda pattern, form: F.try_to_timestamp(F.when(text.rlike(pattern), text), F.lit(form))
    time = r"T\d{1,2}:\d{1,2}:\d{1,2}"
    whole = F.coalesce(
        read(r"(?i)^\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}$", "d MMM yyyy"),
        read(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        read(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{time}(?:Z|[+-]\d\d:\d\d)$", "yyyy-M-d'T'H:m:sXXX"),
        read(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{time}[+-]\d{{4}}$", "yyyy-M-d'T'H:m:sXX"),
        read(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{time}$", "yyyy-M-d'T'H:m:s"),
    )
    named = F.lit("")
    for pattern in reversed(COUNCIL_DAYS):
        found = F.regexp_extract(text, f"(?i){pattern}", 0)
        named = F.when(found != "", F.regexp_replace(found, f"(?i)^{pattern}$", "${day} ${month} ${year}")).otherwise(named)
    day = F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("d MMMM yyyy"))
    return F.when(seconds.isNotNull(), F.timestamp_micros(F.unix_micros(now) - seconds * 1_000_000)).otherwise(F.coalesce(whole, day))


def from_path(url: Column | str, year: Column | int) -> Column:
    """The date in a URL's path: 3rd-may-yyyy, yyyy-mm-dd, yyyy/mm/dd or yyyy/mm, the year from 2000 to the one after
    ``year``, in which the URL is read.  A month's whole name or its first three letters count; a day that is none gives null."""
    text = blank(url)
    year = F.lit(year) if isinstance(year, int) else year
    named = r"(?i)(?:^|/)(\d{1,2})(?:st|nd|rd|th)?-([a-z]+)-(%s)(?:/|$)"
    # Names go with years of 20xx; with later ones where these can be meant.
    day, month, of = (F.when(year >= 2099, F.regexp_extract(text, named % r"[2-9]\d{3}", i)).otherwise(F.regexp_extract(text, named % r"20\d{2}", i)) for i in (1, 2, 3))
    spelt = F.concat_ws(" ", day, month, of)
    ordinal = F.coalesce(F.try_to_timestamp(spelt, F.lit("d MMMM yyyy")), F.try_to_timestamp(spelt, F.lit("d MMM yyyy")))
    is_named = (day != "") & F.lower(month).rlike(_MONTH_NAMES)
    full = F.regexp_extract(text, r"/(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?=[/-]|$)", 0)
    month = F.regexp_extract(text, r"/(\d{4})/(\d{1,2})(?=/|$)", 0)
    text = F.when(full != "", F.regexp_replace(full, "[/-]", "-")).when(month != "", F.concat(F.regexp_replace(month, "[/-]", "-"), F.lit("-1"))).otherwise(F.lit(None))
    found = F.try_to_timestamp(F.regexp_replace(text, "^-", ""), F.lit("yyyy-M-d"))
    found = F.when(is_named, ordinal).otherwise(found)
    return F.when(F.year(found).between(2000, year + 1), found)


def uk_display(c: Column | str) -> Column:
    return F.date_format(c, "d MMMM yyyy")


def uk_short(c: Column | str) -> Column:
    return F.date_format(c, "d MMM yyyy")


def recency(when: Column | str, now: Column, *, days: float, future_hours: float = 24, null_policy: str = "drop") -> Column:
    """Why a date is out of a window: null where it is in.

    ``null_policy``: what a missing date does: "drop" or "keep"."""
    if null_policy not in ("drop", "keep"):
        raise ValueError(null_policy)
    t = F.col(when) if isinstance(when, str) else when
    age = (F.unix_micros(now) - F.unix_micros(t)) / 1e6
    reason = F.when(age > days * 86400, "too old").when(age < -future_hours * 3600, "in the future")
    return F.when(t.isNull(), None if null_policy == "keep" else "no date").otherwise(reason)


def recent(when: Column | str, now: Column, **options) -> Column:
    """Whether a date is in a window: see :func:`recency`."""
    return recency(when, now, **options).isNull()


def two_step_recency(listing: Column | str, detail: Column | str, now: Column, **options) -> Column:
    """As :func:`recency`, for rows that are met in a listing and read in detail later: a listing's date that is
    out of the window decides; a missing one waits for the detail, whose date then must be there."""
    first = recency(listing, now, null_policy="keep", **options)
    then = F.coalesce(F.col(detail) if isinstance(detail, str) else detail, F.col(listing) if isinstance(listing, str) else listing)
    return F.coalesce(first, recency(then, now, null_policy="drop", **options))


def next_fixed_time(now: Column, hour: int, minute: int) -> Column:
    """The next time of day: today, or tomorrow where it has passed."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today > now, today).otherwise(today + F.expr("INTERVAL 1 DAY"))


def next_interval(anchor: Column, now: Column, minutes: int) -> Column:
    """The first time after now that lies whole intervals after an anchor."""
    passed = F.floor((F.unix_timestamp(now) - F.unix_timestamp(anchor)) / (minutes * 60)) + 1
    return F.timestamp_seconds(F.unix_timestamp(anchor) + F.greatest(F.lit(1), passed) * minutes * 60)


#: The modes that refresh after so many minutes.
INTERVALS = {"Every 15 minutes": 15, "Every 30 minutes": 30, "Every 60 minutes": 60, "Every 2 hours": 120, "Every 12 hours": 720}
#: Fixed value: the mode of times of day.
FIXED_TIMES = "Custom fixed times"


def _every(mode: Column | str) -> Column:
    """The microseconds of a mode's interval; null of a mode without one."""
    m = F.col(mode) if isinstance(mode, str) else mode
    out = F.lit(None).cast("long")
    for name, minutes in INTERVALS.items():
        out = F.when(m == name, minutes * 60_000_000).otherwise(out)
    return out


def next_run(mode: Column | str, times: Column | str, last: Column | str, now: Column) -> Column:
    """When a schedule next runs: an interval after its last run (after now, where that is missing or lies
    ahead), or at the first of its times of day (texts HH:MM, others do not count) that is to come, today
    or tomorrow.  Null of any other mode."""
    m, t, at = (F.col(c) if isinstance(c, str) else c for c in (mode, times, last))
    anchor = F.when(at <= now, at).otherwise(now)
    valid = F.filter(F.transform(t, lambda v: F.trim(v)), lambda v: v.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d$"))
    minutes = F.transform(valid, lambda v: F.substring(v, 1, 2).cast("long") * 60 + F.substring(v, 4, 2).cast("long"))
    day = F.unix_micros(F.date_trunc("day", now))
    ahead = F.filter(F.transform(F.concat(minutes, F.transform(minutes, lambda v: v + 1440)), lambda v: day + v * 60_000_000), lambda v: v > F.unix_micros(now))
    return F.timestamp_micros(F.when(_every(m).isNotNull(), F.unix_micros(anchor) + _every(m)).when(m == FIXED_TIMES, F.array_min(ahead)))


def stale(mode: Column | str, last: Column | str, now: Column) -> Column:
    """Whether stored data is due: never in the modes that do not refresh, else where it has never come
    through, or an interval has passed."""
    m, at = (F.col(c) if isinstance(c, str) else c for c in (mode, last))
    idle = F.coalesce(m, F.lit("Manual only")).isin("Off", "Manual only")
    return F.when(idle, False).when(at.isNull(), True).otherwise(F.coalesce(F.unix_micros(now) - F.unix_micros(at) >= _every(m), F.lit(False)))


def due_at(mode: Column | str, last: Column | str, now: Column) -> Column:
    """When a module of an interval is next due: an interval after it came through, but not before now; at
    once where it never did.  Null of the other modes."""
    at = F.col(last) if isinstance(last, str) else last
    return F.timestamp_micros(F.when(_every(mode).isNull(), None).when(at.isNull(), F.unix_micros(now)).otherwise(F.greatest(F.unix_micros(at) + _every(mode), F.unix_micros(now))))
