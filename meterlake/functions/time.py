"""Time functions. ``now`` is always a parameter, so that a report can be repeated."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Clocks may be this much ahead.
SKEW = timedelta(seconds=5)


def start_of_day(now: Column, tz: str) -> Column:
    """When the day of ``now`` began in a zone."""
    return F.to_utc_timestamp(F.date_trunc("DAY", F.from_utc_timestamp(now, tz)), tz)


def since(text: str | None, now: datetime, tz: str = "UTC") -> datetime | None:
    """A moment from ``today``, ``yesterday`` (24 hours before today), ``90m``, ``24h``, ``7d`` or a date; None if it is none of them."""
    key = (text or "").strip().lower()
    if not key:
        return None
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    if key in ("today", "yesterday"):
        start = now.astimezone(ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0).astimezone(timezone.utc)
        return start - timedelta(days=key == "yesterday")
    if m := re.fullmatch(r"(\d+)([smhd])", key):
        return now - timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})
    try:
        d = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def moment(value: datetime) -> Column:
    """A timestamp literal in UTC."""
    v = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int((v - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))))


def epoch(c: Column) -> Column:
    """A time from a number of seconds (above 1e9) or milliseconds (above 1e12), else null."""
    n = c.try_cast("double")
    ms = F.when(n > 1e12, n).when(n > 1e9, n * 1000)
    return F.timestamp_millis(F.when(ms < 9e15, ms).cast("long"))


def instant(text: Column) -> Column:
    """A time from text: ISO dates and times; without a zone, UTC. Null if it isn't one."""
    t = strip(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def utc_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))


def utc_hour(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH':00'"), F.lit("unknown"))


def rollup_moment(day: Column, preferred: Column, now: Column) -> Column:
    """When a day's rollup counts: ``preferred`` if it is on that UTC day and not after noon; else noon once it is past; else the day's start."""
    start = F.to_timestamp(day, "yyyy-MM-dd")
    noon = start + F.expr("INTERVAL 12 HOURS")
    return F.when((preferred >= start) & (preferred <= noon), preferred).when(noon <= now, noon).otherwise(start)
