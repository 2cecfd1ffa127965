"""Calendar arithmetic of US Eastern time, from nanoseconds since 1970."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000


def _nth_sunday(year: Column, month: int, n: int) -> Column:
    """Days since 1970 of the n-th Sunday of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.unix_date(F.next_day(F.date_sub(first, 1), "Sun")) + 7 * (n - 1)


def eastern_ns(ts_ns: Column) -> Column:
    """Wall-clock nanoseconds: UTC-4 from the second Sunday of March, 7:00 UTC, to the first of November, 6:00 UTC, else
    UTC-5, in every year."""
    year = F.year(F.date_from_unix_date(F.floor(ts_ns / DAY_NS).cast("int")))
    begin, end = _nth_sunday(year, 3, 2).cast("long") * DAY_NS + 7 * HOUR_NS, _nth_sunday(year, 11, 1).cast("long") * DAY_NS + 6 * HOUR_NS
    summer = (ts_ns >= begin) & (ts_ns < end)
    return ts_ns - F.when(summer, 4 * HOUR_NS).otherwise(5 * HOUR_NS)


def eastern_day(ts_ns: Column) -> Column:
    """Days since 1970 of the Eastern date."""
    local = eastern_ns(ts_ns)
    return ((local - F.pmod(local, F.lit(DAY_NS))) / DAY_NS).cast("long")


def eastern_minute(ts_ns: Column) -> Column:
    """Minutes since Eastern midnight."""
    return F.floor(F.pmod(eastern_ns(ts_ns), F.lit(DAY_NS)) / 60_000_000_000).cast("long")


def parse_sessions(text: str) -> list[tuple[int, int]]:
    """Half-open minute windows of a list such as ``"08:00-12:15, 14:00-22:00"``.

    A part is left out unless both its ends are times of a day and the first is the earlier; without any part that is
    left, every minute is in session.
    """
    ends = [[_minute(x) for x in part.split("-", 1)] for part in text.split(",")]
    return [(e[0], e[1]) for e in ends if len(e) == 2 and None not in e and e[0] < e[1]]


def _minute(text: str) -> int | None:
    """Minutes since midnight of ``h:m``, digits only."""
    found = re.fullmatch(r"\+?([0-9]+):\+?([0-9]+)", text.strip(), re.ASCII)
    if not found or int(found[1]) > 23 or int(found[2]) > 59:
        return None
    return 60 * int(found[1]) + int(found[2])


def in_sessions(minute: Column, sessions: list[tuple[int, int]]) -> Column:
    """Whether a minute is in one of the windows; always if there are none."""
    inside = F.lit(not sessions)
    for a, b in sessions:
        inside = inside | ((minute >= a) & (minute < b))
    return inside
