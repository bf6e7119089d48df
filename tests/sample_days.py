"""The day on which the sample book is seen, and days counted from it."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2001, 11, 5)


def day(offset: int) -> dt.date:
    return AS_OF + dt.timedelta(days=offset)


def at(offset: int, hour: int = 0) -> dt.datetime:
    return dt.datetime.combine(day(offset), dt.time(hour))
