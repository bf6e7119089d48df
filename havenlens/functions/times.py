"""Time stamps that do not depend on the session's time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(at: dt.datetime | None = None) -> Column:
    """The given time, or now to the second, without a zone. Given times go in as text, since a datetime literal would
    be shifted by any difference between the zones of Python and the session."""
    if at is None:
        return F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
