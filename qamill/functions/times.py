"""Timestamp Column expressions for run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run directories are stamped in this zone and layout.
RUN_TIME_ZONE = "America/Los_Angeles"
RUN_STAMP_FORMAT = "yyyyMMdd_HHmmss"


def local_stamp(ts_utc, zone: str = RUN_TIME_ZONE, fmt: str = RUN_STAMP_FORMAT) -> Column:
    """A UTC wall clock (``timestamp_ntz``) rendered in ``zone`` as ``fmt``."""
    col = F.col(ts_utc) if isinstance(ts_utc, str) else ts_utc
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), col.cast("timestamp_ntz")), fmt)


def instant_stamp(ts, zone: str = RUN_TIME_ZONE, fmt: str = RUN_STAMP_FORMAT) -> Column:
    """An instant (``timestamp``) rendered in ``zone`` as ``fmt``, the same in every
    session time zone: its wall clock is read in the session's zone first."""
    col = F.col(ts) if isinstance(ts, str) else ts
    wall = col.cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), wall), fmt)
