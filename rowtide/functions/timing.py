"""Time literals and windows as plain column comparisons, so that they reach the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

UNIT_SECONDS = {"day": 86400, "hour": 3600, "min": 60}


def cutoff(as_of: datetime, n: int, unit: str) -> datetime:
    return as_of - timedelta(seconds=n * UNIT_SECONDS[unit])


def moment(value: datetime | date | str, like: T.DataType | None = None) -> Column:
    """A literal of the column's own timestamp kind; a mismatch would cast the column and block pushdown."""
    kind = like.simpleString() if isinstance(like, (T.TimestampType, T.DateType)) else "timestamp_ntz"
    return F.lit(str(value)).cast(kind)


def moment_for(df: DataFrame, ts: str, value: datetime | date | str) -> Column:
    return moment(value, df.schema[ts].dataType)


def midnight(day: date | datetime) -> datetime:
    return datetime(day.year, day.month, day.day)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.timestamp_diff("SECOND", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)


def readable_duration(seconds: Column) -> Column:
    """``1h2m3s`` text of a number of seconds."""
    s = seconds.cast("bigint")
    return F.format_string(
        "%dh%dm%ds",
        F.floor(s / 3600),
        F.floor(F.pmod(s, F.lit(3600)) / 60),
        F.pmod(s, F.lit(60)),
    )


def report_range(begin: date | datetime | str, end: date | datetime | str) -> Column:
    """R2: the day range printed under a report title."""
    return F.format_string("%s 0:0:0 - %s 23:59:59", F.lit(str(begin)[:10]), F.lit(str(end)[:10]))
