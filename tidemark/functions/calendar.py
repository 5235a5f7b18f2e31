"""Calendar expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_thursday(day: Column) -> Column:
    """The last Thursday of the month of ``day``."""
    end = F.last_day(day)
    return F.date_sub(end, F.pmod(F.weekday(end) - 3, F.lit(7)).cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def wall_time(iso: Column, zone: str = "Asia/Kolkata") -> Column:
    """Wall time in ``zone`` of ISO text with an offset, whatever the session's zone."""
    seconds = F.unix_micros(F.to_timestamp(iso))
    return from_micros(seconds, zone)


def wall_time_of_epoch(epoch: Column, zone: str = "Asia/Kolkata") -> Column:
    """Wall time in ``zone`` of epoch seconds or milliseconds: 1e10 and more are milliseconds."""
    millis = F.when(F.abs(epoch) < 10_000_000_000, epoch * 1000).otherwise(epoch)
    return from_micros(millis.cast("long") * 1000, zone)


def from_micros(micros: Column, zone: str) -> Column:
    utc = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + whole)


def epoch_date(epoch: Column) -> Column:
    """The UTC date of epoch seconds or milliseconds."""
    seconds = F.when(F.abs(epoch) >= 10_000_000_000, F.floor(epoch / 1000)).otherwise(epoch)
    return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(seconds / 86400).cast("int"))


def month_range(year: int, month: int) -> tuple[dt.date, dt.date]:
    """First and last day of a month."""
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date(year, month, 1), following - dt.timedelta(days=1)


def parse_month(text: str) -> tuple[int, int]:
    """(year, month) of ``YYYY-MM``; anything else raises ValueError."""
    day = dt.datetime.strptime(text.strip(), "%Y-%m")
    return day.year, day.month
