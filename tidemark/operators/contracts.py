"""Choice of futures contracts from instrument masters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_range


def index_futures(master: DataFrame, underlying: str = "NIFTY", kind: Sequence[str] = ("FUTIDX", "FUT")) -> DataFrame:
    """Futures on one underlying, by whichever of the usual columns the master has."""
    have = set(master.columns)
    rows = master
    for column, values in (("underlying_symbol", (underlying,)), ("instrument_type", tuple(kind))):
        if column in have:
            rows = rows.where(F.upper(F.trim(F.col(column).cast("string"))).isin(*values))
    return rows


def expiring_in_month(contracts: DataFrame, year: int, month: int, expiry: str = "expiry") -> DataFrame:
    """The earliest contract that expires within the month (none if there is none)."""
    first, last = month_range(year, month)
    return contracts.where(F.col(expiry).between(F.lit(first), F.lit(last))).orderBy(expiry, *[c for c in ("security_id", "instrument_key") if c in contracts.columns]).limit(1)


def active_on(contracts: DataFrame, day: dt.date, expiry: str = "expiry") -> DataFrame:
    """The contract with the earliest expiry on or after ``day``."""
    return contracts.where(F.col(expiry) >= F.lit(day)).orderBy(expiry, *[c for c in ("security_id", "instrument_key") if c in contracts.columns]).limit(1)


def earliest_on_or_after(rows: DataFrame, key: Sequence[str], date_col: str, day, order: Sequence[str]) -> DataFrame:
    """For each key the first row dated on or after ``day``, as one partial aggregate."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(date_col, *order))
    return rows.where(F.col(date_col) >= day).groupBy(*key).agg(first.alias("__r")).select(*key, "__r.*")


def expired(contracts: DataFrame, day: dt.date, expiry: str = "expiry") -> DataFrame:
    """Contracts that expired before ``day``, the latest first."""
    return contracts.where(F.col(expiry) < F.lit(day)).orderBy(F.desc(expiry))


def find_future(contracts: DataFrame, day: dt.date, underlying: str = "NIFTY", expiry: str = "expiry") -> DataFrame:
    """The future on ``underlying`` that expires on ``day``, if there is one."""
    return index_futures(contracts, underlying).where(F.col(expiry) == F.lit(day)).orderBy(*[c for c in ("security_id", "instrument_key", "trading_symbol") if c in contracts.columns]).limit(1)
