"""Processing of stored raw bars: validate, resample, add indicators, store, verify."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators
from tidemark.operators import bars, quality
from tidemark.plans import reports
from tidemark.sources import candles as store

TIMEFRAMES = (1, 5, 15)
BY = ("instrument",)


def label(minutes: int) -> str:
    return f"{minutes}m"


def validate_month(spark: SparkSession, raw_root: str, month: str, by: Sequence[str] = (), positive: bool = True) -> dict:
    """The quality report of a stored month of one-minute bars."""
    rows = store.read_store(spark, raw_root, month, "1m", places=True)
    return quality_report(rows, f"{month}_1m", by, store.PLACE, positive)


def quality_report(rows: DataFrame, dataset: str, by: Sequence[str] = (), place: Sequence[str] = (), positive: bool = True) -> dict:
    """Checks, totals and overall status as one record; only these few values come to the driver."""
    checks = quality.validate_bars(rows, 1, by, place, positive).collect()
    total, first, last, days = rows.agg(F.count("*"), F.min("timestamp"), F.max("timestamp"), F.countDistinct(F.to_date("timestamp"))).first()
    return reports.validation_record(dataset, total, first, last, days, [c.asDict() for c in checks])


def process_month(spark: SparkSession, raw_root: str, processed_root: str, month: str, timeframes: Sequence[int] = TIMEFRAMES, periods: Sequence[int] = (9, 15), by: Sequence[str] = BY, positive: bool = True) -> dict:
    """Validates a raw month (a failure raises RuntimeError), then writes and verifies every timeframe.

    Returns bars by timeframe, the validation status and the verification
    status of each derived timeframe. Partitions of the month are replaced.
    ``positive`` False lets prices of 0 or less pass with a warning.
    """
    stored = store.read_store(spark, raw_root, month, "1m", places=True)
    raw = stored.drop("month", "tf", *store.PLACE)
    if raw.isEmpty():
        raise FileNotFoundError(f"no raw bars for {month} at {raw_root}")
    report = quality_report(stored, f"{month}_1m", by, store.PLACE, positive)
    if report["overall_status"] == "fail":
        raise RuntimeError(f"validation failed for {month}: {report['errors']}")
    out: dict = {"validation": report["overall_status"], "verification": {}}
    for minutes in timeframes:
        frame = indicators.with_indicators(bars.aggregate_bars(raw, minutes, by), periods, by)
        store.write_store(frame, processed_root, label(minutes))
        stored = store.read_store(spark, processed_root, month, label(minutes))
        out[label(minutes)] = {"bars": stored.count()}
        if minutes > 1:
            checks = [c.asDict() for c in bars.verify_rollup(raw, stored, minutes, by).collect()]
            out["verification"][label(minutes)] = reports.overall(checks, warns=False)
    return out
