"""Broker payloads to candle tables, and the month-partitioned candle store."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.schemas import CANDLES, conform

ROWS = "timestamp double, open double, high double, low double, close double, volume double, open_interest double"


def from_records(spark: SparkSession, records: Sequence[Mapping]) -> DataFrame:
    """Dict rows with epoch seconds or milliseconds (told by the greatest) as candles in exchange wall time.

    Missing open interest is 0. Anything but a list raises ValueError.
    """
    if not isinstance(records, (list, tuple)):
        raise ValueError("the payload is not a list of rows")
    names = ("timestamp", "open", "high", "low", "close", "volume", "open_interest")
    rows = [tuple(None if r.get(n) is None else float(r[n]) for n in names) for r in records]
    frame = spark.createDataFrame(rows, ROWS)
    greatest = max((r[0] for r in rows if r[0] is not None), default=0.0)
    millis = F.col("timestamp") * (1 if greatest >= 10_000_000_000 else 1000)
    stamp = calendar.from_micros(millis.cast("long") * 1000, "Asia/Kolkata")
    return frame.select(stamp.alias("timestamp"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), F.coalesce("open_interest", F.lit(0.0)).cast("long").alias("open_interest"))


def from_arrays(spark: SparkSession, rows: Sequence[Sequence]) -> DataFrame:
    """Positional rows [ISO time with offset, o, h, l, c, volume, (open interest)] as candles in exchange wall time."""
    if not isinstance(rows, (list, tuple)):
        raise ValueError("the payload is not a list of rows")
    flat = [(str(r[0]), *(float(x) for x in r[1:5]), int(r[5]), int(r[6]) if len(r) > 6 and r[6] is not None else 0) for r in rows]
    frame = spark.createDataFrame(flat, "iso string, open double, high double, low double, close double, volume long, open_interest long")
    return frame.select(calendar.wall_time(F.col("iso")).alias("timestamp"), "open", "high", "low", "close", "volume", "open_interest")


def from_json_arrays(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The same from a column of JSON texts {"data": {"candles": [[...], ...]}}, many at a time and without Python."""
    rows = payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.data.candles"), "array<array<string>>")).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    number = lambda i: at(i).cast("double")
    return rows.select(
        calendar.wall_time(at(0)).alias("timestamp"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"),
        number(5).cast("long").alias("volume"), F.coalesce(number(6), F.lit(0.0)).cast("long").alias("open_interest"),
    )


def normalise(candles: DataFrame, contract: Mapping) -> DataFrame:
    """The canonical candle columns with the contract's values on every row."""
    known = {"instrument": "string", "security_id": "string", "exchange": "string", "instrument_type": "string", "expiry": "date", "lot_size": "long", "tick_size": "double"}
    return conform(candles.withColumns({n: F.lit(contract.get(n)).cast(t) for n, t in known.items()}), CANDLES)


def download(spark: SparkSession, fetch: Callable[[], Sequence], contract: Mapping, root: str) -> DataFrame:
    """Fetches one contract's rows with a client function, normalises and stores them; returns what is stored."""
    payload = fetch()
    raw = from_records(spark, payload) if payload and isinstance(payload[0], Mapping) else from_arrays(spark, payload)
    write_store(normalise(raw, contract), root)
    return read_store(spark, root)


def write_store(candles: DataFrame, root: str, timeframe: str = "1m") -> None:
    """Candles by month and timeframe, files and rows in order of time; the partitions written replace those that were there."""
    rows = candles.withColumns({"month": F.date_format("timestamp", "yyyy-MM"), "tf": F.lit(timeframe)})
    rows = rows.repartitionByRange("timestamp").sortWithinPartitions("month", "tf", "timestamp")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "tf").parquet(root)


PLACE = ("__file", "__row")


def read_store(spark: SparkSession, root: str, month: str | None = None, timeframe: str | None = None, places: bool = False) -> DataFrame:
    """Stored candles; month and timeframe prune partitions. With ``places`` also PLACE, each row's file and number in it."""
    rows = spark.read.option("basePath", root).parquet(root)
    if places:
        rows = rows.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    rows = rows.withColumn("month", F.col("month").cast("string"))
    rows = rows if month is None else rows.where(F.col("month") == month)
    return rows if timeframe is None else rows.where(F.col("tf") == timeframe)


def contract_json(contract: Mapping) -> str:
    return json.dumps(dict(contract), indent=2, default=str, sort_keys=True)


def list_months(spark: SparkSession, root: str) -> DataFrame:
    """Bars by month and timeframe; reads no data columns."""
    return read_store(spark, root).groupBy("month", "tf").agg(F.count("*").alias("bars"))


def page(candles: DataFrame, limit: int = 20, offset: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Bars ``offset`` to ``offset + limit`` in order of time; limit is 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    return candles.orderBy("timestamp", *by).offset(offset).limit(limit)
