"""Instrument masters: CSV with a header or (gzipped) JSON, with lower-case columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_csv_master(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; casts belong to ``normalise_master``."""
    return lower_names(spark.read.csv(path, header=True))


def csv_master(spark: SparkSession, text: str) -> DataFrame:
    """The same from a fetched text (``requests.master_text``); masters are small."""
    return lower_names(spark.read.csv(spark.sparkContext.parallelize(text.splitlines(), 1), header=True))


def read_json_master(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or lines of objects; gzip goes by the file's ending. An epoch ``expiry`` becomes a date."""
    rows = lower_names(spark.read.json(path, multiLine=True))
    if "expiry" not in rows.columns:
        return rows.withColumn("expiry", F.lit(None).cast("date"))
    return rows.withColumn("expiry", calendar.epoch_date(F.col("expiry").cast("long")))


def normalise_master(master: DataFrame) -> DataFrame:
    """Expiry as a date and lot and tick sizes as numbers, under one set of names; unreadable values become null."""
    out = lower_names(master)
    for old, new in (("sm_expiry_date", "expiry"), ("sem_expiry_date", "expiry"), ("sem_lot_units", "lot_size"), ("sem_tick_size", "tick_size")):
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    if "expiry" in out.columns and dict(out.dtypes)["expiry"] == "string":
        out = out.withColumn("expiry", F.expr("try_to_date(substring(trim(expiry), 1, 10), 'yyyy-MM-dd')"))
    if "lot_size" in out.columns:
        out = out.withColumn("lot_size", F.expr("try_cast(try_cast(lot_size as double) as bigint)"))
    if "tick_size" in out.columns:
        out = out.withColumn("tick_size", F.expr("try_cast(tick_size as double)"))
    return out
