"""Volatility regimes of days, and trades by regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, LOW = 0.015, 0.008
REGIMES = ("high", "mid", "low")


def day_regimes(bars: DataFrame, by: Sequence[str] = ("instrument",), high: float = HIGH, low: float = LOW) -> DataFrame:
    """Range of each day as a share of its last close, and its label."""
    days = bars.groupBy(*by, F.to_date("timestamp").alias("day_of")).agg(F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", "timestamp").alias("day_close"))
    days = days.withColumn("range_pct", F.try_divide(F.col("day_high") - F.col("day_low"), F.col("day_close")))
    return days.withColumn("regime", F.when(F.col("range_pct") > high, "high").when(F.col("range_pct") < low, "low").otherwise("mid"))


def regime_summary(bars: DataFrame, trades: DataFrame, by: Sequence[str] = ("instrument",), high: float = HIGH, low: float = LOW) -> DataFrame:
    """Days and trades of every regime of every series, empty ones too.

    A trade belongs to its entry's day; trades on days without bars don't
    count. A series without trades shows no days either.
    """
    days = day_regimes(bars, by, high, low).select(*by, "day_of", "regime")
    win = F.col("net_pnl") > 0
    dated = trades.select(*by, F.to_date("entry_time").alias("day_of"), "net_pnl", "gross_pnl").join(days, [*by, "day_of"])
    sums = dated.groupBy(*by, "regime").agg(F.count("*").alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.sum(F.when(win, F.col("gross_pnl"))).alias("__w"), F.sum(F.when(~win, F.col("gross_pnl"))).alias("__l"), F.avg(win.cast("double")).alias("win_rate"))
    counts = days.groupBy(*by, "regime").agg(F.count("*").alias("days"))
    order = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(i).alias("position")) for i, r in enumerate(REGIMES)]))
    frame = days.select(*by).distinct().select(*by, order.alias("r")).select(*by, "r.*")
    traded = trades.select(*by).distinct().withColumn("traded", F.lit(True))
    out = frame.join(counts, [*by, "regime"], "left").join(sums, [*by, "regime"], "left").join(traded, list(by), "left")
    zero = F.lit(0.0)
    return out.select(
        *by, "position", "regime", F.when(F.col("traded"), F.coalesce("days", F.lit(0))).otherwise(0).cast("long").alias("days"), F.coalesce("trades", F.lit(0)).cast("long").alias("trades"),
        F.coalesce("net_pnl", zero).alias("net_pnl"), F.coalesce(F.try_divide(F.coalesce("__w", zero), F.abs(F.coalesce("__l", zero))), zero).alias("profit_factor"), F.coalesce("win_rate", zero).alias("win_rate"),
    )
