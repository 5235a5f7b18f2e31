"""Indicators as window expressions.

``by`` names the columns that tell series apart, ``order`` the time column; a
series is one window partition, so nothing here is global.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEGLIGIBLE = 1e-17


def series(by: Sequence[str], order: str = "timestamp"):
    return Window.partitionBy(*by).orderBy(order)


def reach(period: int) -> int:
    """Preceding rows after which an EMA's dropped weight is below double precision."""
    return math.ceil(math.log(NEGLIGIBLE) / math.log(1 - 2 / (period + 1)))


def ema_name(period: int, source: str = "close") -> str:
    return f"ema_{period}" if source == "close" else f"ema_{source}_{period}"


def _step(period: int):
    a = 2.0 / (period + 1)
    return lambda y, x: y * F.lit(1 - a) + x * F.lit(a)


def _scan(values: Column, start: Column, period: int) -> Column:
    """``start`` and the averages after it, one for each of ``values``."""
    step = _step(period)
    return F.aggregate(values, F.array(start), lambda so_far, x: F.concat(so_far, F.array(step(F.element_at(so_far, -1), x))))


def with_emas(df: DataFrame, periods: Sequence[int], by: Sequence[str], source: str = "close", order: str = "timestamp") -> DataFrame:
    """Adds one EMA column for each period: y0 = x0, then y = (1-a)*y + a*x with a = 2/(period+1).

    The first period-1 rows of a series are null. A series is cut into chunks of
    as many rows as the longest average can tell; each chunk runs the recursion
    once over the chunk before, from its first value, and over its own rows. So a
    row is visited twice, no array holds more than a chunk, and what is dropped
    is below double precision. The source must not be null.
    """
    periods = list(dict.fromkeys(periods))
    size = max(map(reach, periods)) + 1
    others = [c for c in df.columns if c not in by]
    rows = df.withColumn("__row", F.row_number().over(series(by, order)))
    chunks = rows.groupBy(*by, F.floor((F.col("__row") - 1) / size).alias("__chunk")).agg(F.sort_array(F.collect_list(F.struct("__row", *others))).alias("__rows"))
    chunks = chunks.withColumn("__x", F.transform("__rows", lambda r: r[source]))
    chunks = chunks.withColumn("__before", F.lag("__x").over(series(by, "__chunk")))
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    names = {ema_name(p, source): p for p in periods}
    for name, p in names.items():
        carried = F.aggregate(rest(F.col("__before")), F.element_at("__before", 1), _step(p))
        own = F.when(F.col("__before").isNull(), _scan(rest(F.col("__x")), F.element_at("__x", 1), p)).otherwise(rest(_scan(F.col("__x"), carried, p)))
        chunks = chunks.withColumn(name, own)
    each = chunks.select(*by, F.explode(F.arrays_zip("__rows", *names)).alias("__r"))
    emas = [F.when(F.col("__r.__rows.__row") >= p, F.col(f"__r.{n}")).alias(n) for n, p in names.items()]
    return each.select(*[F.col(c) if c in by else F.col(f"__r.__rows.{c}").alias(c) for c in df.columns], *emas)


def angle(column: str, by: Sequence[str], lookback: int = 1, scale: float = 1000.0, order: str = "timestamp") -> Column:
    """Degrees of arctan(scale * relative change over ``lookback`` rows); null without a value that far back.

    A change from zero is a right angle with the sign of the change.
    """
    now, before = F.col(column), F.lag(column, lookback).over(series(by, order))
    slope = F.when(before != 0, (now - before) / F.when(before != 0, before))
    return F.when(before == 0, F.signum(now) * 90.0).otherwise(F.degrees(F.atan(slope * scale)))


def with_indicators(df: DataFrame, periods: Sequence[int] = (9, 15), by: Sequence[str] = ("instrument",), lookback: int = 1, scale: float = 1000.0) -> DataFrame:
    """EMA and EMA angle columns for each period."""
    out = with_emas(df, periods, by)
    return out.withColumns({f"{ema_name(p)}_angle_deg": angle(ema_name(p), by, lookback, scale) for p in periods})
