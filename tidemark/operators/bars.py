"""Price bars by time bucket, and the audit of a roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts that say more of a roll-up's check.
DETAILS = {
    "bucket_size": "%d bucket(s) not containing exactly %d bars",
    "volume_sum": "1m=%d vs %dm=%d",
    "ohlc_integrity": "%d violations",
    "boundary_alignment": "%d timestamp(s) off a %d-minute wall-clock grid",
    "edge_alignment": "first=%s, last_within=%s",
}

OHLCV = ("open", "high", "low", "close", "volume", "open_interest")


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned bucket of wall time ``ts``."""
    return F.window(ts, f"{minutes} minutes")["start"]


def aggregate_bars(bars: DataFrame, minutes: int, by: Sequence[str] = ("instrument",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Bars of ``minutes``: open and every further column from the first row of a bucket, close and open_interest from the last.

    Buckets are closed on the left and named by their start; buckets without
    rows do not appear. ``order`` must tell the rows of a bucket apart, so that
    first and last mean the same whatever the partitioning. One minute or less
    gives the bars as they are. Sums are partial before the one shuffle.
    """
    if minutes <= 1:
        return bars
    at = F.struct(*order)
    rules = {
        "open": F.min_by("open", at), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", at),
        "volume": F.sum("volume"), "open_interest": F.max_by("open_interest", at),
    }
    rest = [c for c in bars.columns if c not in (*by, "timestamp")]
    out = bars.groupBy(*by, F.window("timestamp", f"{minutes} minutes").alias("__w")).agg(*[rules.get(c, F.min_by(c, at)).alias(c) for c in rest])
    return out.withColumn("timestamp", F.col("__w")["start"]).select(*bars.columns)


def bars_from_events(events: DataFrame, minutes: int, key: str = "event_type", price: str = "value", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Bars from single priced events: volume counts them, ``key`` is the instrument."""
    at = F.struct(*order)
    grouped = events.groupBy(F.col(key).alias("instrument"), F.window(F.col(order[0]), f"{minutes} minutes").alias("__w"))
    out = grouped.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
    return out.select("instrument", F.col("__w")["start"].alias("timestamp"), "open", "high", "low", "close", "volume")


def broken_ohlc(strict: bool = False, positive: bool = True) -> Column:
    """Rows whose high and low do not bound open and close; ``strict`` adds prices that are null or, with ``positive``, not positive."""
    wrong = F.lit(False)
    for bad in ("high < low", "high < open", "high < close", "low > open", "low > close"):
        wrong = wrong | F.expr(bad)
    if strict:
        for c in ("open", "high", "low", "close"):
            wrong = wrong | F.col(c).isNull()
            wrong = wrong | (F.col(c) <= 0) if positive else wrong
    return F.coalesce(wrong, F.lit(False))


def verify_rollup(source: DataFrame, derived: DataFrame, minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """Five checks (name, status, failures, details) of bars derived from one-minute bars, for each series of ``by``.

    bucket_size warns; volume_sum, ohlc_integrity, boundary_alignment and
    edge_alignment fail. Each side is read once.
    """
    keys = list(by)
    size = minutes * 60
    stamp = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)")
    sizes = source.groupBy(*keys, F.floor(stamp / size).alias("__b")).agg(F.count("*").alias("n"), F.sum("volume").alias("v"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    left = sizes.groupBy(*keys).agg(F.count_if(F.col("n") != minutes).alias("off_sized"), F.sum("v").alias("source_volume"), F.min("first").alias("source_first"), F.max("last").alias("source_last"))
    right = derived.groupBy(*keys).agg(
        F.sum("volume").alias("derived_volume"), F.count_if(broken_ohlc()).alias("violations"), F.count_if((F.hour("timestamp") * 60 + F.minute("timestamp")) % minutes != 0).alias("off_grid"),
        F.min(stamp).alias("derived_first"), F.max(stamp).alias("derived_last"),
    )
    both = left.join(right, keys, "full") if keys else left.crossJoin(right)
    gap = F.abs(F.coalesce("source_volume", F.lit(0)) - F.coalesce("derived_volume", F.lit(0)))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    first = F.coalesce(F.col("source_first") == F.col("derived_first"), F.lit(False))
    last = F.coalesce(F.col("source_last") - F.col("derived_last") < size, F.lit(False))
    said = lambda flag: F.when(flag, "True").otherwise("False")
    say, span = (lambda name, *values: F.format_string(DETAILS[name], *values)), F.lit(minutes)
    checks = [
        ("bucket_size", F.col("off_sized"), "warn", say("bucket_size", whole("off_sized"), span)),
        ("volume_sum", gap, "fail", say("volume_sum", whole("source_volume"), span, whole("derived_volume"))),
        ("ohlc_integrity", F.col("violations"), "fail", say("ohlc_integrity", whole("violations"))),
        ("boundary_alignment", F.col("off_grid"), "fail", say("boundary_alignment", whole("off_grid"), span)),
        ("edge_alignment", F.when(first & last, 0).otherwise(1), "fail", say("edge_alignment", said(first), said(last))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.coalesce(f, F.lit(0)) == 0, "pass").otherwise(s).alias("status"), F.coalesce(f, F.lit(0)).cast("long").alias("failures"), d.alias("details")) for n, f, s, d in checks]))
    return both.select(*keys, rows.alias("c")).select(*keys, "c.*")
