"""Quality checks of stored bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.bars import broken_ohlc

# The texts that say more of a check.
DETAILS = {
    "daily_bar_counts": "%d day(s) with != %d bars",
    "volume_sanity": "%d negative, %d zero-volume bars",
    "open_interest_sanity": "%d negative, %d jumps > 25%%",
    "continuity": "%d intraday gaps, ~%d missing bars",
}
NOT_APPLICABLE = "n/a"

SESSION = (9 * 60 + 15, 15 * 60 + 30)
SESSION_MINUTES = 375
JUMP = 0.25


def off_session():
    """Bars that open before 09:15 or at 15:30 or later."""
    minute = F.hour("timestamp") * 60 + F.minute("timestamp")
    return (minute < SESSION[0]) | (minute >= SESSION[1])


def duplicates(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The times that a series has more than once."""
    return bars.groupBy(*by, "timestamp").agg(F.count("*").alias("n")).where("n > 1")


def daily_counts(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    return bars.groupBy(*by, F.to_date("timestamp").alias("day_of")).agg(F.count("*").alias("bars"))


def steps(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Bars with what the bar before in order of time says: seconds since (same day) and open-interest change."""
    day = Window.partitionBy(*by, F.to_date("timestamp")).orderBy("timestamp")
    out = bars.withColumn("step_seconds", F.timestamp_diff("SECOND", F.lag("timestamp").over(day), F.col("timestamp")))
    if "open_interest" in bars.columns:
        old = F.lag("open_interest").over(day)
        out = out.withColumn("oi_change", F.abs(F.col("open_interest") - old) / F.greatest(old.cast("double"), F.lit(1.0)))
    return out


STORED_CHUNK = 100_000


def stored_order(bars: DataFrame, place: Sequence[str], by: Sequence[str] = ("instrument",)) -> DataFrame:
    """(``by``, back): how often the time goes back in stored order. ``place`` names the row number and, before it, columns such as the file.

    Rows are compared within chunks of STORED_CHUNK row numbers, then the chunks'
    edges, so a series of any length is many tasks'.
    """
    *file, row = place
    rows = bars.select(*by, *file, F.col(row).alias("__row"), "timestamp").withColumn("__chunk", F.floor(F.col("__row") / STORED_CHUNK))
    inside = Window.partitionBy(*by, *file, "__chunk").orderBy("__row")
    back = F.coalesce(F.col("timestamp") < F.lag("timestamp").over(inside), F.lit(False))
    chunks = rows.withColumn("__back", back).groupBy(*by, *file, "__chunk").agg(F.count_if("__back").alias("n"), F.min_by("timestamp", "__row").alias("first"), F.max_by("timestamp", "__row").alias("last"))
    edge = F.coalesce(F.col("first") < F.lag("last").over(Window.partitionBy(*by).orderBy(*file, "__chunk")), F.lit(False))
    return chunks.withColumn("__edge", edge.cast("long")).groupBy(*by).agg(F.sum(F.col("n") + F.col("__edge")).alias("back"))


def validate_bars(bars: DataFrame, interval_minutes: int = 1, by: Sequence[str] = (), place: Sequence[str] = (), positive: bool = True) -> DataFrame:
    """Eight checks (name, status, failures, details) for each series of ``by``, and the series' overall status.

    The order of windows is by time within a day, so a series of any length is
    spread over its days. ``place`` names the stored order of rows (see
    ``stored_order``); without it that check sees nothing. Prices of 0 or less
    fail; where ``positive`` is False (values that are no prices) they warn.
    """
    keys = list(by)
    per_day = SESSION_MINUTES // interval_minutes
    has_oi, has_volume = "open_interest" in bars.columns, "volume" in bars.columns
    seen = steps(bars, keys)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    zero = F.lit(0).cast("long")
    bad = broken_ohlc(strict=True, positive=positive)
    by_time = seen.groupBy(*keys, "timestamp").agg(
        F.count("*").alias("n"),
        one(off_session()).alias("off_session"),
        one(bad).alias("broken"),
        one(~bad & (F.col("low") <= 0)).alias("not_positive"),
        (one(F.col("volume") < 0) if has_volume else F.sum(zero)).alias("neg_volume"),
        (one(F.col("volume") == 0) if has_volume else F.sum(zero)).alias("no_volume"),
        (one(F.col("open_interest") < 0) if has_oi else F.sum(zero)).alias("neg_oi"),
        (one(F.col("oi_change") > JUMP) if has_oi else F.sum(zero)).alias("jumps"),
        one(F.col("step_seconds") != 60).alias("gaps"),
    )
    totals = ["off_session", "broken", "not_positive", "neg_volume", "no_volume", "neg_oi", "jumps", "gaps"]
    by_day = by_time.groupBy(*keys, F.to_date("timestamp").alias("__day")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("dups"), *[F.sum(c).alias(c) for c in totals])
    whole = by_day.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.count_if(F.col("n") != per_day).alias("off_days"), F.sum("dups").alias("dups"), *[F.sum(c).alias(c) for c in totals])
    if place:
        back = stored_order(bars, place, keys)
        whole = whole.join(back, keys) if keys else whole.crossJoin(back)
    else:
        whole = whole.withColumn("back", zero)
    missing = F.greatest(F.lit(0), F.col("days") * per_day - F.col("n"))
    no_gaps = F.col("gaps") + missing if interval_minutes == 1 else F.lit(0)
    fail = lambda c: F.when(c > 0, "fail").otherwise("pass")
    warn = lambda c: F.when(c > 0, "warn").otherwise("pass")
    count = lambda c: F.coalesce(c, zero).cast("long")
    say = lambda name, *values: F.format_string(DETAILS[name], *map(count, values))
    nothing = F.lit("")
    gone = say("continuity", F.col("gaps"), missing) if interval_minutes == 1 else F.lit(NOT_APPLICABLE)
    checks = [
        ("timestamp_monotonic", fail(F.col("back")), F.col("back"), nothing),
        ("no_duplicates", fail(F.col("dups")), F.col("dups"), nothing),
        ("market_hours", fail(F.col("off_session")), F.col("off_session"), nothing),
        ("daily_bar_counts", warn(F.col("off_days")), F.col("off_days"), say("daily_bar_counts", F.col("off_days"), F.lit(per_day))),
        ("ohlc_integrity", F.when(F.col("broken") > 0, "fail").otherwise(warn(F.col("not_positive"))), F.col("broken") + F.col("not_positive"), nothing),
        ("volume_sanity", F.when(F.col("neg_volume") > 0, "fail").otherwise(warn(F.col("no_volume"))), F.col("neg_volume") + F.col("no_volume"), say("volume_sanity", F.col("neg_volume"), F.col("no_volume"))),
        ("open_interest_sanity", F.when(F.col("neg_oi") > 0, "fail").otherwise(warn(F.col("jumps"))), F.col("neg_oi") + F.col("jumps"), say("open_interest_sanity", F.col("neg_oi"), F.col("jumps"))),
        ("continuity", warn(no_gaps), no_gaps, gone),
    ]
    table = whole.withColumn("checks", F.array(*[F.struct(F.lit(n).alias("name"), s.alias("status"), count(f).alias("failures"), d.alias("details")) for n, s, f, d in checks]))
    states = F.transform("checks", lambda c: c["status"])
    overall = F.when(F.array_contains(states, "fail"), "fail").when(F.array_contains(states, "warn"), "pass_with_warnings").otherwise("pass")
    return table.withColumn("overall", overall).select(*keys, "overall", F.explode("checks").alias("c")).select(*keys, "c.*", "overall")


def day_checks(bars: DataFrame, by: Sequence[str] = ("instrument",), share: float = 3.0, gap: float = 0.05) -> DataFrame:
    """Further signs for each day: volume over ``share`` times the series' mean day or under its inverse, an open
    more than ``gap`` from the last close, weekdays missing since the day before, and values that are not numbers."""
    prices = ("open", "high", "low", "close")
    odd = F.lit(False)
    for c in prices:
        odd = odd | F.isnan(c)
    days = bars.groupBy(*by, F.to_date("timestamp").alias("day_of")).agg(F.sum("volume").alias("volume"), F.min_by("open", "timestamp").alias("day_open"), F.max_by("close", "timestamp").alias("day_close"), F.count_if(odd).alias("not_numbers"))
    w = Window.partitionBy(*by).orderBy("day_of")
    mean = F.avg("volume").over(Window.partitionBy(*by))
    before = F.lag("day_of").over(w)
    inside = F.sequence(F.date_add(before, 1), F.date_sub(F.col("day_of"), 1))
    skipped = F.when(F.datediff("day_of", before) > 1, F.size(F.filter(inside, lambda d: F.weekday(d) < 5))).otherwise(0)
    change = F.abs(F.try_divide(F.col("day_open") - F.lag("day_close").over(w), F.lag("day_close").over(w)))
    return days.select(*by, "day_of", "volume", ((F.col("volume") > mean * share) | (F.col("volume") < mean / share)).alias("odd_volume"), F.coalesce(change > gap, F.lit(False)).alias("open_gap"), skipped.cast("long").alias("missing_weekdays"), "not_numbers")
