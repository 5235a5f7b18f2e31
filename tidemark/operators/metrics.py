"""Performance metrics as aggregates and windows for each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR_DAYS = 252.0

ZERO_WITHOUT_TRADES = ("total_trades", "winning_trades", "losing_trades", "win_rate", "gross_pnl", "net_pnl", "avg_trade_pnl", "profit_factor")


def _or_zero(a, b):
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _summary() -> list:
    """Counts, sums and means of trades; a trade wins if its net is above 0."""
    win, net, gross = F.col("net_pnl") > 0, F.col("net_pnl"), F.col("gross_pnl")
    return [
        F.count("*").alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(~win).alias("losing_trades"), F.avg(win.cast("double")).alias("win_rate"),
        F.sum(gross).alias("gross_pnl"), F.sum(net).alias("net_pnl"), F.avg(net).alias("avg_trade_pnl"),
        F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)).alias("avg_winner"), F.coalesce(F.avg(F.when(~win, net)), F.lit(0.0)).alias("avg_loser"),
        _or_zero(F.coalesce(F.sum(F.when(win, gross)), F.lit(0.0)), F.abs(F.sum(F.when(~win, gross)))).alias("profit_factor"),
        F.avg("holding_periods").alias("avg_holding_periods"), F.avg(net).alias("expectancy"),
    ]


def _streaks() -> list:
    longest = lambda flag: F.coalesce(F.max(F.when(flag, F.col("__run"))), F.lit(0))
    return [longest(F.col("net_pnl") > 0).alias("longest_win_streak"), longest(~(F.col("net_pnl") > 0)).alias("longest_loss_streak")]


def _with_runs(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades with ``__run``, the number of trades of the same outcome in a row up to each."""
    w = Window.partitionBy(*by).orderBy("trade_id")
    win = F.col("net_pnl") > 0
    begins = F.when(F.coalesce(F.lag(win).over(w) != win, F.lit(True)), F.row_number().over(w))
    return trades.withColumn("__begins", begins).withColumn("__run", F.row_number().over(w) - F.last("__begins", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def trade_summary(trades: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Counts, sums and means of trades; a trade wins if its net is above 0."""
    return trades.groupBy(*by).agg(*_summary())


def streaks(trades: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Longest runs of winning and of losing trades."""
    return _with_runs(trades, by).groupBy(*by).agg(*_streaks())


def drawdowns(equity: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The curve with its running peak, drawdown, drawdown share and the number of bars under the peak so far."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    rows = equity.withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"dd_value": F.col("peak") - F.col("equity"), "dd_pct": F.when(F.col("peak") > 0, F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).otherwise(0.0)})
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__top", F.max(F.when(F.col("equity") >= F.col("peak"), F.col("__n"))).over(up_to))
    return rows.withColumn("dd_bars", F.when(F.col("equity") < F.col("peak"), F.col("__n") - F.coalesce("__top", F.lit(0))).otherwise(0).cast("long")).drop("__n", "__top")


def curve_days(equity: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Each day of a curve in one pass: its last equity, the worst drawdown (share, minus the bar's time, value) and the longest stretch under a peak."""
    worst = F.max(F.struct("dd_pct", -F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)"), "dd_value")).alias("worst")
    return drawdowns(equity, by).groupBy(*by, F.to_date("timestamp").alias("day_of")).agg(F.max_by("equity", "timestamp").alias("equity"), worst, F.max("dd_bars").alias("dd_bars"))


def _worst(days: DataFrame) -> list:
    return [F.max("worst")["dd_pct"].alias("max_drawdown_pct"), F.max("worst")["dd_value"].alias("max_drawdown_value"), F.max("dd_bars").alias("max_drawdown_duration_bars")]


def drawdown_summary(equity: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Largest drawdown share, the value at the first bar that has it, and the longest stretch under a peak."""
    days = curve_days(equity, by)
    return days.groupBy(*by).agg(*_worst(days))


def daily_returns(equity: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Each day's last equity and its change from the day before; the first day has none."""
    days = equity.groupBy(*by, F.to_date("timestamp").alias("day_of")).agg(F.max_by("equity", "timestamp").alias("equity"))
    return with_returns(days, by)


def with_returns(days: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy("day_of"))
    return days.withColumn("daily_return", F.when(before > 0, F.try_divide(F.col("equity") - before, before)).when(before.isNotNull(), 0.0))


def curve_summary(equity: DataFrame, capital: float, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Drawdown, days, total return, Sharpe and Sortino of daily returns, from one pass over the curve."""
    r = F.col("daily_return")
    days = with_returns(curve_days(equity, by), by)
    rows = days.groupBy(*by).agg(
        *_worst(days), F.count("*").alias("trading_days"), F.max_by("equity", "day_of").alias("__last"), F.avg(r).alias("__mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("__sd"),
        F.count_if(r < 0).alias("__n"), F.sum(F.when(r < 0, r * r)).alias("__sq"),
    )
    year = F.sqrt(F.lit(YEAR_DAYS))
    down = F.sqrt(F.col("__sq") / F.greatest(F.col("__n") - 1, F.lit(1)))
    ratio = lambda sd: F.when(sd > 0, _or_zero(F.col("__mean"), sd) * year).otherwise(0.0)
    return rows.select(*by, "max_drawdown_pct", "max_drawdown_value", "max_drawdown_duration_bars", "trading_days", _or_zero(F.col("__last") - capital, F.lit(capital)).alias("total_return_pct"), ratio(F.col("__sd")).alias("sharpe"), ratio(down).alias("sortino"))


def compute_metrics(trades: DataFrame, equity: DataFrame, capital: float = 1_000_000.0, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """One row for each series of ``equity``; what needs trades is 0 or null where there are none."""
    keys = list(by)
    out = curve_summary(equity, capital, by).join(_with_runs(trades, by).groupBy(*by).agg(*_summary(), *_streaks()), keys, "left")
    calmar = F.when(F.col("max_drawdown_pct") > 0, F.try_divide(F.col("total_return_pct") * YEAR_DAYS / F.greatest(F.col("trading_days"), F.lit(1)), F.col("max_drawdown_pct"))).otherwise(0.0)
    return out.fillna(0, [*ZERO_WITHOUT_TRADES]).withColumn("calmar", F.coalesce(calmar, F.lit(0.0)))
