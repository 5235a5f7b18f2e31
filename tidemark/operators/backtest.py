"""Next-open execution of signals as windows, without a loop over bars.

A position is flat, long or short. A buy moves it one step up, a sell one step
down, never beyond long or short: position = clamp(position + signal). Two
equal signals in a row end at that side from any start, and after them each
alternating signal only opens or closes it. So the side of the latest repeated
signal (at first, of the first signal) decides: a bar's position is that side
where its signal has it, else flat. This takes two windows over the signals,
linear in their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import costs
from tidemark.functions.schemas import BacktestConfig


def sign(signal_type: str = "signal_type") -> Column:
    return F.when(F.col(signal_type) == "BUY", 1).when(F.col(signal_type) == "SELL", -1).otherwise(0)


def executable(bars: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """``bars`` (open, close) with what a signal on them would fill at: the next bar's number, open and time, and the series' last bar."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bars.withColumns({
        "fill": F.lead("open").over(w), "fill_time": F.lead("timestamp").over(w), "fill_bar": F.row_number().over(w) + 1,
        "last_close": F.last("close").over(whole), "last_time": F.last("timestamp").over(whole), "last_bar": F.count("*").over(whole),
    })


def held(signals: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The signals (``executable`` rows with sig 1 or -1) that fill, with the position after and before; one on the last bar never does."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    rows = signals.where((F.col("sig") != 0) & F.col("fill_time").isNotNull())
    before = F.lag("sig").over(w)
    rows = rows.withColumn("pin", F.when(before.isNull() | (before == F.col("sig")), F.col("sig")))
    rows = rows.withColumn("side", F.last("pin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("position", F.when(F.col("side") == F.col("sig"), F.col("sig")).otherwise(0))
    return rows.withColumn("position_before", F.lag("position", 1, 0).over(w)).drop("pin", "side")


def positions(signals: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The executable signals: bar and time of the fill, its nominal price, position after it and before it.

    ``signals`` needs open and close. A signal fills at the open of the next
    bar; one on the last bar never does.
    """
    return held(executable(signals.select(*by, "timestamp", "open", "close", sign().alias("sig")), by), by)


def run_trades(signals: DataFrame, config: BacktestConfig = BacktestConfig(), by: Sequence[str] = ("instrument",)) -> DataFrame:
    """One row for each trade; a position open at the end is closed at the last close (closed_at_end = 1)."""
    return trades_of(positions(signals, by), config, by)


def trades_of(rows: DataFrame, config: BacktestConfig = BacktestConfig(), by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The trades of ``held`` rows."""
    w = Window.partitionBy(*by).orderBy("fill_bar")
    moves = rows.where("position <> position_before")
    moves = moves.withColumns({"exit_fill": F.lead("fill").over(w), "exit_at": F.lead("fill_time").over(w), "exit_bar": F.lead("fill_bar").over(w)})
    opened = moves.where("position <> 0")
    is_long, at_end = F.col("position") == 1, F.col("exit_bar").isNull()
    buy, sell = F.lit("buy"), F.lit("sell")
    nominal = F.coalesce("exit_fill", "last_close")
    entry = F.when(is_long, costs.fill_price(F.col("fill"), buy, config.slippage)).otherwise(costs.fill_price(F.col("fill"), sell, config.slippage))
    leave = F.when(is_long, costs.fill_price(nominal, sell, config.slippage)).otherwise(costs.fill_price(nominal, buy, config.slippage))
    rows = opened.select(
        *by, F.col("fill_time").alias("entry_time"), F.coalesce("exit_at", "last_time").alias("exit_time"), F.when(is_long, "LONG").otherwise("SHORT").alias("direction"),
        entry.alias("entry_price"), leave.alias("exit_price"), F.lit(config.quantity).cast("long").alias("quantity"), F.col("position").alias("__p"),
        (F.coalesce("exit_bar", "last_bar") - F.col("fill_bar")).cast("long").alias("holding_periods"), at_end.cast("long").alias("closed_at_end"),
    )
    rows = rows.withColumn("gross_pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") * F.col("__p"))
    rows = rows.withColumn("costs", costs.round_trip_cost(F.col("entry_price"), F.col("exit_price"), F.col("quantity"), F.col("__p") == 1, config.costs))
    rows = rows.withColumns({"net_pnl": F.col("gross_pnl") - F.col("costs"), "trade_id": F.row_number().over(Window.partitionBy(*by).orderBy("entry_time")).cast("long")})
    return rows.select(*by, "trade_id", "entry_time", "exit_time", "direction", "entry_price", "exit_price", "quantity", "gross_pnl", "costs", "net_pnl", "holding_periods", "closed_at_end")


def equity_curve(bars: DataFrame, trades: DataFrame, config: BacktestConfig = BacktestConfig(), by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Equity, unrealized and realized at each bar's close: an exit at a bar's open counts in that bar.

    A close at the end of the data is not in the curve, which marks the open
    position to market there.
    """
    w = Window.partitionBy(*by).orderBy("timestamp", "kind").rowsBetween(Window.unboundedPreceding, 0)
    way = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    opened = F.struct(way.alias("way"), F.col("entry_price").alias("price"), F.col("quantity").alias("quantity"))
    flat = F.struct(F.lit(0).alias("way"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("quantity"))
    none = F.lit(None).cast("double")
    event = lambda at, held, net: F.struct(F.col(at).alias("timestamp"), held.alias("held"), net.alias("net"))
    both = F.array(event("entry_time", opened, none), F.when(F.col("closed_at_end") == 0, event("exit_time", flat, F.col("net_pnl"))))
    # a trade's events are rows of their own just before their bar, so that one shuffle by series serves all windows
    events = trades.select(*by, F.explode(both).alias("e")).where("e IS NOT NULL").select(*by, "e.timestamp", F.lit(0).alias("kind"), none.alias("close"), "e.held", "e.net")
    marks = bars.select(*by, "timestamp", F.lit(1).alias("kind"), "close", F.lit(None).cast(events.schema["held"].dataType).alias("held"), none.alias("net"))
    rows = marks.unionByName(events).withColumns({"held": F.last("held", ignorenulls=True).over(w), "realized": F.sum(F.coalesce("net", F.lit(0.0))).over(w)}).where("kind = 1")
    rows = rows.withColumn("unrealized", F.coalesce((F.col("close") - F.col("held.price")) * F.col("held.quantity") * F.col("held.way"), F.lit(0.0)))
    return rows.select(*by, "timestamp", (F.lit(config.initial_capital) + F.col("realized") + F.col("unrealized")).alias("equity"), "unrealized", "realized")


def join_signals(bars: DataFrame, signals: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Signals made elsewhere on the bars that both have; no common bar raises ValueError."""
    rows = bars.select(*by, "timestamp", "open", "close").join(signals.select(*by, "timestamp", "signal_type"), [*by, "timestamp"])
    if rows.isEmpty():
        raise ValueError("bars and signals have no time in common")
    return rows


def run_backtest(signals: DataFrame, config: BacktestConfig = BacktestConfig(), by: Sequence[str] = ("instrument",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, equity, metrics) of signal rows that carry open and close."""
    from tidemark.operators.metrics import compute_metrics

    trades = run_trades(signals, config, by)
    equity = equity_curve(signals, trades, config, by)
    return trades, equity, compute_metrics(trades, equity, config.initial_capital, by)
