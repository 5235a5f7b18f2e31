"""Daily risk limits over trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TRADES, MAX_LOSS, MAX_LOSSES_IN_A_ROW, MAX_LOTS = 20, 50_000.0, 5, 5


def daily_limits(trades: DataFrame, by: Sequence[str] = ("instrument",), max_trades: int = MAX_TRADES, max_loss: float = MAX_LOSS) -> DataFrame:
    """Trades and net of each entry day, and whether they break a limit."""
    out = trades.groupBy(*by, F.to_date("entry_time").alias("day_of")).agg(F.count("*").alias("trades"), F.sum("net_pnl").alias("net_pnl"))
    return out.withColumns({"too_many": F.col("trades") > max_trades, "loss_limit": F.col("net_pnl") < -max_loss})


def trade_limits(trades: DataFrame, by: Sequence[str] = ("instrument",), lots: int = 1, in_a_row: int = MAX_LOSSES_IN_A_ROW, max_lots: int = MAX_LOTS) -> DataFrame:
    """Each trade with the losing trades in a row just before it, and whether it should have been refused."""
    w = Window.partitionBy(*by).orderBy("trade_id")
    before = w.rowsBetween(-in_a_row, -1)
    lost = F.count_if(F.col("net_pnl") <= 0).over(before)
    return trades.withColumns({"losses_before": lost, "refused": (lost >= in_a_row) | F.lit(lots > max_lots)})
