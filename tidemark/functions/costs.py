"""Order costs and slippage as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.schemas import CostConfig, SlippageConfig


def order_cost(price: Column, quantity, side: Column, config: CostConfig = CostConfig()) -> Column:
    """Charges of one order leg; ``side`` is 'buy' or 'sell'."""
    turnover = price * quantity
    exchange = turnover * config.exchange_rate
    stt = F.when(side == "sell", turnover * config.stt_rate).otherwise(0.0)
    stamped = F.lit(True) if config.stamp_side == "both" else side == config.stamp_side
    stamp = F.when(stamped, turnover * config.stamp_rate).otherwise(0.0)
    return F.lit(config.brokerage_flat) + stt + exchange + turnover * config.sebi_rate + stamp + (F.lit(config.brokerage_flat) + exchange) * config.gst_rate


def round_trip_cost(entry: Column, exit_: Column, quantity, is_long: Column, config: CostConfig = CostConfig()) -> Column:
    opened = F.when(is_long, "buy").otherwise("sell")
    closed = F.when(is_long, "sell").otherwise("buy")
    return order_cost(entry, quantity, opened, config) + order_cost(exit_, quantity, closed, config)


def slippage_ticks(side: Column, config: SlippageConfig) -> Column:
    """Adverse ticks of an order; they go by its side, whether it opens or closes."""

    def of(base: int) -> int:
        if config.mode == "stress":
            return max(base, 3)
        return 1 if config.mode == "normal" and base == 0 else base

    return F.when(side == "buy", of(config.entry_ticks)).otherwise(of(config.exit_ticks))


def fill_price(price: Column, side: Column, config: SlippageConfig, tick_size: float | None = None) -> Column:
    """The price after slippage: buys fill higher, sells lower."""
    step = slippage_ticks(side, config) * F.lit(tick_size or config.tick_size)
    return price + F.when(side == "buy", step).otherwise(-step)
