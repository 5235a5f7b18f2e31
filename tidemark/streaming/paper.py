"""Paper trading in a stream: orders checked against limits, fills at the next bar's open, profit and loss bar by bar."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.schemas import BacktestConfig
from tidemark.operators.quality import SESSION
from tidemark.operators.risk import MAX_LOSS, MAX_LOSSES_IN_A_ROW, MAX_LOTS, MAX_TRADES

ROWS = "instrument string, timestamp timestamp, position long, equity double, realized double, fill_price double, net_pnl double, refused string"
STATE = "position long, entry double, entry_cost double, realized double, pending long, last timestamp, day date, trades long, day_net double, losses long"


@dataclass(frozen=True)
class Limits:
    """What an opening order must keep to; a closing order is never refused."""

    max_trades: int = MAX_TRADES
    max_loss: float = MAX_LOSS
    max_losses_in_a_row: int = MAX_LOSSES_IN_A_ROW
    max_lots: int = MAX_LOTS
    session: tuple[int, int] | None = SESSION


def stream_portfolio(signals: DataFrame, config: BacktestConfig = BacktestConfig(), limits: Limits = Limits()) -> DataFrame:
    """One row for each bar of ``signals`` (instrument, timestamp, open, close, signal_type): position, equity and what happened.

    A signal fills at the open of its instrument's next bar, with the backtest's
    slippage and costs. An opening order is refused (``refused`` says why) outside
    the session, beyond a day's trades or loss, after too many losing trades in
    a row, or for too many lots. A bar that comes twice or late is passed over.
    """
    # plain values: the workers need not have this package
    c, rule = config, asdict(limits)
    money, step_of = asdict(config.costs), {"buy": _ticks(config, "buy"), "sell": _ticks(config, "sell")}
    quantity, tick, capital, lots = c.quantity, c.slippage.tick_size, c.initial_capital, c.position_size

    def cost(price, side):
        turnover = price * quantity
        exchange = turnover * money["exchange_rate"]
        stamped = money["stamp_side"] in ("both", side)
        return money["brokerage_flat"] + (turnover * money["stt_rate"] if side == "sell" else 0.0) + exchange + turnover * money["sebi_rate"] + (turnover * money["stamp_rate"] if stamped else 0.0) + (money["brokerage_flat"] + exchange) * money["gst_rate"]

    def refusal(s, at):
        minute = at.hour * 60 + at.minute
        if rule["session"] and not rule["session"][0] <= minute < rule["session"][1]:
            return "session"
        if lots > rule["max_lots"]:
            return "lots"
        if s["trades"] >= rule["max_trades"]:
            return "trades"
        if s["day_net"] < -rule["max_loss"]:
            return "loss"
        return "losses" if s["losses"] >= rule["max_losses_in_a_row"] else None

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("position", "entry", "entry_cost", "realized", "pending", "last", "day", "trades", "day_net", "losses")
        s = dict(zip(names, state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, None, None, 0, 0.0, 0), strict=True))
        rows = []
        for bar in pd.concat(list(parts)).sort_values("timestamp").itertuples(index=False):
            if s["last"] is not None and bar.timestamp <= pd.Timestamp(s["last"]):
                continue
            if s["day"] != bar.timestamp.date():
                s |= {"day": bar.timestamp.date(), "trades": 0, "day_net": 0.0}
            fill = net = refused = None
            way = s["pending"]
            if way and way != s["position"]:
                side = "buy" if way > 0 else "sell"
                price = bar.open + way * step_of[side] * tick
                if s["position"]:
                    fill, gross = price, (price - s["entry"]) * quantity * s["position"]
                    net = gross - s["entry_cost"] - cost(price, side)
                    s |= {"position": 0, "realized": s["realized"] + net, "day_net": s["day_net"] + net, "losses": s["losses"] + 1 if net <= 0 else 0}
                elif (refused := refusal(s, bar.timestamp)) is None:
                    fill = price
                    s |= {"position": way, "entry": price, "entry_cost": cost(price, side), "trades": s["trades"] + 1}
            s |= {"pending": {"BUY": 1, "SELL": -1}.get(bar.signal_type, 0), "last": bar.timestamp}
            open_now = (bar.close - s["entry"]) * quantity * s["position"]
            rows.append((key[0], bar.timestamp, s["position"], capital + s["realized"] + open_now, s["realized"], fill, net, refused))
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame(rows, columns=["instrument", "timestamp", "position", "equity", "realized", "fill_price", "net_pnl", "refused"])

    bars = signals.select("instrument", "timestamp", "open", "close", "signal_type")
    return bars.groupBy("instrument").applyInPandasWithState(update, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def _ticks(config: BacktestConfig, side: str) -> int:
    """Adverse ticks of an order side, as ``costs.slippage_ticks`` has them."""
    slip = config.slippage
    base = slip.entry_ticks if side == "buy" else slip.exit_ticks
    return {"stress": max(base, 3), "normal": base or 1}.get(slip.mode, base)
