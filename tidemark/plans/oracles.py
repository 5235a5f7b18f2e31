"""DuckDB SQL of the engine's queries, built from shared CTEs.

The SQL takes other ways than the plans where there is one: averages are list
folds, positions a clamped fold over all earlier signals.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.functions.indicators import reach
from tidemark.functions.schemas import CostConfig, StrategyConfig

COSTS = CostConfig()


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def bars(minutes: int, name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS instrument, time_bucket(INTERVAL '{minutes} minutes', ts) AS timestamp, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


def rollup(source: str, minutes: int, name: str) -> str:
    return f"""{name} AS (SELECT instrument, time_bucket(INTERVAL '{minutes} minutes', timestamp) AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume)::BIGINT AS volume FROM {source} GROUP BY 1, 2)"""


def emas(source: str, keys: str, periods: Sequence[int], name: str = "ind") -> str:
    over = f"PARTITION BY {keys} ORDER BY timestamp"
    lists = ", ".join(f"list(close) OVER ({over} ROWS BETWEEN {reach(p)} PRECEDING AND CURRENT ROW) AS h{p}" for p in periods)
    folds = ", ".join(f"CASE WHEN rn >= {p} THEN list_reduce(h{p}, lambda a, x: a * {num(1 - 2 / (p + 1))} + x * {num(2 / (p + 1))}) END AS ema_{p}" for p in periods)
    drop = ", ".join(f"h{p}" for p in periods)
    return f"""{name}_h AS (SELECT *, row_number() OVER ({over}) AS rn, {lists} FROM {source}),
{name} AS (SELECT * EXCLUDE (rn, {drop}), {folds} FROM {name}_h)"""


def angle(column: str, keys: str, lookback: int, scale: float) -> str:
    before = f"lag({column}, {lookback}) OVER (PARTITION BY {keys} ORDER BY timestamp)"
    return f"CASE WHEN {before} = 0 THEN sign({column}) * 90.0 ELSE degrees(atan(({column} - {before}) / {before} * {num(scale)})) END"


def signals(source: str, keys: str, config: StrategyConfig, name: str = "sig") -> str:
    f, s = f"ema_{config.fast_ema}", f"ema_{config.slow_ema}"
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp)"
    buy, sell = ("TRUE", "TRUE") if config.signal_mode == "crossover" else (f"angle >= {num(config.angle_threshold)}", f"angle <= -({num(config.angle_threshold)})")
    if config.signal_mode == "crossover_angle_and_trend":
        buy, sell = f"{buy} AND close > {s}", f"{sell} AND NOT (close > {s})"
    return f"""{emas(source, keys, (config.fast_ema, config.slow_ema), name + "_i")},
{name}_x AS (SELECT *, lag({f}) {w} AS f0, lag({s}) {w} AS s0, {angle(f, keys, config.angle_lookback, config.angle_scale)} AS angle FROM {name}_i),
{name} AS (SELECT *, CASE WHEN {f} > {s} AND f0 <= s0 AND {buy} THEN 'BUY' WHEN {f} < {s} AND f0 >= s0 AND {sell} THEN 'SELL' ELSE 'HOLD' END AS signal_type,
  coalesce(({f} > {s} AND f0 <= s0) OR ({f} < {s} AND f0 >= s0), FALSE) AS crossover FROM {name}_x)"""


def grid_signals(source: str, keys: str, configs: Sequence[tuple[str, StrategyConfig]], id_name: str, name: str = "sig") -> str:
    periods = sorted({p for _, c in configs for p in (c.fast_ema, c.slow_ema)})
    slopes = sorted({(c.fast_ema, c.angle_lookback, c.angle_scale) for _, c in configs})
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp)"
    lags = ", ".join(f"lag(ema_{p}) {w} AS b{p}" for p in periods)
    angles = ", ".join(f"{angle(f'ema_{p}', keys, k, s)} AS a{i}" for i, (p, k, s) in enumerate(slopes))
    values = ", ".join(f"('{i}', {c.fast_ema}, {c.slow_ema}, {slopes.index((c.fast_ema, c.angle_lookback, c.angle_scale))}, {num(c.angle_threshold)}, '{c.signal_mode}')" for i, c in configs)
    pick = lambda on, stem: f"CASE {on} " + " ".join(f"WHEN {p} THEN {stem}{p}" for p in periods) + " END"
    chosen = "CASE pa " + " ".join(f"WHEN {i} THEN a{i}" for i in range(len(slopes))) + " END"
    return f"""{emas(source, keys, periods, name + "_i")},
{name}_x AS (SELECT *, {lags}, {angles} FROM {name}_i),
{name}_c({id_name}, pf, ps, pa, pt, pm) AS (VALUES {values}),
{name}_e AS (SELECT c.{id_name}, x.*, pt, pm, {pick("pf", "ema_")} AS f, {pick("ps", "ema_")} AS s, {pick("pf", "b")} AS f0, {pick("ps", "b")} AS s0, {chosen} AS angle FROM {name}_x x, {name}_c c),
{name} AS (SELECT *, CASE WHEN f > s AND f0 <= s0 AND (pm = 'crossover' OR angle >= pt) AND (pm <> 'crossover_angle_and_trend' OR close > s) THEN 'BUY'
  WHEN f < s AND f0 >= s0 AND (pm = 'crossover' OR angle <= -pt) AND (pm <> 'crossover_angle_and_trend' OR NOT (close > s)) THEN 'SELL' ELSE 'HOLD' END AS signal_type FROM {name}_e)"""


def order_cost(price: str, quantity: str, side: str) -> str:
    c, turnover = COSTS, f"({price} * {quantity})"
    exchange = f"({turnover} * {num(c.exchange_rate)})"
    return f"""({num(c.brokerage_flat)} + CASE WHEN {side} = 'sell' THEN {turnover} * {num(c.stt_rate)} ELSE 0 END + {exchange} + {turnover} * {num(c.sebi_rate)} + CASE WHEN {side} = '{c.stamp_side}' THEN {turnover} * {num(c.stamp_rate)} ELSE 0 END + ({num(c.brokerage_flat)} + {exchange}) * {num(c.gst_rate)})"""


def trades(source: str, keys: str, step: float = 0.05, quantity: int = 50, name: str = "tr") -> str:
    w = f"PARTITION BY {keys} ORDER BY timestamp"
    whole = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    entry_side, exit_side = "CASE WHEN pos = 1 THEN 'buy' ELSE 'sell' END", "CASE WHEN pos = 1 THEN 'sell' ELSE 'buy' END"
    return f"""{name}_r AS (SELECT {keys}, timestamp, close, signal_type, lead(open) OVER ({w}) AS fill, lead(timestamp) OVER ({w}) AS fill_time, row_number() OVER ({w}) + 1 AS fill_bar,
  last_value(close) OVER {whole} AS last_close, last_value(timestamp) OVER {whole} AS last_time, count(*) OVER {whole} AS last_bar FROM {source}),
{name}_e AS (SELECT *, CASE signal_type WHEN 'BUY' THEN 1 ELSE -1 END AS s FROM {name}_r WHERE signal_type <> 'HOLD' AND fill_time IS NOT NULL),
{name}_l AS (SELECT *, list(s) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ss FROM {name}_e),
{name}_p AS (SELECT * EXCLUDE (ss), list_reduce(list_prepend(0, ss), lambda a, x: greatest(-1, least(1, a + x))) AS pos FROM {name}_l),
{name}_q AS (SELECT *, lag(pos, 1, 0) OVER ({w}) AS pos_before FROM {name}_p),
{name}_m AS (SELECT *, lead(fill) OVER ({w}) AS exit_fill, lead(fill_time) OVER ({w}) AS exit_at, lead(fill_bar) OVER ({w}) AS exit_bar FROM {name}_q WHERE pos <> pos_before),
{name}_t AS (SELECT {keys}, fill_time AS entry_time, coalesce(exit_at, last_time) AS exit_time, CASE WHEN pos = 1 THEN 'LONG' ELSE 'SHORT' END AS direction,
  CASE WHEN pos = 1 THEN fill + {num(step)} ELSE fill - {num(step)} END AS entry_price, CASE WHEN pos = 1 THEN coalesce(exit_fill, last_close) - {num(step)} ELSE coalesce(exit_fill, last_close) + {num(step)} END AS exit_price,
  {quantity}::BIGINT AS quantity, (coalesce(exit_bar, last_bar) - fill_bar)::BIGINT AS holding_periods, (exit_bar IS NULL)::BIGINT AS closed_at_end, pos FROM {name}_m WHERE pos <> 0),
{name}_g AS (SELECT *, (exit_price - entry_price) * quantity * pos AS gross_pnl, {order_cost("entry_price", "quantity", entry_side)} + {order_cost("exit_price", "quantity", exit_side)} AS costs FROM {name}_t),
{name} AS (SELECT *, gross_pnl - costs AS net_pnl, row_number() OVER (PARTITION BY {keys} ORDER BY entry_time)::BIGINT AS trade_id FROM {name}_g)"""


def equity(source: str, trade: str, keys: str, capital: float = 1_000_000.0, name: str = "eq") -> str:
    cols = keys.split(", ")
    on = " AND ".join(f"b.{k} = t.{k}" for k in cols)
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    each = ", ".join(f"b.{k}" for k in cols)
    return f"""{name}_m AS (SELECT {keys}, entry_time AS timestamp, pos AS way, entry_price AS price, quantity AS q, NULL::DOUBLE AS net FROM {trade} UNION ALL SELECT {keys}, exit_time, 0, 0.0, 0, net_pnl FROM {trade} WHERE closed_at_end = 0),
{name}_j AS (SELECT {each}, b.timestamp, b.close, way, price, q, net FROM {source} b LEFT JOIN {name}_m t ON {on} AND b.timestamp = t.timestamp),
{name}_w AS (SELECT *, last_value(way IGNORE NULLS) {w} AS hw, last_value(price IGNORE NULLS) {w} AS hp, last_value(q IGNORE NULLS) {w} AS hq, sum(coalesce(net, 0)) {w} AS realized FROM {name}_j),
{name} AS (SELECT {keys}, timestamp, coalesce((close - hp) * hq * hw, 0) AS unrealized, realized, {num(capital)} + realized + coalesce((close - hp) * hq * hw, 0) AS equity FROM {name}_w)"""


def drawdown(eq: str, keys: str, name: str = "dd") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_p AS (SELECT *, max(equity) {w} AS peak, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp) AS n FROM {eq}),
{name}_k AS (SELECT *, max(CASE WHEN equity >= peak THEN n END) {w} AS top FROM {name}_p),
{name} AS (SELECT *, peak - equity AS dd_value, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS dd_pct, CASE WHEN equity < peak THEN n - top ELSE 0 END AS dd_bars FROM {name}_k)"""


def daily(eq: str, keys: str, name: str = "dr") -> str:
    return f"""{name}_d AS (SELECT {keys}, timestamp::DATE AS day_of, arg_max(equity, timestamp) AS equity FROM {eq} GROUP BY ALL),
{name}_b AS (SELECT *, lag(equity) OVER (PARTITION BY {keys} ORDER BY day_of) AS before FROM {name}_d),
{name} AS (SELECT {keys}, day_of, equity, CASE WHEN before > 0 THEN (equity - before) / before WHEN before IS NOT NULL THEN 0.0 END AS daily_return FROM {name}_b)"""


def trade_metrics(trade: str, keys: str, name: str = "tm") -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS total_trades, count(*) FILTER (WHERE net_pnl > 0) AS winning_trades, count(*) FILTER (WHERE net_pnl <= 0) AS losing_trades, avg((net_pnl > 0)::INT) AS win_rate,
  sum(gross_pnl) AS gross_pnl, sum(net_pnl) AS net_pnl, avg(net_pnl) AS avg_trade_pnl, coalesce(avg(net_pnl) FILTER (WHERE net_pnl > 0), 0) AS avg_winner, coalesce(avg(net_pnl) FILTER (WHERE net_pnl <= 0), 0) AS avg_loser,
  coalesce(coalesce(sum(gross_pnl) FILTER (WHERE net_pnl > 0), 0) / nullif(abs(sum(gross_pnl) FILTER (WHERE net_pnl <= 0)), 0), 0) AS profit_factor, avg(holding_periods) AS avg_holding_periods FROM {trade} GROUP BY ALL)"""


def streaks(trade: str, keys: str, name: str = "sk") -> str:
    return f"""{name}_r AS (SELECT {keys}, net_pnl > 0 AS win, row_number() OVER (PARTITION BY {keys} ORDER BY trade_id) - row_number() OVER (PARTITION BY {keys}, net_pnl > 0 ORDER BY trade_id) AS run FROM {trade}),
{name}_n AS (SELECT {keys}, win, run, count(*) AS n FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {keys}, coalesce(max(n) FILTER (WHERE win), 0) AS longest_win_streak, coalesce(max(n) FILTER (WHERE NOT win), 0) AS longest_loss_streak FROM {name}_n GROUP BY ALL)"""


def curve_metrics(eq: str, keys: str, capital: float = 1_000_000.0, name: str = "cm") -> str:
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    first = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{drawdown(eq, keys, name + "_dd")},
{daily(eq, keys, name + "_dr")},
{name}_a AS (SELECT {keys}, max(dd_pct) AS max_drawdown_pct, arg_max(dd_value, (dd_pct, -n)) AS max_drawdown_value, max(dd_bars) AS max_drawdown_duration_bars FROM {name}_dd GROUP BY ALL),
{name}_b AS (SELECT {keys}, count(*) AS trading_days, (arg_max(equity, day_of) - {num(capital)}) / {num(capital)} AS total_return_pct, avg(daily_return) AS m, coalesce(stddev_samp(daily_return), 0) AS sd,
  sqrt(sum(daily_return * daily_return) FILTER (WHERE daily_return < 0) / greatest(count(*) FILTER (WHERE daily_return < 0) - 1, 1)) AS down FROM {name}_dr GROUP BY ALL),
{name} AS (SELECT {first}, max_drawdown_pct, max_drawdown_value, max_drawdown_duration_bars, trading_days, total_return_pct, CASE WHEN sd > 0 THEN coalesce(m / sd, 0) * sqrt(252.0) ELSE 0 END AS sharpe, CASE WHEN down > 0 THEN coalesce(m / down, 0) * sqrt(252.0) ELSE 0 END AS sortino,
  CASE WHEN max_drawdown_pct > 0 THEN total_return_pct * 252 / greatest(trading_days, 1) / max_drawdown_pct ELSE 0 END AS calmar FROM {name}_a a JOIN {name}_b b ON {join})"""


def regimes(source: str, high: float, low: float, name: str = "rg") -> str:
    return f"""{name}_d AS (SELECT instrument, timestamp::DATE AS day_of, max(high) AS day_high, min(low) AS day_low, arg_max(close, timestamp) AS day_close FROM {source} GROUP BY ALL),
{name}_p AS (SELECT *, (day_high - day_low) / nullif(day_close, 0) AS range_pct FROM {name}_d),
{name} AS (SELECT *, CASE WHEN range_pct > {num(high)} THEN 'high' WHEN range_pct < {num(low)} THEN 'low' ELSE 'mid' END AS regime FROM {name}_p)"""


def rounded(columns: Sequence[str], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
