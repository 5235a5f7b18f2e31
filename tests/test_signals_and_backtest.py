import datetime as dt
import math
import random

import pandas as pd
import pytest

from tests.frames import BASE, candles, closes, wave
from tidemark.functions import costs, indicators
from tidemark.functions.schemas import MODES, BacktestConfig, CostConfig, SlippageConfig, StrategyConfig
from tidemark.operators import backtest, metrics, signals

BY = ("instrument",)


def test_ema_by_hand(spark):
    out = indicators.with_emas(closes(spark, [1, 2, 3, 4, 5]), (3,), BY).orderBy("timestamp").collect()
    assert [r.ema_3 for r in out] == [None, None, 2.25, 3.125, 4.0625]


@pytest.mark.parametrize("period", [2, 9, 15, 25])
def test_ema_equals_recursion_on_long_series(spark, period):
    rng = random.Random(period)
    values = [100 + 50 * rng.random() for _ in range(900)]
    got = [r[0] for r in indicators.with_emas(closes(spark, values), (period,), BY).orderBy("timestamp").select(f"ema_{period}").collect()]
    want = pd.Series(values).ewm(alpha=2 / (period + 1), adjust=False, min_periods=period).mean()
    assert all((a is None and math.isnan(b)) or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_angle_by_hand_and_at_zero(spark):
    out = indicators.with_emas(closes(spark, [1, 2, 3, 4, 5]), (3,), BY)
    rows = out.withColumn("a", indicators.angle("ema_3", BY, 1, 1.0)).orderBy("timestamp").collect()
    assert rows[-1].a == pytest.approx(math.degrees(math.atan(0.3))) and rows[2].a is None
    flat = closes(spark, [0, 5]).withColumn("a", indicators.angle("close", BY, 1, 1.0)).orderBy("timestamp").collect()
    assert flat[1].a == 90.0


def events(spark, values, **kw):
    rows = signals.generate_signals(closes(spark, values), StrategyConfig(**kw)).orderBy("timestamp").collect()
    return [r.signal_type for r in rows], rows


def test_schema_and_warm_up(spark):
    kinds, rows = events(spark, [100 + i for i in range(120)])
    assert rows[0].__fields__ == ["instrument", "timestamp", "signal_type", "crossover", "ema_fast", "ema_slow", "angle", "candle_close"]
    assert set(kinds[:14]) == {"HOLD"} and rows[13].ema_slow is None and rows[14].ema_slow is not None and len(rows) == 120


def test_buy_on_a_step_and_none_on_a_ramp(spark):
    assert "BUY" in events(spark, [100] * 60 + [101, 103, 106, 110, 115, 121, 128] + [130] * 30)[0]
    assert set(events(spark, [100 + 0.5 * i for i in range(200)])[0]) == {"HOLD"}


def test_no_look_ahead(spark):
    values = [100] * 40 + [98, 97, 96, 95, 94] * 6 + [120] * 40
    whole = events(spark, values)[1]
    for t in (19, 40, 60, 100):
        assert events(spark, values[: t + 1])[1][-1] == whole[t]


@pytest.mark.parametrize("bad", [{"fast_ema": 0}, {"fast_ema": 15}, {"angle_threshold": -1.0}, {"angle_scale": -1.0}, {"angle_lookback": 0}, {"signal_mode": "other"}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        StrategyConfig(**bad)


def test_modes_nest_and_many_equals_one(spark):
    df = closes(spark, wave())
    configs = [(m, StrategyConfig(signal_mode=m, angle_threshold=40.0, angle_scale=50.0)) for m in MODES]
    many = {}
    for r in signals.signals_for_many(df, configs).collect():
        many.setdefault(r.config_id, {})[r.timestamp] = r.signal_type
    for name, config in configs:
        assert {r.timestamp: r.signal_type for r in signals.generate_signals(df, config).collect()} == many[name]
    found = [{t for t, s in many[m].items() if s != "HOLD"} for m in MODES]
    assert found[0] >= found[1] == found[2] and found[0]


def traded(spark, n, marks, config=BacktestConfig(), closes_of=None):
    rows = [("A", BASE + dt.timedelta(minutes=i), 100 + 0.5 * i, 0.0, 0.0, 100 + 0.5 * i + 0.25 if closes_of is None else closes_of[i], 1, 1) for i in range(n)]
    kinds = spark.createDataFrame([("A", BASE + dt.timedelta(minutes=i), marks.get(i, "HOLD")) for i in range(n)], "instrument string, timestamp timestamp_ntz, signal_type string")
    joined = backtest.join_signals(candles(spark, rows), kinds)
    trades = backtest.run_trades(joined, config)
    return trades.orderBy("trade_id").collect(), backtest.equity_curve(joined, trades, config).orderBy("timestamp").collect()


def at(i):
    return BASE + dt.timedelta(minutes=i)


def test_fills_at_the_next_open(spark):
    (t,), _ = traded(spark, 60, {10: "BUY", 50: "SELL"})
    assert (t.entry_time, t.exit_time, t.entry_price, t.exit_price, t.holding_periods) == (at(11), at(51), 105.5, 125.5, 40)


def test_an_exit_uses_up_its_signal(spark):
    trades, _ = traded(spark, 120, {10: "BUY", 40: "SELL", 41: "SELL", 90: "BUY"})
    assert [t.direction for t in trades] == ["LONG", "SHORT"] and trades[1].entry_time == at(42)


def test_repeated_signals_and_last_bar(spark):
    assert len(traded(spark, 60, {10: "BUY", 11: "BUY", 20: "SELL"})[0]) == 1
    assert traded(spark, 20, {19: "BUY"})[0] == []


def test_forced_close_is_not_in_the_curve(spark):
    (t,), curve = traded(spark, 60, {10: "BUY"})
    assert t.closed_at_end == 1 and t.exit_price == 100 + 0.5 * 59 + 0.25 and t.exit_time == at(59)
    assert curve[-1].realized == 0 and curve[-1].unrealized == (t.exit_price - t.entry_price) * 50


def test_curve_ends_at_capital_plus_net(spark):
    trades, curve = traded(spark, 50, {10: "BUY", 40: "SELL"})
    assert len(curve) == 50 and curve[-1].equity == pytest.approx(1e6 + trades[0].net_pnl) and curve[-1].unrealized == 0


def test_no_common_bars(spark):
    kinds = spark.createDataFrame([("A", dt.datetime(2030, 1, 1), "BUY")], "instrument string, timestamp timestamp_ntz, signal_type string")
    with pytest.raises(ValueError):
        backtest.join_signals(closes(spark, [1, 2]), kinds)


def loop(opens, last_close, kinds, step, quantity=50):
    """A bar loop over the same rules."""
    out, position, entry = [], 0, None
    for i in range(1, len(opens)):
        s = {"BUY": 1, "SELL": -1, "HOLD": 0}[kinds[i - 1]]
        if position and s == -position:
            out.append((entry[0], i, position, entry[1], opens[i] - position * step, 0))
            position = 0
        elif not position and s:
            position, entry = s, (i, opens[i] + s * step)
    if position:
        out.append((entry[0], len(opens) - 1, position, entry[1], last_close - position * step, 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_a_bar_loop(spark, seed):
    rng = random.Random(seed)
    n = 150
    kinds = {i: rng.choice(["BUY", "SELL", "HOLD"]) for i in range(n)}
    trades, curve = traded(spark, n, kinds, BacktestConfig(slippage=SlippageConfig("normal")))
    want = loop([100 + 0.5 * i for i in range(n)], 100 + 0.5 * (n - 1) + 0.25, kinds, 0.05)
    got = [((t.entry_time - BASE).seconds // 60, (t.exit_time - BASE).seconds // 60, 1 if t.direction == "LONG" else -1, t.entry_price, t.exit_price, t.closed_at_end) for t in trades]
    assert [(a, b, d, round(e, 9), round(x, 9), c) for a, b, d, e, x, c in got] == [(a, b, d, round(e, 9), round(x, 9), c) for a, b, d, e, x, c in want]
    realized = sum(t.net_pnl for t in trades if not t.closed_at_end)
    assert curve[-1].realized == pytest.approx(realized)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_costs_by_hand(spark):
    from pyspark.sql import functions as F

    buy, sell = 24_500 * 50, 24_600 * 50
    a = 20 + buy * 0.0000345 + buy * 0.000001 + buy * 0.00003 + (20 + buy * 0.0000345) * 0.18
    b = 20 + sell * 0.000125 + sell * 0.0000345 + sell * 0.000001 + (20 + sell * 0.0000345) * 0.18
    assert value(spark, costs.order_cost(F.lit(24_500.0), 50, F.lit("buy"))) == pytest.approx(a)
    assert value(spark, costs.round_trip_cost(F.lit(24_500.0), F.lit(24_600.0), 50, F.lit(True))) == pytest.approx(a + b)
    both = CostConfig(stamp_side="both")
    assert value(spark, costs.order_cost(F.lit(100.0), 1, F.lit("sell"), both)) > value(spark, costs.order_cost(F.lit(100.0), 1, F.lit("sell")))


@pytest.mark.parametrize(("config", "buy", "sell"), [(SlippageConfig(), 0, 0), (SlippageConfig("normal"), 1, 1), (SlippageConfig("stress"), 3, 3), (SlippageConfig("stress", 5, 0), 5, 3), (SlippageConfig("ticks", 2, 1), 2, 1), (SlippageConfig("ideal", 2, 0), 2, 0)])
def test_slippage_goes_by_side(spark, config, buy, sell):
    from pyspark.sql import functions as F

    assert (value(spark, costs.slippage_ticks(F.lit("buy"), config)), value(spark, costs.slippage_ticks(F.lit("sell"), config))) == (buy, sell)
    assert value(spark, costs.fill_price(F.lit(100.0), F.lit("buy"), config)) == pytest.approx(100 + buy * 0.05)
    assert value(spark, costs.fill_price(F.lit(100.0), F.lit("sell"), config, 0.1)) == pytest.approx(100 - sell * 0.1)


def test_metrics_by_hand(spark):
    trades = spark.createDataFrame([("A", 1, 100.0, 120.0, 3), ("A", 2, -50.0, -30.0, 2), ("A", 3, 80.0, 95.0, 4)], "instrument string, trade_id long, net_pnl double, gross_pnl double, holding_periods long")
    curve = [1_000_000.0, 1_000_100.0, 1_000_050.0, 1_000_130.0, 1_000_200.0]
    equity = spark.createDataFrame([(k, dt.datetime(2026, 7, d + 1), v) for k in "AB" for d, v in enumerate(curve if k == "A" else [1e6] * 5)], "instrument string, timestamp timestamp_ntz, equity double")
    a, b = metrics.compute_metrics(trades, equity).orderBy("instrument").collect()
    assert (a.total_trades, a.longest_win_streak, a.longest_loss_streak, a.trading_days, a.max_drawdown_duration_bars) == (3, 1, 1, 5, 1)
    assert a.win_rate == pytest.approx(2 / 3) and a.profit_factor == pytest.approx(215 / 30) and a.max_drawdown_pct == pytest.approx(50 / 1_000_100) and a.max_drawdown_value == 50
    r = [(y - x) / x for x, y in zip(curve, curve[1:], strict=False)]
    mean, sd = sum(r) / 4, pd.Series(r).std()
    assert a.sharpe == pytest.approx(mean / sd * math.sqrt(252)) and a.sortino == pytest.approx(mean / math.sqrt(min(r) ** 2) * math.sqrt(252))
    assert a.calmar == pytest.approx(200 / 1e6 * 252 / 5 / a.max_drawdown_pct) and a.expectancy == pytest.approx(130 / 3)
    assert (b.total_trades, b.net_pnl, b.sharpe, b.calmar, b.avg_winner) == (0, 0.0, 0.0, 0.0, None)
