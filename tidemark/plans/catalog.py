"""Named queries over the driver's tables and their DuckDB counterparts.

Instruments are event types, prices event values; order rows serve as dated
contracts and line items as order legs. Thresholds suit those values: the angle
scale is 2, regimes are cut at ranges of 20 and 6.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import calendar, costs, indicators
from tidemark.functions.schemas import MODES, NORMAL_SLIPPAGE, BacktestConfig, SlippageConfig, StrategyConfig
from tidemark.operators import backtest, bars, contracts, metrics, quality, regime, research, signals
from tidemark.plans import oracles as o

KEY = "instrument"
CONFIG = StrategyConfig(angle_scale=2.0)
IDEAL, NORMAL = BacktestConfig(), BacktestConfig(slippage=NORMAL_SLIPPAGE)
GRID = {"fast_ema": (5, 9), "slow_ema": (15, 21), "angle_threshold": (20.0, 30.0), "angle_lookback": (1, 2)}
HIGH, LOW = 20.0, 6.0
TIMEFRAMES = (60, 120, 240)
AS_OF = dt.date(1996, 1, 1)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    """Registers a function of (spark, sf_dir) and its SQL."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark, sf_dir, minutes=60):
    return bars.bars_from_events(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), minutes)


def dated(df, *columns):
    """Dates as ISO text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("day_of",)})


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- bars ----

for _minutes, _name in ((15, "ohlcv_15m"), (60, "ohlcv_1h"), (1440, "ohlcv_1d")):
    query(_name, o.with_(o.bars(_minutes)) + " SELECT * FROM bars")(lambda spark, sf_dir, m=_minutes: event_bars(spark, sf_dir, m))


@query("ohlcv_4h_from_1h", o.with_(o.bars(60), o.rollup("bars", 240, "up")) + " SELECT * FROM up")
def ohlcv_4h_from_1h(spark, sf_dir):
    return bars.aggregate_bars(event_bars(spark, sf_dir), 240)


@query("verify_rollup", o.with_(o.bars(60), o.rollup("bars", 240, "up"), """sizes AS (SELECT instrument, epoch(timestamp)::BIGINT // 14400 AS b, count(*) AS n, sum(volume) AS v, min(timestamp) AS t0, max(timestamp) AS t1 FROM bars GROUP BY 1, 2),
l AS (SELECT instrument, count(*) FILTER (WHERE n <> 240) AS off_sized, sum(v) AS v, min(t0) AS t0, max(t1) AS t1 FROM sizes GROUP BY 1),
d AS (SELECT instrument, sum(volume) AS v, count(*) FILTER (WHERE high < low OR high < open OR high < close OR low > open OR low > close) AS bad, count(*) FILTER (WHERE (hour(timestamp) * 60 + minute(timestamp)) % 240 <> 0) AS off_grid, min(timestamp) AS t0, max(timestamp) AS t1 FROM up GROUP BY 1),
c AS (SELECT instrument, 'bucket_size' AS name, 'warn' AS s, off_sized AS f, off_sized || ' bucket(s) not containing exactly 240 bars' AS details FROM l UNION ALL SELECT instrument, 'volume_sum', 'fail', abs(l.v - d.v), '1m=' || l.v || ' vs 240m=' || d.v FROM l JOIN d USING (instrument) UNION ALL SELECT instrument, 'ohlc_integrity', 'fail', bad, bad || ' violations' FROM d UNION ALL SELECT instrument, 'boundary_alignment', 'fail', off_grid, off_grid || ' timestamp(s) off a 240-minute wall-clock grid' FROM d
  UNION ALL SELECT instrument, 'edge_alignment', 'fail', (NOT (l.t0 = d.t0 AND epoch(l.t1) - epoch(d.t1) < 14400))::INT, 'first=' || CASE WHEN l.t0 = d.t0 THEN 'True' ELSE 'False' END || ', last_within=' || CASE WHEN epoch(l.t1) - epoch(d.t1) < 14400 THEN 'True' ELSE 'False' END FROM l JOIN d USING (instrument))""") + " SELECT instrument, name, CASE WHEN f = 0 THEN 'pass' ELSE s END AS status, f::BIGINT AS failures, details FROM c")  # fmt: skip
def verify_rollup(spark, sf_dir):
    hourly = event_bars(spark, sf_dir)
    return bars.verify_rollup(hourly, bars.aggregate_bars(hourly, 240), 240, (KEY,))


# ---- indicators and signals ----


@query("ema_9_15", o.with_(o.bars(60), o.emas("bars", KEY, (9, 15))) + " SELECT instrument, timestamp, close, round(ema_9, 8) AS ema_9, round(ema_15, 8) AS ema_15 FROM ind")
def ema_9_15(spark, sf_dir):
    rows = indicators.with_emas(event_bars(spark, sf_dir).select(KEY, "timestamp", "close"), (9, 15), (KEY,))
    return rows.withColumns({c: F.round(c, 8) for c in ("ema_9", "ema_15")})


@query("ema_angle", o.with_(o.bars(60), o.emas("bars", KEY, (9,))) + f" SELECT instrument, timestamp, round(ema_9, 8) AS ema_9, round({o.angle('ema_9', KEY, 1, 2.0)}, 6) AS angle_1, round({o.angle('ema_9', KEY, 3, 2.0)}, 6) AS angle_3 FROM ind")
def ema_angle(spark, sf_dir):
    rows = indicators.with_emas(event_bars(spark, sf_dir).select(KEY, "timestamp", "close"), (9,), (KEY,))
    return rows.select(KEY, "timestamp", F.round("ema_9", 8).alias("ema_9"), F.round(indicators.angle("ema_9", (KEY,), 1, 2.0), 6).alias("angle_1"), F.round(indicators.angle("ema_9", (KEY,), 3, 2.0), 6).alias("angle_3"))


def _signals(mode):
    config = StrategyConfig(angle_scale=2.0, signal_mode=mode)
    sql = o.with_(o.bars(60), o.signals("bars", KEY, config)) + " SELECT instrument, timestamp, signal_type, crossover, round(ema_9, 8) AS ema_fast, round(ema_15, 8) AS ema_slow, round(angle, 6) AS angle, close AS candle_close FROM sig"
    return (lambda spark, sf_dir: r6(signals.generate_signals(event_bars(spark, sf_dir), config), "angle").withColumns({c: F.round(c, 8) for c in ("ema_fast", "ema_slow")})), sql


for _name, _mode in zip(("crossover_signals", "signals_angle", "signals_trend"), MODES, strict=True):
    _function, _sql = _signals(_mode)
    query(_name, _sql)(_function)


@query("signal_counts", o.with_(o.bars(60), o.signals("bars", KEY, CONFIG)) + " SELECT instrument, count(*) FILTER (WHERE signal_type = 'BUY') AS buys, count(*) FILTER (WHERE signal_type = 'SELL') AS sells, count(*) FILTER (WHERE crossover) AS crossovers, count(*) AS bars FROM sig GROUP BY 1")
def signal_counts(spark, sf_dir):
    return signals.signal_counts(signals.generate_signals(event_bars(spark, sf_dir), CONFIG))


@query("signal_events_latest", o.with_(o.bars(60), o.signals("bars", KEY, CONFIG), "n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY timestamp DESC) AS back FROM sig WHERE signal_type <> 'HOLD')") + " SELECT instrument, timestamp, signal_type, close AS candle_close FROM n WHERE back <= 10")
def signal_events_latest(spark, sf_dir):
    """The ten latest events of each instrument (the limit is the feature)."""
    events = signals.signal_events(signals.generate_signals(event_bars(spark, sf_dir), CONFIG))
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("timestamp")))
    return events.withColumn("back", back).where("back <= 10").select(KEY, "timestamp", "signal_type", "candle_close")


def crossover_rows(spark, sf_dir, mode=MODES[0], minutes=60):
    return signals.generate_signals(event_bars(spark, sf_dir, minutes), StrategyConfig(angle_scale=2.0, signal_mode=mode), keep=("open", "close"))


# ---- backtest ----

CROSS = StrategyConfig(angle_scale=2.0, signal_mode=MODES[0])
TRADED = (o.bars(60), o.signals("bars", KEY, CROSS), o.trades("sig", KEY))
CURVE = (*TRADED, o.equity("bars", "tr", KEY))


@query("positions", o.with_(*TRADED) + " SELECT instrument, timestamp, fill_time, fill, fill_bar::BIGINT AS fill_bar, s AS sig, pos AS position, pos_before AS position_before FROM tr_q")
def positions(spark, sf_dir):
    rows = backtest.positions(crossover_rows(spark, sf_dir))
    return rows.select(KEY, "timestamp", "fill_time", "fill", F.col("fill_bar").cast("long").alias("fill_bar"), "sig", "position", "position_before")


MONEY = ("entry_price", "exit_price", "gross_pnl", "costs", "net_pnl")
TRADE_COLUMNS = f"trade_id, entry_time, exit_time, direction, {', '.join(MONEY)}, quantity, holding_periods, closed_at_end"


@query("trades_ideal", o.with_(o.bars(60), o.signals("bars", KEY, CROSS), o.trades("sig", KEY, 0.0)) + f" SELECT instrument, {TRADE_COLUMNS} FROM tr")
def trades_ideal(spark, sf_dir):
    return backtest.run_trades(crossover_rows(spark, sf_dir), IDEAL)


@query("trades_costed", o.with_(*TRADED) + f" SELECT instrument, {TRADE_COLUMNS} FROM tr")
def trades_costed(spark, sf_dir):
    return backtest.run_trades(crossover_rows(spark, sf_dir), NORMAL)


def curve(spark, sf_dir):
    rows = crossover_rows(spark, sf_dir)
    trades = backtest.run_trades(rows, NORMAL)
    return trades, backtest.equity_curve(rows, trades, NORMAL)


@query("equity_curve", o.with_(*CURVE) + f" SELECT instrument, timestamp, {o.rounded(('equity', 'unrealized', 'realized'), 4)} FROM eq")
def equity_curve(spark, sf_dir):
    return curve(spark, sf_dir)[1].withColumns({c: F.round(c, 4) for c in ("equity", "unrealized", "realized")})


@query("drawdown", o.with_(*CURVE, o.drawdown("eq", KEY)) + f" SELECT instrument, timestamp, {o.rounded(('peak', 'dd_value'), 4)}, round(dd_pct, 6) AS dd_pct, dd_bars::BIGINT AS dd_bars FROM dd")
def drawdown(spark, sf_dir):
    rows = metrics.drawdowns(curve(spark, sf_dir)[1])
    return rows.select(KEY, "timestamp", F.round("peak", 4).alias("peak"), F.round("dd_value", 4).alias("dd_value"), F.round("dd_pct", 6).alias("dd_pct"), "dd_bars")


@query("daily_returns", o.with_(*CURVE, o.daily("eq", KEY)) + " SELECT instrument, day_of::VARCHAR AS day_of, round(equity, 4) AS equity, round(daily_return, 8) AS daily_return FROM dr")
def daily_returns(spark, sf_dir):
    return dated(metrics.daily_returns(curve(spark, sf_dir)[1])).withColumns({"equity": F.round("equity", 4), "daily_return": F.round("daily_return", 8)})


SUMS = ("win_rate", "gross_pnl", "net_pnl", "avg_trade_pnl", "avg_winner", "avg_loser", "profit_factor", "avg_holding_periods", "max_drawdown_pct", "max_drawdown_value", "total_return_pct", "sharpe", "sortino", "calmar")
COUNTS = ("total_trades", "winning_trades", "losing_trades", "longest_win_streak", "longest_loss_streak", "max_drawdown_duration_bars", "trading_days")


@query("metrics_summary", o.with_(*CURVE, o.trade_metrics("tr", KEY), o.streaks("tr", KEY), o.curve_metrics("eq", KEY)) + f" SELECT instrument, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in COUNTS)}, {o.rounded(SUMS, 5)} FROM cm LEFT JOIN tm USING (instrument) LEFT JOIN sk USING (instrument)")
def metrics_summary(spark, sf_dir):
    found = metrics.compute_metrics(*curve(spark, sf_dir))
    return found.select(KEY, *[F.col(c).cast("long").alias(c) for c in COUNTS], *[F.round(c, 5).alias(c) for c in SUMS])


@query("streaks", o.with_(*TRADED, o.streaks("tr", KEY)) + " SELECT * FROM sk")
def streaks(spark, sf_dir):
    return metrics.streaks(backtest.run_trades(crossover_rows(spark, sf_dir), NORMAL))


LEG_SIDE = "CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END"


def legs(spark, sf_dir):
    side = F.when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), side.alias("side"))


@query("order_costs", f"WITH legs AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity AS quantity, {LEG_SIDE} AS side FROM lineitem) SELECT l_orderkey, l_linenumber, side, round({o.order_cost('price', 'quantity', 'side')}, 4) AS cost FROM legs")
def order_costs(spark, sf_dir):
    return legs(spark, sf_dir).select("l_orderkey", "l_linenumber", "side", F.round(costs.order_cost(F.col("price"), F.col("quantity"), F.col("side")), 4).alias("cost"))


SLIPPAGES = {"ideal": SlippageConfig(), "normal": NORMAL_SLIPPAGE, "stress": SlippageConfig(mode="stress", exit_ticks=5), "ticks": SlippageConfig(mode="ticks", entry_ticks=2, exit_ticks=1)}


@query("slippage_fills", f"WITH legs AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, {LEG_SIDE} AS side FROM lineitem) SELECT l_orderkey, l_linenumber, side, round(price, 4) AS fill_ideal, round(CASE side WHEN 'buy' THEN price + 0.05 ELSE price - 0.05 END, 4) AS fill_normal, round(CASE side WHEN 'buy' THEN price + 0.15 ELSE price - 0.25 END, 4) AS fill_stress, round(CASE side WHEN 'buy' THEN price + 0.1 ELSE price - 0.05 END, 4) AS fill_ticks FROM legs")
def slippage_fills(spark, sf_dir):
    rows = legs(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "side", *[F.round(costs.fill_price(F.col("price"), F.col("side"), c), 4).alias(f"fill_{n}") for n, c in SLIPPAGES.items()])


# ---- quality ----


def minute_bars(spark, sf_dir):
    """Events as one-minute bars of each type, with volume and a running count as open interest."""
    rows = event_bars(spark, sf_dir, 1)
    return rows.withColumn("open_interest", F.round(F.col("close") * 10).cast("long"))


MINUTES = (o.bars(1), "m AS (SELECT *, round(close * 10)::BIGINT AS open_interest, lag(timestamp) OVER (PARTITION BY instrument, timestamp::DATE ORDER BY timestamp) AS t0, lag(round(close * 10)::BIGINT) OVER (PARTITION BY instrument, timestamp::DATE ORDER BY timestamp) AS oi0 FROM bars)")
OFF = "hour(timestamp) * 60 + minute(timestamp) < 555 OR hour(timestamp) * 60 + minute(timestamp) >= 930"


def planted(spark, sf_dir):
    """The minute bars with some twice and some stored too late: ``stored`` is a row's number in its file, ``half`` the file."""
    rows = minute_bars(spark, sf_dir)
    minute = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60)
    rows = rows.withColumn("copy", F.explode(F.when(F.minute("timestamp") == 17, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    stored = (minute + F.when(F.minute("timestamp") == 41, 1000).otherwise(0)) * 2 + F.col("copy")
    return rows.withColumns({"stored": stored, "half": F.when(F.dayofmonth("timestamp") < 15, "part-0").otherwise("part-1")}).drop("copy")


PLANTED = """m AS (SELECT b.*, round(close * 10)::BIGINT AS open_interest, CASE WHEN day(timestamp) < 15 THEN 'part-0' ELSE 'part-1' END AS half, ((epoch(timestamp) // 60)::BIGINT + CASE WHEN minute(timestamp) = 41 THEN 1000 ELSE 0 END) * 2 + copy AS stored FROM bars b, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR minute(timestamp) = 17),
w AS (SELECT *, lag(timestamp) OVER (PARTITION BY instrument, timestamp::DATE ORDER BY timestamp, stored) AS t0, lag(open_interest) OVER (PARTITION BY instrument, timestamp::DATE ORDER BY timestamp, stored) AS oi0, lag(timestamp) OVER (PARTITION BY instrument ORDER BY half, stored) AS before FROM m)"""


@query("validation_checks", o.with_(o.bars(1), PLANTED, f"""s AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE before > timestamp) AS back, count(*) FILTER (WHERE {OFF}) AS off, count(*) FILTER (WHERE high < low OR high < open OR high < close OR low > open OR low > close OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS bad,
  count(*) FILTER (WHERE volume < 0) AS negv, count(*) FILTER (WHERE volume = 0) AS zerov, count(*) FILTER (WHERE open_interest < 0) AS nego, count(*) FILTER (WHERE abs(open_interest - oi0) / greatest(oi0, 1.0) > 0.25) AS jumps, count(*) FILTER (WHERE epoch(timestamp) - epoch(t0) <> 60) AS gaps FROM w GROUP BY 1),
u AS (SELECT instrument, count(*) AS dups FROM (SELECT instrument, timestamp FROM m GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
d AS (SELECT instrument, count(*) AS days, count(*) FILTER (WHERE n <> 375) AS off_days FROM (SELECT instrument, timestamp::DATE AS d, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT instrument, 'timestamp_monotonic' AS name, 'fail' AS s, back AS f, '' AS details FROM s UNION ALL SELECT instrument, 'no_duplicates', 'fail', coalesce(dups, 0), '' FROM s LEFT JOIN u USING (instrument) UNION ALL SELECT instrument, 'market_hours', 'fail', off, '' FROM s UNION ALL SELECT instrument, 'daily_bar_counts', 'warn', off_days, off_days || ' day(s) with != 375 bars' FROM d UNION ALL SELECT instrument, 'ohlc_integrity', 'fail', bad, '' FROM s
  UNION ALL SELECT instrument, 'volume_sanity', CASE WHEN negv > 0 THEN 'fail' ELSE 'warn' END, negv + zerov, negv || ' negative, ' || zerov || ' zero-volume bars' FROM s UNION ALL SELECT instrument, 'open_interest_sanity', CASE WHEN nego > 0 THEN 'fail' ELSE 'warn' END, nego + jumps, nego || ' negative, ' || jumps || ' jumps > 25%' FROM s UNION ALL SELECT instrument, 'continuity', 'warn', gaps + greatest(0, days * 375 - n), gaps || ' intraday gaps, ~' || greatest(0, days * 375 - n) || ' missing bars' FROM s JOIN d USING (instrument)),
t AS (SELECT instrument, name, CASE WHEN f = 0 THEN 'pass' ELSE s END AS status, f::BIGINT AS failures, details FROM c)""") + " SELECT t.*, CASE WHEN bool_or(status = 'fail') OVER (PARTITION BY instrument) THEN 'fail' WHEN bool_or(status = 'warn') OVER (PARTITION BY instrument) THEN 'pass_with_warnings' ELSE 'pass' END AS overall FROM t")  # fmt: skip
def validation_checks(spark, sf_dir):
    return quality.validate_bars(planted(spark, sf_dir), 1, (KEY,), ("half", "stored"))


@query("stored_order", o.with_(o.bars(1), PLANTED) + " SELECT instrument, count(*) FILTER (WHERE before > timestamp) AS back FROM w GROUP BY 1")
def stored_order(spark, sf_dir):
    return quality.stored_order(planted(spark, sf_dir), ("half", "stored"), (KEY,))


@query("duplicates", "SELECT user_id, time_bucket(INTERVAL '60 minutes', ts) AS timestamp, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", bars.bucket(F.col("ts"), 60).alias("timestamp"))
    return quality.duplicates(rows, ("user_id",))


@query("session_hours", f"SELECT event_type, count(*) FILTER (WHERE {OFF}) AS outside, count(*) FILTER (WHERE NOT ({OFF})) AS inside FROM (SELECT event_type, ts AS timestamp FROM events) GROUP BY 1")
def session_hours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("timestamp"))
    return rows.groupBy("event_type").agg(F.count_if(quality.off_session()).alias("outside"), F.count_if(~quality.off_session()).alias("inside"))


STEPS = o.with_(*MINUTES)


@query("gap_check", STEPS + " SELECT instrument, timestamp::DATE::VARCHAR AS day_of, count(*) FILTER (WHERE epoch(timestamp) - epoch(t0) <> 60) AS gaps, max(epoch(timestamp) - epoch(t0))::BIGINT AS longest FROM m GROUP BY 1, 2")
def gap_check(spark, sf_dir):
    rows = quality.steps(minute_bars(spark, sf_dir), (KEY,))
    return rows.groupBy(KEY, F.to_date("timestamp").cast("string").alias("day_of")).agg(F.count_if(F.coalesce(F.col("step_seconds") != 60, F.lit(False))).alias("gaps"), F.max("step_seconds").alias("longest"))


@query("jump_check", STEPS + " SELECT instrument, timestamp, open_interest, round(abs(open_interest - oi0) / greatest(oi0, 1.0), 6) AS oi_change FROM m WHERE abs(open_interest - oi0) / greatest(oi0, 1.0) > 0.25")
def jump_check(spark, sf_dir):
    rows = quality.steps(minute_bars(spark, sf_dir), (KEY,)).where(F.col("oi_change") > quality.JUMP)
    return rows.select(KEY, "timestamp", "open_interest", F.round("oi_change", 6).alias("oi_change"))


@query("daily_bar_counts", o.with_(o.bars(1)) + " SELECT instrument, timestamp::DATE::VARCHAR AS day_of, count(*) AS bars FROM bars GROUP BY 1, 2")
def daily_bar_counts(spark, sf_dir):
    return dated(quality.daily_counts(event_bars(spark, sf_dir, 1)))


# ---- regimes and research ----

REGIMES = (*TRADED, o.regimes("bars", HIGH, LOW))


@query("regime_labels", o.with_(o.bars(60), o.regimes("bars", HIGH, LOW)) + " SELECT instrument, day_of::VARCHAR AS day_of, day_high, day_low, day_close, round(range_pct, 6) AS range_pct, regime FROM rg")
def regime_labels(spark, sf_dir):
    return dated(r6(regime.day_regimes(event_bars(spark, sf_dir), high=HIGH, low=LOW), "range_pct"))


@query("regime_summary", o.with_(*REGIMES, """w AS (SELECT t.instrument, regime, net_pnl, gross_pnl FROM tr t JOIN rg ON t.instrument = rg.instrument AND t.entry_time::DATE = rg.day_of),
f AS (SELECT instrument, regime, position FROM (SELECT DISTINCT instrument FROM rg), (VALUES ('high', 0), ('mid', 1), ('low', 2)) v(regime, position)),
d AS (SELECT instrument, regime, count(*) AS days FROM rg GROUP BY 1, 2), a AS (SELECT instrument, regime, count(*) AS trades, sum(net_pnl) AS net, coalesce(sum(gross_pnl) FILTER (WHERE net_pnl > 0), 0) AS gw, coalesce(sum(gross_pnl) FILTER (WHERE net_pnl <= 0), 0) AS gl, avg((net_pnl > 0)::INT) AS win_rate FROM w GROUP BY 1, 2)""") + " SELECT f.instrument, f.position, f.regime, coalesce(days, 0)::BIGINT AS days, coalesce(trades, 0)::BIGINT AS trades, round(coalesce(net, 0), 5) AS net_pnl, round(coalesce(gw / nullif(abs(gl), 0), 0), 6) AS profit_factor, round(coalesce(win_rate, 0), 6) AS win_rate FROM f LEFT JOIN d USING (instrument, regime) LEFT JOIN a USING (instrument, regime)")  # fmt: skip
def regime_summary(spark, sf_dir):
    rows = crossover_rows(spark, sf_dir)
    found = regime.regime_summary(event_bars(spark, sf_dir), backtest.run_trades(rows, NORMAL), high=HIGH, low=LOW)
    return r6(found, "profit_factor", "win_rate").withColumn("net_pnl", F.round("net_pnl", 5))


def timeframe_bars(spark, sf_dir):
    """Bars of three timeframes in one table; the larger ones come from the hourly ones."""
    hourly = event_bars(spark, sf_dir)
    parts = [bars.aggregate_bars(hourly, m).withColumn("timeframe", F.lit(f"{m}m")) for m in TIMEFRAMES[1:]]
    out = hourly.withColumn("timeframe", F.lit(f"{TIMEFRAMES[0]}m"))
    for part in parts:
        out = out.unionByName(part)
    return out


TF_KEYS = "variant, instrument, timeframe"
VARIANTS = research.baseline_variants(30.0, angle_scale=2.0)
TF_BARS = (o.bars(60), *[o.rollup("bars", m, f"b{m}") for m in TIMEFRAMES[1:]], "tfb AS (SELECT *, '60m' AS timeframe FROM bars" + "".join(f" UNION ALL SELECT *, '{m}m' FROM b{m}" for m in TIMEFRAMES[1:]) + ")", o.grid_signals("tfb", "instrument, timeframe", VARIANTS, "variant"), o.trades("sig", TF_KEYS), o.trade_metrics("tr", TF_KEYS))


@query("variant_timeframe_matrix", o.with_(*TF_BARS, "k AS (SELECT DISTINCT variant, instrument, timeframe FROM sig)") + " SELECT variant, instrument, " + ", ".join(f"""round(sum(coalesce(net_pnl, 0)) FILTER (WHERE k.timeframe = '{m}m'), 4) AS "{m}m" """ for m in TIMEFRAMES) + " FROM k LEFT JOIN tm USING (variant, instrument, timeframe) GROUP BY 1, 2")
def variant_timeframe_matrix(spark, sf_dir):
    _, found = research.run_baseline(timeframe_bars(spark, sf_dir), by=(KEY, "timeframe"), backtest_config=NORMAL, angle_scale=2.0)
    names = [f"{m}m" for m in TIMEFRAMES]
    return found.groupBy("variant", KEY).pivot("timeframe", names).agg(F.round(F.sum("net_pnl"), 4))


@query("baseline_metrics", o.with_(*TF_BARS, o.equity("sig", "tr", TF_KEYS), o.curve_metrics("eq", TF_KEYS)) + f" SELECT {TF_KEYS}, coalesce(total_trades, 0)::BIGINT AS total_trades, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(net_pnl, 0), 4) AS net_pnl, round(coalesce(profit_factor, 0), 6) AS profit_factor, {o.rounded(('max_drawdown_pct', 'sharpe', 'sortino', 'calmar'), 5)} FROM cm LEFT JOIN tm USING ({TF_KEYS})")
def baseline_metrics(spark, sf_dir):
    _, found = research.run_baseline(timeframe_bars(spark, sf_dir), by=(KEY, "timeframe"), backtest_config=NORMAL, angle_scale=2.0)
    return found.select("variant", KEY, "timeframe", F.col("total_trades").cast("long").alias("total_trades"), F.round("win_rate", 6).alias("win_rate"), F.round("net_pnl", 4).alias("net_pnl"), F.round("profit_factor", 6).alias("profit_factor"), *[F.round(c, 5).alias(c) for c in ("max_drawdown_pct", "sharpe", "sortino", "calmar")])


CONFIGS = research.grid_configs(GRID, angle_scale=2.0)
CONFIG_VALUES = ", ".join(f"('{i}', {c.fast_ema}, {c.slow_ema}, {o.num(c.angle_threshold)}, {c.angle_lookback})" for i, c in CONFIGS)
CFG = f"cfg(experiment_id, fast_ema, slow_ema, angle_threshold, angle_lookback) AS (VALUES {CONFIG_VALUES})"


@query("param_grid", """WITH f AS (SELECT DISTINCT r_regionkey * 4 + 5 AS fast_ema FROM region), s AS (SELECT DISTINCT n_regionkey * 4 + 12 AS slow_ema FROM nation), t(angle_threshold) AS (VALUES (20.0::DOUBLE), (30.0::DOUBLE)), l AS (SELECT DISTINCT l_linenumber AS angle_lookback FROM lineitem),
v AS (SELECT * FROM f, s, t, l WHERE fast_ema < slow_ema)
SELECT printf('RE-%04d', row_number() OVER (ORDER BY fast_ema, slow_ema, angle_threshold, angle_lookback)) AS experiment_id, fast_ema::BIGINT AS fast_ema, slow_ema::BIGINT AS slow_ema, angle_threshold, angle_lookback::BIGINT AS angle_lookback FROM v""")
def param_grid(spark, sf_dir):
    """The valid combinations of values that stand in tables."""
    values = lambda name, value: table(spark, sf_dir, name).agg(F.array_sort(F.collect_set(value.cast("long"))).alias("v"))
    columns = {"fast_ema": values("region", F.col("r_regionkey") * 4 + 5), "slow_ema": values("nation", F.col("n_regionkey") * 4 + 12), "angle_lookback": values("lineitem", F.col("l_linenumber"))}
    axes = spark.range(1).select(F.array(F.lit(20.0), F.lit(30.0)).alias("angle_threshold"))
    for name, found in columns.items():
        axes = axes.crossJoin(found.withColumnRenamed("v", name))
    return research.grid_table(axes)


GRID_KEYS = "experiment_id, instrument"
IN_WINDOW = "win AS (SELECT * FROM bars WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-24')"
GRID_SQL = (o.bars(60), IN_WINDOW, CFG, o.grid_signals("win", KEY, CONFIGS, "experiment_id"), o.trades("sig", GRID_KEYS), o.trade_metrics("tr", GRID_KEYS), "k AS (SELECT DISTINCT experiment_id, instrument FROM sig)",
            "g AS (SELECT instrument, experiment_id, fast_ema, slow_ema, angle_threshold, angle_lookback, coalesce(total_trades, 0)::BIGINT AS total_trades, coalesce(net_pnl, 0) AS net_pnl, coalesce(win_rate, 0) AS win_rate, coalesce(profit_factor, 0) AS profit_factor FROM k JOIN cfg USING (experiment_id) LEFT JOIN tm USING (experiment_id, instrument))",
            "best AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY round(net_pnl, 6) DESC, experiment_id) AS rank FROM g)")


def _training_window(spark, sf_dir):
    """The training window from the first event on; the SQL holds that of the given tables."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"))
    train = research.split_schedule(rows).where("split = 'train'").first()
    return (train.start, train.end) if train else (dt.datetime.max, dt.datetime.max)


def _grid(spark, sf_dir):
    found = research.grid_search(event_bars(spark, sf_dir), _training_window(spark, sf_dir), GRID, backtest_config=NORMAL, angle_scale=2.0)
    return found.withColumn("total_trades", F.col("total_trades").cast("long"))


@query("grid_search", o.with_(*GRID_SQL) + " SELECT instrument, experiment_id, fast_ema, slow_ema, angle_threshold, angle_lookback, total_trades, round(net_pnl, 4) AS net_pnl, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor FROM best")
def grid_search(spark, sf_dir):
    return _grid(spark, sf_dir).select(KEY, "experiment_id", *research.PARAMETERS, "total_trades", F.round("net_pnl", 4).alias("net_pnl"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 6).alias("profit_factor"))


@query("grid_search_topn", o.with_(*GRID_SQL) + " SELECT instrument, rank::INTEGER AS rank, experiment_id, round(net_pnl, 4) AS net_pnl FROM best WHERE rank <= 5")
def grid_search_topn(spark, sf_dir):
    """The five best configurations of each instrument (the limit is the feature)."""
    return _grid(spark, sf_dir).where("rank <= 5").select(KEY, "rank", "experiment_id", F.round("net_pnl", 4).alias("net_pnl"))


@query("grid_share", o.with_(*GRID_SQL) + " SELECT instrument, avg((net_pnl > 0)::INT) AS positive_share, round(median(net_pnl), 4) AS median_net FROM g GROUP BY 1")
def grid_share(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy(KEY).agg(F.avg((F.col("net_pnl") > 0).cast("double")).alias("positive_share"), F.round(F.median("net_pnl"), 4).alias("median_net"))


@query("split_schedule", """WITH f AS (SELECT event_type AS instrument, min(ts)::DATE AS d FROM events GROUP BY 1), s(split, a, b) AS (VALUES ('train', 0, 23), ('validation', 23, 27), ('test', 27, 31))
SELECT instrument, split, (d + a)::TIMESTAMP AS start, (d + b)::TIMESTAMP AS "end" FROM f, s""")
def split_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias(KEY), F.col("ts").alias("timestamp"))
    return research.split_schedule(rows, by=(KEY,))


SPAN = "span AS (SELECT min(ts)::DATE AS d0, max(ts)::DATE AS d1 FROM events)"
STEP_ROWS = """steps AS (SELECT (n + 1)::INTEGER AS step, d0::TIMESTAMP AS train_start, (d0 + (14 + 5 * n)::INT)::TIMESTAMP AS train_end, (d0 + (15 + 5 * n)::INT)::TIMESTAMP AS test_start, least(d0 + (20 + 5 * n)::INT, d1 + 1)::TIMESTAMP AS test_end FROM span, range(0, 1000) r(n) WHERE d0 + (19 + 5 * n)::INT <= d1)"""


@query("walk_windows", f"WITH {SPAN}, {STEP_ROWS} SELECT * FROM steps")
def walk_windows(spark, sf_dir):
    return research.walk_windows(table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp")))


WALK_KEYS, WALK_SERIES = "experiment_id, step, instrument", "step, instrument"
WALK = (o.bars(60), SPAN, STEP_ROWS, CFG,
        "trn AS (SELECT step, b.* FROM bars b JOIN steps ON timestamp >= train_start AND timestamp < train_end)", "tst AS (SELECT step, b.* FROM bars b JOIN steps ON timestamp >= test_start AND timestamp < test_end)",
        o.grid_signals("trn", WALK_SERIES, CONFIGS, "experiment_id", "s1"), o.trades("s1", WALK_KEYS, name="t1"), o.trade_metrics("t1", WALK_KEYS, "m1"),
        o.grid_signals("tst", WALK_SERIES, CONFIGS, "experiment_id", "s2"), o.trades("s2", WALK_KEYS, name="t2"), o.trade_metrics("t2", WALK_KEYS, "m2"),
        "k1 AS (SELECT DISTINCT experiment_id, step, instrument FROM s1)", "k2 AS (SELECT DISTINCT experiment_id, step, instrument FROM s2)",
        f"c AS (SELECT step, instrument, experiment_id, coalesce(net_pnl, 0) AS train_net_pnl, row_number() OVER (PARTITION BY step, instrument ORDER BY round(coalesce(net_pnl, 0), 6) DESC, experiment_id) AS r FROM k1 LEFT JOIN m1 USING ({WALK_KEYS}))",
        f"e AS (SELECT step, instrument, experiment_id, coalesce(net_pnl, 0) AS test_net_pnl, coalesce(total_trades, 0) AS test_trades, coalesce(profit_factor, 0) AS test_profit_factor FROM k2 LEFT JOIN m2 USING ({WALK_KEYS}))")


@query("walk_forward_best", o.with_(*WALK) + f" SELECT c.step, c.instrument, c.experiment_id, train_end, test_start, test_end, fast_ema, slow_ema, angle_threshold, angle_lookback, round(train_net_pnl, 4) AS train_net_pnl, round(test_net_pnl, 4) AS test_net_pnl, test_trades::BIGINT AS test_trades, round(test_profit_factor, 6) AS test_profit_factor FROM c JOIN cfg USING (experiment_id) JOIN steps USING (step) LEFT JOIN e USING ({WALK_KEYS}) WHERE r = 1")
def walk_forward_best(spark, sf_dir):
    found = research.walk_forward(event_bars(spark, sf_dir), GRID, backtest_config=NORMAL, angle_scale=2.0)
    return found.select("step", KEY, "experiment_id", "train_end", "test_start", "test_end", *research.PARAMETERS, F.round("train_net_pnl", 4).alias("train_net_pnl"), F.round("test_net_pnl", 4).alias("test_net_pnl"), F.col("test_trades").cast("long").alias("test_trades"), F.round("test_profit_factor", 6).alias("test_profit_factor"))


# ---- contracts, calendar, reports ----


@query("contract_pick", f"SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' GROUP BY 1")
def contract_pick(spark, sf_dir):
    """The first order of each customer on or after a day, as a master's next expiry."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return contracts.earliest_on_or_after(rows, ("o_custkey",), "o_orderdate", F.lit(AS_OF).cast("timestamp_ntz"), ("o_orderkey",))


@query("last_thursday", "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders) SELECT month::VARCHAR AS month, (last_day(month) - ((isodow(last_day(month)) - 4 + 7) % 7)::INT)::DATE::VARCHAR AS last_thursday FROM m")
def last_thursday(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("month")).distinct()
    return dated(months.select("month", calendar.last_thursday(F.col("month")).alias("last_thursday")), "month", "last_thursday")


@query("daily_volume", o.with_(o.bars(60)) + " SELECT instrument, timestamp::DATE::VARCHAR AS day_of, count(*) AS bars, round(avg(volume), 6) AS avg_volume, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2")
def daily_volume(spark, sf_dir):
    return event_bars(spark, sf_dir).groupBy(KEY, F.to_date("timestamp").cast("string").alias("day_of")).agg(F.count("*").alias("bars"), F.round(F.avg("volume"), 6).alias("avg_volume"), F.sum("volume").alias("volume"))


@query("weekly_range_stats", o.with_(o.bars(60)) + " SELECT instrument, date_trunc('week', timestamp)::TIMESTAMP AS week, round(avg(high - low), 6) AS avg_range, round(coalesce(stddev_samp(high - low), 0), 6) AS sd_range FROM bars GROUP BY 1, 2")
def weekly_range_stats(spark, sf_dir):
    spread = F.col("high") - F.col("low")
    week = F.date_sub(F.to_date("timestamp"), F.weekday("timestamp")).cast("timestamp_ntz")
    return event_bars(spark, sf_dir).groupBy(KEY, week.alias("week")).agg(F.round(F.avg(spread), 6).alias("avg_range"), F.round(F.coalesce(F.stddev_samp(spread), F.lit(0.0)), 6).alias("sd_range"))


@query("months_listing", "SELECT strftime(ts, '%Y-%m') AS month, event_type AS instrument, count(*) AS bars FROM events GROUP BY 1, 2")
def months_listing(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias(KEY)).agg(F.count("*").alias("bars"))


@query("bars_page", o.with_(o.bars(60)) + " SELECT * FROM bars ORDER BY timestamp, instrument LIMIT 20 OFFSET 40")
def bars_page(spark, sf_dir):
    """Page three of the bars, twenty a page (the limit is the feature)."""
    from tidemark.sources.candles import page

    return page(event_bars(spark, sf_dir), 20, 40, (KEY,))


@query("upsert", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert(spark, sf_dir):
    """Orders with the finished ones replaced."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    return research.upsert(old, new, ("o_orderkey",))


@query("monthly_performance", o.with_(*TRADED) + " SELECT instrument, strftime(exit_time, '%Y-%m') AS month, count(*) AS trades, round(sum(net_pnl), 4) AS net_pnl, round(avg((net_pnl > 0)::INT), 6) AS win_rate FROM tr GROUP BY 1, 2")
def monthly_performance(spark, sf_dir):
    found = research.monthly_performance(backtest.run_trades(crossover_rows(spark, sf_dir), NORMAL))
    return found.withColumns({"net_pnl": F.round("net_pnl", 4), "win_rate": F.round("win_rate", 6)})


@query("day_checks", o.with_(o.bars(60), """d AS (SELECT instrument, timestamp::DATE AS day_of, sum(volume)::BIGINT AS volume, arg_min(open, timestamp) AS o, arg_max(close, timestamp) AS c, count(*) FILTER (WHERE isnan(open) OR isnan(close) OR isnan(high) OR isnan(low)) AS not_numbers FROM bars GROUP BY 1, 2),
w AS (SELECT *, avg(volume) OVER (PARTITION BY instrument) AS mean, lag(c) OVER (PARTITION BY instrument ORDER BY day_of) AS c0, lag(day_of) OVER (PARTITION BY instrument ORDER BY day_of) AS d0 FROM d)""") + " SELECT instrument, day_of::VARCHAR AS day_of, volume, volume > mean * 1.5 OR volume < mean / 1.5 AS odd_volume, coalesce(abs((o - c0) / nullif(c0, 0)) > 0.5, FALSE) AS open_gap, coalesce(len(list_filter(range(1, datediff('day', d0, day_of)), lambda i: isodow(d0 + i::INT) < 6)), 0)::BIGINT AS missing_weekdays, not_numbers FROM w")  # fmt: skip
def day_checks(spark, sf_dir):
    return dated(quality.day_checks(event_bars(spark, sf_dir), share=1.5, gap=0.5))


@query("risk_checks", o.with_(*TRADED) + " SELECT instrument, entry_time::DATE::VARCHAR AS day_of, count(*) AS trades, round(sum(net_pnl), 4) AS net_pnl, count(*) > 20 AS too_many, sum(net_pnl) < -50000 AS loss_limit FROM tr GROUP BY 1, 2")
def risk_checks(spark, sf_dir):
    from tidemark.operators.risk import daily_limits

    return dated(daily_limits(backtest.run_trades(crossover_rows(spark, sf_dir), NORMAL))).withColumn("net_pnl", F.round("net_pnl", 4))


def flagship(spark, sf_dir):
    """Crossover trades on hourly bars, with one tick of slippage and all costs."""
    return trades_costed(spark, sf_dir)
