"""Parameter grids, baselines and walk-forward validation as single plans.

A configuration is a value of a column, not a run: indicators are computed once
for each distinct period, and trades, curves and metrics are windows and
aggregates by (configuration, series).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.schemas import MODES, BacktestConfig, StrategyConfig, versions
from tidemark.operators import backtest, metrics, signals

# The default search grid and the metrics it reports.
GRID = {"fast_ema": (5, 7, 9, 12), "slow_ema": (15, 18, 21, 25), "angle_threshold": (20.0, 25.0, 30.0, 35.0, 40.0), "angle_lookback": (1, 2, 3, 5)}
GRID_METRICS = ("net_pnl", "gross_pnl", "profit_factor", "win_rate", "total_trades", "max_drawdown_pct", "sharpe", "sortino", "avg_trade_pnl")
PARAMETERS = ("fast_ema", "slow_ema", "angle_threshold", "angle_lookback")


def grid_table(axes: DataFrame) -> DataFrame:
    """(experiment_id, parameters) of each combination with fast below slow; ``axes`` is one row that holds an array of values for each parameter.

    Experiments are numbered RE-0001 and so on in the order of the arrays, the last parameter running fastest.
    """
    rows = axes.select(*PARAMETERS)
    for p in PARAMETERS:
        rows = rows.select(*[c for c in rows.columns if c != p], F.posexplode(p).alias(f"__{p}", p))
    order = Window.orderBy(*[f"__{p}" for p in PARAMETERS])
    valid = rows.where("fast_ema < slow_ema").withColumn("n", F.row_number().over(order))
    return valid.select(F.format_string("RE-%04d", "n").alias("experiment_id"), *PARAMETERS)


def grid_configs(grid: Mapping[str, Sequence] | None = None, **fixed) -> list[tuple[str, StrategyConfig]]:
    """The rows of ``grid_table`` for plain values, as configurations with ``fixed`` further parameters."""
    axes = [np.asarray((grid or GRID)[p]) for p in PARAMETERS]
    columns = [values[place.ravel()] for values, place in zip(axes, np.indices([len(a) for a in axes]), strict=True)]
    valid = np.flatnonzero(columns[0] < columns[1])
    cells = zip(*[c[valid].tolist() for c in columns], strict=True)
    return [(f"RE-{n:04d}", StrategyConfig(*cell, **fixed)) for n, cell in enumerate(cells, 1)]


def within(bars: DataFrame, window: tuple | None) -> DataFrame:
    """Bars of the half-open window [start, end)."""
    if window is None:
        return bars
    start, end = (F.lit(x).cast("timestamp_ntz") for x in window)
    return bars.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def simulate(bars: DataFrame, configs: Iterable[tuple[str, StrategyConfig]], by: Sequence[str] = ("instrument",), backtest_config: BacktestConfig = BacktestConfig(), name: str = "experiment_id", chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, equity, metrics) of every configuration on every series; with ``chosen`` (``by``, ``name``) only of those.

    Averages, fills and angles are computed once for each bar; a row for each
    configuration comes only where it signals, and in the equity curve.
    """
    configs, keys = list(configs), [name, *by]
    bars = bars.select(*by, "timestamp", "open", "close")
    signalled = signals.fired(signals.with_arrays(backtest.executable(bars, by), configs, by), configs, name)
    if chosen is None:
        marked = bars.withColumn(name, F.explode(F.array(*[F.lit(i) for i, _ in configs])))
    else:
        signalled = signalled.join(chosen.select(*keys), keys, "left_semi")
        marked = bars.join(chosen.select(*keys), list(by))
    trades = backtest.trades_of(backtest.held(signalled, keys), backtest_config, keys)
    equity = backtest.equity_curve(marked, trades, backtest_config, keys)
    return trades, equity, metrics.compute_metrics(trades, equity, backtest_config.initial_capital, keys)


def evaluate(bars: DataFrame, configs: Iterable[tuple[str, StrategyConfig]], by: Sequence[str] = ("instrument",), backtest_config: BacktestConfig = BacktestConfig(), name: str = "experiment_id", chosen: DataFrame | None = None) -> DataFrame:
    """Metrics of every configuration on every series."""
    return simulate(bars, configs, by, backtest_config, name, chosen)[2]


def _parameters(configs, name: str):
    """The parameters of a configuration as columns looked up by its name."""
    out = {}
    for p in PARAMETERS:
        pairs = [F.lit(x) for i, c in configs for x in (i, getattr(c, p))]
        out[p] = F.element_at(F.create_map(*pairs), F.col(name))
    return out


def grid_search(bars: DataFrame, window: tuple | None = None, grid: Mapping | None = None, by: Sequence[str] = ("instrument",), backtest_config: BacktestConfig = BacktestConfig(), **fixed) -> DataFrame:
    """Each configuration's parameters and metrics on the window; ``rank`` orders a series by net P&L, ties by experiment."""
    configs = grid_configs(grid, **fixed)
    found = evaluate(within(bars, window), configs, by, backtest_config)
    best = Window.partitionBy(*by).orderBy(F.desc("net_pnl"), "experiment_id")
    return found.withColumns(_parameters(configs, "experiment_id")).withColumn("rank", F.row_number().over(best)).select(*by, "experiment_id", *PARAMETERS, *GRID_METRICS, "rank")


def split_schedule(bars: DataFrame, train_days: int = 23, validation_days: int = 4, test_days: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive half-open calendar windows (split, start, end) from the first bar's day."""
    first = bars.groupBy(*by).agg(F.to_date(F.min("timestamp")).alias("d"))
    edges = (0, train_days, train_days + validation_days, train_days + validation_days + test_days)
    at = lambda n: F.date_add("d", n).cast("timestamp_ntz")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), at(a).alias("start"), at(b).alias("end")) for s, a, b in zip(("train", "validation", "test"), edges, edges[1:], strict=False)]))
    return first.where(F.col("d").isNotNull()).select(*by, rows.alias("w")).select(*by, "w.*")


ANCHOR_DAYS, TEST_DAYS = 14, 5


def _step_days(step, first, last, test_days: int) -> dict:
    """The edges of step number ``step`` (from 1) as days counted from the first one; training grows from it, a day lies between it and its test."""
    end = F.lit(ANCHOR_DAYS) + (step - 1) * test_days
    return {"train_start": F.lit(0), "train_end": end, "test_start": end + 1, "test_end": F.least(end + 1 + test_days, F.datediff(last, first) + 1)}


def _span(bars: DataFrame, by: Sequence[str], test_days: int) -> DataFrame:
    """(``by``, first and last day, number of steps): a step's training end and ``test_days`` more days must lie within the last day."""
    span = bars.groupBy(*by).agg(F.to_date(F.min("timestamp")).alias("__first"), F.to_date(F.max("timestamp")).alias("__last"))
    return span.withColumn("__steps", F.floor((F.datediff("__last", "__first") - ANCHOR_DAYS) / test_days).cast("int")).where("__steps > 0")


def walk_windows(bars: DataFrame, by: Sequence[str] = (), test_days: int = TEST_DAYS) -> DataFrame:
    """(``by``, step, train_start, train_end, test_start, test_end) over the span of each series, half-open; none where it is too short."""
    steps = _span(bars, by, test_days).withColumn("step", F.explode(F.sequence(F.lit(1), "__steps")))
    edges = _step_days(F.col("step"), F.col("__first"), F.col("__last"), test_days)
    return steps.select(*by, "step", *[F.date_add("__first", d.cast("int")).cast("timestamp_ntz").alias(n) for n, d in edges.items()])


def in_steps(bars: DataFrame, span: DataFrame, part: str, by: Sequence[str] = (), test_days: int = TEST_DAYS) -> DataFrame:
    """Bars once for each step in whose window (``part`` is train or test) they lie; the steps follow from the bar's day by arithmetic."""
    rows = bars.join(span, list(by)) if by else bars.crossJoin(F.broadcast(span))
    day = F.datediff(F.to_date("timestamp"), F.col("__first"))
    if part == "train":
        least, most = F.floor((day - ANCHOR_DAYS) / test_days) + 2, F.col("__steps")
    else:
        least = F.floor((day - ANCHOR_DAYS - 1) / test_days) + 1
        most = F.when(day > ANCHOR_DAYS, F.least(least, F.col("__steps"))).otherwise(0)
    least = F.greatest(least, F.lit(1)).cast("int")
    return rows.withColumn("step", F.explode(F.when(least <= most, F.sequence(least, most.cast("int"))))).drop("__first", "__last", "__steps")


def walk_forward(bars: DataFrame, grid: Mapping | None = None, by: Sequence[str] = ("instrument",), backtest_config: BacktestConfig = BacktestConfig(), test_days: int = TEST_DAYS, **fixed) -> DataFrame:
    """For each step and series: the windows, the best parameters on training bars and their result on unseen test bars.

    Averages warm up anew in each window. The windows span the data of all
    series; too short a span raises ValueError. Test bars run the chosen
    configuration only.
    """
    span = _span(bars, (), test_days)
    if span.isEmpty():
        raise ValueError("too few days for a walk-forward split")
    configs, keys = grid_configs(grid, **fixed), ["step", *by]
    train = evaluate(in_steps(bars, span, "train", (), test_days), configs, keys, backtest_config)
    best = Window.partitionBy(*keys).orderBy(F.desc("net_pnl"), "experiment_id")
    chosen = train.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*keys, "experiment_id", F.col("net_pnl").alias("train_net_pnl"))
    test = evaluate(in_steps(bars, span, "test", (), test_days), configs, keys, backtest_config, chosen=chosen)
    test = test.select(*keys, "experiment_id", F.col("net_pnl").alias("test_net_pnl"), F.col("total_trades").alias("test_trades"), F.col("profit_factor").alias("test_profit_factor"))
    edges = walk_windows(bars, (), test_days)
    out = chosen.join(test, [*keys, "experiment_id"], "left").withColumns(_parameters(configs, "experiment_id")).join(F.broadcast(edges), "step")
    return out.select(*keys, *edges.columns[1:], "experiment_id", *PARAMETERS, "train_net_pnl", "test_net_pnl", "test_trades", "test_profit_factor")


def baseline_variants(angle_threshold: float = 30.0, **fixed) -> list[tuple[str, StrategyConfig]]:
    """A: crossover; B: with angle; C: with angle and trend."""
    return [(v, StrategyConfig(signal_mode=m, angle_threshold=30.0 if m == MODES[0] else angle_threshold, **fixed)) for v, m in zip("ABC", MODES, strict=True)]


def run_baseline(bars: DataFrame, angle_threshold: float = 30.0, by: Sequence[str] = ("timeframe",), backtest_config: BacktestConfig = BacktestConfig(), **fixed) -> tuple[DataFrame, DataFrame]:
    """(trades, metrics) of the three variants on every series; ``by`` holds the timeframe."""
    trades, _, found = simulate(bars, baseline_variants(angle_threshold, **fixed), by, backtest_config, "variant")
    return trades, found


def matrix(found: DataFrame, value: str, timeframes: Sequence[str], name: str = "timeframe") -> DataFrame:
    """One metric as variant by timeframe."""
    return found.groupBy("variant").pivot(name, list(timeframes)).agg(F.first(value))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that share their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def monthly_performance(trades: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Trades, net and winning share by month of exit."""
    month = F.date_format("exit_time", "yyyy-MM").alias("month")
    return trades.groupBy(*by, month).agg(F.count("*").alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"))


def registry(found: DataFrame, configs: Iterable[tuple[str, StrategyConfig]], dataset: str, name: str = "experiment_id") -> DataFrame:
    """Experiments with the digest of their configuration, the versions of data, strategy, cost model and engine, and their metrics, as a table to append to."""
    digests = F.create_map(*[F.lit(x) for i, c in configs for x in (i, c.digest())])
    return found.withColumns({"config_hash": F.element_at(digests, F.col(name)), **{n: F.lit(v) for n, v in versions(dataset).items()}})
