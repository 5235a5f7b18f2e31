"""Command line: ``python -m tidemark process|signals|backtest|baseline|research|download``."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tidemark.functions.schemas import MODES, NORMAL_SLIPPAGE, BacktestConfig, StrategyConfig
from tidemark.plans import outputs, reports
from tidemark.plans.tools import Tools, backtest_config, numbers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("command", choices=["download", "process", "signals", "backtest", "baseline", "research"])
    top.add_argument("month", help="YYYY-MM")
    top.add_argument("--raw", default="data/raw")
    top.add_argument("--processed", default="data/processed")
    top.add_argument("--results", default="data/results")
    top.add_argument("--timeframes", default="1,5,15", help="minutes, comma-separated")
    top.add_argument("--fast", type=int, default=9)
    top.add_argument("--slow", type=int, default=15)
    top.add_argument("--threshold", type=float, default=30.0)
    top.add_argument("--lookback", type=int, default=1)
    top.add_argument("--mode", choices=MODES, default=MODES[1])
    top.add_argument("--slippage", choices=["ideal", "normal", "stress", "ticks"], default="ideal")
    top.add_argument("--ticks", type=int, default=1)
    top.add_argument("--any-sign", action="store_true", help="the series holds values, not prices: those of 0 or less only warn")
    top.add_argument("--client", help="module:function of a download client (security id, first day, last day)")
    top.add_argument("--contract", help="the contract as JSON, for download")
    return top


def run(spark: SparkSession, given: Sequence[str]) -> object:
    """Runs one command and returns what it prints."""
    a = parser().parse_args(given)
    tools = Tools(spark, a.raw, a.processed, positive=not a.any_sign)
    labels = [f"{n}m" for n in numbers(a.timeframes)]
    config = StrategyConfig(a.fast, a.slow, a.threshold, a.lookback, signal_mode=a.mode)
    if a.command == "download":
        module, name = a.client.split(":")
        return tools.download_month_data(a.month, json.loads(a.contract), getattr(importlib.import_module(module), name))
    if a.command == "process":
        return tools.process_month_data(a.month, a.timeframes)
    if a.command == "signals":
        return {t: outputs.write_signals(spark, a.processed, a.results, a.month, t, config) for t in labels}
    if a.command == "backtest":
        return {t: outputs.write_backtest(spark, a.processed, a.results, a.month, t, config, backtest_config(a.slippage, a.ticks)) for t in labels}
    if a.command == "baseline":
        return outputs.write_baseline(spark, a.processed, a.results, a.month, labels, BacktestConfig(slippage=NORMAL_SLIPPAGE))["comparison_table"]
    return outputs.write_research(spark, tools, a.results, a.month, labels)


def main() -> None:
    import sys

    print(reports.dumps(run(SparkSession.builder.getOrCreate(), sys.argv[1:])))


if __name__ == "__main__":
    main()
