"""JSON records and Markdown text of results that are small."""

from __future__ import annotations

import datetime as dt
import json
import numbers
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schemas import versions

# The metrics compared and how each is written.
COMPARED = ("total_trades", "win_rate", "gross_pnl", "net_pnl", "profit_factor", "max_drawdown_pct", "sharpe", "sortino", "avg_trade_pnl", "avg_holding_periods")
STYLES = {"win_rate": "{:.1%}", "max_drawdown_pct": "{:.1%}", "gross_pnl": "{:,.0f}", "net_pnl": "{:,.0f}", "avg_trade_pnl": "{:,.0f}"}

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "dateFormat": "yyyy-MM-dd"}


def records(df: DataFrame) -> list[dict]:
    """The rows of a small result as JSON objects, written by Spark: times as ISO text, nulls kept."""
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("j")).collect()]


def dumps(record) -> str:
    """JSON text; dates and times become ISO text, other objects their text."""
    return json.dumps(record, indent=2, default=lambda value: value.isoformat() if isinstance(value, dt.date) else str(value))


def jsonable(record):
    return json.loads(dumps(record))


def overall(checks: Sequence[Mapping], warns: bool = True) -> str:
    states = {c["status"] for c in checks}
    if "fail" in states:
        return "fail"
    return "pass_with_warnings" if warns and "warn" in states else "pass"


def validation_record(dataset: str, total: int, first, last, days: int, checks: Sequence[Mapping]) -> dict:
    said = lambda state: [f"{c['name']}: {c.get('details') or c['failures']}" for c in checks if c["status"] == state]
    return jsonable({"dataset": dataset, "total_candles": total, "date_range": [first, last], "trading_days": days, "checks": list(checks), "overall_status": overall(checks), "warnings": said("warn"), "errors": said("fail")})


def shown(metric: str, value) -> str:
    """A metric as text in its style; a dash stands for anything that is no number."""
    number = isinstance(value, numbers.Real) and not isinstance(value, bool)
    return STYLES.get(metric, "{:.2f}").format(value) if number else "-"


def minutes_of(timeframe: str) -> int:
    return int(timeframe.rstrip("m"))


def comparison(records: Sequence[Mapping], keys: Sequence[str] = COMPARED) -> dict:
    """variant -> timeframe -> metrics from flat records."""
    out: dict = {}
    for r in sorted(records, key=lambda r: (r["variant"], minutes_of(r["timeframe"]))):
        out.setdefault(r["variant"], {})[r["timeframe"]] = {k: r.get(k) for k in keys}
    return out


def _table(header: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(header), "|" + "---|" * len(header), *map(line, rows)]


def _bullets(pairs) -> list[str]:
    return [f"- {name}: {value}" for name, value in pairs]


def baseline_markdown(period: str, dataset: str, found: Sequence[Mapping], assumptions: Mapping, experiments: Sequence[Mapping] = (), results: str = "") -> str:
    """The comparison of variants and timeframes, each experiment's configuration, and where the raw results are."""
    table = comparison(found)
    columns = [(v, t) for v in table for t in table[v]]
    rows = [[f"**{k}**", *[shown(k, table[v][t][k]) for v, t in columns]] for k in COMPARED]
    lines = ["# Baseline report", "", f"Period {period}, dataset {dataset}, {len(found)} experiments.", "", "## Assumptions", "", *_bullets(assumptions.items()), "", "## Comparison", ""]
    lines += _table(["metric", *[f"{v} {t}" for v, t in columns]], rows)
    if experiments:
        made = [(f"{e['variant']} {e['timeframe']}", f"config {e['config_hash']}, {e['total_trades']} trades, net {shown('net_pnl', e['net_pnl'])}") for e in experiments]
        lines += ["", "## Reproducibility", "", *_bullets(versions(dataset).items()), *_bullets(made)]
    if results:
        lines += ["", "## Raw data", "", *_bullets([("trades of all experiments", f"{results}/baseline/trades"), ("trades, metrics and equity by timeframe", results)])]
    return "\n".join([*lines, ""])


def _timeframe_lines(part: Mapping) -> list[str]:
    """One timeframe of the robustness report: splits, grid, walk-forward steps, regimes."""
    grid, best = part["grid_search"], part["grid_search"]["best"]
    short = lambda time: str(time)[:10]
    lines = ["Splits, half-open:", "", *_bullets((name, f"{short(start)} to {short(end)}") for name, (start, end) in part["splits"].items())]
    lines += ["", f"{grid['combinations']} combinations on the training window, {100 * grid['positive_share']:.1f}% with a profit, median {shown('net_pnl', grid['median_net_pnl'])}.", ""]
    lines += [f"Best {best['params']}: net {shown('net_pnl', best['net_pnl'])}, {best.get('total_trades', '-')} trades, profit factor {shown('profit_factor', best.get('profit_factor'))}.", ""]
    steps = [
        [str(s["step"]), f"{short(s['train_start'])} to {short(s['train_end'])}", f"{short(s['test_start'])} to {short(s['test_end'])}", " / ".join(str(s[p]) for p in ("fast_ema", "slow_ema", "angle_threshold", "angle_lookback"))]
        + [shown("net_pnl", s["train_net_pnl"]), shown("net_pnl", s["test_net_pnl"]), str(s["test_trades"]), shown("profit_factor", s["test_profit_factor"])]
        for s in part["walk_forward"]
    ]
    lines += _table(["step", "training", "test", "fast / slow / angle / lookback", "train net", "test net", "trades", "profit factor"], steps) if steps else ["No walk-forward windows."]
    regimes = [[r["regime"], str(r["days"]), str(r["trades"]), *[shown(k, r[k]) for k in ("net_pnl", "profit_factor", "win_rate")]] for r in part["regimes"]]
    return [*lines, "", *_table(["regime", "days", "trades", "net", "profit factor", "win rate"], regimes)]


def robustness_markdown(summary: Mapping) -> str:
    """Splits, grid, walk-forward and regime results of each timeframe."""
    lines = [f"# Robustness report {summary['period']}"]
    for timeframe in sorted(summary["timeframes"], key=minutes_of):
        lines += ["", f"## {timeframe}", "", *_timeframe_lines(summary["timeframes"][timeframe])]
    made = {"signals": "at the close, from this bar and earlier ones", "fills": "next bar's open, one adverse tick", "experiments": "RE- numbers in the order of the grid"}
    return "\n".join([*lines, "", "## Reproducibility", "", *_bullets((versions(summary["period"]) | made).items()), ""])
