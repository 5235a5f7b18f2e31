"""Table schemas and configuration records.

Bar times are exchange wall time without zone (TIMESTAMP_NTZ); prices and money
are doubles; counts are longs.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"ntz": T.TimestampNTZType(), "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "date": T.DateType(), "boolean": T.BooleanType()}


def struct(spec: str) -> T.StructType:
    """A struct from ``name type, name type`` text."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in spec.split(", "))])


CANDLES = struct("timestamp ntz, instrument string, security_id string, exchange string, instrument_type string, expiry date, open double, high double, low double, close double, volume long, open_interest long, lot_size long, tick_size double")
SIGNALS = struct("timestamp ntz, signal_type string, crossover boolean, ema_fast double, ema_slow double, angle double, candle_close double")
TRADES = struct("trade_id long, entry_time ntz, exit_time ntz, direction string, entry_price double, exit_price double, quantity long, gross_pnl double, costs double, net_pnl double, holding_periods long, closed_at_end long")
EQUITY = struct("timestamp ntz, equity double, unrealized double, realized double")

# Versions that results name.
STRATEGY_VERSION, COST_MODEL_VERSION, ENGINE_VERSION = "ema_9_15_angle_v1", "india_futures_v1", "0.1.0"


def versions(dataset: str) -> dict[str, str]:
    """What a result was made with; ``dataset`` names the data, for example nifty_futures_july_2026_v1."""
    return {"dataset_version": dataset, "strategy_version": STRATEGY_VERSION, "cost_model_version": COST_MODEL_VERSION, "engine_version": ENGINE_VERSION}


MODES = ("crossover", "crossover_and_angle", "crossover_angle_and_trend")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast, with typed nulls for those that ``df`` lacks."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


STRATEGY_RULES = {
    f"signal_mode is one of {MODES}": lambda c: c.signal_mode in MODES,
    "0 < fast_ema < slow_ema": lambda c: 0 < c.fast_ema < c.slow_ema,
    "angle_threshold and angle_scale are 0 or more": lambda c: min(c.angle_threshold, c.angle_scale) >= 0,
    "angle_lookback is 1 or more": lambda c: c.angle_lookback >= 1,
}


# The defaults of the strategy.
@dataclass(frozen=True)
class StrategyConfig:
    """Parameters of the crossover strategy; invalid values raise ValueError."""

    fast_ema: int = 9
    slow_ema: int = 15
    angle_threshold: float = 30.0
    angle_lookback: int = 1
    angle_scale: float = 1000.0
    signal_mode: str = "crossover_and_angle"

    def __post_init__(self):
        broken = [said for said, holds in STRATEGY_RULES.items() if not holds(self)]
        if broken:
            raise ValueError("; ".join(broken))

    def digest(self) -> str:
        """A stable name of the parameters: sha256 of canonical JSON, shortened."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:16]


# Rates of the futures cost model.
@dataclass(frozen=True)
class CostConfig:
    """Charges of one order; rates apply to turnover, GST to brokerage and exchange charge."""

    brokerage_flat: float = 20.0
    stt_rate: float = 0.000125
    exchange_rate: float = 0.0000345
    sebi_rate: float = 0.000001
    stamp_rate: float = 0.00003
    stamp_side: str = "buy"
    gst_rate: float = 0.18


@dataclass(frozen=True)
class SlippageConfig:
    """Adverse ticks: mode ideal, normal, stress or ticks; entry_ticks are those of buys, exit_ticks of sells."""

    mode: str = "ideal"
    entry_ticks: int = 0
    exit_ticks: int = 0
    tick_size: float = 0.05


# The defaults of a backtest.
@dataclass(frozen=True)
class BacktestConfig:
    initial_capital: float = 1_000_000.0
    position_size: int = 1
    lot_size: int = 50
    costs: CostConfig = field(default_factory=CostConfig)
    slippage: SlippageConfig = field(default_factory=SlippageConfig)

    @property
    def quantity(self) -> int:
        return self.position_size * self.lot_size


NORMAL_SLIPPAGE = SlippageConfig(mode="normal")
