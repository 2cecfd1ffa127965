"""From a tape to enriched bars, runs and figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators.broker import Costs, equity_of, simulate, trades_of
from barloom.operators.metrics import run_metrics
from barloom.operators.strategy import cross_signals, indicator_cross

from .params import Param, Registry, Spec

REGISTRY = Registry()
REGISTRY.add("aggregator", "time", lambda bar_secs: lambda t, tick: B.time_bar_ids(t, bar_secs), Spec(Param("bar_secs", 300, 5, 3600, 5)))
REGISTRY.add("aggregator", "range", lambda range_ticks: lambda t, tick: B.range_bar_ids(t, range_ticks, tick), Spec(Param("range_ticks", 30, 1, 400, 1)))
REGISTRY.add("indicator", "technical", lambda **p: lambda bar, levels: I.technical(bar, **p), Spec(Param("fast", 12, 2, 200, 1), Param("slow", 26, 3, 400, 1), Param("rsi_n", 14, 2, 100, 1)))
REGISTRY.add("indicator", "regime", lambda window: lambda bar, levels: I.regime(bar, window), Spec(Param("window", 30, 5, 500, 1)))
REGISTRY.add(
    "strategy", "indicator_cross", lambda **p: p,
    Spec(Param("side", "long_only", options=("long_only", "long_short")), Param("volume_min", 0.0, 0.0, 5.0), Param("stop_ticks", 20.0, 0.0, 400.0), Param("target_ticks", 40.0, 0.0, 400.0)),
)


@dataclass(frozen=True)
class Prepared:
    """Bars and ladders to run strategies on; write them as Parquet to use them again."""

    bars: DataFrame
    levels: DataFrame


def prepare(trades: DataFrame, tick: float, aggregator: str = "time", indicators: tuple[str, ...] = ("technical",), params: dict | None = None) -> Prepared:
    """Trades to bars with a ladder and indicators; ``params`` by stage name."""
    params = params or {}
    with_id = REGISTRY.build("aggregator", aggregator, **params.get(aggregator, {}))(trades, tick)
    levels = B.ladder(with_id, tick)
    bar = B.with_poc(B.bars(with_id), levels)
    for name in indicators:
        bar = REGISTRY.build("indicator", name, **params.get(name, {}))(bar, levels)
    return Prepared(bar, levels)


def run_trials(bars: DataFrame, trials: DataFrame, costs: Costs) -> DataFrame:
    """A run for each symbol and trial (trial_id, side, volume_min, stop_ticks, target_ticks).

    Each bar goes to every trial, which is the work a search asks for; trials are bounded by the search's cap and go
    along as one array, and runs spread over tasks by run_id.
    """
    each = F.struct("trial_id", (F.col("side") == "long_short").alias("long_short"), *(F.col(c).cast("double").alias(c) for c in ("volume_min", "stop_ticks", "target_ticks")))
    every = trials.agg(F.sort_array(F.collect_list(each))).scalar()
    rows = cross_signals(bars).withColumn("trials", every).select("*", F.inline("trials")).drop("trials")
    rows = rows.withColumn("run_id", F.concat_ws("/", "symbol", "trial_id"))
    keep = ["run_id", "symbol", "bar_id", "ts_first_ns", "ts_last_ns", "open", "high", "low", "close", "crossed", "rsi", "volume_ratio", "long_short", "volume_min", "stop_ticks", "target_ticks"]
    return simulate(rows.select(*keep), indicator_cross, costs)


def figures(run: DataFrame, starting: float) -> DataFrame:
    return run_metrics(equity_of(run), trades_of(run), starting)
