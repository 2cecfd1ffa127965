"""Pivots, book levels and histories from streams, with a bounded state for each key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.bars import tick_key
from barloom.operators.indicators import ZigZag

from .folds import folded, time_of

PIVOT = "symbol string, bar_id long, bar_index long, pivot_kind string, pivot_price double, pivot_bar long"
LEVEL = "symbol string, side int, tick_key long, seq long, ts_ns long, level_size double"
HISTORY = "symbol string, bar_id long, closes array<double>"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Pivots:
    def __init__(self, *filters):
        self.at, self.fold = 0, ZigZag(*filters)

    def __call__(self, key, bars):
        done = []
        for bar in bars.itertuples(index=False):
            found = self.fold.step(self.at, bar.high, bar.low)
            if found:
                done.append((key[0], bar.bar_id, self.at, *found))
            self.at += 1
        return pd.DataFrame(done, columns=_columns(PIVOT))


def stream_zigzag(bars: DataFrame, reversal: float, min_leg: float = 0.0, min_leg_bars: int = 0, ts_ns: str = "ts_last_ns", late: str | None = None) -> DataFrame:
    """Pivots of a stream of closed bars (symbol, bar_id, high, low), each with the bar that confirms it. The state of a
    symbol is the open leg. ``late`` orders bars by ``ts_ns`` (``folds.folded``)."""
    return folded(bars, ["symbol"], "bar_id", lambda: _Pivots(reversal, min_leg, min_leg_bars), PIVOT, time_of(ts_ns), late)


class _Level:
    def __init__(self):
        self.size = 0.0

    def __call__(self, key, events):
        done = []
        for e in events.itertuples(index=False):
            change = -e.size if e.kind == "reduce" else e.size
            self.size = max(change if e.kind == "set" else self.size + change, 0.0)
            done.append((*key, e.seq, e.ts_ns, self.size))
        return pd.DataFrame(done, columns=_columns(LEVEL))


def stream_book_states(events: DataFrame, tick: float, late: str | None = None) -> DataFrame:
    """Size at each level after each of its events, as the batch operator gives it; a level's size is its state. ``late``
    orders events by their times (``folds.folded``)."""
    keyed = events.withColumn("tick_key", tick_key(events["price"], tick))
    return folded(keyed, ["symbol", "side", "tick_key"], "seq", _Level, LEVEL, time_of(), late)


class _History:
    def __init__(self, n: int):
        self.n, self.held = n, []

    def __call__(self, key, bars):
        done = []
        for bar in bars.itertuples(index=False):
            self.held = [*self.held, bar.close][-self.n :]
            done.append((key[0], bar.bar_id, self.held))
        return pd.DataFrame(done, columns=_columns(HISTORY))


def stream_history(bars: DataFrame, n: int, ts_ns: str = "ts_last_ns", late: str | None = None) -> DataFrame:
    """Each closed bar (symbol, bar_id, close) of a stream with the closes of the last ``n`` bars up to it. ``late`` orders
    bars by ``ts_ns`` (``folds.folded``)."""
    return folded(bars, ["symbol"], "bar_id", lambda: _History(n), HISTORY, time_of(ts_ns), late)
