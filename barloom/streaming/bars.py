"""Bars from a stream of trades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded, time_of

BAR = "symbol string, bar_id long, ts_first_ns long, ts_last_ns long, open double, high double, low double, close double, volume double, trades long, delta double"


def _figures() -> list:
    signed = F.col("size") * F.col("side")
    return [
        F.min_by("ts_ns", "seq").alias("ts_first_ns"), F.max_by("ts_ns", "seq").alias("ts_last_ns"), F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"), F.sum(signed).alias("delta"),
    ]


def stream_time_bars(trades: DataFrame, bar_secs: int, late: str = "10 minutes") -> DataFrame:
    """Time bars of a stream (symbol, seq, ts_ns, price, size, side), each emitted when the watermark passes its end.

    Trades later than ``late`` behind the newest are left out; the batch operator has no such rule.
    """
    rows = trades.withColumn("ts", time_of()).withWatermark("ts", late)
    by = rows.groupBy("symbol", F.window("ts", f"{bar_secs} seconds"))
    return by.agg(*_figures()).select("symbol", F.expr(f"unix_seconds(window.start) div {bar_secs}").alias("bar_id"), *[c.split()[0] for c in BAR.split(", ")[2:]])


def stream_sliding_bars(trades: DataFrame, bar_secs: int, slide_secs: int, late: str = "10 minutes") -> DataFrame:
    """Bars of ``bar_secs`` that begin every ``slide_secs``, so each trade is in several; ``bar_id`` numbers their beginnings."""
    rows = trades.withColumn("ts", time_of()).withWatermark("ts", late)
    by = rows.groupBy("symbol", F.window("ts", f"{bar_secs} seconds", f"{slide_secs} seconds"))
    return by.agg(*_figures()).select("symbol", F.expr(f"unix_seconds(window.start) div {slide_secs}").alias("bar_id"), *[c.split()[0] for c in BAR.split(", ")[2:]])


def stream_session_bars(trades: DataFrame, gap_secs: int, late: str = "10 minutes") -> DataFrame:
    """A bar for each run of trades without a gap of ``gap_secs``, emitted when the watermark is a gap past its end;
    ``bar_id`` is the second in which it begins. Runs that a trade in between joins are merged in the state."""
    rows = trades.withColumn("ts", time_of()).withWatermark("ts", late)
    by = rows.groupBy("symbol", F.session_window("ts", f"{gap_secs} seconds").alias("window"))
    return by.agg(*_figures()).select("symbol", F.expr("unix_seconds(window.start)").alias("bar_id"), *[c.split()[0] for c in BAR.split(", ")[2:]])


class _RangeBar:
    """The open bar of a symbol; a trade that fills its range closes it."""

    def __init__(self, span: float):
        self.span, self.number, self.bar = span, 0, None

    def __call__(self, key, trades):
        done = []
        for row in trades.itertuples(index=False):
            b = self.bar or [row.ts_ns, row.ts_ns, row.price, row.price, row.price, row.price, 0.0, 0, 0.0]
            b[1], b[3], b[4], b[5] = row.ts_ns, max(b[3], row.price), min(b[4], row.price), row.price
            b[6], b[7], b[8] = b[6] + row.size, b[7] + 1, b[8] + row.size * row.side
            self.bar = b
            if b[3] - b[4] >= self.span:
                done.append((key[0], self.number, *b))
                self.number, self.bar = self.number + 1, None
        return pd.DataFrame(done, columns=[c.split()[0] for c in BAR.split(", ")])


def stream_range_bars(trades: DataFrame, range_ticks: int, tick: float, late: str | None = None) -> DataFrame:
    """Range bars of a stream, each emitted with the trade that fills its range; the open bar is the state of a symbol.
    ``late`` orders trades by their times (``folds.folded``)."""
    return folded(trades, ["symbol"], "seq", lambda: _RangeBar(range_ticks * tick), BAR, time_of(), late)
