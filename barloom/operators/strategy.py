"""The moving-average cross strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .broker import Broker, Order


def cross_signals(bar: DataFrame) -> DataFrame:
    """Adds ``crossed`` (1 above, -1 below, else 0) of sma_fast over sma_slow, and ``volume_ok``'s ratio."""
    by = Window.partitionBy("symbol").orderBy("bar_id")
    fast, slow = F.lag("sma_fast").over(by), F.lag("sma_slow").over(by)
    up = (fast <= slow) & (F.col("sma_fast") > F.col("sma_slow"))
    down = (fast >= slow) & (F.col("sma_fast") < F.col("sma_slow"))
    crossed = F.when(up, 1).when(down, -1).otherwise(0)
    ratio = F.when(F.abs("volume_sma") < 1e-12, F.lit(float("inf"))).otherwise(F.col("volume") / F.col("volume_sma"))
    return bar.withColumns({"crossed": crossed, "volume_ratio": ratio})


def indicator_cross(first):
    """A strategy from a run's first row, whose columns long_short, volume_min, stop_ticks and target_ticks are its
    parameters. It goes long on a cross above, short on one below if it may, and leaves on the opposite cross or when
    the relative strength is spent."""

    def decide(bar, broker: Broker) -> list[Order]:
        side = broker.side
        if side > 0 and (bar.crossed < 0 or bar.rsi >= 75) or side < 0 and (bar.crossed > 0 or bar.rsi <= 25):
            return [Order(0, mode="flat")]
        if side or bar.volume_ratio < max(first.volume_min, 0.0):
            return []
        if bar.crossed > 0 and bar.rsi <= 70:
            return [Order(1, stop_ticks=first.stop_ticks, target_ticks=first.target_ticks)]
        if bar.crossed < 0 and bar.rsi >= 30 and first.long_short:
            return [Order(-1, stop_ticks=first.stop_ticks, target_ticks=first.target_ticks)]
        return []

    return decide
