"""Footprint bars: prices, volumes and a price ladder of buying and selling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan

NS = 1_000_000_000


def tick_key(price: Column, tick: Column | float) -> Column:
    """Whole ticks, halves away from zero."""
    return F.round(price / tick).cast("long")


def time_bar_ids(trades: DataFrame, bar_secs: int = 300, ordered: bool = True) -> DataFrame:
    """Adds ``bar_id``. On a tape whose times never fall, it is the number of the time bucket; else a bar ends whenever
    the bucket differs from the trade before, and bars are numbered by their order."""
    bucket = F.expr(f"ts_ns div {NS} div {bar_secs}")
    if ordered:
        return trades.withColumn("bar_id", bucket)
    by = Window.partitionBy("symbol").orderBy("seq")
    new = F.coalesce((bucket != F.lag(bucket).over(by)).cast("long"), F.lit(0))
    return trades.withColumn("__new", new).withColumn("bar_id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


class _RangeBars:
    """Numbers the trades of one symbol: the trade that fills a bar's range is its last."""

    def __init__(self, span: float):
        self.span, self.count, self.high, self.low = span, 0, None, None

    def state(self):
        return self.high, self.low

    def restore(self, state):
        self.high, self.low = state

    def __call__(self, pdf, first):
        out, bar, high, low = [], self.count, self.high, self.low
        for price in pdf["price"].tolist():
            high = price if high is None or price > high else high
            low = price if low is None or price < low else low
            out.append(bar)
            if high - low >= self.span:
                bar, high, low = bar + 1, None, None
        self.count, self.high, self.low = bar, high, low
        return pdf.assign(bar_id=out)


def range_bar_ids(trades: DataFrame, range_ticks: int = 30, tick: float = 0.25, block: int | None = None) -> DataFrame:
    """Adds ``bar_id`` of bars that close when their range reaches a number of ticks.

    A bar begins where the one before ended, so blocks of a symbol's trades hand on their open bar (``scans.scan``):
    runs from different starts soon close a bar at the same trade, so a block seldom runs more than twice.
    """
    return scan(trades, "symbol", "seq", lambda: _RangeBars(range_ticks * tick), [("bar_id", "long")], block=block)


def with_contract_tick(tape: DataFrame, default: float = 0.25) -> DataFrame:
    """Adds ``tick``, as of each event: the last contract's before it."""
    by = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when((F.col("kind") == "contract") & (F.col("tick_size") > 0) & ~F.isnan("tick_size"), F.col("tick_size"))
    return tape.withColumn("tick", F.coalesce(F.last(known, ignorenulls=True).over(by), F.lit(default)))


def bars(trades: DataFrame) -> DataFrame:
    """One row for each symbol and bar_id: times, prices, volume, trades and delta. Open and close go by ``seq``."""
    signed = F.col("size") * F.col("side")
    return trades.groupBy("symbol", "bar_id").agg(
        F.min_by("ts_ns", "seq").alias("ts_first_ns"), F.max_by("ts_ns", "seq").alias("ts_last_ns"), F.min("seq").alias("seq_first"), F.max("seq").alias("seq_last"),
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"), F.sum(signed).alias("delta"),
    )


def ladder(trades: DataFrame, tick: float) -> DataFrame:
    """Volume bought and sold at each tick of each bar; a level has the price of its first trade."""
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    keyed = trades.withColumn("tick_key", tick_key(F.col("price"), tick))
    return keyed.groupBy("symbol", "bar_id", "tick_key").agg(F.min_by("price", "seq").alias("price"), part(1).alias("buy_vol"), part(-1).alias("sell_vol"))


def point_of_control(levels: DataFrame) -> DataFrame:
    """The price with the most volume of each bar, the lowest of such."""
    best = F.max_by("price", F.struct(F.col("buy_vol") + F.col("sell_vol"), -F.col("tick_key")))
    return levels.groupBy("symbol", "bar_id").agg(best.alias("poc"))


def with_poc(bar: DataFrame, levels: DataFrame) -> DataFrame:
    return bar.join(point_of_control(levels), ["symbol", "bar_id"], "left").withColumn("poc", F.coalesce("poc", "close"))


def volume_profile(levels: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Ladders of bars ``first`` to ``last`` added up by tick; the bounds reach the scan."""
    if first is not None:
        levels = levels.where(F.col("bar_id") >= first)
    if last is not None:
        levels = levels.where(F.col("bar_id") <= last)
    return levels.groupBy("symbol", "tick_key").agg(F.sum("buy_vol").alias("buy_vol"), F.sum("sell_vol").alias("sell_vol"))


def ladder_window(levels: DataFrame, first: int, stop: int, most: int = 2000) -> DataFrame:
    """Ladders of bars from ``first``, before ``stop``, as arrays by ascending price; ``most`` bars at most."""
    rows = levels.where((F.col("bar_id") >= first) & (F.col("bar_id") < min(stop, first + most)))
    return rows.groupBy("symbol", "bar_id").agg(F.sort_array(F.collect_list(F.struct("tick_key", "price", "buy_vol", "sell_vol"))).alias("levels"))


def page(rows: DataFrame, first: int = 0, count: int = 60_000) -> DataFrame:
    """Rows of ``count`` bars (1 to 200,000) from ``first`` on."""
    return rows.where((F.col("bar_id") >= first) & (F.col("bar_id") < first + min(max(count, 1), 200_000)))
