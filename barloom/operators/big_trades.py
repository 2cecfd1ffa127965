"""Trades, and runs of trades of one side, that are large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import tick_key
from .indicators import mean_and_deviations


def dispatched(trades: DataFrame, closing_in_next: bool = False) -> DataFrame:
    """Trades by the bar whose indicators see them. With bars that end inside a trade (range bars), the closing trade is
    seen after its bar was done, so in the next; one without a next bar is not seen."""
    if not closing_in_next:
        return trades
    by = Window.partitionBy("symbol").orderBy("seq")
    after = F.lead("bar_id").over(by)
    closing = F.coalesce(after != F.col("bar_id"), F.lit(False))
    return trades.withColumn("bar_id", F.when(closing, after).otherwise(F.col("bar_id")))


def candidates(trades: DataFrame, cumulative: bool = False) -> DataFrame:
    """Single trades, or runs of trades of the same side within a bar: symbol, bar_id, side, run, total, and rows."""
    if not cumulative:
        return trades.select("symbol", "bar_id", "side", "price", "size", "seq", F.col("seq").alias("run"), F.col("size").alias("total"))
    by = Window.partitionBy("symbol", "bar_id").orderBy("seq")
    turn = F.coalesce((F.col("side") != F.lag("side").over(by)).cast("long"), F.lit(0))
    rows = trades.withColumn("__turn", turn).withColumn("run", F.sum("__turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("symbol", "bar_id", "side", "price", "size", "seq", "run", F.sum("size").over(Window.partitionBy("symbol", "bar_id", "run")).alias("total"))


def thresholds(found: DataFrame, adaptive: bool = False, low: float = 25.0, high: float = 500.0, lookback: int = 20, k: float = 1.0) -> DataFrame:
    """Threshold of each bar that has trades: ``low``, or the mean and k deviations of the largest of the bars before."""
    most = found.groupBy("symbol", "bar_id").agg(F.max("total").alias("most"))
    if not adaptive:
        return most.select("symbol", "bar_id", F.lit(low).alias("threshold"))
    w = Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(-lookback, -1)
    value = mean_and_deviations(F.col("most"), w, k)
    return most.where("most > 0").select("symbol", "bar_id", F.coalesce(F.least(F.greatest(value, F.lit(low)), F.lit(high)), F.lit(low)).alias("threshold"))


def big_levels(trades: DataFrame, tick: float, cumulative: bool = False, **limits) -> DataFrame:
    """Large volume by tick and side (symbol, bar_id, side, tick_key, price, size, runs), as accepted runs give it."""
    found = candidates(trades, cumulative)
    kept = found.join(thresholds(found, **limits), ["symbol", "bar_id"]).where(F.col("total") >= F.col("threshold"))
    keyed = kept.withColumn("tick_key", tick_key(F.col("price"), tick))
    return keyed.groupBy("symbol", "bar_id", "side", "tick_key").agg(F.min_by("price", "seq").alias("price"), F.sum("size").alias("size"), F.count_distinct("run").alias("runs"))


def big_totals(trades: DataFrame, cumulative: bool = False, **limits) -> DataFrame:
    """Large volume bought and sold in each bar that has any, and how many trades or runs it was."""
    found = candidates(trades, cumulative)
    kept = found.join(thresholds(found, **limits), ["symbol", "bar_id"]).where(F.col("total") >= F.col("threshold"))
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    return kept.groupBy("symbol", "bar_id").agg(part(1).alias("buy_size"), part(-1).alias("sell_size"), F.count_distinct("side", "run").alias("big_count"))


def edge_sizes(big: DataFrame, bar: DataFrame, band: float) -> DataFrame:
    """The largest size within ``band`` of a bar's high (bought) and low (sold); of equal ones the highest price."""
    rows = big.join(bar.select("symbol", "bar_id", "high", "low"), ["symbol", "bar_id"])
    top, bottom = (F.col("side") == 1) & (F.col("price") >= F.col("high") - band), (F.col("side") == -1) & (F.col("price") <= F.col("low") + band)
    best = lambda c: F.max_by(F.struct("price", "size"), F.when(c, F.struct("size", "tick_key")))
    return rows.groupBy("symbol", "bar_id").agg(best(top).alias("buy_edge"), best(bottom).alias("sell_edge"))


def top_markers(big: DataFrame, n: int = 8) -> DataFrame:
    by = Window.partitionBy("symbol", "bar_id", "side").orderBy(F.desc("size"), "tick_key")
    return big.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
