"""What is kept of a run besides its figures: visual output, samples of trades, JSON, and lists of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visual_series(points: DataFrame) -> DataFrame:
    """Points (run_id, id, bar_index, value, color) with each series' color: the first that is given, else empty."""
    by = Window.partitionBy("run_id", "id").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    color = F.first(F.when(F.col("color") != "", F.col("color")), ignorenulls=True).over(by)
    return points.withColumn("color", F.coalesce(color, F.lit("")))


def stack_plots(found: DataFrame) -> DataFrame:
    """Stacks of imbalances as ``plots`` of their bar, from low to high: a box over the stack's prices and a marker at its far end."""
    box = F.struct(F.lit("box").alias("kind"), "side", "low", "high", F.concat_ws(" ", F.lit("stack"), F.col("levels").cast("string")).alias("text"))
    end = F.when(F.col("side") == "buy", F.col("low")).otherwise(F.col("high"))
    marker = F.struct(F.lit("marker").alias("kind"), "side", end.alias("low"), end.alias("high"), F.col("volume").cast("string").alias("text"))
    each = found.select("symbol", "bar_id", F.explode(F.array(box, marker)).alias("p"))
    return each.groupBy("symbol", "bar_id").agg(F.sort_array(F.collect_list("p")).alias("plots"))


def with_outcome(trades: DataFrame, outcome: str = "all") -> DataFrame:
    """Trades (``pnl``) that won, lost, or all; one that did neither has won."""
    if outcome == "winners":
        return trades.where("pnl >= 0")
    return trades.where("pnl < 0") if outcome == "losers" else trades


def sampled_trades(trades: DataFrame, key: Column, n: int, seed: int, outcome: str = "all") -> DataFrame:
    """``n`` trades of an outcome, drawn by a digest of the seed and ``key``: the same at every partitioning."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return with_outcome(trades, outcome).orderBy(draw, key).limit(n)


def newest_first(sessions: DataFrame, at: str = "ts_ns") -> DataFrame:
    """Sessions by descending time, equal ones by id."""
    return sessions.orderBy(F.desc(at), "session_id")


def result_json(metrics: DataFrame, trades: DataFrame, equity: DataFrame) -> DataFrame:
    """One JSON text a run (run_id, json): ``metrics``, ``trades`` by their entry, ``equity`` with drawdowns by time.

    A run's text holds all of its trades and points, as a reader of one run needs them; figures of many runs are better
    read from the tables.
    """
    peak = F.max("equity").over(Window.partitionBy("run_id").orderBy("ts_ns", "bar_id").rowsBetween(Window.unboundedPreceding, 0))
    points = equity.withColumn("drawdown", F.least(F.col("equity") - peak, F.lit(0.0)))
    listed = lambda df, name, *first: df.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*first, *(c for c in df.columns if c not in (*first, "run_id"))))).alias(name))
    figures = metrics.select("run_id", F.struct(*(c for c in metrics.columns if c != "run_id")).alias("metrics"))
    rows = figures.join(listed(trades, "trades", "entry_ts_ns"), "run_id", "left").join(listed(points, "equity", "ts_ns"), "run_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("run_id", F.to_json(F.struct("metrics", none("trades"), none("equity"))).alias("json"))
