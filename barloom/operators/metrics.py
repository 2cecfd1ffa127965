"""Figures of each run from its trades and its equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_metrics(equity: DataFrame, trades: DataFrame, starting: float = 100_000.0) -> DataFrame:
    """One row a run. A trade that neither wins nor loses is a win; the drawdown's share is of the last peak."""
    order = ["bar_id", "forced"]
    by = Window.partitionBy("run_id").orderBy(*order)
    before = F.coalesce(F.lag("equity").over(by), F.lit(starting))
    peak = F.greatest(F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(starting))
    points = equity.withColumns({"r": F.when(before != 0, (F.col("equity") - before) / before), "peak": peak})
    curve = points.groupBy("run_id").agg(
        F.max_by("equity", F.struct(*order)).alias("ending_equity"), F.min(F.col("equity") - F.col("peak")).alias("low"), F.max("peak").alias("top"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"), F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)).alias("down"),
    )
    win = F.col("pnl") >= 0
    made = trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.sum(F.when(win, F.col("pnl")).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(~win, -F.col("pnl")).otherwise(0.0)).alias("gross_loss"),
        F.avg(F.greatest("max_adverse_excursion", F.lit(0.0))).alias("avg_mae"), F.avg(F.greatest("max_adverse_ticks", F.lit(0.0))).alias("avg_mae_ticks"),
    )
    rows = curve.join(made, "run_id", "left").fillna(0, ["trades", "wins", "gross_profit", "gross_loss", "avg_mae", "avg_mae_ticks"])
    net, losses = F.col("ending_equity") - starting, F.col("trades") - F.col("wins")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    loss = F.col("gross_loss")
    downside = F.sqrt(F.col("down") / F.col("n"))
    return rows.select(
        "run_id", "ending_equity", net.alias("net_pnl"), (100 * net / starting if starting else F.lit(0.0)).alias("return_pct"), "trades", "wins", losses.alias("losses"), part(F.col("wins"), F.col("trades")).alias("win_rate"),
        F.when(loss > 0, F.col("gross_profit") / loss).when(F.col("gross_profit") > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        part(F.col("gross_profit"), F.col("wins")).alias("avg_win"), (-part(loss, losses)).alias("avg_loss"), part(net, F.col("trades")).alias("expectancy"), "avg_mae", "avg_mae_ticks",
        F.col("low").alias("max_drawdown"), part(100 * F.col("low"), F.col("top")).alias("max_drawdown_pct"),
        F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * F.sqrt("n")).otherwise(0.0).alias("sharpe"),
        F.when((F.col("n") >= 2) & (downside > 0), F.col("mean") / downside * F.sqrt("n")).otherwise(0.0).alias("sortino"),
    )


def experiment_tree(runs: DataFrame, params: list[str]) -> DataFrame:
    """For each value of each parameter: runs, the best net result and the run that has it. Parameters with fewer values
    come first, as they branch first."""
    parts = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params))
    rows = runs.select("run_id", "net_pnl", F.explode(parts).alias("p"))
    each = rows.groupBy("p.param", "p.value").agg(F.count(F.lit(1)).alias("runs"), F.max("net_pnl").alias("best_net_pnl"), F.max_by("run_id", F.struct("net_pnl", "run_id")).alias("best_run"))
    return each.withColumn("values", F.count(F.lit(1)).over(Window.partitionBy("param"))).select("param", "value", "values", "runs", "best_net_pnl", "best_run")


def shared_params(runs: DataFrame, params: list[str]) -> DataFrame:
    """Parameters that have one value in all runs, and that value."""
    parts = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params))
    rows = runs.select(F.explode(parts).alias("p"))
    each = rows.groupBy("p.param").agg(F.count_distinct("p.value").alias("k"), F.count("p.value").alias("with"), F.count(F.lit(1)).alias("n"), F.first("p.value").alias("value"))
    return each.where("k = 1 and with = n").select("param", "value")


def matching_runs(runs: DataFrame, label: str = "", least_trades: int = 0) -> DataFrame:
    return runs.where(F.lower("label").contains(label.lower()) & (F.col("trades") >= least_trades))
