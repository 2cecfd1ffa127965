"""Labels from the bars that follow, and the dataset of candidate bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import by_bar
from .passage import first_passage

#: Dataset columns that are a feature times the direction.
SIGNED = {"signed_delta_zscore": "delta_zscore", "signed_delta_ratio": "delta_ratio", "signed_bar_move_ticks": "bar_move_ticks", "signed_bar_move_zscore": "bar_move_zscore", "signed_delta_efficiency": "delta_efficiency", "signed_cvd_change_3": "cvd_change_3", "signed_distance_to_vwap_ticks": "distance_to_vwap_ticks"}
FIELDS = ("open", "high", "low", "close", "volume", "trades", "delta")
FEATURES = (
    "buy_volume sell_volume delta_ratio trade_rate average_trade_size large_trade_volume large_trade_ratio delta_zscore volume_zscore trade_rate_zscore bar_move_ticks bar_range_ticks close_location "
    "bar_move_zscore delta_efficiency delta_efficiency_zscore absolute_delta_efficiency absolute_delta_efficiency_zscore cvd cvd_change_1 cvd_change_3 cvd_change_5 cvd_slope_5 cvd_slope_10 "
    "distance_to_vwap_ticks distance_to_recent_high_ticks distance_to_recent_low_ticks recent_range_position distance_to_session_high_ticks distance_to_session_low_ticks positive_imbalance_count "
    "negative_imbalance_count max_positive_imbalance_ratio max_negative_imbalance_ratio positive_stack_max_layers negative_stack_max_layers atr realized_volatility time_of_day_minutes"
).split()


def _following(n: int) -> Column:
    return F.collect_list(F.struct("high", "low")).over(by_bar().rowsBetween(1, n))


def _first(bars: Column, rule) -> Column:
    """What ``rule`` says of the first bar of which it says anything."""
    return F.get(F.filter(F.transform(bars, rule), lambda v: v.isNotNull()), F.lit(0))


def continuation(direction: Column, tick: float, target_ticks: float = 8, stop_ticks: float = 5, horizon: int = 5) -> Column:
    """1 if the target is met before the stop within the horizon, 0 if the stop is or both on one bar, else null."""
    up = direction >= 0
    target, stop = F.col("close") + direction * target_ticks * tick, F.col("close") - direction * stop_ticks * tick

    def rule(b):
        lost = F.when(up, b["low"] <= stop).otherwise(b["high"] >= stop)
        won = F.when(up, b["high"] >= target).otherwise(b["low"] <= target)
        return F.when(lost, 0).when(won, 1)

    return _first(_following(horizon), rule)


def failure(direction: Column, atr: Column, continue_atr: float = 1.0, reverse_atr: float = 1.0, horizon: int = 10, early: int = 3, early_share: float = 0.2) -> Column:
    """0 if price goes on by an average range first, or on the same bar; 1 if it turns by one first and had gone on by no
    more than a fifth of one in its first bars; else null."""
    up = direction >= 0
    ahead, back = F.col("close") + direction * continue_atr * atr, F.col("close") - direction * reverse_atr * atr

    def rule(b):
        on = F.when(up, b["high"] >= ahead).otherwise(b["low"] <= ahead)
        turned = F.when(up, b["low"] <= back).otherwise(b["high"] >= back)
        return F.when(on, 0).when(turned, 1)

    first = _first(_following(horizon), rule)
    gain = F.array_max(F.transform(_following(early), lambda b: F.when(up, b["high"] - F.col("close")).otherwise(F.col("close") - b["low"])))
    return F.when(first == 0, 0).when((first == 1) & (F.greatest(gain, F.lit(0.0)) <= early_share * atr), 1)


def _passing(bar: DataFrame, up: Column, ahead: Column, back: Column, horizon: int, block: int | None) -> DataFrame:
    """``bar`` with ``__on`` and ``__back``, whether its first bar beyond ``ahead`` or ``back`` is beyond each; null without one."""
    levels = bar.withColumns({"__up": up, "__ahead": ahead, "__stop": back})
    upward = F.col("__up")
    found = first_passage(levels, F.when(upward, F.col("__ahead")).otherwise(F.col("__stop")), F.when(upward, F.col("__stop")).otherwise(F.col("__ahead")), horizon, block)
    on = F.when(upward, F.col("passed_high") >= F.col("__ahead")).otherwise(F.col("passed_low") <= F.col("__ahead"))
    off = F.when(upward, F.col("passed_low") <= F.col("__stop")).otherwise(F.col("passed_high") >= F.col("__stop"))
    return found.withColumns({"__on": on, "__back": off}).drop("__ahead", "__stop", "place", "passed", "passed_high", "passed_low")


def with_continuation(bar: DataFrame, direction: Column, tick: float, target_ticks: float = 8, stop_ticks: float = 5, horizon: int = 5, block: int | None = None) -> DataFrame:
    """``bar`` with the label of ``continuation``, for a horizon of any length."""
    target, stop = F.col("close") + direction * target_ticks * tick, F.col("close") - direction * stop_ticks * tick
    rows = _passing(bar, direction >= 0, target, stop, horizon, block)
    return rows.withColumn("label", F.when(F.col("__back"), 0).when(F.col("__on"), 1)).drop("__up", "__on", "__back")


def with_failure(bar: DataFrame, direction: Column, atr: Column, continue_atr: float = 1.0, reverse_atr: float = 1.0, horizon: int = 10, early: int = 3, early_share: float = 0.2, block: int | None = None) -> DataFrame:
    """``bar`` with the label of ``failure``, for a horizon of any length."""
    ahead, back = F.col("close") + direction * continue_atr * atr, F.col("close") - direction * reverse_atr * atr
    soon = by_bar().rowsBetween(1, early)
    gain = F.when(direction >= 0, F.max("high").over(soon) - F.col("close")).otherwise(F.col("close") - F.min("low").over(soon))
    rows = _passing(bar.withColumns({"__gain": gain, "__atr": atr}), direction >= 0, ahead, back, horizon, block)
    label = F.when(F.col("__on"), 0).when(F.col("__back") & (F.greatest("__gain", F.lit(0.0)) <= early_share * F.col("__atr")), 1)
    return rows.withColumn("label", label).drop("__up", "__on", "__back", "__gain", "__atr")


def direction() -> Column:
    """The side that was the aggressor: the sign of the score of delta, up if it is nought."""
    return F.when(F.col("delta_zscore") < 0, -1).otherwise(1)


def dataset(features: DataFrame, tick: float, kind: str = "continuation", threshold: float = 2.0, keep_unlabelled: bool = False) -> DataFrame:
    """Bars whose delta is unusual, with 57 features and a label of the given kind."""
    way = direction()
    label = continuation(way, tick) if kind == "continuation" else failure(way, F.col("atr"))
    rows = features.withColumn("label", label).where(F.abs("delta_zscore") >= threshold).withColumn("dir", way)
    if kind != "continuation":
        rows = rows.where("atr > 0")
    if not keep_unlabelled:
        rows = rows.where("label is not null")
    flip = lambda c: F.when(F.col("dir") >= 0, F.col(c)).otherwise(1 - F.col(c))
    signed = {k: F.col("dir") * F.col(v) for k, v in SIGNED.items()}
    signed |= {"signed_close_location": flip("close_location"), "signed_range_position": flip("recent_range_position"), "signed_distance_to_range_edge_ticks": F.when(F.col("dir") >= 0, F.col("distance_to_recent_high_ticks")).otherwise(F.col("distance_to_recent_low_ticks"))}
    double = lambda c: F.col(c).cast("double").alias(c)
    return rows.select("symbol", "bar_id", "ts_first_ns", "dir", *(double(c) for c in FIELDS), F.abs("delta").alias("delta_abs"), *(double(c) for c in FEATURES), *(v.cast("double").alias(k) for k, v in signed.items()), F.col("label").cast("int").alias("label"))
