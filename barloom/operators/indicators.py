"""Indicators of each bar from it and the bars before."""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scans import affine_scan, scan

def by_bar() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar_id")


def last(n: int) -> WindowSpec:
    """The bar and the n - 1 before."""
    return by_bar().rowsBetween(-(n - 1), 0)


def prior(n: int) -> WindowSpec:
    """The n bars before."""
    return by_bar().rowsBetween(-n, -1)


def technical(bar: DataFrame, fast: int = 12, slow: int = 26, rsi_n: int = 14, bb_n: int = 20, bb_k: float = 2.0, volume_n: int = 20) -> DataFrame:
    """Moving averages, relative strength, Bollinger bands, and tags. Windows grow until they are full.

    Relative strength is of simple sums of the last changes, 50 until there are enough and 100 without losses.
    """
    slow = max(slow, fast + 1)
    close, change = F.col("close"), F.col("close") - F.lag("close").over(by_bar())
    bar = bar.withColumns({"__up": F.when(change >= 0, change).otherwise(0.0), "__down": F.when(change < 0, -change).otherwise(0.0), "__n": F.row_number().over(by_bar())})
    gain, loss = F.sum("__up").over(last(rsi_n)), F.sum("__down").over(last(rsi_n))
    rsi = F.when(F.col("__n") <= rsi_n, 50.0).when(loss <= 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    mid, sd = F.avg(close).over(last(bb_n)), F.stddev_pop(close).over(last(bb_n))
    bar = bar.withColumns({
        "sma_fast": F.avg(close).over(last(fast)), "sma_slow": F.avg(close).over(last(slow)), "volume_sma": F.avg("volume").over(last(volume_n)), "delta_sma": F.avg("delta").over(last(volume_n)),
        "rsi": rsi, "bb_mid": mid, "bb_upper": mid + bb_k * sd, "bb_lower": mid - bb_k * sd, "bb_width": F.when(F.abs(mid) < 1e-12, 0.0).otherwise(2 * bb_k * sd / mid),
    })
    trend = F.when(F.col("sma_fast") > F.col("sma_slow"), "up").when(F.col("sma_fast") < F.col("sma_slow"), "down").otherwise("flat")
    state = F.when(F.col("rsi") >= 70, "overbought").when(F.col("rsi") <= 30, "oversold").otherwise("neutral")
    return bar.withColumns({"trend": trend, "rsi_state": state}).drop("__up", "__down", "__n")


def ema(bar: DataFrame, fast: int = 12, slow: int = 26, block: int | None = None) -> DataFrame:
    """Exponential averages, begun with the first close; blocks of a symbol's bars are affine maps that are composed."""
    return affine_scan(bar, "symbol", "bar_id", "close", {"ema_fast": 2 / (fast + 1), "ema_slow": 2 / (slow + 1)}, block)


def true_range() -> Column:
    before = F.lag("close").over(by_bar())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def regime(bar: DataFrame, n: int = 30) -> DataFrame:
    """Efficiency ratio and choppiness of the last n bars, null until a bar before them is there."""
    from math import log10

    bar = bar.withColumns({"__tr": true_range(), "__move": F.abs(F.col("close") - F.lag("close").over(by_bar())), "__n": F.row_number().over(by_bar()), "__from": F.lag("close", n).over(by_bar())})
    path = F.sum("__move").over(last(n))
    clamp = lambda x, hi: F.least(F.greatest(x, F.lit(0.0)), F.lit(hi))
    ratio = F.when(path > 0, clamp(F.abs(F.col("close") - F.col("__from")) / path, 1.0)).otherwise(0.0)
    span, total = F.max("high").over(last(n)) - F.min("low").over(last(n)), F.sum("__tr").over(last(n))
    chop = F.when((span > 0) & (total > 0), clamp(100 * F.log10(total / span) / log10(n), 100.0)).otherwise(100.0)
    full = F.col("__n") > n
    return bar.withColumns({"efficiency_ratio": F.when(full, ratio), "choppiness": F.when(full, chop)}).drop("__tr", "__move", "__n", "__from")


def mean_and_deviations(value: Column, window: WindowSpec, k: float) -> Column:
    count = F.count(value).over(window)
    mean = F.sum(value).over(window) / count
    return mean + k * F.sqrt(F.greatest(F.sum(value * value).over(window) / count - mean * mean, F.lit(0.0)))


def adaptive_threshold(value: Column, n: int, k: float, low: float, high: float) -> Column:
    """Mean and k deviations of the n bars before, between bounds; the lower bound without any.

    From sums and sums of squares, which are exact for whole sizes, so that equal bars give equal thresholds.
    """
    t = mean_and_deviations(value, prior(n), k)
    return F.coalesce(F.least(F.greatest(t, F.lit(low)), F.lit(high)), F.lit(low))


def edge_nodes(bar: DataFrame, levels: DataFrame, band: float) -> DataFrame:
    """The level with the most net buying within ``band`` of the high, the highest of such, and with the most net
    selling within it of the low, the lowest of such; without such levels null."""
    net = F.col("buy_vol") - F.col("sell_vol")
    rows = levels.join(bar.select("symbol", "bar_id", "high", "low"), ["symbol", "bar_id"])
    top = (F.col("price") >= F.col("high") - band) & (net > 0)
    bottom = (F.col("price") <= F.col("low") + band) & (net < 0)
    return rows.groupBy("symbol", "bar_id").agg(
        F.max(F.when(top, net)).alias("buy_node"), F.max_by("price", F.when(top, F.struct(net, F.col("price")))).alias("buy_node_price"),
        F.min(F.when(bottom, net)).alias("sell_node"), F.min_by("price", F.when(bottom, F.struct(net, F.col("price")))).alias("sell_node_price"),
    )


def adaptive_imbalance(bar: DataFrame, levels: DataFrame, band: float, lookback: int = 20, sensitivity: float = 1.0, node: tuple[float, float] = (90.0, 1200.0), delta: tuple[float, float] = (100.0, 2000.0)) -> DataFrame:
    """Flags bars whose edge node and own delta reach thresholds that follow the bars before. Absent edges are 0."""
    rows = bar.join(edge_nodes(bar, levels, band), ["symbol", "bar_id"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("buy_node", "sell_node", "buy_node_price", "sell_node_price")})
    rows = rows.withColumns({"__node": F.greatest(F.abs("buy_node"), F.abs("sell_node")), "__delta": F.abs("delta")})
    rows = rows.withColumns({"node_threshold": adaptive_threshold(F.col("__node"), lookback, sensitivity, *node), "bar_threshold": adaptive_threshold(F.col("__delta"), lookback, sensitivity, *delta)})
    loud = F.abs("delta") >= F.col("bar_threshold")
    flag = lambda c: (loud & (F.abs(c) >= F.col("node_threshold"))).cast("int")
    return rows.withColumns({"buy_flag": flag("buy_node"), "sell_flag": flag("sell_node")}).drop("__node", "__delta")


def diagonal_imbalances(levels: DataFrame, ratio: float = 3.0, min_volume: float = 0.0) -> DataFrame:
    """Levels with ``buy`` and ``sell`` flags and ratios: buying against the selling one tick lower, selling against
    the buying one tick higher. The neighbour must be there and have volume."""
    by = Window.partitionBy("symbol", "bar_id").orderBy("tick_key")
    below = F.when(F.lag("tick_key").over(by) == F.col("tick_key") - 1, F.lag("sell_vol").over(by))
    above = F.when(F.lead("tick_key").over(by) == F.col("tick_key") + 1, F.lead("buy_vol").over(by))
    least = F.greatest(F.lit(min_volume), F.coalesce(F.col("volume_threshold"), F.lit(0.0))) if "volume_threshold" in levels.columns else F.lit(min_volume)
    flag = lambda v, other: F.coalesce((other > 0) & (v >= ratio * other) & (v >= least), F.lit(False))
    rows = levels.withColumns({"__below": below, "__above": above})
    buy, sell = flag(F.col("buy_vol"), F.col("__below")), flag(F.col("sell_vol"), F.col("__above"))
    return rows.withColumns({
        "buy": buy, "sell": sell, "buy_ratio": F.when(buy, F.col("buy_vol") / F.col("__below")), "sell_ratio": F.when(sell, F.col("sell_vol") / F.col("__above")),
    }).drop("__below", "__above")


def stacks(flagged: DataFrame, min_stack: int = 3) -> DataFrame:
    """Runs of neighbouring flagged levels (symbol, bar_id, side, low, high, levels, volume, ratio)."""
    one = lambda side, v: flagged.where(side).select("symbol", "bar_id", F.lit(side).alias("side"), "tick_key", "price", F.col(v).alias("volume"), F.col(f"{side}_ratio").alias("ratio"))
    rows = one("buy", "buy_vol").unionAll(one("sell", "sell_vol"))
    by = Window.partitionBy("symbol", "bar_id", "side").orderBy("tick_key")
    runs = rows.withColumn("run", F.col("tick_key") - F.row_number().over(by)).groupBy("symbol", "bar_id", "side", "run").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("levels"), F.sum("volume").alias("volume"), F.max("ratio").alias("ratio"),
    )
    return runs.where(F.col("levels") >= min_stack).drop("run")


def strongest_stack(found: DataFrame) -> DataFrame:
    """The stack with the most volume of each bar and side, the highest of such."""
    best = F.max_by(F.struct("low", "high", "levels", "volume", "ratio"), F.struct("volume", "low"))
    return found.groupBy("symbol", "bar_id", "side").agg(best.alias("s")).select("symbol", "bar_id", "side", "s.*")


def top_stacks(found: DataFrame, n: int = 2) -> DataFrame:
    """The n largest of each bar and side, the lower price first of equal volumes."""
    by = Window.partitionBy("symbol", "bar_id", "side").orderBy(F.desc("volume"), "low")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


class _Percentile:
    """The percentile of whole-number volumes over the last bars, from a histogram that moves along."""

    def __init__(self, p: float, lookback: int, floor: float, cap: int):
        self.p, self.lookback, self.floor, self.count = p, lookback, floor, 0
        self.counts, self.total, self.held = np.zeros(cap + 1, np.int64), 0, deque()

    def state(self):
        return tuple((b.tolist(), n.tolist()) for b, n in self.held)

    def restore(self, state):
        for b, n in state:
            own = np.asarray(b, np.int64), np.asarray(n, np.int64)
            self._add(own, 1)
            self.held.append(own)

    def __call__(self, pdf, first):
        out = []
        for buckets, numbers in zip(pdf["buckets"], pdf["numbers"], strict=True):
            found = self.floor
            if self.total:
                found = float(np.searchsorted(np.cumsum(self.counts), np.floor(self.total * self.p), "right"))
            out.append(max(found, self.floor))
            own = np.asarray(buckets, np.int64), np.asarray(numbers, np.int64)
            self._add(own, 1)
            self.held.append(own)
            if len(self.held) > self.lookback:
                self._add(self.held.popleft(), -1)
        return pdf.assign(volume_threshold=out)

    def _add(self, own, sign: int) -> None:
        self.counts[own[0]] += sign * own[1]
        self.total += sign * int(own[1].sum())


def volume_thresholds(bar: DataFrame, levels: DataFrame, p: float = 0.7, lookback: int = 500, floor: float = 10.0, bucket_cap: int = 4095, block: int | None = None) -> DataFrame:
    """``volume_threshold`` of each bar: a percentile of the level volumes, by whole numbers, of the bars before.

    Volumes are counted by bar and bucket first, 4,096 buckets at most, so what moves and what a fold holds depends on
    bars, not on trades. What a block of bars hands on is the counts of its last ``lookback``.
    """
    both = levels.select("symbol", "bar_id", F.explode(F.array("buy_vol", "sell_vol")).alias("v")).where("v > 0")
    counts = both.groupBy("symbol", "bar_id", F.least(F.round("v"), F.lit(bucket_cap)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("symbol", "bar_id").agg(F.collect_list(F.struct("bucket", "n")).alias("h"))
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c.split(".")[1])
    rows = bar.select("symbol", "bar_id").join(counts, ["symbol", "bar_id"], "left").select("symbol", "bar_id", none("h.bucket", "int").alias("buckets"), none("h.n", "bigint").alias("numbers"))
    return scan(rows, "symbol", "bar_id", lambda: _Percentile(p, lookback, floor, bucket_cap), [("volume_threshold", "double")], ["symbol", "bar_id"], block)


class ZigZag:
    """Pivots of one symbol, each known at the bar that confirms it."""

    def __init__(self, reversal: float, min_leg: float, min_bars: int):
        self.reversal, self.min_leg, self.min_bars, self.count = reversal, min_leg, min_bars, 0
        self.way, self.peak, self.last, self.high, self.low = 0, None, None, None, None

    def state(self):
        return self.way, self.peak, self.last, self.high, self.low

    def restore(self, state):
        self.way, self.peak, self.last, self.high, self.low = state

    def step(self, bar: int, high: float, low: float):
        if self.way == 0:
            return self._begin(bar, high, low)
        up = self.way > 0
        if (high > self.peak[0]) if up else (low < self.peak[0]):
            self.peak = (high if up else low, bar)
        if not (low <= self.peak[0] - self.reversal if up else high >= self.peak[0] + self.reversal):
            return None
        pivot = ("high" if up else "low", *self.peak)
        self.way, self.peak = -self.way, (low if up else high, bar)
        major = self.last is None or (abs(pivot[1] - self.last[1]) + sys.float_info.epsilon >= self.min_leg and max(pivot[2] - self.last[2], 0) >= self.min_bars)
        if major and (self.last is None or self.last[0] != pivot[0]):
            self.last = pivot
            return pivot
        return None

    def _begin(self, bar, high, low):
        if self.high is None:
            self.high, self.low = (high, bar), (low, bar)
            return None
        self.high, self.low = max(self.high, (high, bar), key=lambda x: x[0]), min(self.low, (low, bar), key=lambda x: x[0])
        move = max(self.reversal, self.min_leg)
        for way, hit, pivot, peak in ((1, high >= self.low[0] + move, ("low", *self.low), high), (-1, low <= self.high[0] - move, ("high", *self.high), low)):
            if hit:
                self.way, self.peak, self.last = way, (peak, bar), pivot
                return pivot
        return None

    def __call__(self, pdf, first):
        pdf["bar_index"] = range(first, first + len(pdf))
        found = [self.step(b, h, lo) for b, h, lo in zip(pdf["bar_index"].tolist(), pdf["high"].tolist(), pdf["low"].tolist(), strict=True)]
        for k, name in enumerate(("pivot_kind", "pivot_price", "pivot_bar")):
            pdf[name] = [None if p is None else p[k] for p in found]
        pdf["pivot_bar"] = pdf["pivot_bar"].astype("Int64")
        return pdf


def zigzag(bar: DataFrame, reversal: float, min_leg: float = 0.0, min_leg_bars: int = 0, block: int | None = None) -> DataFrame:
    """Confirmed pivots: symbol, bar_index (of the confirming bar, from 0), pivot_kind, pivot_price, pivot_bar.

    Filters under zero count as zero, and a reversal under the least difference as that. Blocks of a symbol's bars hand on their open leg and last pivot (``scans.scan``).
    """
    filters = max(reversal, sys.float_info.epsilon), max(min_leg, 0.0), max(min_leg_bars, 0)
    adds = [("bar_index", "long"), ("pivot_kind", "string"), ("pivot_price", "double"), ("pivot_bar", "long")]
    found = scan(bar.select("symbol", "bar_id", "high", "low"), "symbol", "bar_id", lambda: ZigZag(*filters), adds, ["symbol"], block)
    return found.where("pivot_kind is not null")
