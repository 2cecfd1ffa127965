"""Trade-flow features of each bar, from it and the past alone; a missing value is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.market_time import eastern_day, eastern_minute

from .indicators import by_bar, diagonal_imbalances, last, prior, stacks, true_range

TINY = 1e-9
#: Columns whose past-only scores are kept, and the names of the scores.
SCORED = {"delta": "delta_zscore", "volume": "volume_zscore", "trade_rate": "trade_rate_zscore", "bar_move_ticks": "bar_move_zscore", "delta_efficiency": "delta_efficiency_zscore", "absolute_delta_efficiency": "absolute_delta_efficiency_zscore"}


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol", "day").orderBy("bar_id")


def base(bar: DataFrame, tick: float) -> DataFrame:
    """Sides of the volume, rates, moves in ticks, and what a unit of delta moved."""
    seconds = F.greatest((F.col("ts_last_ns") - F.col("ts_first_ns")) / 1e9, F.lit(1e-3))
    clip = lambda x: F.greatest(x, F.lit(0.0))
    bar = bar.withColumns({
        "buy_volume": clip((F.col("volume") + F.col("delta")) / 2), "sell_volume": clip((F.col("volume") - F.col("delta")) / 2),
        "delta_ratio": F.col("delta") / F.greatest("volume", F.lit(TINY)), "trade_rate": F.col("trades") / seconds, "average_trade_size": F.col("volume") / F.greatest(F.col("trades"), F.lit(1)),
        "bar_move_ticks": (F.col("close") - F.col("open")) / tick, "bar_range_ticks": (F.col("high") - F.col("low")) / tick,
        "close_location": (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(tick)),
    })
    unit = F.greatest(F.abs("delta"), F.lit(1.0))
    return bar.withColumns({"delta_efficiency": F.col("bar_move_ticks") / unit, "absolute_delta_efficiency": F.abs("bar_move_ticks") / unit})


def zscore(value: Column | str, n: int = 100, least: int = 30) -> Column:
    """Deviations from the mean of the n bars before; null with under ``least`` of them or without spread."""
    value = F.col(value) if isinstance(value, str) else value
    w = prior(n)
    sd = F.stddev_samp(value).over(w)
    return F.when((F.count(value).over(w) >= least) & (sd >= TINY), (value - F.avg(value).over(w)) / sd)


def scores(bar: DataFrame, n: int = 100, least: int = 30) -> DataFrame:
    return bar.withColumns({out: zscore(c, n, least) for c, out in SCORED.items()})


def with_day(bar: DataFrame) -> DataFrame:
    """Adds the Eastern day and minute of a bar's first trade."""
    return bar.withColumns({"day": eastern_day(F.col("ts_first_ns")), "time_of_day_minutes": eastern_minute(F.col("ts_first_ns"))})


def cumulative_delta(bar: DataFrame) -> DataFrame:
    """Delta added up since the day began, and its changes over bars of the day."""
    bar = bar.withColumn("cvd", F.sum("delta").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    change = lambda k: F.col("cvd") - F.lag("cvd", k).over(by_day())
    return bar.withColumns({"cvd_change_1": change(1), "cvd_change_3": change(3), "cvd_change_5": change(5), "cvd_slope_5": change(5) / 5, "cvd_slope_10": change(10) / 10})


def locations(bar: DataFrame, levels: DataFrame, tick: float, recent: int = 20) -> DataFrame:
    """Distances from the recent range, from the day's extremes before, and from the day's volume-weighted price."""
    money = levels.groupBy("symbol", "bar_id").agg(F.sum(F.col("price") * (F.col("buy_vol") + F.col("sell_vol"))).alias("__pv"), F.sum(F.col("buy_vol") + F.col("sell_vol")).alias("__v"))
    bar = bar.join(money, ["symbol", "bar_id"], "left")
    bar = bar.withColumns({"__pv": F.coalesce("__pv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")), "__v": F.coalesce("__v", "volume")})
    today, upto = by_day().rowsBetween(Window.unboundedPreceding, -1), by_day().rowsBetween(Window.unboundedPreceding, 0)
    close, hi, lo = F.col("close"), F.max("high").over(prior(recent)), F.min("low").over(prior(recent))
    weight = F.sum("__v").over(upto)
    bar = bar.withColumns({
        "distance_to_recent_high_ticks": (hi - close) / tick, "distance_to_recent_low_ticks": (close - lo) / tick, "recent_range_position": (close - lo) / F.greatest(hi - lo, F.lit(tick)),
        "distance_to_session_high_ticks": (F.max("high").over(today) - close) / tick, "distance_to_session_low_ticks": (close - F.min("low").over(today)) / tick,
        "session_vwap": F.when(weight > TINY, F.sum("__pv").over(upto) / weight),
    })
    # greatest() skips nulls; a position needs a range.
    bar = bar.withColumn("recent_range_position", F.when(F.col("distance_to_recent_high_ticks").isNotNull(), F.col("recent_range_position")))
    return bar.withColumn("distance_to_vwap_ticks", (close - F.col("session_vwap")) / tick).drop("__pv", "__v")


def imbalance_counts(bar: DataFrame, levels: DataFrame, ratio: float = 3.0, min_volume: float = 5.0) -> DataFrame:
    """Numbers, largest ratios and longest runs of diagonal imbalances; zero without any."""
    flagged = diagonal_imbalances(levels, ratio, min_volume)
    count = flagged.groupBy("symbol", "bar_id").agg(
        F.count_if("buy").alias("positive_imbalance_count"), F.count_if("sell").alias("negative_imbalance_count"),
        F.max("buy_ratio").alias("max_positive_imbalance_ratio"), F.max("sell_ratio").alias("max_negative_imbalance_ratio"),
    )
    runs = stacks(flagged, 1).groupBy("symbol", "bar_id").agg(F.max(F.when(F.col("side") == "buy", F.col("levels"))).alias("positive_stack_max_layers"), F.max(F.when(F.col("side") == "sell", F.col("levels"))).alias("negative_stack_max_layers"))
    out = bar.join(count, ["symbol", "bar_id"], "left").join(runs, ["symbol", "bar_id"], "left")
    names = [c for c in [*count.columns, *runs.columns] if c not in ("symbol", "bar_id")]
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})


def volatility(bar: DataFrame, tick: float, atr_n: int = 20, vol_n: int = 20) -> DataFrame:
    """Average true range, a tick at least, and the deviation of moves between closes in ticks."""
    bar = bar.withColumns({"__tr": true_range(), "__move": (F.col("close") - F.lag("close").over(by_bar())) / tick})
    moves = F.count("__move").over(last(vol_n))
    return bar.withColumns({"atr": F.greatest(F.avg("__tr").over(last(atr_n)), F.lit(tick)), "realized_volatility": F.when(moves >= 2, F.stddev_samp("__move").over(last(vol_n)))}).drop("__tr", "__move")


def numbered_trades(trades: DataFrame, block: int = 1 << 16) -> DataFrame:
    """symbol, bar_id, size and ``i``, the trade's place among its symbol's, from 1.

    Trades are numbered within blocks of ``block`` values of ``seq``; only the blocks' counts go through a window of the
    whole symbol.
    """
    rows = trades.select("symbol", "bar_id", "size", "seq", F.floor(F.col("seq") / block).alias("__block"))
    counts = rows.groupBy("symbol", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("symbol", "__block").orderBy("seq"))
    placed = rows.withColumn("__k", within).join(counts.select("symbol", "__block", before.alias("__before")), ["symbol", "__block"])
    return placed.select("symbol", "bar_id", "size", (F.col("__before") + F.col("__k")).alias("i"))


def large_trades(bar: DataFrame, trades: DataFrame, n: int = 2000, p: float = 0.95, floor: float = 10.0, piece: int = 512) -> DataFrame:
    """Volume of trades of a bar no smaller than a percentile of the n trades before the bar.

    ``trades`` have ``bar_id``. Sizes are counted in pieces of ``piece`` trades and whole numbers, so a bar joins the
    few pieces that its n trades touch, not the trades; only the pieces at the ends give single trades.
    """
    numbered = numbered_trades(trades)
    first = numbered.groupBy("symbol", "bar_id").agg(F.min("i").alias("to"))
    spans = first.withColumns({"from": F.greatest(F.col("to") - n, F.lit(1)), "piece": F.explode(F.sequence(F.floor(F.greatest(F.col("to") - n, F.lit(1)) / piece), F.floor((F.col("to") - 1) / piece)))})
    kept = numbered.withColumn("piece", F.floor(F.col("i") / piece))
    packed = kept.groupBy("symbol", "piece").agg(F.collect_list(F.struct("i", "size")).alias("s"))
    inside = spans.join(packed, ["symbol", "piece"]).select("symbol", "bar_id", F.transform(F.filter("s", lambda x: (x["i"] >= F.col("from")) & (x["i"] < F.col("to"))), lambda x: x["size"]).alias("s"))
    past = inside.groupBy("symbol", "bar_id").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    rank = F.get("s", F.least(F.floor(F.size("s") * p), F.size("s") - 1).cast("int"))
    threshold = past.select("symbol", "bar_id", F.greatest(F.round(rank), F.lit(floor)).alias("large_trade_threshold"))
    own = trades.join(threshold, ["symbol", "bar_id"], "left").withColumn("large_trade_threshold", F.coalesce("large_trade_threshold", F.lit(floor)))
    big = own.groupBy("symbol", "bar_id").agg(F.first("large_trade_threshold").alias("large_trade_threshold"), F.sum(F.when(F.col("size") >= F.col("large_trade_threshold"), F.col("size")).otherwise(0.0)).alias("large_trade_volume"))
    return bar.join(big, ["symbol", "bar_id"], "left").withColumn("large_trade_ratio", F.col("large_trade_volume") / F.greatest("volume", F.lit(TINY)))


def trade_flow(bar: DataFrame, levels: DataFrame, trades: DataFrame, tick: float, window: int = 100, least: int = 30) -> DataFrame:
    """All features of each bar."""
    rows = scores(base(with_day(bar), tick), window, least)
    rows = locations(cumulative_delta(rows), levels, tick)
    return large_trades(volatility(imbalance_counts(rows, levels), tick), trades)
