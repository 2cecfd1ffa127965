"""Order-book state, snapshots and heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import tick_key

EMPTY = 1e-9


def book_states(events: DataFrame, tick: float) -> DataFrame:
    """Size at each level after each of its events (kinds add, reduce, set).

    A size is never below zero. Since the last set, it is the sum S of the changes less the least of 0 and of all sums
    so far: what a fold would have cut off at zero. So two window passes over a level's own rows replace the fold.
    """
    rows = events.withColumn("tick_key", tick_key(F.col("price"), tick))
    level = Window.partitionBy("symbol", "side", "tick_key")
    upto = level.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("kind") == "reduce", -F.col("size")).when(F.col("kind") == "set", F.greatest("size", F.lit(0.0))).otherwise(F.col("size"))
    rows = rows.withColumns({"change": change, "part": F.sum((F.col("kind") == "set").cast("int")).over(upto)})
    within = Window.partitionBy("symbol", "side", "tick_key", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("change").over(within))
    rows = rows.withColumn("level_size", F.col("total") - F.least(F.min("total").over(within), F.lit(0.0)))
    return rows.select("symbol", "side", "tick_key", "seq", "ts_ns", "level_size")


def close_events(bar: DataFrame, closing_trade_ends_bar: bool = False) -> DataFrame:
    """Adds ``close_seq``, the event whose arrival closes a bar: the next bar's first trade, or the bar's own last for
    range bars; null for the last bar of a tape of time bars."""
    if closing_trade_ends_bar:
        return bar.withColumn("close_seq", F.col("seq_last"))
    return bar.withColumn("close_seq", F.lead("seq_first").over(Window.partitionBy("symbol").orderBy("bar_id")))


def snapshots(bar: DataFrame, states: DataFrame, tick: float, reach: int = 200, width: int = 4096) -> DataFrame:
    """Levels at each bar's close within ``reach`` ticks of its price: symbol, bar_id, tick_key, bid_size, ask_size.

    A level holds from its event until its next. Those spans meet the closes by a range join with bins of ``width``
    events and up, so a level that stands for long gives a few rows only.
    """
    from .joins import binned_range_join

    by = Window.partitionBy("symbol", "side", "tick_key").orderBy("seq")
    end = F.max("seq").over(Window.partitionBy("symbol")) + 1
    spans = states.withColumns({"until": F.lead("seq").over(by), "end": end}).withColumn("until", F.coalesce("until", "end")).where(F.col("level_size") > EMPTY)
    closes = bar.select("symbol", "bar_id", "ts_last_ns", "close", "close_seq").join(states.groupBy("symbol").agg(F.max("seq").alias("__end")), "symbol")
    closes = closes.withColumn("at", F.least(F.coalesce("close_seq", F.col("__end") + 1) - 1, F.col("__end")))
    rows = binned_range_join(closes, spans.select("symbol", "side", "tick_key", "level_size", F.col("seq").alias("lo"), F.col("until").alias("hi")), ["symbol"], "at", "lo", "hi", width)
    rows = rows.where(F.abs(F.col("tick_key") - tick_key(F.col("close"), tick)) <= reach)
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("level_size")).otherwise(0.0))
    return rows.groupBy("symbol", "bar_id", "tick_key").agg(part(1).alias("bid_size"), part(-1).alias("ask_size"))


def sampled(states: DataFrame, interval_ns: int) -> DataFrame:
    """The last size of each level in each interval, with the interval's number ``bucket``."""
    rows = states.withColumn("bucket", F.floor(F.col("ts_ns") / interval_ns))
    return rows.groupBy("symbol", "bucket", "side", "tick_key").agg(F.max_by("level_size", "seq").alias("size"))


def heatmap(samples: DataFrame, bucket_ns: int, t0: int, t1: int, key_min: int, key_max: int, cols: int = 1200, rows: int = 600) -> DataFrame:
    """A raster of the largest size in each cell: symbol, col, row, value, intensity (0 to 255, by logarithm).

    A bucket fills the columns that it overlaps; the grid has 4,000 columns and 2,000 rows at most.
    """
    cols, rows = min(max(cols, 1), 4000), min(max(rows, 1), 2000)
    inside = samples.where((F.col("bucket") * bucket_ns < t1) & ((F.col("bucket") + 1) * bucket_ns > t0) & F.col("tick_key").between(key_min, key_max) & (F.col("size") > EMPTY))
    per_col, per_row = (t1 - t0) / cols, (key_max - key_min + 1) / rows
    first = F.greatest(F.floor((F.col("bucket") * bucket_ns - t0) / per_col), F.lit(0))
    stop = F.least(F.ceil(((F.col("bucket") + 1) * bucket_ns - t0) / per_col), F.lit(cols))
    cells = inside.withColumns({"col": F.explode(F.sequence(first, F.greatest(stop - 1, first))), "row": F.least(F.floor((F.col("tick_key") - key_min) / per_row), F.lit(rows - 1))})
    grid = cells.groupBy("symbol", "col", "row").agg(F.max("size").alias("value"))
    most = F.max("value").over(Window.partitionBy("symbol"))
    return grid.withColumn("intensity", F.round(255 * F.log1p("value") / F.log1p(most)).cast("int"))


def raster_bytes(grid: DataFrame, cols: int, rows: int) -> DataFrame:
    """The raster of each symbol as base64 of its bytes, row by row; the grid's size is bounded."""
    cells = grid.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct((F.col("row") * cols + F.col("col")).cast("int"), F.col("intensity")))).alias("m"))
    code = F.transform(F.sequence(F.lit(0), F.lit(cols * rows - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.element_at(F.col("m"), i), F.lit(0))), 2, "0"))
    return cells.select("symbol", F.base64(F.unhex(F.array_join(code, ""))).alias("raster"))


def quotes(trades: DataFrame, tick: float, interval_ns: int) -> DataFrame:
    """Best bid and ask of each interval, the last of those that trades imply: a buy lifts the ask, a sell hits the bid.
    Intervals that repeat the quote before are left out."""
    bid = F.when(F.col("side") > 0, F.col("price") - tick).otherwise(F.col("price"))
    ask = F.when(F.col("side") > 0, F.col("price")).otherwise(F.col("price") + tick)
    rows = trades.withColumn("bucket", F.floor(F.col("ts_ns") / interval_ns)).groupBy("symbol", "bucket").agg(F.max_by(F.struct(bid.alias("bid"), ask.alias("ask")), "seq").alias("q")).select("symbol", "bucket", "q.*")
    by = Window.partitionBy("symbol").orderBy("bucket")
    same = (F.col("bid") == F.lag("bid").over(by)) & (F.col("ask") == F.lag("ask").over(by))
    return rows.withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same")).drop("__same")


def column_traces(trades: DataFrame, quote: DataFrame, bucket_ns: int, t0: int, t1: int, cols: int) -> DataFrame:
    """Last price, bought and sold volume, and quotes carried forward for each column of a heatmap."""
    per = (t1 - t0) / cols
    at = F.floor((F.col("ts_ns") - t0) / per)
    rows = trades.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") < t1)).withColumn("col", at)
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    own = rows.groupBy("symbol", "col").agg(F.max_by("price", "seq").alias("last_price"), part(1).alias("buy_volume"), part(-1).alias("sell_volume"))
    q = quote.where(F.col("bucket") * bucket_ns < t1).withColumn("col", F.greatest(F.floor((F.col("bucket") * bucket_ns - t0) / per), F.lit(-1)))
    q = q.groupBy("symbol", "col").agg(F.max_by(F.struct("bid", "ask"), "bucket").alias("q"))
    grid = trades.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(-1), F.lit(cols - 1))).alias("col"))
    by = Window.partitionBy("symbol").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(own, ["symbol", "col"], "left").join(q, ["symbol", "col"], "left").withColumns({c: F.last(c, ignorenulls=True).over(by) for c in ("q", "last_price")})
    return full.where("col >= 0").select("symbol", "col", "last_price", F.coalesce("buy_volume", F.lit(0.0)).alias("buy_volume"), F.coalesce("sell_volume", F.lit(0.0)).alias("sell_volume"), "q.bid", "q.ask")


def exact_trades(trades: DataFrame, t0: int, t1: int, most: int = 200_000) -> tuple[DataFrame, int | None]:
    """Trades of a window, none if there are more than ``most``, and the time of the first after it."""
    inside = trades.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") <= t1))
    if inside.limit(most + 1).count() > most:
        inside = inside.limit(0)
    return inside, trades.where(F.col("ts_ns") > t1).agg(F.min("ts_ns")).first()[0]


def parse_heatmap_query(query: str) -> dict[str, float]:
    """t0, t1, pmin and pmax, which must be given, and cols, rows and bucket with their defaults."""
    from urllib.parse import parse_qs

    given = {k: v[0] for k, v in parse_qs(query.lstrip("?")).items()}
    missing = [k for k in ("t0", "t1", "pmin", "pmax") if k not in given]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return {"t0": int(given["t0"]), "t1": int(given["t1"]), "pmin": float(given["pmin"]), "pmax": float(given["pmax"]), "cols": int(given.get("cols", 1200)), "rows": int(given.get("rows", 600)), "bucket_ns": max(1, int(given.get("bucket", 1_000_000_000)))}
