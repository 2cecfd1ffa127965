"""Joins of positions with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of one level in a bin of the next, and levels, of the range join.
FAN, LEVELS = 16, 8


def binned_range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Points (``at``) with the spans (``start`` <= at < ``stop``) of the same keys that hold them.

    Bins are ``width`` wide at the lowest level and FAN times as wide at each further one. A span is dealt to the bins
    that it touches at the first level at which they are FAN at most, and a point to its bin at every level that spans
    have, so the join is one on equal bins and a span of any length gives FAN rows at most. Empty spans meet nothing.
    """
    widths = [width * FAN**k for k in range(LEVELS) if width * FAN**k < 1 << 62]
    bin_of = lambda c, w: F.floor(c / F.lit(w))
    ends = lambda w: (bin_of(F.col(start), w), bin_of(F.col(stop) - 1, w))
    cells = None
    for k, w in reversed([*enumerate(widths)]):
        first, last = ends(w)
        own = F.arrays_zip(F.array_repeat(F.lit(k), (last - first + 1).cast("int")).alias("l"), F.sequence(first, last).alias("b"))
        cells = own if cells is None else F.when(last - first < FAN, own).otherwise(cells)
    at_all = F.array(*(F.struct(F.lit(k).alias("l"), bin_of(F.col(at), w).alias("b")) for k, w in enumerate(widths)))
    s = spans.where(F.col(stop) > F.col(start)).withColumn("__bin", F.explode(cells))
    used = s.agg(F.collect_set("__bin.l")).scalar()
    p = points.withColumn("__bin", F.explode(at_all)).where(F.array_contains(used, F.col("__bin.l")))
    return p.join(s, [*keys, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("__bin")


def events_in_bars(bar: DataFrame, calendar: DataFrame, impact: str | None = None, countries: tuple[str, ...] = (), width: int = 3_600_000_000_000) -> DataFrame:
    """Each bar with each of the calendar events (ts_ns, impact, country, title) after the bar before and up to its own end.

    A bar's span begins where the one before ended, the first bar's with its own first trade; ``width`` is about that of a
    bar, in nanoseconds.
    """
    if impact and impact.lower() != "all":
        calendar = calendar.where(F.lower("impact") == impact.lower())
    if countries:
        calendar = calendar.where(F.col("country").isin(*countries))
    by = Window.partitionBy("symbol").orderBy("bar_id")
    spans = bar.select("symbol", "bar_id", (F.coalesce(F.lag("ts_last_ns").over(by), F.col("ts_first_ns") - 1) + 1).alias("start"), (F.col("ts_last_ns") + 1).alias("stop")).where("stop > start")
    return binned_range_join(calendar, spans, [], "ts_ns", "start", "stop", width)


def calendar_hits(bar: DataFrame, calendar: DataFrame, impact: str | None = None, countries: tuple[str, ...] = ()) -> DataFrame:
    """Each bar with calendar events: symbol, bar_id, events, first_title."""
    hit = events_in_bars(bar, calendar, impact, countries)
    return hit.groupBy("symbol", "bar_id").agg(F.count(F.lit(1)).alias("events"), F.min_by("title", F.struct("ts_ns", "title")).alias("first_title"))


def event_lines(bar: DataFrame, calendar: DataFrame, most: int = 5, impact: str | None = None, countries: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` events of each bar by time and title, one line each, as ``lines``."""
    by = Window.partitionBy("symbol", "bar_id").orderBy("ts_ns", "title")
    first = events_in_bars(bar, calendar, impact, countries).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "country", "impact", "title"))), lambda e: F.concat_ws(" ", e["country"], e["impact"], e["title"]))
    return first.groupBy("symbol", "bar_id").agg(F.array_join(listed, "\n").alias("lines"))


def bar_at(times: DataFrame, bar: DataFrame, width: int) -> DataFrame:
    """``times`` (id, symbol, ts_ns) with the bar that holds each, else the one that begins nearest, the earlier of two."""
    spans = bar.select("symbol", "bar_id", F.col("ts_first_ns").alias("start"), (F.col("ts_last_ns") + 1).alias("stop"))
    inside = binned_range_join(times, spans, ["symbol"], "ts_ns", "start", "stop", width).groupBy("id", "symbol", "ts_ns").agg(F.min("bar_id").alias("bar_id"))
    rest = times.join(inside.select("id"), "id", "left_anti")
    # The nearest beginning is the last before or the first after: one pass over beginnings and times in order.
    both = rest.select("symbol", "id", "ts_ns", F.lit(None).cast("long").alias("b")).unionAll(spans.select("symbol", F.lit(None).cast(times.schema["id"].dataType).alias("id"), F.col("start").alias("ts_ns"), F.col("bar_id").alias("b")))
    by = Window.partitionBy("symbol").orderBy("ts_ns", F.col("b").isNull())
    at = F.when(F.col("b").isNotNull(), F.struct("ts_ns", "b"))
    both = both.withColumns({"before": F.last(at, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(at, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    later = F.col("before").isNull() | (F.col("after.ts_ns") - F.col("ts_ns") < F.col("ts_ns") - F.col("before.ts_ns"))
    near = both.where("id is not null").select("id", "symbol", "ts_ns", F.when(later & F.col("after").isNotNull(), F.col("after.b")).otherwise(F.col("before.b")).alias("bar_id"))
    return inside.select("id", "symbol", "ts_ns", "bar_id").unionAll(near)


def trade_windows(trades: DataFrame, bar: DataFrame, before: int = 3, after: int = 2, width: int = 86_400_000_000_000) -> DataFrame:
    """For each round trip (run_id, symbol, entry_ts_ns, exit_ts_ns): its bars, from ``before`` the entry to ``after``
    the exit, and the moves and deltas of the three bars up to the entry."""
    by = Window.partitionBy("symbol").orderBy("bar_id")
    index = bar.withColumn("i", F.row_number().over(by))
    ids = trades.withColumn("id", F.xxhash64("run_id", "symbol", "entry_ts_ns", "exit_ts_ns"))
    ends = {}
    for end in ("entry", "exit"):
        found = bar_at(ids.select("id", "symbol", F.col(f"{end}_ts_ns").alias("ts_ns")).distinct(), bar, width)
        ends[end] = found.join(index.select("symbol", "bar_id", "i"), ["symbol", "bar_id"]).select("id", F.col("i").alias(f"{end}_i"))
    spans = ids.join(ends["entry"], "id").join(ends["exit"], "id").withColumns({"lo": F.col("entry_i") - before, "hi": F.greatest("entry_i", "exit_i") + after + 1})
    rows = binned_range_join(index.select("symbol", "i", "open", "close", "delta"), spans.select("symbol", "id", "run_id", "entry_ts_ns", "entry_i", F.greatest("lo", F.lit(1)).alias("lo"), "hi"), ["symbol"], "i", "lo", "hi", 64)
    lead = F.when((F.col("i") <= F.col("entry_i")) & (F.col("i") > F.col("entry_i") - 3), F.struct("i", (F.col("close") - F.col("open")).alias("move"), "delta"))
    return rows.groupBy("run_id", "symbol", "entry_ts_ns", "id").agg(F.min("i").alias("first_bar"), F.max("i").alias("last_bar"), F.count(F.lit(1)).alias("n_bars"), F.sort_array(F.collect_list(lead)).alias("approach")).drop("id")
