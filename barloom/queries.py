"""Queries of the order-flow operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.market_time import in_sessions, parse_sessions
from barloom.operators import bars as B
from barloom.operators import big_trades as T
from barloom.operators import book as K
from barloom.operators import factors as FA
from barloom.operators import features as FE
from barloom.operators import indicators as I
from barloom.operators import joins as J
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.operators import replay as R
from barloom.operators import results as RE
from barloom.operators import run_tree as RT
from barloom.operators.broker import Costs, equity_of, trades_of
from barloom.operators.strategy import cross_signals
from barloom.plans import search as S
from barloom.plans import tables as TB
from barloom.plans.backtest import REGISTRY, figures, prepare, run_trials
from barloom.session import ship_package
from barloom.sources import heatmap_store as HS
from barloom.sources.tape import book_from_events, from_events, read_text_tape
from barloom.storage import workspace

Query = Callable[[SparkSession, str], DataFrame]
SECS, TICK = 14_400, 5.0
COSTS = Costs(commission=1.0, slippage_ticks=0.1, tick=TICK)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bar_ids(from_events(events(spark, sf_dir)), SECS)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(trades(spark, sf_dir))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ladder(trades(spark, sf_dir), TICK)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, numbers with a fraction to six digits."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in names or df.columns))


KEY = ("symbol", "bar_id")
#: Order numbers of a block where one symbol's fold is dealt to tasks.
BLOCK = 1024


def _bars_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(B.time_bar_ids(from_events(events(spark, sf_dir), 1), 600))


_TAPE = """tape as (select 'U' || cast(user_id % 8 as varchar) as symbol, event_id as seq, epoch_us(ts) * 1000 as ts_ns, value as price,
 cast(json_extract_string(props, '$.k') as double) as size, case when event_type in ('click', 'purchase') then 1 else -1 end as side from events),
keyed as (select *, ts_ns // 1000000000 // 14400 as bar_id, cast(round(price / 5.0) as bigint) as tick_key from tape)"""
_BARS = """bars as (select symbol, bar_id, arg_min(ts_ns, seq) as ts_first_ns, arg_max(ts_ns, seq) as ts_last_ns, min(seq) as seq_first, max(seq) as seq_last,
 arg_min(price, seq) as open, max(price) as high, min(price) as low, arg_max(price, seq) as close, sum(size) as volume, count(*) as trades, sum(size * side) as delta
 from keyed group by symbol, bar_id)"""
_LEVELS = """levels as (select symbol, bar_id, tick_key, arg_min(price, seq) as price, sum(case when side = 1 then size else 0.0 end) as buy_vol,
 sum(case when side = -1 then size else 0.0 end) as sell_vol from keyed group by symbol, bar_id, tick_key)"""
_W = "partition by symbol order by bar_id"


def _deviation(x: str, w: str = "p") -> str:
    """Mean and one deviation over a window, from sums and sums of squares: exact for whole sizes."""
    mean = f"(sum({x}) over {w} / count({x}) over {w})"
    return f"{mean} + sqrt(greatest(sum({x} * {x}) over {w} / count({x}) over {w} - {mean} * {mean}, 0.0))"

_ET = """et as (select *, make_date(cast(year(make_timestamp(ts_first_ns // 1000)) as bigint), 3, 1) as m3, make_date(cast(year(make_timestamp(ts_first_ns // 1000)) as bigint), 11, 1) as m11 from bars),
local as (select *, ts_first_ns - case when ts_first_ns >= (epoch_us(cast(m3 as timestamp)) // 1000000 // 86400 + (7 - dayofweek(m3)) % 7 + 7) * 86400000000000 + 25200000000000
 and ts_first_ns < (epoch_us(cast(m11 as timestamp)) // 1000000 // 86400 + (7 - dayofweek(m11)) % 7) * 86400000000000 + 21600000000000 then 14400000000000 else 18000000000000 end as wall from et),
days as (select *, wall // 86400000000000 as day, wall % 86400000000000 // 60000000000 as time_of_day_minutes from local)"""
_FLAGS = """near as (select *, lag(tick_key) over w as kb, lag(sell_vol) over w as vb, lead(tick_key) over w as ka, lead(buy_vol) over w as va from levels window w as (partition by symbol, bar_id order by tick_key)),
flags as (select *, coalesce(kb = tick_key - 1 and vb > 0 and buy_vol >= 1.5 * vb, false) as buy, coalesce(ka = tick_key + 1 and va > 0 and sell_vol >= 1.5 * va, false) as sell from near)"""


def _sql(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join([_TAPE, *ctes])} {select}"


def _one_symbol(sql: str, secs: int = SECS) -> str:
    """The same over a tape of one symbol, in bars of another length."""
    return sql.replace("user_id % 8", "user_id % 1").replace(f"// {SECS}", f"// {secs}")


_BUILT: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _BUILT[f.__name__] = f, sql
        return f

    return add


@_query(_sql("select * from bars", _BARS))
def time_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@_query(
    _sql(
        "select symbol, bar_id, arg_min(price, seq) as open, max(price) as high, min(price) as low, arg_max(price, seq) as close, sum(size) as volume, count(*) as trades from walk group by symbol, bar_id",
        "placed as (select *, row_number() over (partition by symbol order by seq) as i from tape)",
        """walk as (select symbol, i, seq, price, size, cast(0 as bigint) as bar_id, price as hi, price as lo from placed where i = 1
 union all select p.symbol, p.i, p.seq, p.price, p.size, w.bar_id + case when w.hi - w.lo >= 150.0 then 1 else 0 end,
 case when w.hi - w.lo >= 150.0 then p.price else greatest(w.hi, p.price) end, case when w.hi - w.lo >= 150.0 then p.price else least(w.lo, p.price) end
 from walk w join placed p on p.symbol = w.symbol and p.i = w.i + 1)""",
        recursive=True,
    )
)
def range_bars(spark, sf_dir):
    tape = from_events(events(spark, sf_dir)).select("symbol", "seq", "ts_ns", "price", "size", "side")
    return B.bars(B.range_bar_ids(tape, 30, TICK)).select(*KEY, "open", "high", "low", "close", "volume", "trades")


@_query(_one_symbol(_BUILT["range_bars"][1]))
def range_bars_one_symbol(spark, sf_dir):
    """All trades as one symbol's, dealt to tasks in blocks."""
    tape = from_events(events(spark, sf_dir), 1).select("symbol", "seq", "ts_ns", "price", "size", "side")
    return B.bars(B.range_bar_ids(tape, 30, TICK, BLOCK)).select(*KEY, "open", "high", "low", "close", "volume", "trades")


@_query(_sql("select symbol, bar_id, arg_max(price, struct_pack(v := buy_vol + sell_vol, k := -tick_key)) as poc, count(*) as n_levels, sum(buy_vol) as buy_vol, sum(sell_vol) as sell_vol from levels group by symbol, bar_id", _LEVELS))
def ladder_poc(spark, sf_dir):
    rows = levels(spark, sf_dir)
    return B.point_of_control(rows).join(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_levels"), F.sum("buy_vol").alias("buy_vol"), F.sum("sell_vol").alias("sell_vol")), [*KEY])


@_query(_sql("select symbol, tick_key, sum(buy_vol) as buy_vol, sum(sell_vol) as sell_vol from levels where bar_id between 118350 and 118400 group by symbol, tick_key", _LEVELS))
def volume_profile(spark, sf_dir):
    return B.volume_profile(levels(spark, sf_dir), 118_350, 118_400)


@_query(
    _sql(
        f"""select symbol, bar_id, round(avg(close) over (w rows between 11 preceding and current row), 6) as sma_fast, round(avg(close) over (w rows between 25 preceding and current row), 6) as sma_slow,
 round(avg(volume) over (w rows between 19 preceding and current row), 6) as volume_sma, round(avg(delta) over (w rows between 19 preceding and current row), 6) as delta_sma from bars window w as ({_W})""",
        _BARS,
    )
)
def sma(spark, sf_dir):
    return rounded(I.technical(bars(spark, sf_dir)), *KEY, "sma_fast", "sma_slow", "volume_sma", "delta_sma")


@_query(
    _sql(
        """select symbol, bar_id, round(case when n <= 14 then 50.0 when loss <= 0 then 100.0 else 100 - 100 / (1 + gain / loss) end, 6) as rsi,
 case when (case when n <= 14 then 50.0 when loss <= 0 then 100.0 else 100 - 100 / (1 + gain / loss) end) >= 70 then 'overbought'
 when (case when n <= 14 then 50.0 when loss <= 0 then 100.0 else 100 - 100 / (1 + gain / loss) end) <= 30 then 'oversold' else 'neutral' end as rsi_state from sums""",
        _BARS,
        f"moves as (select *, close - lag(close) over ({_W}) as d, row_number() over ({_W}) as n from bars)",
        f"""sums as (select symbol, bar_id, n, sum(case when d >= 0 then d else 0.0 end) over ({_W} rows between 13 preceding and current row) as gain,
 sum(case when d < 0 then -d else 0.0 end) over ({_W} rows between 13 preceding and current row) as loss from moves)""",
    )
)
def rsi(spark, sf_dir):
    return rounded(I.technical(bars(spark, sf_dir)), *KEY, "rsi", "rsi_state")


@_query(
    _sql(
        f"""select symbol, bar_id, round(m, 6) as bb_mid, round(m + 2 * s, 6) as bb_upper, round(m - 2 * s, 6) as bb_lower, round(case when abs(m) < 1e-12 then 0.0 else 4 * s / m end, 6) as bb_width
 from (select symbol, bar_id, avg(close) over ({_W} rows between 19 preceding and current row) as m, stddev_pop(close) over ({_W} rows between 19 preceding and current row) as s from bars)""",
        _BARS,
    )
)
def bollinger(spark, sf_dir):
    return rounded(I.technical(bars(spark, sf_dir)), *KEY, "bb_mid", "bb_upper", "bb_lower", "bb_width")


@_query(
    _sql(
        "select symbol, bar_id, round(f, 6) as ema_fast, round(s, 6) as ema_slow from walk",
        _BARS,
        f"placed as (select symbol, bar_id, close, row_number() over ({_W}) as i from bars)",
        """walk as (select symbol, bar_id, i, close as f, close as s from placed where i = 1 union all
 select p.symbol, p.bar_id, p.i, 2.0 / 13 * p.close + (1 - 2.0 / 13) * w.f, 2.0 / 27 * p.close + (1 - 2.0 / 27) * w.s from walk w join placed p on p.symbol = w.symbol and p.i = w.i + 1)""",
        recursive=True,
    )
)
def ema(spark, sf_dir):
    return rounded(I.ema(bars(spark, sf_dir).select(*KEY, "close")), *KEY, "ema_fast", "ema_slow")


@_query(_one_symbol(_BUILT["ema"][1], 600))
def ema_one_symbol(spark, sf_dir):
    """Bars of ten minutes of one symbol, dealt to tasks in blocks."""
    return rounded(I.ema(_bars_of_one(spark, sf_dir).select(*KEY, "close"), block=BLOCK), *KEY, "ema_fast", "ema_slow")


@_query(
    _sql(
        """select symbol, bar_id, case when n > 10 then round(case when path > 0 then least(greatest(abs(close - c0) / path, 0), 1) else 0.0 end, 6) end as efficiency_ratio,
 case when n > 10 then round(case when span > 0 and total > 0 then least(greatest(100 * log10(total / span) / log10(10), 0), 100) else 100.0 end, 6) end as choppiness from sums""",
        _BARS,
        f"""tr as (select *, greatest(high - low, abs(high - lag(close) over ({_W})), abs(low - lag(close) over ({_W}))) as tr, abs(close - lag(close) over ({_W})) as move,
 lag(close, 10) over ({_W}) as c0, row_number() over ({_W}) as n from bars)""",
        f"""sums as (select *, sum(move) over (w rows between 9 preceding and current row) as path, sum(tr) over (w rows between 9 preceding and current row) as total,
 max(high) over (w rows between 9 preceding and current row) - min(low) over (w rows between 9 preceding and current row) as span from tr window w as ({_W}))""",
    )
)
def regime_er_chop(spark, sf_dir):
    return rounded(I.regime(bars(spark, sf_dir), 10), *KEY, "efficiency_ratio", "choppiness")


@_query(
    _sql(
        f"""select symbol, bar_id, round(greatest(avg(tr) over (w rows between 19 preceding and current row), 5.0), 6) as atr,
 case when count(move) over (w rows between 19 preceding and current row) >= 2 then round(stddev_samp(move) over (w rows between 19 preceding and current row), 6) end as realized_volatility from tr window w as ({_W})""",
        _BARS,
        f"tr as (select *, greatest(high - low, abs(high - lag(close) over ({_W})), abs(low - lag(close) over ({_W}))) as tr, (close - lag(close) over ({_W})) / 5.0 as move from bars)",
    )
)
def atr(spark, sf_dir):
    return rounded(FE.volatility(bars(spark, sf_dir), TICK), *KEY, "atr", "realized_volatility")


_Z = "case when count({0}) over p >= 30 and stddev_samp({0}) over p >= 1e-9 then round(({0} - avg({0}) over p) / stddev_samp({0}) over p, 6) end as {1}"
_BASE = """base as (select *, trades / greatest((ts_last_ns - ts_first_ns) / 1e9, 1e-3) as trade_rate, (close - open) / 5.0 as bar_move_ticks, (close - open) / 5.0 / greatest(abs(delta), 1.0) as delta_efficiency,
 abs((close - open) / 5.0) / greatest(abs(delta), 1.0) as absolute_delta_efficiency from bars)"""


@_query(_sql(f"select symbol, bar_id, {', '.join(_Z.format(c, o) for c, o in FE.SCORED.items())} from base window p as ({_W} rows between 100 preceding and 1 preceding)", _BARS, _BASE))
def zscores(spark, sf_dir):
    return rounded(FE.scores(FE.base(bars(spark, sf_dir), TICK)), *KEY, *FE.SCORED.values())


@_query(
    _sql(
        """select symbol, bar_id, round(volume, 6) as volume, round(greatest((volume + delta) / 2, 0), 6) as buy_volume, round(greatest((volume - delta) / 2, 0), 6) as sell_volume, round(delta / greatest(volume, 1e-9), 6) as delta_ratio,
 round(volume / greatest(trades, 1), 6) as average_trade_size, round((high - low) / 5.0, 6) as bar_range_ticks, round((close - low) / greatest(high - low, 5.0), 6) as close_location from bars""",
        _BARS,
    )
)
def bar_features(spark, sf_dir):
    return rounded(FE.base(bars(spark, sf_dir), TICK), *KEY, "volume", "buy_volume", "sell_volume", "delta_ratio", "average_trade_size", "bar_range_ticks", "close_location")


@_query(_sql("select symbol, bar_id, day, time_of_day_minutes from days where (time_of_day_minutes >= 570 and time_of_day_minutes < 960)", _BARS, _ET))
def session_bars(spark, sf_dir):
    return FE.with_day(bars(spark, sf_dir)).where(in_sessions(F.col("time_of_day_minutes"), parse_sessions("09:30-16:00"))).select(*KEY, "day", "time_of_day_minutes")


@_query(_sql("select symbol, bar_id, day, time_of_day_minutes from days where time_of_day_minutes >= 600 and time_of_day_minutes < 720", _BARS, _ET))
def session_bars_of_odd_windows(spark, sf_dir):
    """Windows that end before they begin or are no times of a day are left out; the one that is left holds."""
    windows = parse_sessions("16:00-09:30, 25:00-26:99, 10:00-12:00, 13:00")
    return FE.with_day(bars(spark, sf_dir)).where(in_sessions(F.col("time_of_day_minutes"), windows)).select(*KEY, "day", "time_of_day_minutes")


@_query(_sql("select symbol, bar_id, day, time_of_day_minutes from days", _BARS, _ET))
def session_bars_without_windows(spark, sf_dir):
    """Without a window that holds, every bar is in session."""
    return FE.with_day(bars(spark, sf_dir)).where(in_sessions(F.col("time_of_day_minutes"), parse_sessions("16:00-09:30"))).select(*KEY, "day", "time_of_day_minutes")


@_query(
    _sql(
        """select symbol, bar_id, cvd, cvd - lag(cvd, 1) over w as cvd_change_1, cvd - lag(cvd, 3) over w as cvd_change_3, cvd - lag(cvd, 5) over w as cvd_change_5, round((cvd - lag(cvd, 5) over w) / 5, 6) as cvd_slope_5
 from (select *, sum(delta) over (partition by symbol, day order by bar_id) as cvd from days) window w as (partition by symbol, day order by bar_id)""",
        _BARS, _ET,
    )
)
def cvd(spark, sf_dir):
    return rounded(FE.cumulative_delta(FE.with_day(bars(spark, sf_dir))), *KEY, "cvd", "cvd_change_1", "cvd_change_3", "cvd_change_5", "cvd_slope_5")


@_query(
    _sql(
        """select symbol, bar_id, round(sum(pv) over w / sum(v) over w, 6) as session_vwap, round((close - sum(pv) over w / sum(v) over w) / 5.0, 6) as distance_to_vwap_ticks from
 (select d.*, m.pv, m.v from days d join (select symbol, bar_id, sum(price * (buy_vol + sell_vol)) as pv, sum(buy_vol + sell_vol) as v from levels group by symbol, bar_id) m using (symbol, bar_id))
 window w as (partition by symbol, day order by bar_id rows between unbounded preceding and current row)""",
        _BARS, _LEVELS, _ET,
    )
)
def session_vwap(spark, sf_dir):
    return rounded(FE.locations(FE.with_day(bars(spark, sf_dir)), levels(spark, sf_dir), TICK), *KEY, "session_vwap", "distance_to_vwap_ticks")


@_query(
    _sql(
        f"""select symbol, bar_id, round((h - close) / 5.0, 6) as distance_to_recent_high_ticks, round((close - l) / 5.0, 6) as distance_to_recent_low_ticks, case when h is not null then round((close - l) / greatest(h - l, 5.0), 6) end as recent_range_position
 from (select *, max(high) over ({_W} rows between 20 preceding and 1 preceding) as h, min(low) over ({_W} rows between 20 preceding and 1 preceding) as l from bars)""",
        _BARS,
    )
)
def recent_range(spark, sf_dir):
    return rounded(FE.locations(FE.with_day(bars(spark, sf_dir)), levels(spark, sf_dir), TICK), *KEY, "distance_to_recent_high_ticks", "distance_to_recent_low_ticks", "recent_range_position")


@_query(
    _sql(
        """select symbol, bar_id, round((max(high) over w - close) / 5.0, 6) as distance_to_session_high_ticks, round((close - min(low) over w) / 5.0, 6) as distance_to_session_low_ticks from days
 window w as (partition by symbol, day order by bar_id rows between unbounded preceding and 1 preceding)""",
        _BARS, _ET,
    )
)
def session_extremes(spark, sf_dir):
    return rounded(FE.locations(FE.with_day(bars(spark, sf_dir)), levels(spark, sf_dir), TICK), *KEY, "distance_to_session_high_ticks", "distance_to_session_low_ticks")


@_query(_sql("select symbol, bar_id, tick_key, buy, sell, case when buy then round(buy_vol / vb, 6) end as buy_ratio, case when sell then round(sell_vol / va, 6) end as sell_ratio from flags where buy or sell", _LEVELS, _FLAGS))
def diag_imbalance(spark, sf_dir):
    return rounded(I.diagonal_imbalances(levels(spark, sf_dir), 1.5).where("buy or sell"), *KEY, "tick_key", "buy", "sell", "buy_ratio", "sell_ratio")


_STACKS = """runs as (select symbol, bar_id, 'buy' as side, tick_key, price, buy_vol as volume, tick_key - row_number() over (partition by symbol, bar_id order by tick_key) as run from flags where buy
 union all select symbol, bar_id, 'sell', tick_key, price, sell_vol, tick_key - row_number() over (partition by symbol, bar_id order by tick_key) from flags where sell),
stacks as (select symbol, bar_id, side, min(price) as low, max(price) as high, count(*) as levels, sum(volume) as volume from runs group by symbol, bar_id, side, run having count(*) >= 2)"""


@_query(_sql("select symbol, bar_id, side, low, high, levels, volume, row_number() over (partition by symbol, bar_id, side order by volume desc, low) as rank from stacks", _LEVELS, _FLAGS, _STACKS))
def stacked_zones(spark, sf_dir):
    found = I.stacks(I.diagonal_imbalances(levels(spark, sf_dir), 1.5), 2)
    return I.top_stacks(found, 1000).select(*KEY, "side", "low", "high", "levels", "volume", F.col("rank").cast("long").alias("rank"))


@_query(_sql("select symbol, bar_id, side, arg_max(low, struct_pack(v := volume, l := low)) as low, arg_max(levels, struct_pack(v := volume, l := low)) as levels, max(volume) as volume from stacks group by symbol, bar_id, side", _LEVELS, _FLAGS, _STACKS))
def strongest_stacks(spark, sf_dir):
    return I.strongest_stack(I.stacks(I.diagonal_imbalances(levels(spark, sf_dir), 1.5), 2)).select(*KEY, "side", "low", "levels", "volume")


@_query(
    _sql(
        """select b.symbol, b.bar_id, greatest(coalesce((select list_sort(list(least(round(v.v), 4095.0)))[cast(floor(count(*) * cast(0.7 as double)) as bigint) + 1] from vols v where v.symbol = b.symbol and v.i >= b.i - 20 and v.i < b.i), 10.0), 10.0) as volume_threshold from idx b""",
        _BARS, _LEVELS,
        f"idx as (select symbol, bar_id, row_number() over ({_W}) as i from bars)",
        "vols as (select i.symbol, i.i, u.v from (select symbol, bar_id, buy_vol as v from levels union all select symbol, bar_id, sell_vol from levels) u join idx i using (symbol, bar_id) where u.v > 0)",
    )
)
def volume_thresholds(spark, sf_dir):
    return I.volume_thresholds(bars(spark, sf_dir), levels(spark, sf_dir), 0.7, 20, 10.0)


@_query(
    _sql(
        f"""select symbol, bar_id, buy_node, sell_node, round(coalesce(least(greatest({_deviation('node')}, 20.0), 200.0), 20.0), 6) as node_threshold,
 cast(abs(delta) >= coalesce(least(greatest({_deviation('abs(delta)')}, 30.0), 400.0), 30.0) and abs(buy_node) >= coalesce(least(greatest({_deviation('node')}, 20.0), 200.0), 20.0) as int) as buy_flag,
 cast(abs(delta) >= coalesce(least(greatest({_deviation('abs(delta)')}, 30.0), 400.0), 30.0) and abs(sell_node) >= coalesce(least(greatest({_deviation('node')}, 20.0), 200.0), 20.0) as int) as sell_flag
 from nodes window p as ({_W} rows between 20 preceding and 1 preceding)""",
        _BARS, _LEVELS,
        """edges as (select b.symbol, b.bar_id, b.delta, coalesce(max(case when l.price >= b.high - 20 and l.buy_vol > l.sell_vol then l.buy_vol - l.sell_vol end), 0.0) as buy_node,
 coalesce(min(case when l.price <= b.low + 20 and l.buy_vol < l.sell_vol then l.buy_vol - l.sell_vol end), 0.0) as sell_node from bars b join levels l using (symbol, bar_id) group by b.symbol, b.bar_id, b.delta)""",
        "nodes as (select *, greatest(abs(buy_node), abs(sell_node)) as node from edges)",
    )
)
def adaptive_imbalance(spark, sf_dir):
    rows = I.adaptive_imbalance(bars(spark, sf_dir), levels(spark, sf_dir), 20.0, 20, 1.0, (20.0, 200.0), (30.0, 400.0))
    return rounded(rows, *KEY, "buy_node", "sell_node", "node_threshold", "buy_flag", "sell_flag")


_BIG = "select symbol, bar_id, sum(case when side = 1 then size else 0.0 end) as buy_size, sum(case when side = -1 then size else 0.0 end) as sell_size, count(distinct (side, run)) as big_count from kept group by symbol, bar_id"


@_query(_sql(_BIG, "kept as (select *, seq as run from keyed where size >= 60)"))
def big_trades_single(spark, sf_dir):
    return T.big_totals(trades(spark, sf_dir), low=60.0)


@_query(
    _sql(
        _BIG,
        "turns as (select *, coalesce(cast(side <> lag(side) over (partition by symbol, bar_id order by seq) as int), 0) as turn from keyed)",
        "numbered as (select *, sum(turn) over (partition by symbol, bar_id order by seq) as run from turns)",
        "totals as (select *, sum(size) over (partition by symbol, bar_id, run) as total from numbered)",
        "kept as (select * from totals where total >= 120)",
    )
)
def big_trades_cumulative(spark, sf_dir):
    return T.big_totals(trades(spark, sf_dir), cumulative=True, low=120.0)


@_query(
    _sql(
        _BIG,
        "most as (select symbol, bar_id, max(size) as m from keyed group by symbol, bar_id having max(size) > 0)",
        f"limits as (select symbol, bar_id, coalesce(least(greatest({_deviation('m', 'w')}, 25.0), 500.0), 25.0) as t from most window w as ({_W} rows between 20 preceding and 1 preceding))",
        "kept as (select k.*, k.seq as run from keyed k join limits l using (symbol, bar_id) where k.size >= l.t)",
    )
)
def big_trades_adaptive(spark, sf_dir):
    return T.big_totals(trades(spark, sf_dir), adaptive=True)


@_query(
    _sql(
        """select b.symbol, b.bar_id, t.t as large_trade_threshold, sum(case when k.size >= t.t then k.size else 0.0 end) as large_trade_volume from bars b join limits t using (symbol, bar_id) join keyed k using (symbol, bar_id) group by b.symbol, b.bar_id, t.t""",
        _BARS,
        "placed as (select symbol, bar_id, size, row_number() over (partition by symbol order by seq) as i from keyed)",
        "firsts as (select symbol, bar_id, min(i) as i0 from placed group by symbol, bar_id)",
        "limits as (select f.symbol, f.bar_id, greatest(coalesce(round(list_sort(list(p.size) filter (where p.size is not null))[cast(floor(count(p.size) * cast(0.95 as double)) as bigint) + 1]), 10.0), 10.0) as t from firsts f left join placed p on p.symbol = f.symbol and p.i < f.i0 and p.i >= f.i0 - 200 group by f.symbol, f.bar_id)",
    )
)
def large_trades(spark, sf_dir):
    rows = trades(spark, sf_dir)
    return FE.large_trades(B.bars(rows), rows, n=200).select(*KEY, "large_trade_threshold", "large_trade_volume")


@_query(
    _sql(
        "select symbol, i as bar_index, kind as pivot_kind, price as pivot_price, pivot_at as pivot_bar from walk where kind is not null",
        _BARS,
        f"placed as (select symbol, row_number() over ({_W}) - 1 as i, high, low from bars)",
        """walk as (select symbol, i, 0 as way, high as peak, i as peak_bar, cast(null as varchar) as last_kind, cast(null as double) as last_price, cast(null as bigint) as last_bar,
 high as top, i as top_bar, low as bottom, i as bottom_bar, cast(null as varchar) as kind, cast(null as double) as price, cast(null as bigint) as pivot_at from placed where i = 0
 union all select symbol, i, case when begun <> 0 then begun when turned then -way else way end,
 case when begun = 1 then high when begun = -1 then low when turned then case when way = 1 then low else high end else p end, case when begun <> 0 or turned then i else pb end,
 case when begun = 1 then 'low' when begun = -1 then 'high' when major then own else last_kind end, case when begun = 1 then b else case when begun = -1 then t else case when major then p else last_price end end end,
 case when begun = 1 then bb when begun = -1 then tb when major then pb else last_bar end, t, tb, b, bb,
 case when begun = 1 then 'low' when begun = -1 then 'high' when major then own end, case when begun = 1 then b when begun = -1 then t when major then p end, case when begun = 1 then bb when begun = -1 then tb when major then pb end
 from (select *, turned and last_kind <> own and abs(p - last_price) + 2.220446049250313e-16 >= 80.0 and greatest(pb - last_bar, 0) >= 2 as major from
 (select *, case when way <> 0 then 0 when high >= b + 80.0 then 1 when low <= t - 80.0 then -1 else 0 end as begun, (way = 1 and low <= p - 60.0) or (way = -1 and high >= p + 60.0) as turned, case when way = 1 then 'high' else 'low' end as own from
 (select n.symbol, n.i, n.high, n.low, w.way, w.last_kind, w.last_price, w.last_bar, case when n.high > w.top then n.high else w.top end as t, case when n.high > w.top then n.i else w.top_bar end as tb,
 case when n.low < w.bottom then n.low else w.bottom end as b, case when n.low < w.bottom then n.i else w.bottom_bar end as bb,
 case when w.way = 1 and n.high > w.peak then n.high when w.way = -1 and n.low < w.peak then n.low else w.peak end as p, case when w.way = 1 and n.high > w.peak or w.way = -1 and n.low < w.peak then n.i else w.peak_bar end as pb
 from walk w join placed n on n.symbol = w.symbol and n.i = w.i + 1))))""",
        recursive=True,
    )
)
def zigzag(spark, sf_dir):
    return I.zigzag(bars(spark, sf_dir), 60.0, 80.0, 2)


@_query(_one_symbol(_BUILT["zigzag"][1], 600))
def zigzag_one_symbol(spark, sf_dir):
    return I.zigzag(_bars_of_one(spark, sf_dir), 60.0, 80.0, 2, BLOCK)


_CAL = """cal as (select 1704067200000000000 + (epoch_us(o_orderdate) // 1000000 + o_orderkey * 7919) % 2592000 * 1000000000 as ts_ns, o_orderpriority from orders where o_orderpriority like '1-%')"""
_SPANS = f"spans as (select symbol, bar_id, ts_last_ns, coalesce(lag(ts_last_ns) over ({_W}), ts_first_ns - 1) as prev from bars)"


def _calendar(spark, sf_dir) -> DataFrame:
    """All orders as calendar events, spread over the tape's thirty days."""
    second = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000
    ns = 1_704_067_200_000_000_000 + (second.cast("long") + F.col("o_orderkey") * 7919) % 2_592_000 * 1_000_000_000
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(ns.alias("ts_ns"), F.when(F.col("o_orderpriority").startswith("1-"), "High").otherwise("Low").alias("impact"), F.lit("US").alias("country"), F.col("o_orderpriority").alias("title"))


@_query(
    _sql(
        """select s.symbol, s.bar_id, count(*) as events, arg_min(o.o_orderpriority, struct_pack(t := o.ts_ns, p := o.o_orderpriority)) as first_title from spans s join cal o on o.ts_ns > s.prev and o.ts_ns <= s.ts_last_ns group by s.symbol, s.bar_id""",
        _BARS, _CAL, _SPANS,
    )
)
def calendar_hits(spark, sf_dir):
    return J.calendar_hits(bars(spark, sf_dir), _calendar(spark, sf_dir), "high", ("US",))


@_query(
    _sql(
        """select symbol, bar_id, string_agg('US High ' || title, chr(10) order by k) as lines from (select s.symbol, s.bar_id, o.o_orderpriority as title, row_number() over (partition by s.symbol, s.bar_id order by o.ts_ns, o.o_orderpriority) as k
 from spans s join cal o on o.ts_ns > s.prev and o.ts_ns <= s.ts_last_ns) where k <= 3 group by symbol, bar_id""",
        _BARS, _CAL, _SPANS,
    )
)
def event_lines(spark, sf_dir):
    return J.event_lines(bars(spark, sf_dir), _calendar(spark, sf_dir), 3, "high", ("US",))


_FOLLOW = f"placed as (select *, row_number() over ({_W}) as i from bars)"


@_query(
    _sql(
        """select p.symbol, p.bar_id, cast(arg_min(case when f.low <= p.close - 25 then 0 else 1 end, f.i) as int) as label from placed p join placed f on f.symbol = p.symbol and f.i > p.i and f.i <= p.i + 5
 and (f.low <= p.close - 25 or f.high >= p.close + 40) group by p.symbol, p.bar_id""",
        _BARS, _FOLLOW,
    )
)
def continuation_label(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("label", L.continuation(F.lit(1), TICK)).where("label is not null").select(*KEY, "label")


@_query(
    _sql(
        """select symbol, bar_id, cast(case when first = 0 then 0 else 1 end as int) as label from (select p.symbol, p.bar_id, arg_min(case when f.high >= p.close + 30 then 0 else 1 end, f.i) filter (where f.high >= p.close + 30 or f.low <= p.close - 30) as first,
 greatest(max(f.high - p.close) filter (where f.i <= p.i + 3), 0) as gain from placed p join placed f on f.symbol = p.symbol and f.i > p.i and f.i <= p.i + 10 group by p.symbol, p.bar_id) where first = 0 or (first = 1 and gain <= 6)""",
        _BARS, _FOLLOW,
    )
)
def failure_label(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("label", L.failure(F.lit(1), F.lit(30.0))).where("label is not null").select(*KEY, "label")


_LONG = f"placed as (select *, row_number() over ({_W}) as i from bars)"


@_query(
    _sql(
        """select p.symbol, p.bar_id, cast(arg_min(case when f.low <= p.close - 250 then 0 else 1 end, f.i) as int) as label from placed p join placed f on f.symbol = p.symbol and f.i > p.i and f.i <= p.i + 10000
 and (f.low <= p.close - 250 or f.high >= p.close + 400) group by p.symbol, p.bar_id""",
        _BARS, _LONG,
    ).replace(f"// {SECS}", "// 600")
)
def long_continuation(spark, sf_dir):
    """Labels of bars of ten minutes from the 10,000 bars after each."""
    bar = B.bars(B.time_bar_ids(from_events(events(spark, sf_dir)), 600))
    return L.with_continuation(bar, F.lit(1), TICK, 80, 50, 10_000, BLOCK).where("label is not null").select(*KEY, "label")


def _features(spark, sf_dir) -> DataFrame:
    rows = trades(spark, sf_dir)
    return FE.trade_flow(B.bars(rows), B.ladder(rows, TICK), rows, TICK)


_RAW_Z = "case when count({0}) over p >= 30 and stddev_samp({0}) over p >= 1e-9 then ({0} - avg({0}) over p) / stddev_samp({0}) over p end as {1}"
_STRICT = _FLAGS.replace("buy_vol >= 1.5 * vb", "buy_vol >= 3.0 * vb and buy_vol >= 5.0").replace("sell_vol >= 1.5 * va", "sell_vol >= 3.0 * va and sell_vol >= 5.0")
#: Columns of the dataset as SQL over the tables joined below; other features have their own names there.
_DATASET = {
    "buy_volume": "greatest((volume + delta) / 2, 0)", "sell_volume": "greatest((volume - delta) / 2, 0)", "delta_ratio": "delta / greatest(volume, 1e-9)", "average_trade_size": "volume / greatest(trades, 1)",
    "large_trade_ratio": "large_trade_volume / greatest(volume, 1e-9)", "bar_range_ticks": "(high - low) / 5.0", "close_location": "(close - low) / greatest(high - low, 5.0)",
    "cvd_slope_5": "cvd_change_5 / 5", "cvd_slope_10": "cvd_change_10 / 10", "distance_to_vwap_ticks": "(close - vwap) / 5.0", "distance_to_recent_high_ticks": "(rh - close) / 5.0", "distance_to_recent_low_ticks": "(close - rl) / 5.0",
    "recent_range_position": "case when rh is not null then (close - rl) / greatest(rh - rl, 5.0) end", "distance_to_session_high_ticks": "(sh - close) / 5.0", "distance_to_session_low_ticks": "(close - sl) / 5.0",
}
_OF = lambda c: f"({_DATASET.get(c, c)})"
_FLIPPED = {"signed_close_location": "close_location", "signed_range_position": "recent_range_position"}


@_query(
    _sql(
        "select symbol, bar_id, ts_first_ns, dir, "
        + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in L.FIELDS)
        + ", round(abs(delta), 6) as delta_abs, "
        + ", ".join(f"round(cast({_OF(c)} as double), 6) as {c}" for c in L.FEATURES)
        + ", "
        + ", ".join(f"round(cast(dir * {_OF(v)} as double), 6) as {k}" for k, v in L.SIGNED.items())
        + ", "
        + ", ".join(f"round(cast(case when dir >= 0 then {_OF(v)} else 1 - {_OF(v)} end as double), 6) as {k}" for k, v in _FLIPPED.items())
        + f", round(case when dir >= 0 then {_OF('distance_to_recent_high_ticks')} else {_OF('distance_to_recent_low_ticks')} end, 6) as signed_distance_to_range_edge_ticks, label from joined",
        _BARS, _LEVELS, _ET, _BASE, _STRICT, _STACKS,
        f"z as (select symbol, bar_id, {', '.join(_RAW_Z.format(c, o) for c, o in FE.SCORED.items())} from base window p as ({_W} rows between 100 preceding and 1 preceding))",
        """c as (select symbol, bar_id, cvd, cvd - lag(cvd, 1) over w as cvd_change_1, cvd - lag(cvd, 3) over w as cvd_change_3, cvd - lag(cvd, 5) over w as cvd_change_5, cvd - lag(cvd, 10) over w as cvd_change_10
 from (select *, sum(delta) over (partition by symbol, day order by bar_id) as cvd from days) window w as (partition by symbol, day order by bar_id))""",
        """money as (select d.symbol, d.bar_id, sum(m.pv) over w / sum(m.v) over w as vwap, max(d.high) over e as sh, min(d.low) over e as sl, d.time_of_day_minutes
 from days d join (select symbol, bar_id, sum(price * (buy_vol + sell_vol)) as pv, sum(buy_vol + sell_vol) as v from levels group by symbol, bar_id) m using (symbol, bar_id)
 window w as (partition by d.symbol, d.day order by d.bar_id rows between unbounded preceding and current row), e as (partition by d.symbol, d.day order by d.bar_id rows between unbounded preceding and 1 preceding))""",
        f"recent as (select symbol, bar_id, max(high) over w as rh, min(low) over w as rl from bars window w as ({_W} rows between 20 preceding and 1 preceding))",
        "counts as (select symbol, bar_id, count(*) filter (where buy) as p, count(*) filter (where sell) as n, max(case when buy then buy_vol / vb end) as pr, max(case when sell then sell_vol / va end) as nr from flags group by symbol, bar_id)",
        "layers as (select symbol, bar_id, max(case when side = 'buy' then k end) as pl, max(case when side = 'sell' then k end) as nl from (select symbol, bar_id, side, run, count(*) as k from runs group by symbol, bar_id, side, run) group by symbol, bar_id)",
        f"moves as (select *, greatest(high - low, abs(high - lag(close) over ({_W})), abs(low - lag(close) over ({_W}))) as tr, (close - lag(close) over ({_W})) / 5.0 as move from bars)",
        f"""risk as (select symbol, bar_id, greatest(avg(tr) over w, 5.0) as atr, case when count(move) over w >= 2 then stddev_samp(move) over w end as realized_volatility from moves window w as ({_W} rows between 19 preceding and current row))""",
        "numbered as (select symbol, bar_id, size, row_number() over (partition by symbol order by seq) as i from keyed)",
        "firsts as (select symbol, bar_id, min(i) as i0 from numbered group by symbol, bar_id)",
        """limits as (select f.symbol, f.bar_id, greatest(coalesce(round(list_sort(list(n.size) filter (where n.size is not null))[cast(floor(count(n.size) * cast(0.95 as double)) as bigint) + 1]), 10.0), 10.0) as t
 from firsts f left join numbered n on n.symbol = f.symbol and n.i < f.i0 and n.i >= f.i0 - 2000 group by f.symbol, f.bar_id)""",
        "large as (select symbol, bar_id, sum(case when size >= t then size else 0.0 end) as large_trade_volume from keyed join limits using (symbol, bar_id) group by symbol, bar_id)",
        """every as (select base.*, z.* exclude (symbol, bar_id), c.* exclude (symbol, bar_id), money.* exclude (symbol, bar_id), recent.* exclude (symbol, bar_id), risk.* exclude (symbol, bar_id), large_trade_volume,
 coalesce(p, 0) as positive_imbalance_count, coalesce(n, 0) as negative_imbalance_count, coalesce(pr, 0) as max_positive_imbalance_ratio, coalesce(nr, 0) as max_negative_imbalance_ratio, coalesce(pl, 0) as positive_stack_max_layers, coalesce(nl, 0) as negative_stack_max_layers,
 cast(case when delta_zscore < 0 then -1 else 1 end as int) as dir, row_number() over (partition by base.symbol order by base.bar_id) as i
 from base join z using (symbol, bar_id) join c using (symbol, bar_id) join money using (symbol, bar_id) join recent using (symbol, bar_id) join risk using (symbol, bar_id) join large using (symbol, bar_id) left join counts using (symbol, bar_id) left join layers using (symbol, bar_id))""",
        """labels as (select e.symbol, e.bar_id, cast(arg_min(case when (e.dir = 1 and f.low <= e.close - 25) or (e.dir = -1 and f.high >= e.close + 25) then 0 else 1 end, f.i) as int) as label from every e join every f on f.symbol = e.symbol and f.i > e.i and f.i <= e.i + 5
 and (f.low <= e.close - case when e.dir = 1 then 25 else 40 end or f.high >= e.close + case when e.dir = 1 then 40 else 25 end) group by e.symbol, e.bar_id)""",
        "joined as (select * from every join labels using (symbol, bar_id) where abs(delta_zscore) >= 0.5)",
    )
)
def ml_dataset(spark, sf_dir):
    return rounded(L.dataset(_features(spark, sf_dir), TICK, threshold=0.5))


@_query(
    _sql(
        """select b.symbol, b.bar_id, cast(coalesce(p, 0) as double) as positive_imbalance_count, cast(coalesce(n, 0) as double) as negative_imbalance_count, round(coalesce(pr, 0), 6) as max_positive_imbalance_ratio, round(coalesce(nr, 0), 6) as max_negative_imbalance_ratio,
 cast(coalesce(pl, 0) as double) as positive_stack_max_layers, cast(coalesce(nl, 0) as double) as negative_stack_max_layers from bars b
 left join (select symbol, bar_id, count(*) filter (where buy) as p, count(*) filter (where sell) as n, max(case when buy then buy_vol / vb end) as pr, max(case when sell then sell_vol / va end) as nr from flags group by symbol, bar_id) using (symbol, bar_id)
 left join (select symbol, bar_id, max(case when side = 'buy' then k end) as pl, max(case when side = 'sell' then k end) as nl from (select symbol, bar_id, side, run, count(*) as k from runs group by symbol, bar_id, side, run) group by symbol, bar_id) using (symbol, bar_id)""",
        _BARS, _LEVELS, _FLAGS, _STACKS,
    )
)
def imbalance_counts(spark, sf_dir):
    rows = FE.imbalance_counts(bars(spark, sf_dir), levels(spark, sf_dir), 1.5, 0.0)
    return rounded(rows, *KEY, "positive_imbalance_count", "negative_imbalance_count", "max_positive_imbalance_ratio", "max_negative_imbalance_ratio", "positive_stack_max_layers", "negative_stack_max_layers")


_BIG_LEVELS = "big as (select symbol, bar_id, side, tick_key, arg_min(price, seq) as price, sum(size) as size, count(*) as runs from keyed where size >= 60 group by symbol, bar_id, side, tick_key)"


@_query(
    _sql(
        """select symbol, bar_id, max(size) filter (where side = 1 and price >= high - 20) as buy_size, arg_max(price, struct_pack(s := size, k := tick_key)) filter (where side = 1 and price >= high - 20) as buy_price,
 max(size) filter (where side = -1 and price <= low + 20) as sell_size, arg_max(price, struct_pack(s := size, k := tick_key)) filter (where side = -1 and price <= low + 20) as sell_price from big join bars using (symbol, bar_id) group by symbol, bar_id""",
        _BARS, _BIG_LEVELS,
    )
)
def big_trade_edges(spark, sf_dir):
    rows = T.edge_sizes(T.big_levels(trades(spark, sf_dir), TICK, low=60.0), bars(spark, sf_dir), 20.0)
    return rows.select(*KEY, *(F.col(f"{s}_edge.{c}").alias(f"{s}_{c}") for s in ("buy", "sell") for c in ("size", "price")))


@_query(_sql("select symbol, bar_id, side, tick_key, size, runs, rank from (select *, row_number() over (partition by symbol, bar_id, side order by size desc, tick_key) as rank from big) where rank <= 2", _BIG_LEVELS))
def big_trade_markers(spark, sf_dir):
    rows = T.top_markers(T.big_levels(trades(spark, sf_dir), TICK, low=60.0), 2)
    return rows.select(*KEY, "side", "tick_key", "size", "runs", F.col("rank").cast("long").alias("rank"))


@_query(_sql("select symbol, bar_id, count(*) as n_levels, arg_min(price, tick_key) as lowest, arg_max(price, tick_key) as highest, sum(buy_vol) as buy_vol, sum(sell_vol) as sell_vol from levels where bar_id between 118360 and 118409 group by symbol, bar_id", _LEVELS))
def ladder_window(spark, sf_dir):
    rows = B.ladder_window(levels(spark, sf_dir), 118_360, 200_000, 50)
    total = lambda c: F.aggregate("levels", F.lit(0.0), lambda a, x: a + x[c]).alias(c)
    return rows.select(*KEY, F.size("levels").cast("long").alias("n_levels"), F.col("levels")[0]["price"].alias("lowest"), F.element_at("levels", -1)["price"].alias("highest"), total("buy_vol"), total("sell_vol"))


@_query(_sql("select * from bars where bar_id between 118340 and 118419", _BARS))
def bar_page(spark, sf_dir):
    return B.page(bars(spark, sf_dir), 118_340, 80)


_AVERAGES = f"""averages as (select symbol, bar_id, round(volume / avg(volume) over (w rows between 19 preceding and current row), 6) as volume_ratio, row_number() over w as n,
 round(avg(close) over (w rows between 11 preceding and current row), 6) as f, round(avg(close) over (w rows between 25 preceding and current row), 6) as s from bars window w as ({_W}))"""


@_query(
    _sql(
        """select symbol, bar_id, volume_ratio, case when f > s then 'up' when f < s then 'down' else 'flat' end as trend, cast(case when f0 <= s0 and f > s then 1 when f0 >= s0 and f < s then -1 else 0 end as int) as crossed
 from (select *, lag(f) over (partition by symbol order by bar_id) as f0, lag(s) over (partition by symbol order by bar_id) as s0 from averages)""",
        _BARS, _AVERAGES,
    )
)
def average_crosses(spark, sf_dir):
    """Crosses and trends of averages rounded to six digits, as equal averages of growing windows must tie in any order of addition."""
    rows = rounded(I.technical(bars(spark, sf_dir)), *KEY, "volume", "volume_sma", "sma_fast", "sma_slow")
    trend = F.when(F.col("sma_fast") > F.col("sma_slow"), "up").when(F.col("sma_fast") < F.col("sma_slow"), "down").otherwise("flat")
    return rounded(cross_signals(rows).withColumn("trend", trend).withColumn("crossed", F.col("crossed").cast("int")), *KEY, "volume_ratio", "trend", "crossed")


@_query(
    _sql(
        "select symbol, id, bar_index, value, coalesce(first_value(color ignore nulls) over (partition by symbol, id order by bar_index rows between unbounded preceding and unbounded following), '') as color from points",
        _BARS,
        f"placed as (select *, row_number() over ({_W}) - 1 as bar_index from bars)",
        """points as (select symbol, 'close' as id, bar_index, close as value, case when bar_index >= 3 then 'c' || cast(bar_index as varchar) end as color from placed union all select symbol, 'volume', bar_index, volume, null from placed)""",
    )
)
def visual_series(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("bar_index", (F.row_number().over(Window.partitionBy("symbol").orderBy("bar_id")) - 1).cast("long"))
    color = F.when(F.col("bar_index") >= 3, F.concat(F.lit("c"), F.col("bar_index").cast("string")))
    both = F.array(F.struct(F.lit("close").alias("id"), F.col("close").alias("value"), color.alias("color")), F.struct(F.lit("volume").alias("id"), F.col("volume").alias("value"), F.lit(None).cast("string").alias("color")))
    points = rows.select(F.col("symbol").alias("run_id"), "bar_index", F.explode(both).alias("p")).select("run_id", "bar_index", "p.*")
    return RE.visual_series(points).withColumnRenamed("run_id", "symbol").select("symbol", "id", "bar_index", "value", "color")


@_query(_sql("select symbol, bar_id, 2 * count(*) as n_plots, min(low) as lowest, max(high) as highest, count(*) filter (where side = 'buy') as buy_markers from stacks group by symbol, bar_id", _LEVELS, _FLAGS, _STACKS))
def stack_plots(spark, sf_dir):
    rows = RE.stack_plots(I.stacks(I.diagonal_imbalances(levels(spark, sf_dir), 1.5), 2))
    bound = lambda f, c: f(F.transform("plots", lambda p: p[c]))
    return rows.select(*KEY, F.size("plots").cast("long").alias("n_plots"), bound(F.array_min, "low").alias("lowest"), bound(F.array_max, "high").alias("highest"), F.size(F.filter("plots", lambda p: (p["kind"] == "marker") & (p["side"] == "buy"))).cast("long").alias("buy_markers"))


@_query("select o_orderkey as trade_id, o_totalprice - 150000 as pnl from orders where o_totalprice - 150000 >= 0 order by md5('7:' || o_orderkey), o_orderkey limit 200")
def sampled_trades(spark, sf_dir):
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_totalprice") - 150_000).alias("pnl"))
    return RE.sampled_trades(made, F.col("trade_id"), 200, 7, "winners")


@_query(
    """with runs as (select o_orderkey as run_id, 'order' as kind, o_orderpriority as a, o_orderstatus as b from orders), long as (select 'kind' as param, kind as value from runs union all select 'a', a from runs union all select 'b', b from runs)
select param, min(value) as value from long group by param having count(distinct value) = 1 and count(value) = count(*)"""
)
def shared_params(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return M.shared_params(rows, ["kind", "a", "b"])


@_query(
    _sql(
        """select g.symbol, g.col, last_value(o.last_price ignore nulls) over w as last_price, coalesce(o.buy_volume, 0) as buy_volume, coalesce(o.sell_volume, 0) as sell_volume, last_value(q.bid ignore nulls) over w as bid, last_value(q.ask ignore nulls) over w as ask
 from (select symbol, unnest(range(0, 120)) as col from (select distinct symbol from tape)) g
 left join (select symbol, (ts_ns - 1704067200000000000) // 21600000000000 as col, arg_max(price, seq) as last_price, sum(case when side = 1 then size else 0.0 end) as buy_volume, sum(case when side = -1 then size else 0.0 end) as sell_volume from tape group by all) o using (symbol, col)
 left join (select symbol, (ts_ns - 1704067200000000000) // 21600000000000 as col, arg_max(case when side > 0 then price - 5 else price end, seq) as bid, arg_max(case when side > 0 then price else price + 5 end, seq) as ask from tape group by all) q using (symbol, col)
 window w as (partition by g.symbol order by g.col)"""
    )
)
def column_traces(spark, sf_dir):
    """Traces of thirty days in columns of six hours."""
    tape = from_events(events(spark, sf_dir))
    return K.column_traces(tape, K.quotes(tape, TICK, 3_600_000_000_000), 3_600_000_000_000, _T0, _T0 + 30 * 86_400_000_000_000, 120)


@_query(
    _sql(
        "select factor, count(*) as n, round(corr(rx, ry), 6) as ic from ranked group by factor",
        _BARS,
        """long as (select symbol, bar_id, close as y, 'volume' as factor, volume as x from bars union all select symbol, bar_id, close, 'delta', delta from bars union all select symbol, bar_id, close, 'trades', cast(trades as double) from bars)""",
        """ranked as (select factor, rank() over (partition by factor order by x) + (count(*) over (partition by factor, x) - 1) / 2.0 as rx, rank() over (partition by factor order by y) + (count(*) over (partition by factor, y) - 1) / 2.0 as ry from long)""",
    )
)
def spearman_ic(spark, sf_dir):
    return rounded(FA.spearman(bars(spark, sf_dir), ["volume", "delta", "trades"], "close"))


@_query(_BUILT["spearman_ic"][1])
def spearman_ic_by_ranges(spark, sf_dir):
    """The same with each factor's values ranked in ranges."""
    return rounded(FA.spearman(bars(spark, sf_dir), ["volume", "delta", "trades"], "close", 8))


@_query(_one_symbol(_BUILT["ema"][1], 600))
def averages_in_sql(spark, sf_dir):
    """Exponential averages through a table function."""
    TB.register(spark)
    _bars_of_one(spark, sf_dir).select(*KEY, "close").createOrReplaceTempView("bars_of_one")
    return rounded(spark.sql("select * from averages(table(bars_of_one) partition by symbol order by (bar_id), 12, 26)"), *KEY, "ema_fast", "ema_slow")


@_query(_BUILT["range_bars"][1])
def range_bars_in_sql(spark, sf_dir):
    TB.register(spark)
    from_events(events(spark, sf_dir)).select("symbol", "seq", "ts_ns", "price", "size", "side").createOrReplaceTempView("trades_of_all")
    made = spark.sql(f"select * from range_bars(table(trades_of_all) partition by symbol order by (seq), 30, {TICK})")
    return B.bars(made).select(*KEY, "open", "high", "low", "close", "volume", "trades")


def _run(spark, sf_dir) -> DataFrame:
    points = [{"side": s, "volume_min": v, "stop_ticks": a, "target_ticks": 12.0} for s in ("long_only", "long_short") for v in (0.0, 0.8) for a in (3.0, 6.0)]
    rows = prepare(from_events(events(spark, sf_dir)), TICK, params={"time": {"bar_secs": 3600}, "technical": {"fast": 5, "slow": 12}})
    return run_trials(rows.bars, S.trials(spark, points), COSTS)


@_query()
def broker_trades(spark, sf_dir):
    return trades_of(_run(spark, sf_dir))


@_query()
def equity_curve(spark, sf_dir):
    return equity_of(_run(spark, sf_dir))


@_query()
def run_metrics(spark, sf_dir):
    return figures(_run(spark, sf_dir), COSTS.starting)


_PNL = """curve as (select symbol as run_id, bar_id, false as forced, 1000 + sum(case when side = 1 then price else -price end) over (partition by symbol order by seq) as e, row_number() over (partition by symbol, bar_id order by seq desc) as k from keyed),
points as (select run_id, bar_id, e as equity from curve where k = 1)"""


@_query(
    _sql(
        """select run_id, round(arg_max(equity, bar_id), 6) as ending_equity, round(min(equity - peak), 6) as max_drawdown, round(avg(r) / stddev_samp(r) * sqrt(count(r)), 6) as sharpe,
 round(avg(r) / sqrt(sum(case when r < 0 then r * r else 0.0 end) / count(r)) * sqrt(count(r)), 6) as sortino from
 (select *, greatest(max(equity) over (partition by run_id order by bar_id), 1000.0) as peak, (equity - coalesce(lag(equity) over (partition by run_id order by bar_id), 1000.0)) / nullif(coalesce(lag(equity) over (partition by run_id order by bar_id), 1000.0), 0) as r from points)
 group by run_id""",
        _PNL,
    )
)
def drawdown(spark, sf_dir):
    """Risk figures of a curve that adds up signed prices."""
    rows = trades(spark, sf_dir)
    run = F.sum(F.when(F.col("side") == 1, F.col("price")).otherwise(-F.col("price"))).over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    curve = rows.withColumn("e", 1000 + run).groupBy(F.col("symbol").alias("run_id"), "bar_id").agg(F.max_by("e", "seq").alias("equity")).withColumn("forced", F.lit(False))
    none = spark.range(0).select(F.lit("").alias("run_id"), F.lit(0.0).alias("pnl"), F.lit(0.0).alias("max_adverse_excursion"), F.lit(0.0).alias("max_adverse_ticks"))
    return rounded(M.run_metrics(curve, none, 1000.0), "run_id", "ending_equity", "max_drawdown", "sharpe", "sortino")


@_query("select 't' || lpad(cast(row_number() over (order by f, s) - 1 as varchar), 6, '0') as trial_id, f as technical_fast, s as technical_slow from (select f, s from range(2, 201) a(f), range(3, 401) b(s) order by f, s limit 2000)")
def param_grid(spark, sf_dir):
    axes = S.space({"technical": REGISTRY.spec("indicator", "technical")}, {"technical.rsi_n": 14})
    return S.trials(spark, S.grid(axes, 2000))


@_query()
def trial_metrics(spark, sf_dir):
    done = figures(_run(spark, sf_dir), COSTS.starting)
    return S.best(done.select(F.col("run_id").alias("trial_id"), "trades", F.col("net_pnl").alias("score")))


@_query(
    """with runs as (select o_orderkey as run_id, o_orderpriority as a, o_orderstatus as b, o_totalprice as net_pnl from orders), long as (select run_id, net_pnl, 'a' as param, a as value from runs union all select run_id, net_pnl, 'b', b from runs)
select param, value, count(*) over (partition by param) as values, runs, best_net_pnl, best_run from (select param, value, count(*) as runs, max(net_pnl) as best_net_pnl, arg_max(run_id, struct_pack(p := net_pnl, r := run_id)) as best_run from long group by param, value)"""
)
def experiment_tree(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_totalprice").alias("net_pnl"))
    return M.experiment_tree(rows, ["a", "b"])


def _tree_level(k: int) -> str:
    """What the nodes of level k branch on, their children, and the parameters that are open below."""
    return f"""
act{k} as (select node, key, rank from open{k} group by node, key, rank having count(distinct value) > 1),
chosen{k} as materialized (select o.run_id, o.node as parent, o.net_pnl, o.key, o.value, o.node || '/' || o.key || '=' || o.value as node from open{k} o join (select node, arg_min(key, rank) as key from act{k} group by node) using (node, key)),
open{k + 1} as materialized (select c.run_id, c.node, o.net_pnl, o.key, o.value, o.rank from open{k} o join act{k} a on a.node = o.node and a.key = o.key join chosen{k} c on c.run_id = o.run_id where o.key <> c.key),
fixed{k + 1} as (select node, string_agg(key || '=' || value, ',' order by rank) as implied from (select node, key, rank, min(value) as value from open{k + 1} group by node, key, rank having count(distinct value) = 1) group by node),
nodes{k + 1} as (select node, parent, {k + 1} as depth, key, value, coalesce(any_value(implied), '') as implied, count(*) as runs, max(net_pnl) as best, arg_min(run_id, struct_pack(p := -net_pnl, r := run_id)) as best_run
 from chosen{k} left join fixed{k + 1} using (node) group by node, parent, key, value)"""


@_query(
    f"""with runs as (select o_orderkey as run_id, o_orderstatus as strategy, o_totalprice as net_pnl, o_orderpriority as a, cast(year(o_orderdate) as varchar) as b,
 case when o_orderpriority like '1%' then 'x' when o_orderpriority like '5%' then null else cast(o_custkey % 3 as varchar) end as c, '0' as d, case when o_orderstatus = 'F' then 'done' else 'open' end as e from orders),
long as materialized (select run_id, strategy, net_pnl, k.key, k.own, coalesce(k.own, '—') as value from runs, unnest([struct_pack(key := 'a', own := a), struct_pack(key := 'b', own := b), struct_pack(key := 'c', own := c), struct_pack(key := 'd', own := d), struct_pack(key := 'e', own := e)]) u(k)),
shared as (select key from long group by key having count(distinct value) = 1 and count(own) = count(*)),
keys as (select strategy as node, key, count(distinct value) as v, count(own) = count(*) as everywhere, min(value) as one from long group by strategy, key having count(own) > 0),
root as (select strategy as node, count(*) as runs, max(net_pnl) as best, arg_min(run_id, struct_pack(p := -net_pnl, r := run_id)) as best_run from runs group by strategy),
constant as (select node, string_agg(key || '=' || one, ',' order by key) as implied from keys where v = 1 and everywhere and key not in (select key from shared) group by node),
open0 as materialized (select run_id, strategy as node, net_pnl, key, value, rank from long join (select node as strategy, key, row_number() over (partition by node order by v, key) as rank from keys where v > 1) using (strategy, key)),
{",".join(_tree_level(k) for k in range(3))},
nodes as (select node, cast(null as varchar) as parent, 0 as depth, 'strategy' as key, node as value, coalesce(implied, '') as implied, runs, best, best_run from root left join constant using (node)
 {" ".join(f"union all select * from nodes{k}" for k in (1, 2, 3))}),
ends as (select run_id, arg_max(node, depth) as node, max(depth) as depth from (select run_id, strategy as node, 0 as depth from runs {" ".join(f"union all select run_id, node, {k + 1} from chosen{k}" for k in range(3))}) group by run_id)
select node as node_id, parent as parent_id, depth, key, value, implied, runs, best, best_run, cast(row_number() over (partition by parent order by best desc, value) as int) as place, cast(null as bigint) as run_id from nodes
union all select e.node || '/#' || e.run_id, e.node, e.depth + 1, null, null, '', 1, r.net_pnl, e.run_id, null, e.run_id from ends e join runs r using (run_id)"""
)
def run_tree(spark, sf_dir):
    """Orders as runs: two parameters that branch everywhere, one that others imply, one of each strategy, one that all share."""
    first = F.col("o_orderpriority").substr(1, 1)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("strategy"), F.col("o_totalprice").alias("net_pnl"), F.col("o_orderpriority").alias("a"), F.year("o_orderdate").alias("b"),
        F.when(first == "1", "x").when(first != "5", (F.col("o_custkey") % 3).cast("string")).alias("c"), F.lit("0").alias("d"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("e"),
    )
    tree = RT.run_tree(rows, ["a", "b", "c", "d", "e"])
    return tree.withColumn("implied", F.array_join(F.transform("implied", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ","))


_STATES = """ev as (select *, case when seq % 7 = 0 then 'set' when seq % 3 = 0 then 'reduce' else 'add' end as kind from keyed),
parts as (select *, case when kind = 'reduce' then -size else size end as change, sum(cast(kind = 'set' as int)) over (partition by symbol, side, tick_key order by seq) as part from ev),
sums as (select *, sum(change) over (partition by symbol, side, tick_key, part order by seq) as total from parts),
states as (select symbol, side, tick_key, seq, ts_ns, total - least(min(total) over (partition by symbol, side, tick_key, part order by seq), 0) as level_size from sums)"""


@_query(_sql("select * from states", _STATES))
def book_state(spark, sf_dir):
    return K.book_states(book_from_events(events(spark, sf_dir)), TICK)


@_query(
    _sql(
        """select c.symbol, c.bar_id, s.tick_key, sum(case when s.side = 1 then s.level_size else 0.0 end) as bid_size, sum(case when s.side = -1 then s.level_size else 0.0 end) as ask_size
 from closes c join spans s on s.symbol = c.symbol and c.at >= s.lo and c.at < s.hi where abs(s.tick_key - cast(round(c.close / 5.0) as bigint)) <= 20 group by c.symbol, c.bar_id, s.tick_key""",
        _BARS, _STATES,
        "ends as (select symbol, max(seq) as e from states group by symbol)",
        "spans as (select s.symbol, s.side, s.tick_key, s.level_size, s.seq as lo, coalesce(lead(s.seq) over (partition by s.symbol, s.side, s.tick_key order by s.seq), e.e + 1) as hi from states s join ends e using (symbol) qualify true)",
        f"closes as (select b.symbol, b.bar_id, b.close, least(coalesce(lead(b.seq_first) over (partition by b.symbol order by b.bar_id) - 1, e.e), e.e) as at from bars b join ends e using (symbol))",
    ).replace(" qualify true", "").replace("from closes c join spans s on s.symbol", "from closes c join (select * from spans where level_size > 1e-9) s on s.symbol")
)
def book_snapshot(spark, sf_dir):
    states = K.book_states(book_from_events(events(spark, sf_dir)), TICK)
    return K.snapshots(K.close_events(bars(spark, sf_dir)), states, TICK, reach=20)


_LINES = """made as (select event_id as id, epoch_us(ts) * 1000 as ts_ns, value as price, cast(json_extract_string(props, '$.k') as bigint) as size, event_id % 13 as m,
 case when event_type in ('click', 'purchase') then 2 else 1 end as code from events)"""


@_query(
    _sql(
        """select kind, side, count(*) as events, round(sum(price), 4) as prices, sum(size) as sizes, sum(ts_ns // 1000000000) as seconds from (
 select case when m in (0, 1) then 'trade' when m = 2 then 'add' when m = 3 then 'reduce' when m = 4 then 'set' when m in (5, 6, 10) then 'trade' when m = 7 then 'add' end as kind,
 case when m = 0 then -1 when m = 4 then case when code = 1 then 1 else -1 end when m = 6 then -1 when code = 2 then 1 else -1 end as side, case when m = 7 then price * 10 else price end as price, cast(size as double) as size, ts_ns from made where m <= 7 or (m = 10 and size = 0))
 group by kind, side""",
        _LINES,
    )
)
def text_tape(spark, sf_dir):
    """The events as a text tape with rows of every kind, sound and unsound (a size of -0 is sound), written and read again."""
    e = events(spark, sf_dir)
    ns = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    code, m = F.when(F.col("event_type").isin("click", "purchase"), "2").otherwise("1"), F.col("event_id") % 13
    price, size = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    row = lambda *x: F.concat_ws(",", *(F.lit(v) if isinstance(v, str) else v for v in x))
    line = (
        F.when(m == 0, row("T", ns, "x", F.format_string("%.6f", "value"), size)).when(m == 1, row("T", ns, "x", F.format_string("%.6f", "value"), size, code))
        .when(m == 2, row("AddLimit", ns, "x", price, size, code)).when(m == 3, row("R", ns, "x", price, F.concat(F.lit("+"), size), code)).when(m == 4, row("r", ns, "x", code, price, size))
        .when(m == 5, row("T", ns, "x", F.format_string("%.6f", "value"), size, F.concat(code, F.lit("\r")))).when(m == 6, row("T", ns, "x", F.format_string("%.6f", "value"), size, "buy")).when(m == 7, row("A", ns, "x", F.concat(F.format_string("%.6f", "value"), F.lit("e1")), size, code))
        .when(m == 8, row("A", ns, "x", "NaN", size, code)).when(m == 9, row("R", ns, "x", F.concat(F.lit(" "), price), size, code)).when(m == 10, row("T", ns, "x", price, F.concat(F.lit("-"), size), code))
        .when(m == 11, row("r", ns, "x", "bid", price, size)).otherwise(row("c", "-", "0", "e", "s", "t", "0.25"))
    )
    path = workspace(spark, "tape")
    e.select(line.alias("value")).write.text(path)
    rows = read_text_tape(spark, path, "S", split_bytes=1 << 16)
    return rows.groupBy("kind", F.col("side").cast("int").alias("side")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("price"), 4).alias("prices"), F.sum("size").alias("sizes"), F.sum(F.expr("ts_ns div 1000000000")).alias("seconds"))


_T0, _T1 = 1_704_067_200_000_000_000, 1_704_067_200_000_000_000 + 20 * 86_400_000_000_000


@_query(
    _sql(
        """select symbol, col, row, value, cast(round(255 * ln(1 + value) / ln(1 + max(value) over (partition by symbol))) as int) as intensity from (select symbol, col, row, max(size) as value from cells group by symbol, col, row)""",
        _STATES,
        "samples as (select symbol, ts_ns // 21600000000000 as bucket, side, tick_key, arg_max(level_size, seq) as size from states group by all)",
        f"""cells as (select symbol, size, unnest(range(cast(floor((bucket * 21600000000000 - {_T0}) / 21600000000000.0) as bigint), cast(ceil(((bucket + 1) * 21600000000000 - {_T0}) / 21600000000000.0) as bigint))) as col,
 least(cast(floor(tick_key / 2.5) as bigint), 39) as row from samples where bucket * 21600000000000 < {_T1} and (bucket + 1) * 21600000000000 > {_T0} and tick_key between 0 and 99 and size > 1e-9)""",
    )
)
def heatmap_grid(spark, sf_dir):
    samples = K.sampled(K.book_states(book_from_events(events(spark, sf_dir)), TICK), 21_600_000_000_000)
    return K.heatmap(samples, 21_600_000_000_000, _T0, _T1, 0, 99, 80, 40)


@_query(_sql(f"select symbol, ts_ns, price, cast(cast(size as float) as double) as size, cast(side as int) as side, (select min(ts_ns) from tape n where n.symbol = 'U3' and n.ts_ns > {_T1}) as next_trade_ns from tape where symbol = 'U3' and ts_ns between {_T0 + 5 * 86_400_000_000_000} and {_T1}"))
def stored_trades(spark, sf_dir):
    """A window of one symbol's trades from the store, and the time of the next one."""
    path = workspace(spark, "trades")
    HS.write_trades(from_events(events(spark, sf_dir)), path)
    after = HS.next_trade_ns(spark, path, "U3", _T1).scalar()
    return HS.read_trades(spark, path, "U3", _T0 + 5 * 86_400_000_000_000, _T1).withColumn("next_trade_ns", after)


@_query(
    _sql(
        """select symbol, bucket, bid, ask from (select *, lag(bid) over w as b0, lag(ask) over w as a0 from (select symbol, ts_ns // 3600000000000 as bucket, arg_max(case when side > 0 then price - 5 else price end, seq) as bid, arg_max(case when side > 0 then price else price + 5 end, seq) as ask from keyed group by all)
 window w as (partition by symbol order by bucket)) where not coalesce(bid = b0 and ask = a0, false)"""
    )
)
def bbo_quotes(spark, sf_dir):
    return K.quotes(from_events(events(spark, sf_dir)), TICK, 3_600_000_000_000)


@_query()
def trade_windows(spark, sf_dir):
    made = prepare(from_events(events(spark, sf_dir)), TICK, params={"time": {"bar_secs": 3600}}).bars
    return J.trade_windows(trades_of(_run(spark, sf_dir)), made)


@_query()
def replay_session(spark, sf_dir):
    """A session for each symbol, all with the same orders."""
    made = prepare(from_events(events(spark, sf_dir)), TICK, params={"time": {"bar_secs": 3600}}, indicators=()).bars.withColumn("session_id", F.col("symbol"))
    log = [("market", 1, 2.0, None, None, None, None), ("step", None, None, None, None, None, 5), ("market", 1, 1.0, None, None, None, None), ("step", None, None, None, None, None, 3), ("market", -1, 4.0, None, None, None, None), ("limit", 1, 1.0, 10.0, None, None, None), ("step", None, None, None, None, None, 20), ("undo", None, None, None, None, None, None), ("flatten", None, None, None, None, None, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(log)], R.COMMAND.replace("session_id string, ", "")).withColumn("session_id", F.explode(F.array(*(F.lit(f"U{k}") for k in range(8)))))
    return R.replay(made, rows, tick=TICK)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _BUILT.items() if sql}
