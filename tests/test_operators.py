"""Small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import market_time as MT
from barloom.operators import bars as B
from barloom.operators import book as K
from barloom.operators import factors as FA
from barloom.operators import features as FE
from barloom.operators import indicators as I
from barloom.operators import joins as J
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.plans import search as S
from barloom.plans.params import Param, Registry, Spec
from barloom.sources import tape as TP

TAPE = "symbol string, seq long, ts_ns long, price double, size double, side int"
BAR = "symbol string, bar_id long, ts_first_ns long, ts_last_ns long, open double, high double, low double, close double, volume double, trades long, delta double"
LEVEL = "symbol string, bar_id long, tick_key long, price double, buy_vol double, sell_vol double"


def bars(spark, rows, symbol="S", step=60_000_000_000, start=1_767_625_200_000_000_000):
    return spark.createDataFrame([(symbol, i, start + i * step, start + i * step + 59_000_000_000, *map(float, r[:4]), float(r[4]), int(r[4]), float(r[5])) for i, r in enumerate(rows)], BAR)


def ladder(spark, rows, bar_id=0, tick=0.25):
    return spark.createDataFrame([("S", bar_id, round(p / tick), float(p), float(b), float(s)) for p, b, s in rows], LEVEL)


def walk(n=200, seed=1):
    r, out, c = random.Random(seed), [], 100.0
    for _ in range(n):
        o, c = c, c + r.choice([-1, -0.25, 0, 0.25, 0.5, 1])
        v = r.randint(1, 50)
        out.append((o, max(o, c) + 0.25, min(o, c) - 0.5, c, v, r.randint(-v, v)))
    return out


def test_range_bar_holds_its_closing_trade(spark):
    rows = [("S", i, i, p, 1.0, 1) for i, p in enumerate([100.0, 107.25, 107.5, 100.0])]
    got = B.bars(B.range_bar_ids(spark.createDataFrame(rows, TAPE), 30, 0.25)).orderBy("bar_id").collect()
    assert [(b.open, b.close, b.trades) for b in got] == [(100.0, 107.5, 3), (100.0, 100.0, 1)]


def test_partitioning_changes_nothing(spark):
    r = random.Random(3)
    rows = [(f"S{k}", i, i, 100 + r.randint(-40, 40) / 4, 1.0, 1) for k in range(3) for i in range(500)]
    df = spark.createDataFrame(rows, TAPE)
    got = [sorted(map(tuple, B.range_bar_ids(df.repartition(n), 20, 0.25).select("symbol", "seq", "bar_id").collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_late_trade_starts_a_new_bar(spark):
    rows = [("S", i, s * 1_000_000_000, 1.0, 1.0, 1) for i, s in enumerate([1, 2, 70, 3, 71])]
    got = B.time_bar_ids(spark.createDataFrame(rows, TAPE), 60, ordered=False).orderBy("seq").collect()
    assert [b.bar_id for b in got] == [0, 0, 1, 2, 3]


def test_poc_tie_is_the_lowest_price(spark):
    assert B.point_of_control(ladder(spark, [(100, 5, 5), (100.25, 10, 0), (100.5, 1, 0)])).first().poc == 100.0


def test_tick_key_rounds_halves_away(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,)], "p double").select(B.tick_key(F.col("p"), 1.0).alias("k")).collect()
    assert [r.k for r in got] == [3, -3]


def test_contract_tick_holds_from_its_event(spark):
    rows = [("S", 0, "trade", None), ("S", 1, "contract", 0.5), ("S", 2, "trade", None)]
    got = B.with_contract_tick(spark.createDataFrame(rows, "symbol string, seq long, kind string, tick_size double")).orderBy("seq").collect()
    assert [r.tick for r in got] == [0.25, 0.5, 0.5]


@pytest.mark.parametrize("side, rows, want", [
    ("buy", [(100, 10, 20), (100.25, 90, 25), (100.5, 80, 20), (100.75, 70, 5), (101, 10, 10)], (100.25, 100.75, 3)),
    ("sell", [(100, 5, 70), (100.25, 20, 80), (100.5, 25, 90), (100.75, 30, 10)], (100.0, 100.5, 3)),
    ("buy", [(100, 10, 20), (100.25, 90, 25), (100.5, 80, 20), (101, 90, 5)], None),
])
def test_stacks(spark, side, rows, want):
    got = [s for s in I.strongest_stack(I.stacks(I.diagonal_imbalances(ladder(spark, rows), 3.0), 3)).collect() if s.side == side]
    assert ([(s.low, s.high, s.levels) for s in got] or [None]) == [want]


def test_volume_percentile_takes_the_bars_before(spark):
    levels = ladder(spark, [(100, 100, 100), (100.25, 200, 200)]).unionAll(ladder(spark, [(100, 1, 1)], 1))
    got = I.volume_thresholds(bars(spark, walk(2)), levels, 0.5, 10, 1.0).orderBy("bar_id").collect()
    assert [r.volume_threshold for r in got] == [1.0, 200.0]


def test_regime(spark):
    up = [(100 + i, 100.5 + i, 99.5 + i, 100.4 + i, 1, 0) for i in range(12)]
    sway = [(100 + i % 2, 101 + i % 2, 99 + i % 2, 100 + i % 2, 1, 0) for i in range(12)]
    a, b = (I.regime(bars(spark, r), 10).orderBy("bar_id").collect() for r in (up, sway))
    assert a[0].efficiency_ratio is None and a[-1].efficiency_ratio > 0.7 and a[-1].choppiness < 50
    assert b[-1].efficiency_ratio < 0.2 and b[-1].choppiness > 60


@pytest.mark.parametrize("rows, want", [
    ([(100, 100), (106, 101), (110, 108), (109, 104)], [("low", 100.0, 0, 1), ("high", 110.0, 2, 3)]),
    ([(100, 100), (106, 101), (112, 106)], [("low", 100.0, 0, 1), ("high", 112.0, 2, 2)]),
])
def test_zigzag(spark, rows, want):
    got = I.zigzag(bars(spark, [(lo, h, lo, lo, 1, 0) for h, lo in rows]), 5.0).orderBy("bar_index").collect()
    assert [(p.pivot_kind, p.pivot_price, p.pivot_bar, p.bar_index) for p in got] == want


def test_zigzag_alternates(spark):
    got = I.zigzag(bars(spark, walk(300, 7)), 2.0, 3.0, 3).orderBy("bar_index").collect()
    kinds = [p.pivot_kind for p in got]
    assert len(kinds) > 3 and all(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def test_the_future_changes_nothing(spark):
    rows = walk(60)
    other = rows[:40] + [(1, 9, 0, 5, 99, 99)] * 20

    def all_of(r):
        b = bars(spark, r)
        lv = b.select("symbol", "bar_id", F.round(F.col("close") / 0.25).cast("long").alias("tick_key"), F.col("close").alias("price"), F.col("volume").alias("buy_vol"), F.lit(0.0).alias("sell_vol"))
        tr = b.select("symbol", "bar_id", F.col("bar_id").alias("seq"), F.col("volume").alias("size"), F.lit(1).alias("side"), F.col("close").alias("price"))
        f = FE.trade_flow(b, lv, tr, 0.25, 20, 5)
        f = I.regime(I.technical(I.ema(f), 3, 6), 10)
        f = I.adaptive_imbalance(f, lv, 1.0)
        return [x.asDict() for x in f.where("bar_id < 40").orderBy("bar_id").collect()]

    assert all_of(rows) == all_of(other)


def test_z_score_looks_back_only(spark):
    rows = [(100, 100, 100, 100, 20, 4 if i % 2 else -4) for i in range(40)] + [(100, 100, 100, 100, 520, 480)]
    got = bars(spark, rows).withColumn("z", FE.zscore("delta")).orderBy("bar_id").collect()
    assert got[29].z is None and abs(got[39].z) < 2 and got[40].z > 5


def test_cumulative_delta_restarts_each_day(spark):
    day = 86_400_000_000_000
    rows = [("S", i, ts, ts, 1.0, 1.0, 1.0, 1.0, 1.0, 1, d) for i, (ts, d) in enumerate([(1_767_625_200_000_000_000, 20.0), (1_767_625_260_000_000_000, 20.0), (1_767_625_200_000_000_000 + day, 10.0)])]
    got = FE.cumulative_delta(FE.with_day(spark.createDataFrame(rows, BAR))).orderBy("bar_id").collect()
    assert [(r.cvd, r.cvd_change_1) for r in got] == [(20, None), (40, 20), (10, None)]


def test_large_trades_use_the_trades_before(spark):
    rows = [("S", 0, i, 2.0) for i in range(200)] + [("S", 1, 200, 50.0)]
    trades = spark.createDataFrame(rows, "symbol string, bar_id long, seq long, size double")
    got = FE.large_trades(bars(spark, walk(2)), trades).orderBy("bar_id").collect()
    assert [r.large_trade_volume for r in got] == [0.0, 50.0]


def test_eastern_time_changes(spark):
    def minute(text):
        ns = F.unix_micros(F.to_timestamp(F.lit(text + "Z"))) * 1000
        return spark.range(1).select(MT.eastern_minute(ns).alias("m")).first().m

    assert [minute(t) for t in ("2026-03-08 06:59:00", "2026-03-08 07:00:00", "2026-11-01 05:59:00", "2026-11-01 06:00:00")] == [119, 180, 119, 60]


def test_sessions(spark):
    assert MT.parse_sessions("09:35-11:30,13:30-15:45") == [(575, 690), (810, 945)] and MT.parse_sessions("junk") == []
    assert MT.parse_sessions("16:00-09:30,24:00-25:00,10:60-11:00, 8:5 - 9:00 ,10:00-10:00,1:00-2:00-3:00,-1:00-2:00,07:00") == [(485, 540)]
    inside = lambda m, s: spark.range(1).select(MT.in_sessions(F.lit(m), s).alias("x")).first().x
    assert inside(600, MT.parse_sessions("09:35-11:30")) and not inside(700, MT.parse_sessions("09:35-11:30")) and inside(1, [])


def test_labels(spark):
    def label(following, make):
        rows = [(100, 100, 100, 100, 1, 0)] + [(100, h, lo, 100, 1, 0) for h, lo in following]
        return bars(spark, rows).withColumn("y", make()).orderBy("bar_id").first().y

    go = lambda: L.continuation(F.lit(1), 0.25)
    assert [label([x], go) for x in ((102.5, 100), (100.5, 98), (103, 98), (100.5, 99.5))] == [1, 0, 0, None]
    fail = lambda: L.failure(F.lit(1), F.lit(2.0))
    assert [label(x, fail) for x in ([(100.25, 99.5), (99.75, 97.5)], [(102.5, 100)], [(101, 100), (100.5, 97.5)])] == [1, 0, None]


def test_metrics_of_two_trades(spark):
    trades = spark.createDataFrame([("r", 10.0, 25.0, 2.0), ("r", -5.0, 75.0, 6.0)], "run_id string, pnl double, max_adverse_excursion double, max_adverse_ticks double")
    equity = spark.createDataFrame([("r", 0, False, 100_010.0), ("r", 1, False, 100_005.0)], "run_id string, bar_id long, forced boolean, equity double")
    m = M.run_metrics(equity, trades).first()
    assert (m.avg_mae, m.avg_mae_ticks, m.win_rate, m.profit_factor, m.max_drawdown, m.expectancy) == (50.0, 4.0, 0.5, 2.0, -5.0, 2.5)
    wins = M.run_metrics(equity, trades.where("pnl > 0")).first()
    assert wins.profit_factor == float("inf")


def test_book_equals_a_fold(spark):
    r = random.Random(9)
    rows = [("S", i, i, r.choice(["add", "add", "reduce", "reduce", "set"]), float(r.randint(100, 103)), float(r.randint(0, 9)), r.choice([1, -1])) for i in range(800)]
    got = {x.seq: x.level_size for x in K.book_states(spark.createDataFrame(rows, "symbol string, seq long, ts_ns long, kind string, price double, size double, side int"), 1.0).collect()}
    state = {}
    for _, seq, _, kind, price, size, side in rows:
        old = state.get((price, side), 0.0)
        state[price, side] = max(0.0, size if kind == "set" else old + size if kind == "add" else old - size)
        assert got[seq] == state[price, side]


def test_heatmap_trades_and_query(spark):
    rows = spark.createDataFrame([("S", 0, 100, 10.0, 2.0, 1), ("S", 1, 150, 10.25, 3.0, -1), ("S", 2, 220, 10.5, 4.0, 1)], TAPE)
    inside, after = K.exact_trades(rows, 90, 160)
    assert inside.count() == 2 and after == 220
    assert K.parse_heatmap_query("?t0=1&t1=2&pmin=3&pmax=4")["cols"] == 1200
    with pytest.raises(ValueError, match="pmax"):
        K.parse_heatmap_query("t0=1&t1=2&pmin=3")


def test_bar_at_takes_the_span_or_the_nearest(spark):
    b = spark.createDataFrame([("S", 0, 0, 10), ("S", 1, 100, 110), ("S", 2, 200, 210)], "symbol string, bar_id long, ts_first_ns long, ts_last_ns long")
    t = spark.createDataFrame([(i, "S", x) for i, x in enumerate([5, 110, 50, 160, 900, -7])], "id long, symbol string, ts_ns long")
    assert {r.id: r.bar_id for r in J.bar_at(t, b, 64).collect()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 2, 5: 0}


def test_average_ranks_and_coverage(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), None, 2.0 * i) for i in range(200)], "a double, b double, c double, y double")
    assert FA.covered(rows, ["a", "b", "c"]) == ["a", "b"]
    ic = {r.factor: r.ic for r in FA.spearman(rows, ["a", "b"], "y").collect()}
    assert ic["a"] == pytest.approx(1.0) and abs(ic["b"]) < 0.2
    assert FA.split(rows, ["y"], 0.7).where("train").count() == 140
    with pytest.raises(ValueError):
        FA.split(rows.limit(50), ["y"])


def test_boosting_finds_the_signal(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(x := r.random(), r.random(), 2 * x) for _ in range(400)], "signal double, noise double, y double")
    predict, ranked = FA.boosted(rows, ["signal", "noise"], "y", 5, 3)
    assert ranked[0][0] == "signal" and FA.report(predict(rows), label="y").first().r2 > 0.5


def test_params():
    spec = Spec(Param("window", 20, 5, 50, 5), Param("threshold", 1.0, 0, 3), Param("side", "both", options=("both", "long")), Param("tick", 0.25, fixed=True))
    assert spec.parse(["window=30"]) == {"window": 30} and spec.resolve({})["side"] == "both"
    for bad in ("window=31", "threshold=text", "side=short", "what=1", "window="):
        with pytest.raises(ValueError):
            spec.parse([bad])
    registry = Registry()
    registry.add("strategy", "s", lambda **p: p, spec)
    assert registry.build("strategy", "s", window=25)["window"] == 25
    with pytest.raises(ValueError, match="known: s"):
        registry.build("strategy", "t")


def test_search(spark):
    axes = {"a": Param("a", 1, 1, 3, 1), "b": Param("b", "x", options=("x", "y"))}
    assert S.grid(axes, 3) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}]
    assert S.random_points(axes, 5, 1) == S.random_points(axes, 5, 1) != S.random_points(axes, 5, 2)
    scored = spark.createDataFrame([("t0", 1.0), ("t1", 3.0), ("t2", 3.0), ("t3", float("nan"))], "trial_id string, score double")
    assert S.best(scored).first().trial_id == "t2"


def test_text_tape(spark, tmp_path):
    (tmp_path / "tape.csv").write_text("c,1,0,X,ES,F,0.5,50,1\nT,2,1,100.5,3,2,0\nT,3,2,100,4\nA,4,3,99,5,2\nr,5,4,1,98,6\nT,6,5,bad,1,2\nz,7\nr,8,4,,98,6\nT,9,6,100,-1,2\n")
    got = TP.read_text_tape(spark, str(tmp_path / "tape.csv"), "S").orderBy("seq").collect()
    assert [(r.kind, r.ts_ns, r.price, r.size, r.side) for r in got] == [("contract", 1, None, None, None), ("trade", 2, 100.5, 3.0, 1), ("trade", 3, 100.0, 4.0, -1), ("add", 4, 99.0, 5.0, 1), ("set", 5, 98.0, 6.0, 1)]
    assert got[0].tick_size == 0.5 and got[0].multiplier == 50.0
    assert TP.read_text_tape(spark, str(tmp_path / "tape.csv"), "S", ("trade",)).count() == 2


def test_calendar(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"date":"2026-01-05T10:00:00.250-05:00","impact":"High","country":"US","title":"A"},{"date":"2026-01-05T10:00:00","title":"B"}]')
    (row,) = TP.read_calendar(spark, str(tmp_path / "c.json")).collect()
    assert (row.title, row.ts_ns) == ("A", 1_767_625_200_000_000_000)


def test_calendar_hits_fall_between_bars(spark):
    b = spark.createDataFrame([("S", 0, 10, 20), ("S", 1, 30, 40)], "symbol string, bar_id long, ts_first_ns long, ts_last_ns long")
    cal = spark.createDataFrame([(9, "High", "US", "early"), (10, "High", "US", "a"), (25, "Low", "US", "gap"), (40, "high", "EU", "c"), (41, "High", "US", "late")], "ts_ns long, impact string, country string, title string")
    assert {(r.bar_id, r.events, r.first_title) for r in J.calendar_hits(b, cal).collect()} == {(0, 1, "a"), (1, 2, "gap")}
    assert {(r.bar_id, r.events) for r in J.calendar_hits(b, cal, "High", ("EU",)).collect()} == {(1, 1)}


def test_empty_tape(spark):
    t = spark.createDataFrame([], TAPE)
    rows = B.time_bar_ids(t, 60)
    b, lv = B.bars(rows), B.ladder(rows, 0.25)
    assert FE.trade_flow(B.with_poc(b, lv).drop("poc"), lv, rows, 0.25).count() == 0
    assert B.bars(B.range_bar_ids(t, 30)).count() == 0
