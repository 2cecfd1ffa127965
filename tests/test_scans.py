"""Folds by blocks give the rows that one fold a key gives."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import labels as L
from barloom.operators import passage, scans


def tape(spark, n=4000, symbols=2, seed=1, step=1):
    r, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        price += r.choice([-1, 0, 1]) * 0.25
        rows.append((f"S{k % symbols}", k * step, k * 10**9, price + r.randint(-3, 3) / 4, float(r.randint(1, 9)), r.choice([1, -1])))
    return spark.createDataFrame(rows, "symbol string, seq long, ts_ns long, price double, size double, side int").repartition(5)


def same(a, b, digits=9):
    key = lambda df: sorted(tuple((x is None, round(x, digits) if isinstance(x, float) else x) for x in r) for r in df.collect())
    assert key(a) == key(b) and a.count()


@pytest.mark.parametrize("block", [37, 500, 100_000])
def test_range_bars(spark, block):
    rows = tape(spark)
    same(B.range_bar_ids(rows, 9, 0.25, block), B.range_bar_ids(rows, 9, 0.25, 0))


def test_bars_that_never_close_are_handed_on_through_all_blocks(spark):
    rows = tape(spark, 600)
    same(B.range_bar_ids(rows, 10**6, 0.25, 100), B.range_bar_ids(rows, 10**6, 0.25, 0))


@pytest.mark.parametrize("block", [50, 700])
def test_averages_pivots_and_thresholds(spark, block):
    trades = B.time_bar_ids(tape(spark, step=3), 5)
    bar, levels = B.bars(trades), B.ladder(trades, 0.25)
    same(I.ema(bar, 5, 12, block), I.ema(bar, 5, 12, 0))
    same(I.zigzag(bar, 2.0, 2.5, 2, block), I.zigzag(bar, 2.0, 2.5, 2, 0))
    same(I.volume_thresholds(bar, levels, 0.7, 20, 2.0, block=block), I.volume_thresholds(bar, levels, 0.7, 20, 2.0, block=0))


def test_blocks_spread_over_tasks_and_keys_may_be_null(spark):
    rows = tape(spark, symbols=1).withColumn("symbol", F.lit(None).cast("string"))
    blocks = scans.pack(rows, "symbol", "seq", 100)
    got = blocks.withColumn("task", F.spark_partition_id()).orderBy("block").collect()
    assert [r.n for r in got] == [100] * 40 and [r["first"] for r in got] == [100 * k for k in range(40)]
    assert scans.unpacked(got[3].data).column("seq").to_pylist() == list(range(300, 400))
    made = B.range_bar_ids(rows, 9, 0.25, 100)
    assert made.where("bar_id is null").count() == 0 and made.agg(F.max("bar_id")).first()[0] > 50
    assert B.range_bar_ids(rows.limit(0), 9, 0.25, 100).count() == 0


def _first(rows, i, above, below, horizon):
    for j in range(i + 1, min(i + 1 + horizon, len(rows))):
        if above is not None and rows[j][2] >= above or below is not None and rows[j][3] <= below:
            return j
    return None


@pytest.mark.parametrize(("horizon", "block"), [(5, 40), (10_000, 40), (10_000, 7), (300, 100_000)])
def test_first_passage(spark, horizon, block):
    """Levels that are passed soon, late, never, or are missing; ids with gaps."""
    r, price, rows = random.Random(horizon + block), 100.0, []
    for k in range(700):
        price += r.choice([-1, 0, 1])
        rows.append(("A" if k < 690 else None, 3 * k, price + r.random(), price - r.random(), r.choice([None, price + r.choice([1, 5, 40])]), r.choice([None, float("nan"), price - r.choice([2, 9])]), "x"))
    bar = spark.createDataFrame(rows, "symbol string, bar_id long, high double, low double, up double, down double, passed_by string").repartition(3)
    got = {(x.symbol, x.place): x for x in passage.first_passage(bar, F.col("up"), F.col("down"), horizon, block).collect()}
    assert len(got) == 700
    for symbol in ("A", None):
        own = [x for x in rows if x[0] == symbol]
        for i, x in enumerate(own):
            j = _first(own, i, x[4], None if x[5] is None or x[5] != x[5] else x[5], horizon)
            g = got[symbol, i]
            assert (g.bar_id, g.passed, g.passed_high, g.passed_low, g.passed_by) == (x[1], j, *((None, None) if j is None else own[j][2:4]), "x")


@pytest.mark.parametrize("way", [1, -1])
def test_long_labels_are_the_short_ones(spark, way):
    bar = B.bars(B.time_bar_ids(tape(spark, 1500, step=3), 7))
    for short, long in ((L.continuation(F.lit(way), 0.25, 4, 3, 6), L.with_continuation(bar, F.lit(way), 0.25, 4, 3, 6, 50)), (L.failure(F.lit(way), F.lit(0.9), horizon=8), L.with_failure(bar, F.lit(way), F.lit(0.9), horizon=8, block=50))):
        same(bar.withColumn("label", short).select("symbol", "bar_id", "label"), long.select("symbol", "bar_id", "label"))
        assert {x[0] for x in long.select("label").distinct().collect()} == {0, 1, None}
