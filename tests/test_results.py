"""Visual output, samples, JSON of a run, the heatmap store and the range join."""

import json
import random

from pyspark.sql import functions as F

from barloom.operators import features as FE
from barloom.operators import results as RE
from barloom.operators.joins import binned_range_join
from barloom.sources import heatmap_store as HS
from barloom.sources.heatmap_store import read_samples, write_samples


def test_range_join(spark):
    """Long, short, empty and negative spans meet the points that they hold, once each."""
    r = random.Random(3)
    points = [("a" if i % 3 else "b", r.randint(-50_000, 50_000)) for i in range(300)] + [("a", 7), ("a", 7)]
    spans = [("a" if i % 2 else "b", i, s := r.randint(-50_000, 50_000), s + r.choice([0, 1, 5, 300, 20_000, 100_000])) for i in range(120)]
    got = binned_range_join(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, i long, lo long, hi long"), ["k"], "at", "lo", "hi", 4)
    want = sorted((k, at, i) for k, at in points for k2, i, lo, hi in spans if k == k2 and lo <= at < hi)
    assert sorted((x.k, x.at, x.i) for x in got.collect()) == want


def test_numbered_trades(spark):
    """Places go on across blocks, whatever the gaps in ``seq``."""
    rows = [("S" if i % 4 else "T", i // 10, float(i), i * i) for i in range(200)]
    got = FE.numbered_trades(spark.createDataFrame(rows, "symbol string, bar_id long, size double, seq long"), 512).collect()
    want = {(s, size): n for sym in "ST" for n, (s, _, size, _) in enumerate([x for x in rows if x[0] == sym], 1)}
    assert {(x.symbol, x.size): x.i for x in got} == want and len(got) == 200


def test_visual_series(spark):
    rows = [("r", "a", 0, 1.0, None), ("r", "a", 1, 2.0, "red"), ("r", "a", 2, 3.0, "blue"), ("r", "b", 0, 1.0, "")]
    got = RE.visual_series(spark.createDataFrame(rows, "run_id string, id string, bar_index long, value double, color string")).collect()
    assert {(x.id, x.color) for x in got} == {("a", "red"), ("b", "")} and len(got) == 4


def test_sampled_trades(spark):
    """The same trades at every partitioning; a trade that neither wins nor loses has won."""
    rows = spark.createDataFrame([(i, float(i - 50)) for i in range(100)], "id long, pnl double")
    ids = lambda df: [x.id for x in df.collect()]
    a = ids(RE.sampled_trades(rows, F.col("id"), 10, 1, "winners"))
    assert a == ids(RE.sampled_trades(rows.repartition(7), F.col("id"), 10, 1, "winners")) and len(a) == 10 and min(a) >= 50
    assert a != ids(RE.sampled_trades(rows, F.col("id"), 10, 2, "winners"))
    assert sorted(ids(RE.with_outcome(rows, "losers"))) == [*range(50)] and 50 in ids(RE.with_outcome(rows, "winners"))


def test_newest_first(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "session_id string, ts_ns long")
    assert [x.session_id for x in RE.newest_first(rows).collect()] == ["b", "c", "a"]


def test_result_json(spark):
    metrics = spark.createDataFrame([("r", 5.0), ("none", 0.0)], "run_id string, net_pnl double")
    trades = spark.createDataFrame([("r", 20, 3.0), ("r", 10, 2.0)], "run_id string, entry_ts_ns long, pnl double")
    equity = spark.createDataFrame([("r", 1, 0, 100.0), ("r", 2, 1, 90.0), ("r", 3, 2, 105.0)], "run_id string, ts_ns long, bar_id long, equity double")
    got = {x.run_id: json.loads(x.json) for x in RE.result_json(metrics, trades, equity).collect()}
    assert got["none"] == {"metrics": {"net_pnl": 0.0}, "trades": [], "equity": []}
    assert [t["pnl"] for t in got["r"]["trades"]] == [2.0, 3.0] and [e["drawdown"] for e in got["r"]["equity"]] == [0.0, -10.0, 0.0]


def test_heatmap_store(spark, tmp_path):
    rows = [("U", b, 1, k, float(b + k)) for b in range(50) for k in range(4)] + [("V", 3, 1, 1, 1.0)]
    write_samples(spark.createDataFrame(rows, "symbol string, bucket long, side int, tick_key long, size double"), str(tmp_path / "heat"))
    got = read_samples(spark, str(tmp_path / "heat"), "U", 10, 12)
    assert sorted(tuple(x) for x in got.collect()) == [x for x in rows if x[0] == "U" and 10 <= x[1] < 12]
    assert "GreaterThanOrEqual(bucket,10)" in got._jdf.queryExecution().executedPlan().toString()


def test_trade_store(spark, tmp_path):
    """Windows of stored trades are those of the table; a window reads the blocks that it touches; ties and null rows."""
    r, rows = random.Random(2), []
    for k in range(3000):
        rows.append((r.choice("AB"), k, (k // 3) * 10**9, 100 + r.randint(-9, 9) / 4, float(r.randint(1, 9)), r.choice([1, -1])))
    rows.append(("A", 9999, None, 1.0, 1.0, 1))
    table = spark.createDataFrame(rows, "symbol string, seq long, ts_ns long, price double, size double, side int").repartition(4)
    path = str(tmp_path / "trades")
    HS.write_trades(table, path, 100)
    blocks = spark.read.parquet(path)
    assert blocks.agg(F.sum("n")).first()[0] == 3000 and blocks.where("n > 100").count() == 0
    for t0, t1 in ((0, 10**12), (100 * 10**9, 103 * 10**9), (5, 6), (999 * 10**9, 10**15), (-5, -1)):
        want = sorted(x[2:] for x in rows if x[0] == "A" and x[2] is not None and t0 <= x[2] <= t1)
        got = HS.read_trades(spark, path, "A", t0, t1)
        assert sorted((x.ts_ns, x.price, x.size, x.side) for x in got.collect()) == want
        later = [x[2] for x in rows if x[0] == "A" and x[2] is not None and x[2] > t1]
        assert HS.next_trade_ns(spark, path, "A", t1).first()[0] == min(later, default=None)
    few = blocks.where("symbol = 'A' and last_ns >= 100000000000 and first_ns <= 103000000000").count()
    assert 1 <= few <= 3 < blocks.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = HS.read_trades(spark, path, "A", 0, 5)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(last_ns,0)" in plan and "LessThanOrEqual(first_ns,5)" in plan
    assert HS.read_trades(spark, path, "none", 0, 5).count() == 0
