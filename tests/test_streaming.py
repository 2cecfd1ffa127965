"""A stream over files gives the bars that the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.book import book_states
from barloom.operators.indicators import zigzag
from barloom.streaming import states as ST
from barloom.streaming.bars import stream_range_bars, stream_session_bars, stream_sliding_bars, stream_time_bars

TAPE = "symbol string, seq long, ts_ns long, price double, size double, side int"


def tape():
    r = random.Random(4)
    return [(f"S{k}", i, i * 7_000_000_000, 100 + r.randint(-30, 30) / 4, float(r.randint(1, 9)), r.choice([1, -1])) for k in range(2) for i in range(300)]


def streamed(spark, tmp_path, rows, make, name, schema=TAPE):
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 100 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in{part}"))
    src = tmp_path / f"{name}-src"
    for part in range(3):
        spark.read.parquet(str(tmp_path / f"{name}-in{part}")).coalesce(1).write.mode("append").parquet(str(src))
        query = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_range_bars(spark, tmp_path):
    rows = tape()
    got = streamed(spark, tmp_path, rows, lambda t: stream_range_bars(t, 20, 0.25), "range")
    want = B.bars(B.range_bar_ids(spark.createDataFrame(rows, TAPE), 20, 0.25))
    key = lambda df: {(r.symbol, r.bar_id): (r.open, r.high, r.low, r.close, r.volume, r.trades, r.delta) for r in df.collect()}
    got, want = key(got), key(want)
    last = {s: max(b for t, b in want if t == s) for s, _ in want}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got or k[1] == last[k[0]] for k in want)


def test_time_bars(spark, tmp_path):
    rows = tape()
    got = streamed(spark, tmp_path, rows, lambda t: stream_time_bars(t, 60, "0 seconds"), "time")
    want = B.bars(B.time_bar_ids(spark.createDataFrame(rows, TAPE), 60))
    key = lambda df: {(r.symbol, r.bar_id): (r.open, r.high, r.low, r.close, r.volume, r.trades, r.delta) for r in df.collect()}
    got, want = key(got), key(want)
    assert len(got) > 40 and all(want[k] == v for k, v in got.items())


def test_states(spark, tmp_path):
    """Pivots, book levels and histories of a stream are those of the batch operators."""
    r = random.Random(8)
    rows = [(s, i, i, 100.0 + (k := r.randint(-20, 20)), 99.0 + k, 99.5 + k) for s in ("A", "B") for i in range(300)]
    schema = "symbol string, seq long, bar_id long, high double, low double, close double"
    bar = spark.createDataFrame(rows, schema)
    got = streamed(spark, tmp_path, rows, lambda t: ST.stream_zigzag(t, 12.0, 15.0, 2), "pivots", schema)
    pivots = lambda df: sorted((x.symbol, x.bar_index, x.pivot_kind, x.pivot_price, x.pivot_bar) for x in df.collect())
    assert pivots(got) == pivots(zigzag(bar, 12.0, 15.0, 2)) and got.count() > 10
    held = streamed(spark, tmp_path, rows, lambda t: ST.stream_history(t, 5), "history", schema).collect()
    close = {(x[0], x[2]): x[5] for x in rows}
    assert len(held) == 600 and all(x.closes == [close[x.symbol, b] for b in range(max(0, x.bar_id - 4), x.bar_id + 1)] for x in held)


def test_book_states(spark, tmp_path):
    r = random.Random(9)
    rows = [("A", i, i, r.choice(["add", "reduce", "set"]), 10.0 + r.randint(0, 3), float(r.randint(0, 9)), r.choice([1, -1])) for i in range(300)]
    schema = "symbol string, seq long, ts_ns long, kind string, price double, size double, side int"
    got = streamed(spark, tmp_path, rows, lambda t: ST.stream_book_states(t, 1.0), "book", schema)
    want = book_states(spark.createDataFrame(rows, schema), 1.0)
    key = lambda df: sorted((x.side, x.tick_key, x.seq, x.level_size) for x in df.collect())
    assert key(got) == key(want)


@pytest.fixture
def lists(spark):
    """A state store that keeps lists and timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def shuffled(rows, near, seed=3):
    """Rows that come up to ``near`` places too early or late, in triggers that cut across their order."""
    r = random.Random(seed)
    return sorted(rows, key=lambda x: x[1] + r.uniform(0, near))


def replayed(spark, tmp_path, rows, make, name, schema):
    """What a stream gives of rows that arrive in three parts as they are listed."""
    src, cut = tmp_path / f"{name}-src", len(rows) // 3 + 1
    for k in range(0, len(rows), cut):
        spark.createDataFrame(rows[k : k + cut], schema).coalesce(1).write.mode("append").parquet(str(src))
        query = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


SECOND = 10**9


def test_shuffled_replay_gives_the_batch_rows(spark, tmp_path, lists):
    """Range bars, pivots and book levels of events that come out of order, up to the watermark; a last event, far later, pushes it."""
    rows = [(s, i, (i + 1) * SECOND, *x) for s, i, _, *x in tape()]  # no time is before the watermark that a stream begins with, 0
    ends = [(s, 10**6, 10**6 * SECOND, 100.0, 1.0, 1) for s in ("S0", "S1")]
    got = replayed(spark, tmp_path, [*shuffled(rows, 40), *ends], lambda t: stream_range_bars(t, 20, 0.25, "60 seconds"), "range", TAPE)
    want = B.bars(B.range_bar_ids(spark.createDataFrame(rows, TAPE), 20, 0.25, 0))
    key = lambda df: {(r.symbol, r.bar_id): (r.open, r.high, r.low, r.close, r.volume, r.trades, r.delta) for r in df.collect()}
    got, want = key(got), key(want)
    last = {s: max(b for t, b in want if t == s) for s, _ in want}
    assert len(got) > 30 and got == {k: v for k, v in want.items() if k in got} and all(k in got or k[1] == last[k[0]] for k in want)

    r = random.Random(8)
    bars = [(s, i, i, 100.0 + (k := r.randint(-20, 20)), 99.0 + k, (i + 1) * SECOND) for s in ("A", "B") for i in range(300)]
    schema = "symbol string, seq long, bar_id long, high double, low double, ts_last_ns long"
    end = [(s, 10**6, 10**6, 100.0, 99.0, 10**6 * SECOND) for s in ("A", "B")]
    got = replayed(spark, tmp_path, [*shuffled(bars, 30), *end], lambda t: ST.stream_zigzag(t, 12.0, 15.0, 2, late="60 seconds"), "pivots", schema)
    pivots = lambda df: sorted((x.symbol, x.bar_index, x.pivot_kind, x.pivot_price, x.pivot_bar) for x in df.collect())
    assert pivots(got) == pivots(zigzag(spark.createDataFrame(bars, schema), 12.0, 15.0, 2, 0)) and got.count() > 10

    book = [("A", i, (i + 1) * SECOND, r.choice(["add", "reduce", "set"]), 10.0 + r.randint(0, 3), float(r.randint(0, 9)), r.choice([1, -1])) for i in range(300)]
    schema = "symbol string, seq long, ts_ns long, kind string, price double, size double, side int"
    end = [("A", 10**6 + k, 10**6 * SECOND, "add", 10.0 + k % 4, 1.0, 1 - 2 * (k // 4)) for k in range(8)]
    got = replayed(spark, tmp_path, [*shuffled(book, 30), *end], lambda t: ST.stream_book_states(t, 1.0, "60 seconds"), "book", schema)
    want = book_states(spark.createDataFrame(book, schema), 1.0)
    key = lambda df: sorted((x.side, x.tick_key, x.seq, x.level_size) for x in df.collect())
    assert key(got) == key(want)


def test_events_behind_the_watermark_are_left_out(spark, tmp_path, lists):
    rows = [("A", k, k * SECOND, 100.0, float(k), 1) for k in (1, 2, 3, 900, 901, 4, 902, 5000, 5001)]
    schema = "symbol string, bar_id long, ts_last_ns long, high double, close double, side int"
    got = replayed(spark, tmp_path, rows, lambda t: ST.stream_history(t, 3, late="10 seconds"), "history", schema)
    assert sorted((x.bar_id, x.closes) for x in got.collect()) == [(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (900, [2.0, 3.0, 900.0]), (901, [3.0, 900.0, 901.0]), (902, [900.0, 901.0, 902.0])]


def test_sliding_and_session_windows(spark, tmp_path):
    """Runs of trades without a gap are the islands of a batch query, also where a late trade joins two; sliding bars are
    those of each beginning."""
    r, rows, t = random.Random(6), [], 0
    for k in range(300):
        t += r.choice([1, 2, 3, 40])
        rows.append((f"S{k % 2}", k, t * SECOND, 100 + r.randint(-30, 30) / 4, float(r.randint(1, 9)), r.choice([1, -1])))
    batch = spark.createDataFrame(rows, TAPE)
    late = sorted(rows, key=lambda x: x[1] + r.uniform(0, 4))
    got = replayed(spark, tmp_path, late, lambda s: stream_session_bars(s, 20, "600 seconds"), "session", TAPE)
    key = lambda df: {(x.symbol, x.bar_id): (x.open, x.high, x.low, x.close, x.volume, x.trades, x.delta) for x in df.collect()}
    from pyspark.sql import Window

    by = Window.partitionBy("symbol").orderBy("ts_ns", "seq")
    new = (F.col("ts_ns") - F.lag("ts_ns").over(by) >= 20 * SECOND).cast("int")
    islands = batch.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("bar_id", F.sum("new").over(by))
    want = {(s, v[0]): v[1:] for (s, _), v in ((k, v) for k, v in {(x.symbol, x.bar_id): (x.ts_first_ns // SECOND, x.open, x.high, x.low, x.close, x.volume, x.trades, x.delta) for x in B.bars(islands).collect()}.items())}
    got = key(got)
    assert len(got) > 20 and all(want[k] == v for k, v in got.items())
    got = key(replayed(spark, tmp_path, late, lambda s: stream_sliding_bars(s, 60, 20, "600 seconds"), "sliding", TAPE))
    for (s, b), v in got.items():
        own = [x for x in rows if x[0] == s and b * 20 <= x[2] // SECOND < b * 20 + 60]
        assert v[4] == sum(x[4] for x in own) and v[5] == len(own) and v[0] == own[0][3]
    assert len(got) > 50
