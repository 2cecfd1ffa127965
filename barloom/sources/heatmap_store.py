"""Sampled book levels and trades on disk, in order of time, so that a window reads the blocks that it touches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ship_package

#: Trades of a block; each block has an entry, its first and last time, in the columns by which it is found.
BLOCK_TRADES = 4096
#: A trade as stored: 21 bytes.
RECORD = np.dtype([("ts_ns", "<i8"), ("price", "<f8"), ("size", "<f4"), ("buy", "u1")])
_BLOCKS = "symbol string, first_ns long, last_ns long, n int, records binary"
_TRADES = "symbol string, ts_ns long, price double, size double, side int"


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples (symbol, bucket, side, tick_key, size) as Parquet: ranges of symbol and bucket, sorted within."""
    order = ("symbol", "bucket", "tick_key", "side")
    samples.repartitionByRange("symbol", "bucket").sortWithinPartitions(*order).write.parquet(path)


def read_samples(spark: SparkSession, path: str, symbol: str, first: int, stop: int) -> DataFrame:
    """Samples of a symbol in buckets from ``first``, before ``stop``; the bounds reach the scan, whose statistics skip the rest."""
    return spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("bucket") >= first) & (F.col("bucket") < stop))


def _records(block: int):
    """Blocks of trades that come sorted by symbol and time."""

    def out(symbol: str, t: pa.Table) -> pa.RecordBatch:
        made = np.zeros(len(t), RECORD)
        made["ts_ns"], made["price"], made["size"], made["buy"] = (t.column(c).to_numpy() for c in ("ts_ns", "price", "size", "buy"))
        return pa.RecordBatch.from_arrays([pa.array([symbol], pa.string()), pa.array([int(made["ts_ns"][0])]), pa.array([int(made["ts_ns"][-1])]), pa.array([len(made)], pa.int32()), pa.array([made.tobytes()])], names=["symbol", "first_ns", "last_ns", "n", "records"])

    def run(batches):
        symbol, held = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            while len(t):
                name = t.column("symbol")[0].as_py()
                same = int(np.searchsorted(t.column("symbol").to_numpy() != name, True)) if t.column("symbol")[-1].as_py() != name else len(t)
                if held is not None and name != symbol and len(held):
                    yield out(symbol, held)
                    held = None
                part = t.slice(0, same)
                held, symbol, t = part if held is None else pa.concat_tables([held, part]), name, t.slice(same)
                while len(held) >= block:
                    yield out(symbol, held.slice(0, block))
                    held = held.slice(block)
        if held is not None and len(held):
            yield out(symbol, held)

    return run


def write_trades(trades: DataFrame, path: str, block: int = BLOCK_TRADES, row_group_bytes: int = 8 << 20) -> None:
    """Trades (symbol, seq, ts_ns, price, size, side) in blocks of fixed-length records, by symbol, time and ``seq``.

    Symbols and times are dealt in ranges, so a symbol is many tasks' work. Sizes are kept as 32-bit numbers; rows with a
    missing value are left out.
    """
    ship_package(trades.sparkSession)
    rows = trades.select("symbol", "ts_ns", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("float").alias("size"), (F.col("side") > 0).cast("int").alias("buy")).dropna()
    dealt = rows.repartitionByRange("symbol", "ts_ns", "seq").sortWithinPartitions("symbol", "ts_ns", "seq")
    dealt.mapInArrow(_records(block), _BLOCKS).write.option("parquet.block.size", row_group_bytes).parquet(path)


def _decoded(t0: int, t1: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                made = np.frombuffer(batch.column("records")[i].as_buffer(), RECORD)
                a, b = np.searchsorted(made["ts_ns"], [t0, t1 + 1])
                made = made[a:b]
                if len(made):
                    columns = [pa.array(np.ascontiguousarray(made[c])) for c in ("ts_ns", "price")]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("symbol")[i].as_py()] * len(made), pa.string()), *columns, pa.array(made["size"].astype(float)), pa.array(np.where(made["buy"] > 0, 1, -1).astype(np.int32))], names=["symbol", "ts_ns", "price", "size", "side"])

    return run


def read_trades(spark: SparkSession, path: str, symbol: str, t0: int, t1: int) -> DataFrame:
    """Trades of a symbol from ``t0`` to ``t1``, both included. The blocks' times reach the scan, and a block's own records are
    found by binary search."""
    ship_package(spark)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    touched = blocks.where((F.col("symbol") == symbol) & (F.col("last_ns") >= t0) & (F.col("first_ns") <= t1))
    return touched.mapInArrow(_decoded(t0, t1), _TRADES)


def next_trade_ns(spark: SparkSession, path: str, symbol: str, t1: int) -> DataFrame:
    """One row, ``next_trade_ns``: the time of the symbol's first trade after ``t1``, null if there is none."""
    blocks = spark.read.schema(_BLOCKS).parquet(path).where((F.col("symbol") == symbol) & (F.col("last_ns") > t1))
    first = blocks.agg(F.min("last_ns")).scalar()  # the block in which it is ends no later than any other that is left
    inside = blocks.where(F.col("last_ns") == first).mapInArrow(_decoded(t1 + 1, (1 << 63) - 2), _TRADES)
    return inside.agg(F.min("ts_ns").alias("next_trade_ns"))
