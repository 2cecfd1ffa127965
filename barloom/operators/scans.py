"""Folds over keys of any length, whose blocks run side by side.

A key's rows are dealt to blocks by their order number, and each block is packed into one row of a written table. Two
kinds of folds find what a block begins with:

* ``scan``: every block first runs from a fresh start. Then what a block ended with is what the next begins with, and
  the blocks whose beginning changed run again, until none does. Folds that soon forget how they began, as bars and
  pivots do, need one repeat; any other is still right, as each repeat settles one more block of a key at least.
* ``affine_scan``: a block is an affine map of what it begins with, and the maps are composed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from itertools import accumulate
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import ship_package
from barloom.storage import estimated_bytes, small, written

from .sequential import sequential

#: Order numbers of a block.
BLOCK = 1 << 16
#: Tables of fewer bytes, as the optimizer sees them, run as one fold a key.
SMALL_BYTES = 32 << 20


class Fold(Protocol):
    """A fold over the rows of a key. ``count`` may number what it makes and is no part of its state."""

    count: int

    def state(self) -> tuple: ...
    def restore(self, state: tuple) -> None: ...
    def __call__(self, pdf: pd.DataFrame, first: int) -> pd.DataFrame:
        """The next rows, of which ``first`` of their key come before, with the columns that the fold adds."""


class _InOrder:
    """A fold for ``sequential`` that counts the rows before."""

    def __init__(self, fold: Fold):
        self.fold, self.first = fold, 0

    def __call__(self, pdf):
        out = self.fold(pdf, self.first)
        self.first += len(pdf)
        return out


def packed(table: pa.Table) -> bytes:
    """Rows as Arrow data."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _blocks_of(key: str):
    """Packs rows that come sorted by key and __block: a row for each block, with its rows as Arrow data."""

    def out(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        data = packed(t.drop_columns([key, "__block"]))
        return pa.RecordBatch.from_arrays([t.column(key).slice(0, 1).combine_chunks(), t.column("__block").slice(0, 1).combine_chunks(), pa.array([len(t)], pa.int64()), pa.array([data], pa.binary())], names=[key, "block", "n", "data"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            of, block = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column("__block").to_numpy()
            new = [0, *(1 + np.flatnonzero((of[1:] != of[:-1]) | (block[1:] != block[:-1]))).tolist()]
            same = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in (key, "__block"))
            for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
                if held and not (a == 0 and same):
                    yield out(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield out(held)

    return run


def pack(df: DataFrame, key: str, order: str, block: int = BLOCK, also: list[str] | None = None) -> DataFrame:
    """A written table with a row for each block of each key: key, block, n, first (rows of the key before it) and data,
    its rows by ``order`` and ``also``. A block has the rows of ``block`` consecutive order numbers; a null key is a key."""
    spark = df.sparkSession
    ship_package(spark)
    dealt = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "__block").sortWithinPartitions(key, "__block", order, *(also or []))
    kind = df.schema[key].dataType.simpleString()
    blocks = written(dealt.mapInArrow(_blocks_of(key), f"{key} {kind}, block long, n long, data binary"), "blocks")
    before = F.sum("n").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = written(blocks.select(key, "block", "n").withColumn("first", F.coalesce(before, F.lit(0))).drop("n"), "places")
    return beside(blocks, places, key)


def beside(blocks: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Blocks with the row that ``rows``, a written table, has for them; blocks without one go."""
    return blocks.alias("p").join(small(rows).alias("r"), F.col(f"p.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("p.block") == F.col("r.block"))).select("p.*", *(F.col(f"r.{c}") for c in rows.columns if c not in (key, "block")))


def _previous(key: str, *columns: Column) -> list[Column]:
    return [F.lag(c).over(Window.partitionBy(key).orderBy("block")) for c in columns]


def scan(df: DataFrame, key: str, order: str, make: Callable[[], Fold], adds: list[tuple[str, str]], only: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Runs a fold over each key's rows by ``order``: the columns ``only``, or all, with those that the fold adds.

    A key's rows are dealt to many tasks, by blocks of ``block`` order numbers. With 0, or if it isn't given and the
    table has fewer than SMALL_BYTES by the optimizer's estimate, keys are folded one a task, which gives the same rows.
    """
    names = only or df.columns
    if block == 0 or block is None and estimated_bytes(df) < SMALL_BYTES:
        return sequential(df, [key], [order], lambda: _InOrder(make()), adds, names)
    kind, adds_sql = df.schema[key].dataType.simpleString(), ", ".join(f"{a} {t}" for a, t in adds)
    blocks = pack(df, key, order, block or BLOCK)

    def start(row) -> Fold:
        fold = make()
        if row.begin is not None:
            fold.restore(pickle.loads(row.begin))
        return fold

    def ends(pieces):
        for pdf in pieces:
            out = []
            for row in pdf.itertuples(index=False):
                fold = start(row)
                fold(unpacked(row.data).to_pandas().assign(**{key: getattr(row, key)}), row.first)
                out.append((getattr(row, key), row.block, row.begin, pickle.dumps(fold.state()), fold.count))
            yield pd.DataFrame(out, columns=[key, "block", "begin", "end", "count"])

    schema = f"{key} {kind}, block long, begin binary, end binary, count long"
    run = lambda begun: begun.mapInPandas(ends, schema)
    done = written(run(blocks.withColumn("begin", F.lit(None).cast("binary"))), "ends")
    while True:
        (before,) = _previous(key, F.col("end"))
        changed = written(done.withColumn("__next", before).where(~F.col("__next").eqNullSafe(F.col("begin"))).select(key, "block", F.col("__next").alias("begin")), "changed")
        if changed.isEmpty():
            break
        again = run(beside(blocks, changed, key))
        kept = done.alias("d").join(small(changed).alias("c"), F.col(f"d.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("d.block") == F.col("c.block")), "left_anti")
        done = written(kept.unionByName(again), "ends")
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(done.select(key, "block", "begin", before.alias("offset")), "starts")
    schema = T.StructType([*(df.schema[c] for c in names), *T.StructType.fromDDL(adds_sql).fields])

    def rows(pieces):
        for pdf in pieces:
            for row in pdf.itertuples(index=False):
                fold = start(row)
                fold.count = row.offset
                yield fold(unpacked(row.data).to_pandas().assign(**{key: getattr(row, key)}), row.first)[schema.names]

    return beside(blocks, starts, key).mapInPandas(rows, schema)


def affine_scan(df: DataFrame, key: str, order: str, value: str, shares: dict[str, float], block: int | None = None) -> DataFrame:
    """``df`` with, for each name and share a, y = a * value + (1 - a) * (y before) over the key's rows by ``order``,
    begun with the first value. A block is the affine map from the y before it to its last one; a key's maps, one row a
    block, are composed in order. Small tables, as in ``scan``, are folded key by key."""
    adds = [(name, "double") for name in shares]
    if block == 0 or block is None and estimated_bytes(df) < SMALL_BYTES:
        return sequential(df, [key], [order], lambda: _Affine(value, shares), adds)
    blocks = pack(df, key, order, block or BLOCK)
    kind, maps = df.schema[key].dataType.simpleString(), ", ".join(f"{c}_{k} double" for k in range(len(shares)) for c in ("scale", "shift"))

    def summaries(pieces):
        for pdf in pieces:
            out = []
            for row in pdf.itertuples(index=False):
                x = unpacked(row.data).column(value).to_pandas().tolist()
                ends = [v for a in shares.values() for v in ((1 - a) ** len(x), _smooth(x, a, 0.0)[-1])]
                out.append((getattr(row, key), row.block, x[0], *ends))
            yield pd.DataFrame(out, columns=[key, "block", "head", *(c.split()[0] for c in maps.split(", "))])

    found = written(blocks.mapInPandas(summaries, f"{key} {kind}, block long, head double, {maps}"), "maps")
    carried = sequential(found, [key], ["block"], lambda: _Composed(list(shares)), [(f"__{n}", "double") for n in shares], [key, "block"])
    starts = written(carried, "starts")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in shares)])

    def rows(pieces):
        for pdf in pieces:
            for values in pdf.to_dict("records"):
                part = unpacked(values["data"]).to_pandas().assign(**{key: values[key]})
                x = part[value].tolist()
                for name, a in shares.items():
                    part[name] = _smooth(x, a, values[f"__{name}"])
                yield part[schema.names]

    return beside(blocks, starts, key).mapInPandas(rows, schema)


def _smooth(values: list[float], share: float, start: float) -> list[float]:
    return list(accumulate(values, lambda y, x: share * x + (1 - share) * y, initial=start))[1:]


class _Affine:
    """The fold itself, for ``sequential``."""

    def __init__(self, value: str, shares: dict[str, float]):
        self.value, self.shares, self.last = value, shares, {}

    def __call__(self, pdf):
        x = pdf[self.value].tolist()
        for name, a in self.shares.items():
            pdf[name] = _smooth(x, a, self.last.get(name, x[0]))
            self.last[name] = pdf[name].iloc[-1]
        return pdf


class _Composed:
    """What each block of a key begins with, from the maps of those before; the first begins with its own first value."""

    def __init__(self, names: list[str]):
        self.names, self.y = names, None

    def __call__(self, pdf):
        out = []
        for row in pdf.to_dict("records"):
            self.y = self.y or [row["head"]] * len(self.names)
            out.append(list(self.y))
            self.y = [row[f"scale_{k}"] * y + row[f"shift_{k}"] for k, y in enumerate(self.y)]
        return pdf.assign(**{f"__{n}": [o[k] for o in out] for k, n in enumerate(self.names)})
