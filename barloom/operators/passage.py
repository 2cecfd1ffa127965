"""The first bar that passes a level, however far ahead.

Bars are packed in blocks, and rows that look for a bar go to blocks, so no row carries the bars that follow it. In a
block, maxima and minima of runs of 1, 2, 4, ... bars find each row's bar in logarithmic steps, for all rows at once. A row
that finds none in its own block looks, in the same way, among its symbol's blocks for the first that passes a level, and
then goes to that block alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.storage import small, written

from .scans import BLOCK, pack, packed, unpacked

#: No bar.
_NONE = -1


def first_beyond(high: np.ndarray, low: np.ndarray, start: np.ndarray, stop: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each row, the first place from ``start`` and before ``stop`` whose high is at least ``above`` or whose low is at
    most ``below``, or -1. A level that is not a number is never passed."""
    top, bottom = [high], [low]
    while 2 << (len(top) - 1) <= len(high):
        n = 1 << (len(top) - 1)
        top.append(np.fmax(top[-1][:-n], top[-1][n:]))
        bottom.append(np.fmin(bottom[-1][:-n], bottom[-1][n:]))
    at, stop = start.astype(np.int64), np.minimum(stop, len(high))
    for k in range(len(top) - 1, -1, -1):  # over runs of 2**k bars in which nothing passes
        n = 1 << k
        own = np.flatnonzero(at + n <= stop)
        i = at[own]
        clear = ~((top[k][i] >= above[own]) | (bottom[k][i] <= below[own]))
        at[own[clear]] += n
        if k == len(top) - 1:  # the longest runs may be needed again and again
            while clear.any():
                own = own[clear]
                own = own[at[own] + n <= stop[own]]
                i = at[own]
                clear = ~((top[k][i] >= above[own]) | (bottom[k][i] <= below[own]))
                at[own[clear]] += n
    found = np.full(len(at), _NONE)
    open_ = np.flatnonzero(at < stop)
    i = at[open_]
    hit = (high[i] >= above[open_]) | (low[i] <= below[open_])
    found[open_[hit]] = i[hit]
    return found


_ADDS = "place long, passed long, passed_high double, passed_low double"


def _marked(rows: pa.Table, place: np.ndarray, hit: np.ndarray, first: int, high: np.ndarray, low: np.ndarray) -> pa.Table:
    """Rows with their own place and the bar of this block that each passes, if any."""
    none, at = hit < 0, np.maximum(hit, 0)
    adds = {"place": pa.array(place), "passed": pa.array(first + at, mask=none), "passed_high": pa.array(high[at], mask=none), "passed_low": pa.array(low[at], mask=none)}
    for name, values in adds.items():
        rows = rows.append_column(name, values)
    return rows


def _levels(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(c).to_numpy().astype(float) for c in ("__above", "__below"))


def _prices(bars: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(bars.column(c).to_numpy().astype(float) for c in ("high", "low"))


def _heads(pieces):
    for pdf in pieces:
        found = [(b.symbol, b.block, b.first, b.n, *(f(x) for f, x in zip((np.fmax.reduce, np.fmin.reduce), _prices(unpacked(b.data)), strict=True))) for b in pdf.itertuples(index=False)]
        yield pd.DataFrame(found, columns=["symbol", "block", "first", "n", "high", "low"])


def _asked(horizon: int):
    """Each block's rows: those that need no other block with what they found, and those that go on to each other block."""

    def run(pieces):
        for pdf in pieces:
            out = []
            for b in pdf.itertuples(index=False):
                rows = unpacked(b.data)
                (above, below), (high, low) = _levels(rows), _prices(rows)
                own = np.arange(len(rows))
                hit = first_beyond(high, low, own + 1, np.minimum(own + 1 + horizon, len(rows)), above, below)
                until = b.first + own + 1 + horizon
                on = np.flatnonzero((hit < 0) & (until > b.first + b.n) & ~(np.isnan(above) & np.isnan(below)))
                block, first, top, bottom = (np.array(x) for x in (b.blocks, b.firsts, b.highs, b.lows))
                start = np.full(len(on), np.searchsorted(block, b.block, "right"))
                stop = np.maximum(np.searchsorted(first, until[on], "left"), start)
                to = first_beyond(top, bottom, start, stop, above[on], below[on])
                target = np.full(len(rows), _NONE)
                target[on] = to
                for t in np.unique(target).tolist():
                    some = np.flatnonzero(target == t)
                    part = _marked(rows.take(pa.array(some)), b.first + some, hit[some], b.first, high, low)
                    out.append((b.symbol, None if t == _NONE else int(block[t]), packed(part)))
            yield pd.DataFrame({"symbol": [x[0] for x in out], "target": pd.array([x[1] for x in out], "Int64"), "rows": [x[2] for x in out]})

    return run


def _found(names: list[str], horizon: int):
    """Rows of packed pieces; those that bring a block's data look for their bar in it."""

    def run(pieces):
        for pdf in pieces:
            for b in pdf.to_dict("records"):
                rows = unpacked(b["rows"])
                if "data" in b:
                    place, (high, low) = rows.column("place").to_numpy(), _prices(unpacked(b["data"]))
                    stop = np.clip(place + 1 + horizon - b["first"], 0, len(high))
                    hit = first_beyond(high, low, np.zeros(len(rows), np.int64), stop, *_levels(rows))
                    rows = _marked(rows.drop_columns([c.split()[0] for c in _ADDS.split(", ")]), place, hit, b["first"], high, low)
                out = rows.to_pandas(integer_object_nulls=True)
                out["symbol"] = b["symbol"]
                yield out[names]

    return run


def first_passage(bar: DataFrame, above: Column, below: Column, horizon: int, block: int | None = None) -> DataFrame:
    """``bar`` (symbol, bar_id, high, low and others) with ``place``, its place among the symbol's bars from 0, and, of the
    first of the ``horizon`` bars after it whose high is at least ``above`` or whose low is at most ``below``, the place
    ``passed`` and its prices ``passed_high`` and ``passed_low``: null if there is none. A level that is null or not a
    number is never passed; prices that are null or not numbers pass nothing.

    A block has the bars of ``block`` consecutive ids. A row is shuffled to its own block and, if it goes on, in a piece
    with its block's other rows to one more. Of each symbol a row a block is kept together: one for BLOCK bars.
    """
    nan = F.lit(float("nan"))
    rows = bar.withColumns({"__above": F.coalesce(above.cast("double"), nan), "__below": F.coalesce(below.cast("double"), nan)})
    blocks = pack(rows, "symbol", "bar_id", block or BLOCK)
    kind = bar.schema["symbol"].dataType.simpleString()
    heads = blocks.mapInPandas(_heads, f"symbol {kind}, block long, first long, n long, high double, low double")
    listed = F.sort_array(F.collect_list(F.struct("block", "first", "high", "low")))
    heads = heads.groupBy("symbol").agg(listed.alias("h")).select("symbol", F.col("h.block").alias("blocks"), F.col("h.first").alias("firsts"), F.col("h.high").alias("highs"), F.col("h.low").alias("lows"))
    both = blocks.alias("b").join(small(written(heads, "heads")).alias("h"), F.col("b.symbol").eqNullSafe(F.col("h.symbol"))).select("b.*", "blocks", "firsts", "highs", "lows")
    pieces = written(both.mapInPandas(_asked(horizon), f"symbol {kind}, target long, rows binary"), "pieces")
    schema = T.StructType([*bar.schema.fields, *T.StructType.fromDDL(_ADDS).fields])
    here = pieces.where("target is null").select("symbol", "rows").mapInPandas(_found(schema.names, horizon), schema)
    same = F.col("p.symbol").eqNullSafe(F.col("b.symbol")) & (F.col("p.target") == F.col("b.block"))
    there = pieces.where("target is not null").alias("p").join(blocks.alias("b"), same).select("p.symbol", "p.rows", "b.first", "b.data")
    return here.unionAll(there.mapInPandas(_found(schema.names, horizon), schema))
