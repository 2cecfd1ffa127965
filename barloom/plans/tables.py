"""Folds as table functions in SQL.

``select * from range_bars(table(trades) partition by symbol order by (seq), 30, 0.25)`` gives the rows of ``trades`` with
the columns that the fold adds. A partition is one task's work; the DataFrame operators deal a key's blocks to many.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barloom.operators.bars import _RangeBars
from barloom.operators.indicators import ZigZag
from barloom.operators.scans import Fold, _smooth
from barloom.session import ship_package

#: Rows that a fold gets at a time.
PIECE = 8192


class _Averages:
    """Exponential averages of ``close``."""

    def __init__(self, fast: int, slow: int):
        self.shares, self.count = {"ema_fast": 2 / (fast + 1), "ema_slow": 2 / (slow + 1)}, 0
        self.last: dict[str, float] = {}

    def state(self):
        return tuple(self.last.items())

    def restore(self, state):
        self.last = dict(state)

    def __call__(self, pdf, first):
        x = pdf["close"].tolist()
        for name, share in self.shares.items():
            pdf[name] = _smooth(x, share, self.last.get(name, x[0]))
            self.last[name] = pdf[name].iloc[-1]
        return pdf


#: Name, what makes the fold of the function's further arguments, and the columns that it adds.
FOLDS: dict[str, tuple[Callable[..., Fold], str]] = {
    "range_bars": (lambda range_ticks=30, tick=0.25: _RangeBars(range_ticks * float(tick)), "bar_id long"),
    "averages": (lambda fast=12, slow=26: _Averages(fast, slow), "ema_fast double, ema_slow double"),
    "zigzag": (lambda reversal=4.0, min_leg=0.0, min_leg_bars=0: ZigZag(float(reversal), float(min_leg), min_leg_bars), "bar_index long, pivot_kind string, pivot_price double, pivot_bar long"),
}


def table_function(make: Callable[..., Fold], adds: str):
    """A table function that runs a fold over the rows of each partition in their order, PIECE rows at a time."""
    added = T.StructType.fromDDL(adds)

    class FoldTable:
        def __init__(self):
            self.fold, self.rows, self.first, self.names = None, [], 0, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, *params: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            return AnalyzeResult(T.StructType([*rows.dataType.fields, *added.fields]))

        def eval(self, row, *params):
            if self.fold is None:
                self.fold, self.names = make(*params), list(row.asDict())
            self.rows.append(tuple(row))
            if len(self.rows) >= PIECE:
                yield from self.flush()

        def terminate(self):
            if self.rows:
                yield from self.flush()

        def flush(self):
            out = self.fold(pd.DataFrame(self.rows, columns=self.names), self.first)
            columns = [[None if v is None or v is pd.NA or v != v else v for v in out[c].tolist()] for c in added.names]
            self.first += len(self.rows)
            for row, *more in zip(self.rows, *columns, strict=True):
                yield (*row, *more)
            self.rows = []

    return udtf(FoldTable)


def register(spark: SparkSession, folds: dict[str, tuple[Callable[..., Fold], str]] | None = None) -> None:
    """Makes table functions, those of FOLDS unless others are given, known to a session's SQL."""
    ship_package(spark)
    for name, (make, adds) in (folds or FOLDS).items():
        spark.udtf.register(name, table_function(make, adds))
