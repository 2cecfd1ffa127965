"""Folds whose next step needs the one before, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Fold = Callable[[pd.DataFrame], pd.DataFrame]


def sequential(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], adds: list[tuple[str, str]], only: list[str] | None = None) -> DataFrame:
    """Runs a fold over each key's rows in order.

    Rows are dealt by key and sorted; a task passes them on in pieces, and keeps for each key no more than the fold
    object ``make`` returns, which gets the key's next rows and returns them with the columns ``adds`` (name, type).
    So a key of any length fits, but it is one task's work: parallelism comes from the number of keys.
    """
    names = only or df.columns
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in adds))
    schema = T.StructType([*(df.schema[c] for c in names), *added.fields])
    out = [f.name for f in schema.fields]

    def run(pieces):
        last, fold = object(), None
        for pdf in pieces:
            if not len(pdf):
                continue
            group = (pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum()
            for _, part in pdf.groupby(group, sort=False):
                key = tuple(part.iloc[0][keys])
                if key != last:
                    last, fold = key, make()
                yield fold(part.reset_index(drop=True))[out]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
