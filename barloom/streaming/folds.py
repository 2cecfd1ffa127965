"""Folds over the events of each key of a stream, as they come or in the order of their times."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A fold gets its key and the next events in order and returns rows of its output; it can be pickled.
Fold = Callable[[tuple, pd.DataFrame], pd.DataFrame]
_HELD = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("event", T.BinaryType())])
_FOLD = T.StructType([T.StructField("fold", T.BinaryType())])


def folded(events: DataFrame, keys: list[str], order: str, make: Callable[[], Fold], schema: str, ts: Column | None = None, late: str | None = None) -> DataFrame:
    """What a fold makes of each key's events; its object is the state.

    Without ``late``, events of one trigger are put in the order of ``order``, and across triggers they are taken as
    they come. With it, events are held until the watermark, ``late`` behind the newest ``ts``, has passed them, and then
    go in the order of their times, by milliseconds, and of ``order``; a later event is left out. So any arrival within
    ``late`` gives the same rows. This form needs a state store that keeps lists, such as RocksDB's.
    """
    if late is None:

        def step(key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            fold = pickle.loads(state.get[0]) if state.exists else make()
            out = fold(key, pd.concat(list(pieces)).sort_values(order))
            state.update((pickle.dumps(fold),))
            yield out

        return events.groupBy(*keys).applyInPandasWithState(step, schema, "fold binary", "append", GroupStateTimeout.NoTimeout)
    # Names that begin with an underscore do not reach the processor.
    timed = events.withColumn("time__", ts).withWatermark("time__", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_InOrder(keys, order, make, schema), T.StructType.fromDDL(schema), "append", "EventTime")


def time_of(ts_ns: str = "ts_ns") -> Column:
    return F.timestamp_micros(F.expr(f"{ts_ns} div 1000"))


class _InOrder(StatefulProcessor):
    """Holds events in a list until the watermark passes them; one timer, at the first of them, is set at a time."""

    def __init__(self, keys: list[str], order: str, make: Callable[[], Fold], schema: str):
        self.keys, self.order, self.make = keys, order, make
        self.columns = T.StructType.fromDDL(schema).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.fold = handle.getValueState("fold", _FOLD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = []
        for pdf in rows:
            at = pdf["time__"].astype("datetime64[ms]").astype("int64").tolist()
            rest = [c for c in pdf.columns if c not in ("time__", *self.keys)]
            held += [(t, int(s), pickle.dumps(e)) for t, s, e in zip(at, pdf[self.order].tolist(), pdf[rest].to_dict("records"), strict=True) if t > passed]
        if held:
            self.held.appendList(held)
            self._wake(min(t for t, _, _ in held))
        return iter(())

    def _wake(self, at: int) -> None:
        timers = [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.held.get()]
        ready, later = sorted(x for x in held if x[0] <= passed), [x for x in held if x[0] > passed]
        if later:
            self.held.put(later)
            self.handle.registerTimer(min(t for t, _, _ in later))
        else:
            self.held.clear()
        if not ready:
            return
        fold = pickle.loads(bytes(self.fold.get()[0])) if self.fold.exists() else self.make()
        out = fold(key, pd.DataFrame([pickle.loads(bytes(e)) for _, _, e in ready]))
        self.fold.update((pickle.dumps(fold),))
        yield out[self.columns]

    def close(self) -> None:
        pass
