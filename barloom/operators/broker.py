"""Broker simulation: orders fill on the next bar, lots carry brackets, and every bar is marked to market.

A strategy's decisions depend on its position, so a run is a fold over its bars; runs are independent and go to
different tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequential import sequential

#: Bars for which a resting limit is tried, after the first.
LIMIT_BARS = 8
TRADE = "entry_ts_ns: long, exit_ts_ns: long, dir: int, qty: double, entry_px: double, exit_px: double, stop: double, target: double, max_adverse_excursion: double, max_adverse_ticks: double, pnl: double, reason: string, label: string"


@dataclass(frozen=True)
class Order:
    """An intent: ``mode`` replace, add or flat. Brackets by price win over ticks."""

    dir: int
    qty: float = 1.0
    mode: str = "replace"
    limit: float | None = None
    band: tuple[float, float] | None = None
    stop: float | None = None
    target: float | None = None
    stop_ticks: float = 0.0
    target_ticks: float = 0.0
    max_delay_ns: int | None = None
    label: str = ""


@dataclass(frozen=True)
class Costs:
    commission: float = 0.0
    slippage_ticks: float = 0.0
    starting: float = 100_000.0
    tick: float = 0.25
    multiplier: float = 1.0


@dataclass
class _Lot:
    dir: int
    qty: float
    px: float
    ts: int
    stop: float | None
    target: float | None
    label: str
    intrabar: bool
    bars: int = 0
    mae: float = 0.0
    mae_ticks: float = 0.0


@dataclass
class _Resting:
    order: Order
    ts: int
    age: int = 0


@dataclass
class Broker:
    costs: Costs
    lots: list[_Lot] = field(default_factory=list)
    pending: list[_Resting] = field(default_factory=list)
    realized: float = 0.0
    peak: float = 0.0
    closed: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.realized = self.peak = self.costs.starting

    @property
    def slip(self) -> float:
        return self.costs.slippage_ticks * self.costs.tick

    @property
    def side(self) -> int:
        net = sum(x.dir * x.qty for x in self.lots)
        return (net > 0) - (net < 0)

    def submit(self, order: Order, ts: int) -> None:
        """Queues an order; all but an added one clear what is queued."""
        if order.mode != "add":
            self.pending.clear()
        self.pending.append(_Resting(order, ts))

    def cancel(self) -> None:
        self.pending.clear()

    def bar(self, bar) -> tuple[float, float]:
        """Takes a bar: fills, excursions, exits, mark to market. Returns equity and drawdown."""
        self._fill(bar)
        for lot in self.lots:
            lot.bars += 1
            self._excursion(lot, bar)
        for lot in self.lots[::-1]:  # the newest first
            self._exit(lot, bar)
        return self.mark(bar.close)

    def mark(self, price: float) -> tuple[float, float]:
        equity = self.realized + sum(x.dir * (price - x.px) * x.qty for x in self.lots) * self.costs.multiplier
        self.peak = max(self.peak, equity)
        return equity, equity - self.peak

    def finish(self, bar) -> tuple[float, float] | None:
        """Closes what is open at the last close; None if nothing was."""
        if not self.lots:
            return None
        for lot in self.lots[:]:
            self._close(lot, bar.close - lot.dir * self.slip, bar.ts_last_ns, "end_of_data")
        return self.mark(bar.close)

    def _fill(self, bar) -> None:
        kept = []
        for rest in self.pending:
            order = rest.order
            if order.max_delay_ns is not None and bar.ts_first_ns - rest.ts > order.max_delay_ns:
                continue
            if order.mode == "flat":
                self._close_all(bar)
                continue
            if order.mode == "replace" and self.lots and all(x.dir == order.dir for x in self.lots):
                continue
            price = self._price(order, bar)
            if price is None:
                if order.limit is not None and rest.age < LIMIT_BARS:
                    kept.append(replace(rest, age=rest.age + 1))
                continue
            if order.band and not order.band[0] <= price <= order.band[1]:
                continue
            if order.mode == "replace":
                self._close_all(bar)
            self._open(order, price + order.dir * self.slip, bar, intrabar=order.limit is not None and price != bar.open)
        self.pending = kept

    def _price(self, order: Order, bar) -> float | None:
        """Market orders fill at the open, limits there if it is as good, else at the limit if the bar reaches it."""
        if order.limit is None:
            return bar.open
        better, reached = (bar.open <= order.limit, bar.low <= order.limit) if order.dir > 0 else (bar.open >= order.limit, bar.high >= order.limit)
        return bar.open if better else order.limit if reached else None

    def _open(self, order: Order, px: float, bar, intrabar: bool) -> None:
        tick = self.costs.tick
        stop = order.stop if order.stop is not None else px - order.dir * order.stop_ticks * tick if order.stop_ticks > 0 else None
        target = order.target if order.target is not None else px + order.dir * order.target_ticks * tick if order.target_ticks > 0 else None
        self.realized -= self.costs.commission * order.qty
        self.lots.append(_Lot(order.dir, order.qty, px, bar.ts_first_ns, stop, target, order.label, intrabar))

    def _excursion(self, lot: _Lot, bar) -> None:
        touched = lot.stop is not None and (bar.low <= lot.stop if lot.dir > 0 else bar.high >= lot.stop)
        worst = lot.stop if touched else bar.low if lot.dir > 0 else bar.high
        away = max(lot.dir * (lot.px - worst), 0.0)
        lot.mae = max(lot.mae, away * lot.qty * self.costs.multiplier)
        lot.mae_ticks = max(lot.mae_ticks, away / self.costs.tick)

    def _exit(self, lot: _Lot, bar) -> None:
        up = lot.dir > 0
        if lot.stop is not None and (bar.low <= lot.stop if up else bar.high >= lot.stop):
            self._close(lot, min(bar.open, lot.stop) if up else max(bar.open, lot.stop), bar.ts_last_ns, "stop_loss")
        elif lot.target is not None and not (lot.bars == 1 and lot.intrabar) and (bar.high >= lot.target if up else bar.low <= lot.target):
            self._close(lot, lot.target, bar.ts_last_ns, "take_profit")

    def _close_all(self, bar) -> None:
        for lot in self.lots[:]:
            self._close(lot, bar.open - lot.dir * self.slip, bar.ts_first_ns, "signal")

    def _close(self, lot: _Lot, px: float, ts: int, reason: str) -> None:
        pnl = lot.dir * (px - lot.px) * lot.qty * self.costs.multiplier - self.costs.commission * lot.qty
        self.realized += pnl
        self.lots.remove(lot)
        self.closed.append({
            "entry_ts_ns": int(lot.ts), "exit_ts_ns": int(ts), "dir": lot.dir, "qty": lot.qty, "entry_px": lot.px, "exit_px": px, "stop": lot.stop, "target": lot.target,
            "max_adverse_excursion": lot.mae, "max_adverse_ticks": lot.mae_ticks, "pnl": pnl, "reason": reason, "label": lot.label,
        })

    def take_closed(self) -> list[dict]:
        out, self.closed = self.closed, []
        return out


#: What a strategy is: from a bar with its columns, and the broker, orders to queue after that bar.
Strategy = Callable[[object, Broker], list[Order]]


class _Run:
    def __init__(self, make: Callable[[dict], Strategy], costs: Costs):
        self.make, self.costs, self.broker = make, costs, None

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            if self.broker is None:
                self.broker, self.decide = Broker(self.costs), self.make(row)
            equity, drawdown = self.broker.bar(row)
            closed = self.broker.take_closed()
            if not row.is_last:
                for order in self.decide(row, self.broker):
                    self.broker.submit(order, row.ts_last_ns)
            out.append((equity, drawdown, self.broker.side, closed, False))
            if row.is_last and (end := self.broker.finish(row)):
                out.append((*end, 0, self.broker.take_closed(), True))
        extra = len(out) - len(pdf)
        rows = pd.concat([pdf, pdf.iloc[[-1]]], ignore_index=True) if extra else pdf.copy()
        for k, name in enumerate(("equity", "drawdown", "position", "closed", "forced")):
            rows[name] = [x[k] for x in out]
        return rows


def simulate(signals: DataFrame, make: Callable[[object], Strategy], costs: Costs) -> DataFrame:
    """Runs a strategy over ``signals``, the bars of each run_id with the columns that it reads.

    ``make`` gets a run's first row and returns the strategy. Returns run_id, bar_id, ts_ns, equity, drawdown,
    position, closed (an array of trades) and forced, true for the point after the forced close at the end. Bars pass in
    pieces and only the broker's state stays, so a run may be of any length.
    """
    last = F.lead("bar_id").over(Window.partitionBy("run_id").orderBy("bar_id")).isNull()
    adds = [("equity", "double"), ("drawdown", "double"), ("position", "int"), ("closed", f"array<struct<{TRADE}>>"), ("forced", "boolean")]
    rows = sequential(signals.withColumn("is_last", last), ["run_id"], ["bar_id"], lambda: _Run(make, costs), adds, only=["run_id", "symbol", "bar_id", "ts_last_ns"])
    return rows.withColumnRenamed("ts_last_ns", "ts_ns")


def trades_of(run: DataFrame) -> DataFrame:
    """Round trips, in the order in which they closed."""
    return run.select("run_id", "symbol", "bar_id", F.posexplode("closed").alias("k", "t")).select("run_id", "symbol", "bar_id", "k", "t.*")


def equity_of(run: DataFrame) -> DataFrame:
    """A point for each bar, and one more for a forced close."""
    return run.select("run_id", "bar_id", "forced", "ts_ns", "equity", "drawdown")
