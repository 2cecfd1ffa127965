"""Manual replay: a log of commands and the bars give the same session each time.

This is another fill engine than the broker's: market orders fill at the current close, brackets at their own prices
without a rule for gaps, a resting order never expires, and fees come out of both sides of a trade's result.
"""

from __future__ import annotations

from copy import deepcopy

import pandas as pd
from pyspark.sql import DataFrame

#: Steps of one command, and states that can be undone.
MOST = 20_000
COMMAND = "session_id string, n long, action string, dir int, qty double, price double, stop double, target double, count long"
STATE = "session_id string, n long, cursor long, side int, qty double, avg_px double, realized double, equity double, drawdown double, resting boolean, note string, closed array<struct<entry_ts_ns: long, exit_ts_ns: long, dir: int, qty: double, entry_px: double, exit_px: double, mae: double, pnl: double, reason: string>>"


class Session:
    """State of one replay over bars (dicts with ts_first_ns, ts_last_ns, open, high, low, close)."""

    def __init__(self, bars: list[dict], cursor: int | None = None, tick: float = 0.25, multiplier: float = 1.0, fee: float = 2.0, slip_ticks: float = 1.0, starting: float = 100_000.0):
        self.bars, self.tick, self.multiplier, self.fee, self.slip, self.starting = bars, tick, multiplier, fee, slip_ticks * tick, starting
        self.cursor = min(200, len(bars) // 5) if cursor is None else cursor
        self.side, self.qty, self.px, self.entry_ts, self.entry_fee, self.mae = 0, 0.0, 0.0, 0, 0.0, 0.0
        self.stop = self.target = self.resting = None
        self.realized, self.points, self.closed, self.undo = starting, [], [], []
        self.mark()

    @property
    def bar(self) -> dict:
        return self.bars[self.cursor]

    def mark(self) -> None:
        """The equity at the current close; a point of the same time is replaced."""
        equity = self.realized + self.side * (self.bar["close"] - self.px) * self.qty * self.multiplier - self.entry_fee
        if self.points and self.points[-1][0] == self.bar["ts_last_ns"]:
            self.points.pop()
        self.points.append((self.bar["ts_last_ns"], equity))

    @property
    def drawdown(self) -> float:
        return self.points[-1][1] - max(self.starting, *(e for _, e in self.points))

    def fill(self, way: int, qty: float, px: float, ts: int, stop=None, target=None) -> None:
        """Opens, adds at the mean price, reduces, or reverses."""
        if self.side and way != self.side:
            out = min(qty, self.qty)
            self.close_qty(out, px, ts, "signal")
            qty -= out
            if qty <= 0:
                return
        self.entry_fee += self.fee * qty
        if self.side:
            self.px = (self.px * self.qty + px * qty) / (self.qty + qty)
            self.qty += qty
        else:
            self.side, self.qty, self.px, self.entry_ts, self.mae, self.stop, self.target = way, qty, px, ts, 0.0, stop, target

    def close_qty(self, qty: float, px: float, ts: int, reason: str) -> None:
        share = qty / self.qty
        fees, mae = self.entry_fee * share + self.fee * qty, self.mae * share
        pnl = self.side * (px - self.px) * qty * self.multiplier - fees
        self.closed.append({"entry_ts_ns": int(self.entry_ts), "exit_ts_ns": int(ts), "dir": self.side, "qty": qty, "entry_px": self.px, "exit_px": px, "mae": mae, "pnl": pnl, "reason": reason})
        self.realized, self.entry_fee, self.mae, self.qty = self.realized + pnl, self.entry_fee * (1 - share), self.mae - mae, self.qty - qty
        if self.qty <= 1e-12:
            self.side, self.qty, self.px, self.entry_fee, self.mae, self.stop, self.target = 0, 0.0, 0.0, 0.0, 0.0, None, None

    def advance(self) -> str:
        """One bar on; returns what happened in it."""
        self.cursor += 1
        bar, note, intrabar = self.bar, "", False
        if self.resting:
            px = self._rest_price(bar)
            if px is not None:
                kind, way, qty, _, stop, target = self.resting
                fresh = not self.side
                intrabar = fresh and px != bar["open"]
                self.resting = None
                self.fill(way, qty, px + (way * self.slip if kind == "breakout" else 0.0), bar["ts_first_ns"], stop, target)
                note = "filled"
        if self.side:
            up = self.side > 0
            hit = self.stop is not None and (bar["low"] <= self.stop if up else bar["high"] >= self.stop)
            worst = self.stop if hit else bar["low"] if up else bar["high"]
            self.mae = max(self.mae, max(self.side * (self.px - worst), 0.0) * self.qty * self.multiplier)
            if hit:
                self.close_qty(self.qty, self.stop, bar["ts_last_ns"], "stop_loss")
                note = "stopped"
            elif self.target is not None and not intrabar and (bar["high"] >= self.target if up else bar["low"] <= self.target):
                self.close_qty(self.qty, self.target, bar["ts_last_ns"], "take_profit")
                note = "target"
        self.mark()
        return note

    def _rest_price(self, bar: dict) -> float | None:
        kind, way, _, price, _, _ = self.resting
        below = (way > 0) == (kind == "limit")  # waits for a price at or below its own
        if bar["open"] <= price if below else bar["open"] >= price:
            return bar["open"]
        return price if (bar["low"] <= price if below else bar["high"] >= price) else None

    def protected(self, way: int, px: float, stop, target) -> bool:
        return not (stop is not None and way * (px - stop) <= 0 or target is not None and way * (target - px) <= 0)

    def do(self, c: dict) -> str:
        """Runs a command; returns a note, which says ``rejected`` if it changed nothing."""
        action = c["action"]
        if action == "undo":
            if not self.undo:
                return "rejected"
            self.__dict__.update(self.undo.pop())
            return "undone"
        before = {k: deepcopy(v) for k, v in self.__dict__.items() if k not in ("bars", "undo")}
        note = getattr(self, f"_do_{action}", lambda _: "rejected")(c)
        if note != "rejected":
            self.undo = [*self.undo[-(MOST - 1) :], before]
            self.mark()
        return note

    def _do_step(self, c) -> str:
        for _ in range(min(max(int(c["count"] or 1), 1), MOST)):
            if self.cursor + 1 >= len(self.bars):
                return "end"
            if note := self.advance():
                return note
        return ""

    def _do_to(self, c) -> str:
        while self.cursor + 1 < len(self.bars) and self.bar["ts_last_ns"] < int(c["count"]):
            if note := self.advance():
                return note
        return ""

    def _do_market(self, c) -> str:
        px = self.bar["close"] + c["dir"] * self.slip
        if not (c["qty"] or 0) > 0 or not self.protected(c["dir"], px, c["stop"], c["target"]):
            return "rejected"
        self.fill(c["dir"], c["qty"], px, self.bar["ts_last_ns"], c["stop"], c["target"])
        return "filled"

    def _rest(self, kind: str, c) -> str:
        if self.resting or not (c["qty"] or 0) > 0 or c["price"] is None or not self.protected(c["dir"], c["price"], c["stop"], c["target"]):
            return "rejected"
        self.resting = (kind, c["dir"], c["qty"], c["price"], c["stop"], c["target"])
        return "resting"

    def _do_limit(self, c) -> str:
        return self._rest("limit", c)

    def _do_breakout(self, c) -> str:
        return self._rest("breakout", c)

    def _do_protect(self, c) -> str:
        """A live bracket may cross the entry, but not the current price."""
        if not self.side or not self.protected(self.side, self.bar["close"], c["stop"], c["target"]):
            return "rejected"
        self.stop, self.target = c["stop"], c["target"]
        return "protected"

    def _do_cancel(self, c) -> str:
        self.resting = None
        return "cancelled"

    def _do_flatten(self, c) -> str:
        self.resting = None
        if self.side:
            self.close_qty(self.qty, self.bar["close"] - self.side * self.slip, self.bar["ts_last_ns"], "signal")
        return "flat"


def replay(bars: DataFrame, commands: DataFrame, **settings) -> DataFrame:
    """The state after each command. ``bars`` have a session_id; a session's bars and commands meet in one task.

    Commands (see COMMAND) run in order of ``n``; closed trades stand with the command that closed them.
    """
    names = [c.split()[0] for c in COMMAND.split(", ")]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.sort_values("bar_id")[["ts_first_ns", "ts_last_ns", "open", "high", "low", "close"]].to_dict("records")
        out = []
        if rows and len(right):
            session = Session(rows, **settings)
            for c in right.sort_values("n")[names].astype(object).where(lambda x: x.notna(), None).to_dict("records"):
                done = len(session.closed)
                note = session.do(c)
                out.append((key[0], c["n"], session.cursor, session.side, session.qty, session.px, session.realized, session.points[-1][1], session.drawdown, session.resting is not None, note, session.closed[done:]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", closed")[0].split(", ")] + ["closed"])

    return bars.groupBy("session_id").cogroup(commands.groupBy("session_id")).applyInPandas(run, STATE)
