"""Fills, brackets and accounting of the broker, bar by bar."""

from types import SimpleNamespace

import pytest

from barloom.operators.broker import Broker, Costs, Order

UNIT = Costs(tick=1.0, multiplier=1.0)


def bar(o, h, lo, c, ts):
    return SimpleNamespace(open=o, high=h, low=lo, close=c, ts_first_ns=ts, ts_last_ns=ts + 1)


def flat(px, ts):
    return bar(px, px, px, px, ts)


def started(*orders, at=None, costs=UNIT):
    b = Broker(costs)
    b.bar(at or flat(100, 100))
    for o in orders:
        b.submit(o, (at or flat(100, 100)).ts_first_ns)
    return b


def test_stale_order_is_dropped():
    b = started(Order(1, max_delay_ns=100, stop_ticks=10, target_ticks=2))
    b.bar(flat(101, 1000))
    assert not b.lots and not b.pending


def test_timely_order_fills():
    b = started(Order(1, max_delay_ns=100, stop_ticks=10, target_ticks=2))
    b.bar(flat(101, 150))
    assert len(b.lots) == 1 and not b.pending


def test_two_lots_take_their_profits():
    b = started(Order(1, mode="add", limit=100, stop_ticks=10, target_ticks=2), Order(1, mode="add", limit=99, stop_ticks=10, target_ticks=4))
    b.bar(bar(100, 100, 99, 99, 1))
    assert len(b.lots) == 2 and b.side == 1
    b.bar(bar(99, 103, 99, 103, 2))
    done = b.take_closed()
    assert [t["reason"] for t in done] == ["take_profit"] * 2 and sum(t["pnl"] for t in done) == 6.0


def test_replace_does_not_stack():
    b = started(Order(1))
    b.bar(flat(100, 1))
    b.submit(Order(1), 1)
    b.bar(flat(101, 2))
    assert len(b.lots) == 1 and not b.take_closed()


def test_flat_closes_all():
    b = started(Order(1, mode="add"), Order(1, mode="add"))
    b.bar(flat(100, 1))
    b.submit(Order(0, mode="flat"), 1)
    b.bar(flat(101, 2))
    assert [t["reason"] for t in b.take_closed()] == ["signal", "signal"] and not b.lots


def test_cancel_keeps_position_and_label_is_kept():
    b = started(Order(1, label="breakout"))
    b.bar(flat(100, 1))
    b.submit(Order(1, mode="add", limit=50), 1)
    b.cancel()
    b.bar(flat(100, 2))
    assert len(b.lots) == 1 and not b.take_closed()
    b.submit(Order(0, mode="flat"), 2)
    b.bar(flat(100, 3))
    assert b.take_closed()[0]["label"] == "breakout"


def test_limit_lives_nine_bars():
    b = started(Order(1, limit=90))
    for k in range(8):
        b.bar(flat(100, k))
        assert b.pending
    b.bar(flat(100, 9))
    assert not b.pending


def test_target_waits_on_the_bar_of_an_intrabar_fill():
    b = started(Order(1, limit=99, target_ticks=2))
    b.bar(bar(100, 105, 99, 104, 1))
    assert len(b.lots) == 1
    b.bar(bar(104, 104, 104, 104, 2))
    assert b.take_closed()[0]["exit_px"] == 101


def test_gap_through_stop_fills_at_open_and_stop_comes_before_target():
    b = started(Order(1, stop_ticks=5, target_ticks=5))
    b.bar(flat(100, 1))
    b.bar(bar(90, 110, 90, 100, 2))
    (t,) = b.take_closed()
    assert t["reason"] == "stop_loss" and t["exit_px"] == 90


def test_costs_and_forced_close():
    costs = Costs(commission=2.0, slippage_ticks=1, tick=1.0, starting=1000.0)
    b = started(Order(1), costs=costs)
    equity, _ = b.bar(flat(100, 1))
    assert equity == 1000 - 2 - 1  # fee of the entry, and the slip marked at the close
    assert b.finish(flat(110, 2))[0] == pytest.approx(1000 - 4 + 8)
    (t,) = b.take_closed()
    assert t["pnl"] == 6 and t["reason"] == "end_of_data"
    assert b.finish(flat(110, 3)) is None


def test_band_rejects_the_unslipped_price():
    b = started(Order(1, band=(0, 99)))
    b.bar(flat(100, 1))
    assert not b.lots and not b.pending


def test_excursion_stops_at_the_stop():
    b = started(Order(1, stop_ticks=5))
    b.bar(flat(100, 1))
    b.bar(bar(100, 100, 80, 90, 2))
    (t,) = b.take_closed()
    assert t["max_adverse_excursion"] == 5 and t["max_adverse_ticks"] == 5
