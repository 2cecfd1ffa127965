from barloom.operators.replay import Session


def session(**kw):
    bars = [{"ts_first_ns": i * 60_000_000_000, "ts_last_ns": i * 60_000_000_000 + 59_000_000_000, "open": (p := 100 + (i % 10) * 0.25), "high": p + 1, "low": p - 1, "close": p + 0.5} for i in range(100)]
    return Session(bars, tick=0.25, multiplier=2.0, **kw)


def do(s, action, **kw):
    return s.do({"action": action, "dir": None, "qty": None, "price": None, "stop": None, "target": None, "count": None} | kw)


def test_steps_and_undo():
    s = session()
    assert s.cursor == 20
    do(s, "step", count=5)
    assert s.cursor == 25
    do(s, "undo")
    assert s.cursor == 20 and do(s, "undo") == "rejected"


def test_scale_reduce_reverse_flatten():
    s = session()
    do(s, "market", dir=1, qty=1.0)
    do(s, "step", count=1)
    do(s, "market", dir=1, qty=1.0)
    assert (s.side, s.qty) == (1, 2.0) and s.px == (100.75 + 101.0) / 2
    do(s, "market", dir=-1, qty=1.0)
    assert s.qty == 1.0 and len(s.closed) == 1
    do(s, "market", dir=-1, qty=3.0)
    assert (s.side, s.qty) == (-1, 2.0) and len(s.closed) == 2
    do(s, "flatten")
    assert s.side == 0 and abs(s.realized - 100_000 - sum(t["pnl"] for t in s.closed)) < 1e-9


def test_breakout_stops_a_skip():
    s = session(slip_ticks=0.0)
    assert do(s, "breakout", dir=1, qty=1.0, price=102.5) == "resting"
    assert do(s, "limit", dir=1, qty=1.0, price=99.0) == "rejected"
    assert do(s, "step", count=50) == "filled" and s.px == 102.5


def test_stop_fills_at_its_price_and_protection_is_checked():
    s = session(slip_ticks=0.0, fee=0.0)
    assert do(s, "market", dir=1, qty=1.0, stop=200.0) == "rejected"
    do(s, "market", dir=1, qty=1.0, stop=99.5)
    assert do(s, "protect", stop=150.0) == "rejected" and do(s, "protect", stop=100.0) == "protected"
    assert do(s, "step", count=1) == "stopped" and s.closed[0]["exit_px"] == 100.0
