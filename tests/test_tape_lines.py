"""The tape's data source: ranges, pruning, exact rows, streams over growing files."""

import random

import pytest

from barloom.sources import tape as TP
from barloom.sources import tape_lines as TL

GOOD = {
    "T,5,x,1.5,2,2": ("trade", 5, 1.5, 2.0, 1), "T,-5,x,-.5,2.,1": ("trade", -5, -0.5, 2.0, -1), "T,5,x,7,0": ("trade", 5, 7.0, 0.0, -1), "T,5,x,7,3,buy": ("trade", 5, 7.0, 3.0, -1),
    "T,5zz,1,2,2": ("trade", 5, 1.0, 2.0, 1), "T,5,x,1,2,99999999999999999999": ("trade", 5, 1.0, 2.0, -1), "T,5,x,1.2.3,2": ("trade", 5, 1.2, 0.3, 1), "T,5,x,4,2,2,more\r": ("trade", 5, 4.0, 2.0, 1),
    "A,+5,x,+1e1,2,2": ("add", 5, 10.0, 2.0, 1), "AddLimit,5,,1.,2": ("add", 5, 1.0, 2.0, -1), "R,5,x,.5,2E0,x": ("reduce", 5, 0.5, 2.0, -1), "ReduceLimit,5,x,1,2,+2": ("reduce", 5, 1.0, 2.0, 1),
    "r,5,x,1,9,2": ("set", 5, 9.0, 2.0, 1), "r,5,x,7,9,0,": ("set", 5, 9.0, 0.0, -1), "c,no,0,e,s,t,0.25,50,9": ("contract", None, None, None, None), "c,7,0,e,s,t,1e-2,many": ("contract", 7, None, None, None),
}
BAD = [
    "", "T", "T,", "T,x,1,2,3,4", "T,5,x,+1,2,2", "T,5,x,1,-2,2", "T,5,x,.,2,2", "T,99999999999999999999,x,1,2,2", "T, 5,x,1,2,2", "TT,5,x,1,2,2", "t,5,x,1,2,2", "A,5,x,nan,2,2", "A,5,x,1,inf,2", "A,5,x, 1,2,2",
    "A,5,x,1d,2,2", "A,5.0,x,1,2,2", "A,5,x,1", "R,5,x,1,-1,2", "r,5,x,,9,2", "r,5,x,b,9,2", "r,5,x,1,9", "c,7,0,e,s,t,0.25", "c,7,0,e,s,t,x,1", "c,7,0,e,s", "X,5,x,1,2,2",
]


def test_rows(spark, tmp_path):
    """Every sound row gives its event and every other none, whatever the ranges cut."""
    lines = [*GOOD, *BAD] * 3
    random.Random(1).shuffle(lines)
    (tmp_path / "tape.csv").write_bytes("\n".join(lines).encode())
    for split in (7, 64, 1 << 20):
        got = TP.read_text_tape(spark, str(tmp_path / "tape.csv"), "S", split_bytes=split).orderBy("seq").collect()
        want = [GOOD[x] for x in lines if x in GOOD]
        assert [(r.kind, r.ts_ns, r.price, r.size, r.side) for r in got] == want
    ticks = [(r.tick_size, r.multiplier) for r in got if r.kind == "contract"]
    assert sorted(set(ticks)) == [(0.01, 1.0), (0.25, 50.0)]


def test_kinds_are_pruned_in_the_reader_and_files_keep_their_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{2 - k}.csv").write_text("".join(f"{'TAr'[i % 3]},{(2 - k) * 100 + i},x,1,1,1\n" for i in range(90)))
    (tmp_path / "_SUCCESS").write_text("T,1,x,1,1,1\n")
    rows = TP.read_text_tape(spark, str(tmp_path), "S", ("trade",), split_bytes=100)
    assert [r.ts_ns for r in rows.orderBy("seq").collect()] == [100 * k + i for k in range(3) for i in range(0, 90, 3)]
    reader = TL._Reader({"path": str(tmp_path), "splitbytes": "100", "kinds": "trade"})
    assert {b.column("kind")[0].as_py() for p in reader.partitions() for b in reader.read(p)} == {"trade"}
    both = TP.read_text_tape(spark, str(tmp_path), "S", ("set", "add"))
    # One table under several filters.
    assert both.where("kind = 'add'").count() == 90 and both.count() == 180 and both.where("kind = 'set'").count() == 90
    (tmp_path / "none").mkdir()
    assert TP.read_text_tape(spark, str(tmp_path / "none"), "S").count() == 0


@pytest.mark.parametrize("cut", [3, 40])
def test_a_stream_over_growing_files_gives_each_event_once(spark, tmp_path, cut):
    """Lines that are written in parts, new files, stop and resume; and the share that was read."""
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    text = {"b.csv": "".join(f"T,{i},x,1,1,1\n" for i in range(200)), "a.csv": "".join(f"A,{1000 + i},x,1,1,1\n" for i in range(150))}
    progress = TL.Progress(str(src))
    spark.streams.addListener(progress)
    try:
        for turn in range(3):
            for name, whole in text.items():
                if turn or name == "b.csv":
                    part = len(whole) * (turn + 1) // 3 - (cut if turn < 2 else 0)
                    (src / name).write_text(whole[:part])
            query = TP.stream_text_tape(spark, str(src), "S").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.streams.removeListener(progress)
    got = spark.read.parquet(str(out)).orderBy("seq").collect()
    assert sorted(r.ts_ns for r in got) == [*range(200), *range(1000, 1150)] and len({r.seq for r in got}) == 350
    assert [r.ts_ns for r in got] == [*range(200), *range(1000, 1150)]  # files by when they were first seen
    assert progress.fractions and max(progress.fractions.values()) == 1.0
