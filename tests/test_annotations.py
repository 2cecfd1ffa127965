"""Annotations are there as whole versions, whatever befalls their writers."""

import pytest

from barloom.sources import annotations as A


def ids(notes, run=None):
    return [(r.id, r.text) for r in notes.read(run).orderBy("version", "row").collect()]


def test_append_and_delete(spark, tmp_path):
    notes = A.Annotations(spark, str(tmp_path / "n"))
    assert ids(notes) == [] and not notes.delete("a")
    make = lambda *rows: spark.createDataFrame(list(rows), A.SCHEMA).coalesce(1)
    notes.append(make(("a", "r", 1, "x"), ("b", "r", 2, "y"), ("a", "s", 3, "z")))
    notes.append(make(("a", "r", 4, "again"), ("c", None, None, None)))
    assert ids(notes, "r") == [("a", "x"), ("b", "y"), ("a", "again")]
    assert notes.delete("a", "r") and ids(notes, "r") == [("b", "y"), ("a", "again")] and ids(notes, "s") == [("a", "z")]
    assert notes.delete("a") and ids(notes) == [("b", "y"), ("a", "again"), ("c", None)]  # of any run: the first
    assert not notes.delete("zz") and not notes.delete("b", "s") and notes.version() == 4
    with pytest.raises(ValueError):
        notes.delete("")


def test_killed_and_second_writers(spark, tmp_path, monkeypatch):
    notes = A.Annotations(spark, str(tmp_path / "n"))
    row = spark.createDataFrame([("a", "r", 1, "x")], A.SCHEMA)
    notes.append(row)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after the rows, before the manifest
        m.setattr(notes, "_commit", killed)
        for act in (lambda: notes.append(row), lambda: notes.delete("a")):
            with pytest.raises(KeyboardInterrupt):
                act()
    (tmp_path / "n" / "_versions" / ".half").write_text('{"parts": [')  # of a manifest
    assert ids(notes) == [("a", "x")]
    with monkeypatch.context() as m:  # another was faster
        m.setattr(notes, "version", lambda: 0)
        with pytest.raises(RuntimeError):
            notes.append(row)
    assert ids(notes) == [("a", "x")] and notes.append(row) == 2 and len(ids(notes)) == 2
