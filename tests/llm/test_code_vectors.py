"""Filtering Lloyd against plain Lloyd iterations that compare every part with every entry."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import code_vectors as c


def plain(rows, entries, rounds):
    """Codes, errors and codebooks of rows (vec_id, vector of whole numbers), with Python's integers."""
    width = len(rows[0][1]) // 4
    first = [v for _, v in sorted(rows)[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(4)]
    near = lambda v, p: min(range(len(first)), key=lambda e: (sum((x - y) ** 2 for x, y in zip(cut(v, p), books[p][e], strict=True)), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(4)] for _, v in rows]
        for p in range(4):
            for e in range(len(first)):
                own = [cut(v, p) for (_, v), k in zip(rows, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = [[near(v, p) for p in range(4)] for _, v in rows]
    errors = [sum((x - y) ** 2 for p in range(4) for x, y in zip(cut(v, p), books[p][k[p]], strict=True)) for (_, v), k in zip(rows, codes, strict=True)]
    return [bytes(k).hex() for k in codes], errors, books


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "large"])
def test_codes(spark, kind):
    r = random.Random(kind)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    make = {
        "spread": lambda: [r.gauss(0, 1) for _ in range(12)],
        "clustered": lambda: [x + r.gauss(0, 0.01) for x in r.choice(centres)],
        "ties": lambda: [r.choice([0.0, 1 / 1024, -1 / 1024]) for _ in range(12)],
        "large": lambda: [r.choice([-1, 1]) * r.random() * 65536 for _ in range(12)],
    }[kind]
    rows = [(k * 7 % 403, make(), r.choice([None, 1, 2])) for k in range(403)]
    want, errors, books = plain([(i, [int(np.floor(x * 1024)) for x in v]) for i, v, _ in rows], 20, 3)
    got = {x.vec_id: x for x in c.coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), 20, 3).collect()}
    assert [(got[i].code, got[i].error) for i, _, _ in rows] == list(zip(want, errors, strict=True))
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {x.codebooks_sha256 for x in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}
    for label in (None, 1, 2):
        assert {got[i].label_error for i, _, k in rows if k == label} == {sum(e for e, x in zip(errors, rows, strict=True) if x[2] == label)}


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, repeated ids, other lengths, lengths that four doesn't divide, names that clash."""
    v = [0.5, -0.25, 1.0, 2.0, 0.1]
    rows = [(1, v, "a"), (1, v, "a"), (None, v, None), (2, None, "a"), (3, [None, *v[1:]], "a"), (4, [float("nan"), *v[1:]], "b"), (5, [float("inf"), *v[1:]], "b"), (6, v[:3], "b"), (7, [1e300, *v[1:]], "b"), (8, [], "b")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"code": F.lit(1), "error": F.lit("x"), "vector": F.lit(2), "of": F.lit(3)})
    got = sorted(c.coded(t).collect(), key=str)
    assert sorted((x.vec_id is None, x.vec_id or 0) for x in got) == [(False, 1), (False, 1), (False, 7), (True, 0)]
    assert {x.error for x in got} == {0} and all(len(x.code) == 8 for x in got)
    assert c.coded(t.limit(0)).count() == 0 and c.coded(t.where("vec_id = 8")).first().error == 0
    assert c.coded(t.where("vec_id = 2")).count() == 0


def test_trees_assign_whole_subtrees():
    """In clustered parts most points are assigned with a subtree; sums are those of the codes."""
    r = np.random.default_rng(3)
    book = r.integers(-5000, 5000, (40, 4))
    points = (book[r.integers(0, 40, 5000)] + r.integers(-30, 30, (5000, 4))).astype(np.int32)
    tree = c.build(points)
    code, total, count, whole = c.assign(tree, book)
    far = ((tree.points.astype(np.int64)[:, None] - book) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and whole > 0.5 * len(points)
    assert (count == np.bincount(code, minlength=40)).all() and (total[7] == tree.points[code == 7].sum(0)).all()
    assert (points[tree.order] == tree.points).all()


def test_chunks_do_not_matter(spark, monkeypatch):
    r = random.Random(5)
    t = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(8)], k % 3) for k in range(300)], "vec_id long, embedding array<float>, label int")
    one = {tuple(x) for x in c.coded(t.coalesce(1), 30).collect()}
    monkeypatch.setattr(c, "CHUNK", 37)
    assert {tuple(x) for x in c.coded(t.repartition(4), 30).collect()} == one
