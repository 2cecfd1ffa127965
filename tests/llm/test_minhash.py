"""b-bit MinHash against full sets, and its estimates against true Jaccard indexes."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import bbit_minhash as b

from .test_operators import empty, low, odd  # noqa: F401


def _set(text):
    w = [x for x in __import__("re").split(r"[ \t\n\r\x0b\x0c]+", low(text)) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 4 else (tuple(w[i : i + 4]) for i in range(len(w) - 3)))


def _components(rows):
    """component_id of rows (doc_id, text), by comparing all pairs."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))
    named = {s for (i, _), s in zip(rows, sets, strict=True) if i is not None}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and sets[i] in named and sets[j] in named and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, c = root[i], root[j]
                root = [c if x == a else x for x in root]
    ids = lambda k: [rows[x][0] for x in range(len(rows)) if root[x] == root[k] and rows[x][0] is not None]
    return [(rows[k][0], len(sets[k]), min(ids(k), default=None)) for k in range(len(rows))]


def test_groups_of_edited_texts(spark):
    """Chains of edits, sets at the threshold (4 of 5 shingles, 8 of 10), short texts, copies and repeated ids."""
    r, rows = random.Random(11), [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "A b c"), (4, "a B c"), (5, "a b c d"), (6, ""), (7, None), (None, "p q r s t u v w"), (None, "p q r s t u v w x"), (9, "p q r s t u v w x y"), (None, "p q r s t u v w x y")]
    for n in (12, 40, 300, 3000):
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(7):
            rows.append((len(rows) + 10, " ".join(w)))
            w = [x if r.random() > 0.03 else f"v{r.randrange(10**6)}" for x in w]
    rows += [rows[20], (rows[20][0], "another text of that id")]
    got = b.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted(_components(rows), key=key)
    # All rows of a component whose id is repeated are in the component of their own text.
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=key) == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got) and len({x.component_id for x in got}) < len(rows) - 10


def test_odd_rows(odd, empty):  # noqa: F811
    got = b.near_dedup(odd.withColumns({"kept": F.lit("x"), "component_id": F.lit(3), "keys": F.lit(1)})).collect()
    assert len(got) == 9 and sum(x.doc_id == 5 for x in got) == 3 and all(x.kept for x in got)
    assert b.near_dedup(empty).count() == 0


def test_estimates_and_candidates():
    """Estimates are near the truth, far pairs are turned down, near ones never, and they have a band in common."""
    r = np.random.default_rng(1)
    for size, equal in ((400, 400), (400, 356), (400, 200), (400, 0), (9, 8), (200_000, 178_000)):
        x = r.integers(0, 2**64, 2 * size - equal, dtype=np.uint64)
        least = b.minima(np.concatenate([x[:size], x[size - equal :]]), np.array([0, size, 2 * size]))
        true = equal / (2 * size - equal)
        sign = b.packed(least)
        assert abs(b.estimate(sign[:1], sign[1:])[0] - true) < 0.13
        keys = b.band_keys(least)
        assert (keys[0] == keys[1]).any() == (true > 0.5) or 0.3 < true < 0.6
        near = b._may_link(np.array([size, size]), sign, np.array([0]), np.array([1]))[0]
        assert near == (true >= 0.8) or 0.5 < true < 0.8
    assert b.HASHES - b.equal_fields(sign[:1], sign[:1])[0] == 0


def test_minima_do_not_depend_on_pieces(monkeypatch):
    x, off = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 0, 10, 3000, 3000, 4999, 5000])
    whole = b.minima(x, off)
    monkeypatch.setattr(b, "_PIECE", 700)
    assert (b.minima(x, off) == whole).all() and len(whole) == 4
