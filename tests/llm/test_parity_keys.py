"""Keys of the parity join: every link has one in common, they are few and packed, and buckets of equal members are one."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import parity_join as p


def _keys_of(sets):
    tokens, off = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    own = np.searchsorted(p.BANDS, np.diff(off), "right") - 1
    out = [[] for _ in sets]
    for step in (0, 1):
        for k, row in zip(*(x.tolist() for x in p.block_keys(tokens, off, own + step)), strict=True):
            out[row].append(k)
    return out


def _pair(r, n, m):
    """Two sets of n and m elements, n <= m, with as few in common as a link allows."""
    both = -(-3 * (n + m) // 7)
    x = r.integers(0, 1 << 63, n + m - both).astype(np.uint64)
    return [np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))]


def test_linked_sets_have_a_key_in_common():
    r = np.random.default_rng(3)
    ends = [b + d for b in p.BANDS[1:9].tolist() for d in (-1, 0)]
    for n in [*range(3, 60), *ends, 1500]:
        for m in sorted({n, n + n // 7, max(n, 4 * n // 3 - 1), 4 * n // 3}):
            a, b = _keys_of(_pair(r, n, m))
            assert set(a) & set(b), (n, m)


def test_keys_are_few():
    """A third of a set's elements, and as many again only near the upper end of its band."""
    r = np.random.default_rng(4)
    n = np.unique(np.geomspace(100, 3000, 60).astype(int)).tolist()
    keys = [len(x) for x in _keys_of([np.sort(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in n])]
    assert sum(k <= x // 3 + 2 for k, x in zip(keys, n, strict=True)) > len(n) / 2
    assert sum(k / x for k, x in zip(keys, n, strict=True)) / len(n) < 0.5


@pytest.mark.parametrize("parts", [1, 7, 5000])
def test_keys_are_packed(parts):
    r = np.random.default_rng(5)
    key, cid = r.integers(-(1 << 63), 1 << 63, 20000), np.repeat(r.integers(-(1 << 63), 1 << 63, 40), 500)
    key[500:700] = key[:200]
    batch = p.pack_keys(key, cid, parts)
    part = batch.column("part").to_pylist()
    assert len(set(part)) == len(part) and max(part) < parts
    rows = [x for b in p.unpack_keys([batch]) for x in zip(*b.to_pydict().values(), strict=True)]
    sizes = lambda pairs: collections.Counter(tuple(sorted(c for _, c in g)) for g in _by_key(pairs).values())
    assert sizes(rows) == sizes(zip(key.tolist(), cid.tolist(), strict=True))
    if parts < 10:  # 16 bytes a row before
        assert sum(len(x.as_py()) for k in (1, 2, 3) for x in batch.column(k)) < 6 * len(key)


def _by_key(pairs):
    out = collections.defaultdict(list)
    for x in pairs:
        out[x[0]].append(x)
    return out


@pytest.mark.parametrize("step", [3, 1000])
@pytest.mark.parametrize("whole", [5, 1 << 16])
def test_buckets_of_equal_members_are_one(monkeypatch, step, whole):
    monkeypatch.setattr(p, "WHOLE", whole)
    r = random.Random(6)
    kinds = [sorted(r.sample(range(100), n)) for n in (1, 2, 2, 3, 6, 12, 40)]
    chosen = [r.choice(kinds) for _ in range(80)]
    rows = [(k, c) for k, members in enumerate(chosen) for c in members for _ in range(r.choice([1, 1, 2]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[a : a + step], strict=True)], names=["key", "cid"]) for a in range(0, len(rows), step)]
    want = collections.Counter(tuple(m) for m in chosen if len(m) > 1)
    for alike in (False, True):
        got = [x for b in p._meetings(alike)(batches) for x in zip(*b.to_pydict().values(), strict=True)]
        groups, found = collections.defaultdict(dict), collections.Counter()
        for key, cid, head, weight in got:
            groups[key].setdefault(cid, []).append(weight)
            assert head in groups[key]
        for members in groups.values():
            weights = {sum(w) for w in members.values()}
            assert len(weights) == 1
            found[tuple(sorted(members))] += weights.pop()
        assert found == want
        if alike and whole > 40:
            assert len(groups) == len(want)
            assert step == 3 or len(got) <= sum(map(len, want)) + len(chosen[-1])  # the last one is held back


def test_kin_give_few_rows_of_buckets(spark):
    """Two near texts have many keys in common, which were a bucket each."""
    base = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(base), 1), (2, " ".join([*base[:399], "x"]), 2), (3, "a text of its own", 3)]
    rows = p._buckets(spark.createDataFrame(rows, "doc_id long, text string, h long"))[2].collect()
    assert len(rows) == 2 and rows[0].weight == rows[1].weight > 50


def test_keys_are_unpacked_by_spark_alone(spark):
    """One Python function a task: keys are unpacked by expressions, to the same buckets."""
    r = np.random.default_rng(7)
    key, cid = r.integers(-(1 << 63), 1 << 63, 20000), np.repeat(r.integers(-(1 << 63), 1 << 63, 40), 500)
    key[500:700] = key[:200]
    batch = p.pack_keys(key, cid, 7)
    out = p.unpacked(spark.createDataFrame(pa.Table.from_batches([batch])))
    sizes = lambda pairs: collections.Counter(tuple(sorted(c for _, c in g)) for g in _by_key(pairs).values())
    assert sizes((x.key, x.cid) for x in out.collect()) == sizes(zip(key.tolist(), cid.tolist(), strict=True))
    docs = spark.createDataFrame([(1, "a b c d e f", 1)], "doc_id long, text string, h long")
    plans, write = [], p.written
    try:
        p.written = lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name)
        p._buckets(docs)
    finally:
        p.written = write
    for plan in plans:  # between two shuffles
        assert all(stage.count("MapInArrow") < 2 for stage in plan.split("Repartition")), plan
