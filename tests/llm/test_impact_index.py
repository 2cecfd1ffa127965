"""The bit-sliced index against scores computed document by document."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import impact_index as x

from .test_operators import LONG, empty, odd, split  # noqa: F401


def plain(docs, queries, k):
    """Rank, doc_id and score for each query (by its place), from the definition."""
    terms = [collections.Counter(split(t)) for _, t in docs]
    lengths = [sum(t.values()) for t in terms]
    n, total = sum(v > 0 for v in lengths), sum(lengths)
    df = collections.Counter(w for t in terms for w in t)
    out = []
    for _, text in queries:
        scores = []
        for (i, _), t, length in zip(docs, terms, lengths, strict=True):
            m = 75 + 25 * length * n // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 12 * m)) for w, c in collections.Counter(split(text)).items() if t[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out.append([(r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])])
    return out


def found(table, n):
    out = collections.defaultdict(list)
    for r in table.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return [sorted(out[i]) for i in range(n)]


@pytest.mark.parametrize("block", [(1 << 16, 2_000_000), (100, 2_000_000), (1 << 16, 300)])
def test_scores(spark, block):
    """Frequent, middling and rare terms, ties, repeated ids and rows, null ids; blocks of any size give the same."""
    r = random.Random(13)
    word = lambda: f"W{int(400 * r.random() ** 3)}" if r.random() < 0.9 else f"é{r.randrange(5000)}"
    docs = [(k * 37 % 1009, " ".join(word() for _ in range(r.choice([0, 1, 5, 40, 300])))) for k in range(600)]
    docs += [(2000 + k, "twin text W1 w1 w2") for k in range(40)] + [(5, "w1 w1"), (5, "w1 w1"), (None, "w3 w4"), (None, None), (7, "")]
    queries = [(k, " ".join(word() for _ in range(r.choice([1, 3, 30])))) for k in range(40)] + [(40, "twin"), (41, "w1 W1 w1 w1 w1 w2"), (42, "unknown"), (43, ""), (44, None), (45, "w0")]
    index = x.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), None, *block)
    got = x.search(index, spark.createDataFrame(queries, "item_id long, text string"), 20, 1 << 20 if block[0] != 100 else 900)
    assert found(got, len(queries)) == plain(docs, queries, 20)
    assert (index.documents, index.words) == (sum(bool(split(t)) for _, t in docs), sum(len(split(t)) for _, t in docs))


def test_odd_rows(spark, odd, empty):  # noqa: F811
    clash = odd.withColumns({c: F.lit(1) for c in ("term", "block", "words", "docs", "score", "rank", "query")})
    index = x.build(clash)
    queries = spark.createDataFrame([(1, "same row lorem"), (1, "same row lorem"), (None, "id HERE")], "item_id int, text string").withColumns({"rank": F.lit("a"), "query": F.lit(1), "doc_id": F.lit(2)})
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain(docs, [(0, "same row lorem"), (1, "id HERE")], 20)
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in x.search(index, queries).collect()]
    assert sorted(g[1:] for g in got if g[0] == 1) == sorted(want[0] * 2) and [g[1:] for g in got if g[0] is None] == want[1]
    none = x.build(empty)
    assert none.rows.count() == 0 and x.search(none, queries).count() == 0 and x.search(index, queries.limit(0)).count() == 0


def test_additions_carry_and_the_best_are_found(monkeypatch):
    r = np.random.default_rng(4)
    values = r.integers(0, 1 << 35, (3, 5, 200))
    values[:, :, 50:] = values[:, :, 50:51]  # ties
    values[0, :, 10:40] = 0
    sums = np.zeros((3, 45, 4), np.uint64)
    pad = lambda v: np.pad(x.slices(v)[0], ((0, 0), (0, 32 - 25))).view(np.uint64)
    for j in range(5):
        for q in range(3):
            x.add(sums, np.array([q]), pad(values[q, j])[None], j % 3)
    total = sum(values[:, j] << (j % 3) for j in range(5))
    bits = np.unpackbits(sums.view(np.uint8), axis=2, bitorder="little")
    assert ((bits.astype(np.int64) << np.arange(45)[:, None]).sum(1)[:, :200] == total).all()
    for k in (1, 20, 60, 200):
        sure, maybe = x.best(sums, k)
        for q in range(3):
            a = np.flatnonzero(np.unpackbits(sure[q].view(np.uint8), bitorder="little"))
            b = np.flatnonzero(np.unpackbits(maybe[q].view(np.uint8), bitorder="little"))[: k - len(a)]
            want = [i for i in sorted(range(200), key=lambda i: (-total[q, i], i)) if total[q, i]][:k]
            assert sorted([*a, *b]) == sorted(want)


def test_groups_of_queries_do_not_matter(spark, sf_dir):
    """Small bounds on what a search holds give the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = x.build(docs).rows.orderBy("block").toArrow().to_batches()

    class Sent:
        value = x._hashed([1, 2, 3], ["the of and in", "and and and and the thin", "in erhe"])

    run = lambda: [b.to_pylist() for b in x._search(Sent, 7)(iter(rows))]
    flat = lambda parts: sorted((r["query"], r["score"], r["doc_id"]) for p in parts for r in p)
    whole = flat(run())
    sums, terms = x.SUM_BYTES, x.TERM_BYTES
    x.SUM_BYTES = x.TERM_BYTES = 1
    try:
        assert flat(run()) == whole and whole
    finally:
        x.SUM_BYTES, x.TERM_BYTES = sums, terms
