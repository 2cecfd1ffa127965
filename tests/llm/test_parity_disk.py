"""What the parity join keeps on disk: no bucket of all texts with one passage, no shuffle files of steps that have ended, and
only texts that are needed are shuffled."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common as c
from barloom.llm import parity_join as p


def _texts(r, many, words=150):
    return [" ".join(f"w{r.randrange(10**9)}" for _ in range(words)) for _ in range(many)]


def test_a_common_passage_makes_no_bucket(spark):
    r = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"{t} {passage}" for t in _texts(r, 200)]
    texts += [t.replace("w", "v", 3) for t in texts[:20]]
    rows = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, h long")
    each, classes, buckets = p._buckets(rows)
    assert buckets.groupBy("key").count().agg(F.max("count")).first()[0] < 20  # all 220 before
    found, level = p.frequent_shingles(rows, classes, p.PARITY)
    assert len(found) == len(level) == 36 and (found[1:] > found[:-1]).all()
    got = {x.doc_id: x.component_id for x in p.near_groups(rows.select("doc_id", "text")).collect()}
    assert got == {k: k if k < 200 else k - 200 for k in range(220)}


def test_links_have_a_key_in_common_whatever_is_frequent():
    r = np.random.default_rng(2)
    for n in (3, 10, 40, 150, 700, 1500):
        for m in (n, n + n // 7, 4 * n // 3):
            both = -(-3 * (n + m) // 7)
            x = r.integers(0, 1 << 63, n + m - both).astype(np.uint64)
            sets = [np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))]
            some = np.unique(np.concatenate([r.choice(x, len(x) // 2), r.integers(0, 1 << 63, 50).astype(np.uint64)]))
            tokens, off = np.concatenate(sets), np.array([0, n, n + m])
            own = np.searchsorted(p.BANDS, np.diff(off), "right") - 1
            for frequent in ((some, r.integers(1, 9, len(some)).astype(np.int8)), (np.sort(x), np.ones(len(x), np.int8)), (x[:0], np.zeros(0, np.int8))):
                keys = [set(), set()]
                for step in (0, 1):
                    for k, row in zip(*(y.tolist() for y in p.block_keys(tokens, off, own + step, frequent)), strict=True):
                        keys[row].add(k)
                assert keys[0] & keys[1], (n, m)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark):
    setting, before = spark.conf.get(c.SHUFFLE_CLEANUP, None), _shuffle_files(spark)
    table = c.written(spark.range(100_000).repartition(4, "id"), "shuffled")
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 100_000 and spark.conf.get(c.SHUFFLE_CLEANUP, None) == setting


@pytest.mark.parametrize("many", [1, 3000, 40000])
def test_the_filter_passes_all_keys_and_few_others(spark, many):
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"))
    keys = rows.where(F.col("a") <= many)
    got = c.perhaps(rows, keys, ["a", "b"], keys.count())
    assert got.columns == ["a", "b", "__perhaps"] and got.count() == 100_000
    assert got.where(f"a <= {many} and not __perhaps").count() == 0
    assert got.where(f"(a is null or a > {many}) and __perhaps").count() < 0.09 * 100_000


def test_large_tables_of_needs_shuffle_few_texts(spark, monkeypatch):
    r = random.Random(3)
    texts = _texts(r, 400, 60)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t + " more") for k, t in enumerate(texts[:40])] + [(None, texts[0]), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [sorted(f(docs).collect(), key=str) for f in (p.near_groups, p.one_of_groups)]
    made, join, joined = [], p.perhaps, p.texts_of
    monkeypatch.setattr(p, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(p, "perhaps", lambda *a: made.append(a) or join(*a))
    counts = []
    monkeypatch.setattr(p, "texts_of", lambda need, rows: counts.append((need.count(), join(rows, need, ["doc_id"], need.count()).where("__perhaps").count())) or joined(need, rows))
    assert [sorted(f(docs).collect(), key=str) for f in (p.near_groups, p.one_of_groups)] == want
    assert len(made) >= 3 and {tuple(x[2]) for x in made} == {("doc_id",), ("__id", "__h")}
    assert max(n for n, _ in counts) >= 80 and all(shuffled <= n + 40 for n, shuffled in counts)
