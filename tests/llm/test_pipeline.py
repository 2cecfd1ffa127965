import base64
import collections
import random

import corpus_pipeline as p
from pyspark.sql import functions as F

from barloom.llm import langid
from barloom.llm import queries as q

from .test_operators import brute_groups, ids_of, split


def test_stages_against_brute_force(spark, sf_dir):
    docs = q.table(spark, sf_dir, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in p.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(p.STAGES) - 1:
            break
        assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in out.collect()]
        if name == "language ID":
            assert {i for i, _ in rows} == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "n-gram Jaccard join":
            assert {i for i, _ in rows} == {i for i, (_, root) in brute_groups(before).items() if root == i}
        elif name == "benchmark decontamination":
            grams = {tuple(w[j : j + 10]) for r in q.table(spark, sf_dir, "benchmark").collect() for w in [split(r.text)] for j in range(len(w) - 9)}
            dirty = {i for i, t in before.items() for w in [split(t)] if any(tuple(w[j : j + 10]) in grams for j in range(len(w) - 9))}
            assert dirty and {i for i, _ in rows} == set(before) - dirty
        else:
            count = collections.Counter(i for i, _ in rows)
            assert set(count) <= set(before) and max(count.values()) <= q.MIX_EPOCHS
        before, docs = dict(rows), out
    got = out.collect()
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(r.text)) + 1 for r in docs.collect())


def test_language_stage_rejects_noise_and_keeps_unlearnt_texts(spark, sf_dir):
    docs = q.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    r = random.Random(2)
    noise = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400)), base64.b64encode(r.randbytes(600)).decode()]
    odd = spark.createDataFrame([(-1, noise[0], None, "x"), (-2, noise[1], None, "x"), (-3, "", None, "x"), (-4, "12 !", None, "x")], docs.schema)
    got = {x.doc_id for x in p.language_id(spark, docs.unionAll(odd), sf_dir).collect()}
    assert not got & {-1, -2, -3, -4} and len(got) > 50
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert p.language_id(spark, none.unionAll(odd), sf_dir).count() == docs.where(r"text rlike '\\p{L}'").count() + 2


def test_run_is_the_stages(spark, sf_dir):
    assert p.run(spark, sf_dir).count() > 50 and p.ORACLE_SQL is None
    assert langid.UNKNOWN == "und"
