"""Fingerprints and mixtures recomputed from their definitions, and odd tables through every stage of the pipeline."""

import collections
import hashlib
import re
from fractions import Fraction

import corpus_pipeline as p
import xxhash
from pyspark.sql import functions as F

from barloom.llm import imatch, mixing
from barloom.llm import queries as q

from .test_operators import docs, empty, odd, texts  # noqa: F401


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def _terms(text):
    found = {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w}
    return sorted(_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in found)


def _print(terms, lexicon):
    known = [t for t in terms if t in lexicon]
    chosen = known if len(known) >= 4 else terms
    out = ""
    for scale in (1, 4, 16):
        for subset in range(16):
            h, some = 42, [t for t in chosen if (t >> 20) % scale == 0 and t % 16 == subset]
            for t in some:
                h = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), h)
            out += f"{h:016x}"[:6] if some else "------"
    return out


def _likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for scale in range(3):
        pairs = [(a[k : k + 6], b[k : k + 6]) for k in range(scale * 96, scale * 96 + 96, 6)]
        pairs = [x for x in pairs if x != ("------", "------")]
        if len(pairs) >= 4:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def test_fingerprints_from_their_definition(docs, texts):  # noqa: F811
    df = collections.Counter(t for x in texts.values() for t in _terms(x or ""))
    lexicon = {t for t, n in df.items() if 0.01 * len(texts) <= n <= 0.05 * len(texts)}
    order, want = sorted(texts, reverse=True), {}
    for k, i in enumerate(order):
        t, other = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        a, b, c = (_print(_terms(x), lexicon) for x in (t, edited, other))
        want[i] = (a, b, _likeness(a, b), _likeness(a, c))
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.compare(docs).collect()}
    assert got == want


def test_ranges_of_ids(spark):
    """Ranges are as full as each other however the ids are spread, and ordered as the ids are."""
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") * F.col("id") * 100_000).alias("doc_id"))
    n = ids.withColumn("b", imatch.id_ranges(ids, 64)).groupBy("b").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("b").collect()
    assert len(n) > 55 and max(r.n for r in n) < 120 and all(a.hi < b.lo for a, b in zip(n, n[1:], strict=False))


def _divide(amount, nodes):
    """Shares of nodes (name: supply, weight): in proportion, none over its supply."""
    share, open_ = {}, dict(nodes)
    while True:
        left, weight = amount - sum(share.values()), sum(w for _, w in open_.values())
        full = [k for k, (s, w) in open_.items() if Fraction(left) * w >= s * weight]
        if not full:
            break
        share |= {k: open_.pop(k)[0] for k in full}
        if not open_:
            return share
    part = {k: left * w // weight for k, (_, w) in open_.items()}
    for k in sorted(open_)[: left - sum(part.values())]:
        part[k] = min(part[k] + 1, open_[k][0])
    return share | part


def test_mixture_from_its_definition(spark, docs):  # noqa: F811
    leaf, tokens, epochs = {}, {}, q.MIX_EPOCHS
    for r in docs.withColumn("d", q.domain()).collect():
        leaf[r.doc_id] = (r.d, r.lang or "(none)", r.source or "(none)")
        tokens[r.doc_id] = max(1, len(re.findall(r"[^ \t\n\r]+", r.text or "")))
    size = collections.Counter()
    for i, path in leaf.items():
        for k in range(4):
            size[path[:k]] += tokens[i]
    share = {(): sum(tokens.values()) * q.MIX_PERCENT // 100}
    for k in range(3):
        for up in [x for x in size if len(x) == k]:
            below = {x: (size[x] * epochs, q.MIX_WEIGHTS.get(x, 1)) for x in size if len(x) == k + 1 and x[:k] == up}
            share |= _divide(share[up], below)
    want = {}
    for path in set(leaf.values()):
        whole, rest = divmod(share[path], size[path])
        mine = sorted((hashlib.md5(f"{q.MIX_SEED}|{whole}|{i}".encode()).hexdigest(), i) for i in leaf if leaf[i] == path)
        upto, last = 0, -1
        for k, (_, i) in enumerate(mine):
            upto += tokens[i]
            if rest and upto - Fraction(tokens[i], 2) <= rest:
                last = k
        want |= {i: whole + (k <= last) for k, (_, i) in enumerate(mine)}
    mixed = mixing.mix(docs, q.domain(), q.MIX_WEIGHTS, q.MIX_PERCENT, epochs, q.MIX_SEED)
    assert {r.doc_id: r.c for r in mixed.select("doc_id", F.col("__copies").alias("c")).collect()} == want


def test_stages_of_odd_rows(spark, sf_dir, odd, empty):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, clashing names and no rows at all, in every stage on its own."""
    names = ["score", "lang_pred", "bits_per_byte", "__letter", "end", "epochs", "window", "__leaf", "__id", "__h", "__copies"]
    odd = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for c in names})
    for name, stage in p.STAGES:
        got, none = stage(spark, odd, sf_dir), stage(spark, empty, sf_dir)
        assert none.count() == 0, name
        if name == "token-ID output":
            rows = got.orderBy("start").collect()
            assert len(rows) == 9 and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1]
            continue
        assert got.columns == odd.columns and none.columns == empty.columns, name
        n = collections.Counter(r.doc_id for r in got.collect())
        assert all(r[c] == f"{c}{r.doc_id or 0}" for r in got.collect() for c in names), name
        if name == "mixing sources to target weights":  # nearly all tokens are those of one row, whose leaf is taken whole
            assert set(n) <= {None, 1, 2, 3, 4, 5, 6} and n[3] in (1, q.MIX_EPOCHS)
            continue
        assert n == {
            "language ID": {None: 1, 3: 1, 4: 1, 5: 3},
            "n-gram Jaccard join": {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1},
            "benchmark decontamination": {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 3, 6: 1},
        }[name], name
