"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted over a bounded sample of labelled texts and
then frozen. A text's code length in bits under each tree, with escapes to shorter contexts, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, text_slices

UNKNOWN = "und"
#: Labelled texts to learn from, for each language, in expectation; whole texts are counted.
TEXTS_PER_LANGUAGE = 400
#: Languages that a model may have at most; more are an error, for each adds to the model that all tasks hold.
MAX_LANGUAGES = 256
#: Languages whose code lengths of all bytes of a slice are held at a time.
LANGUAGES_AT_ONCE = 16
#: A code length is kept as a whole number of these parts of a bit, so sums do not depend on their order.
PARTS = 1 << 16
#: Bytes to which a text's evidence is scaled for the score.
EVIDENCE_BYTES = 32.0
#: Bytes of texts that are scored at a time.
SLICE_BYTES = 1 << 18
_START = 0x0A
_DRAW = 1 << 40


def _grams(langs: list[str]):
    def run(batches):
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for first, buf, off in text_slices(batch.column(1)):
                for i in range(len(off) - 1):
                    b = buf[off[i] : off[i + 1]].astype(np.int64)
                    if not len(b):
                        continue
                    p = np.concatenate([np.full(3, _START, np.int64), b])
                    gram, n = np.unique((p[:-3] << 24) | (p[1:-2] << 16) | (p[2:-1] << 8) | p[3:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), langs.index(lang[first + i]), np.int32)), pa.array(gram), pa.array(n)], names=["l", "gram", "n"])

    return run


@dataclass(frozen=True)
class Model:
    """Frozen statistics as arrays: contexts find a row, a row and a byte find the code lengths of all languages."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes that were never seen
    row: np.ndarray  # three symbols -> row of the longest context that was seen
    bits: np.ndarray  # (row * symbols + symbol, language) -> code length in parts of a bit


def _escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of all symbols after a context with these counts; lower: those after its shorter context.

    The escape has the weight of the number of distinct symbols seen (method C), and what it leaves is shared among
    the symbols not seen here, in proportion to their lower probabilities; so each row adds up to one.
    """
    seen, kinds = counts > 0, (counts > 0).sum(1, keepdims=True)
    total = counts.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(1, keepdims=True)
    whole = np.where(left > 0, total + kinds, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(seen, counts / whole, rest * (kinds / (whole * left)))
    return np.where(total > 0, p, lower)


def freeze(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Turns counts of four-byte strings by language into a model."""
    byte = np.stack([(gram >> s) & 255 for s in (24, 16, 8, 0)], 1)
    known = np.union1d(np.unique(byte), [_START])
    symbol = np.zeros(256, np.int32)
    symbol[known] = np.arange(1, len(known) + 1)
    s, a, m = symbol[byte].astype(np.int64), len(known) + 1, len(langs)
    ctx = {1: s[:, 2], 2: s[:, 1] * a + s[:, 2], 3: (s[:, 0] * a + s[:, 1]) * a + s[:, 2]}
    keys = {k: np.unique(c) for k, c in ctx.items()}
    flat = np.full((1, a), 1.0 / 256)
    flat[0, 0] = max(1.0 / 256, 1 - (a - 1) / 256)  # all bytes that were never seen share symbol 0
    bits = []
    for i in range(m):
        own = lang == i
        count = np.zeros((1, a))
        np.add.at(count[0], s[own, 3], n[own])
        p = [_escape(count, flat)]
        parent = np.zeros(len(keys[1]), np.int64)
        for k in (1, 2, 3):
            count = np.zeros((len(keys[k]), a))
            np.add.at(count, (np.searchsorted(keys[k], ctx[k][own]), s[own, 3]), n[own])
            p.append(_escape(count, p[-1][parent]))
            if k < 3:
                parent = np.searchsorted(keys[k], keys[k + 1] % a**k)
        length = -np.log2(np.concatenate(p))
        length[:, 0] = np.minimum(length[:, 0] + np.log2(max(1, 257 - a)), 32)
        bits.append(np.rint(length * PARTS).astype(np.int32).ravel())
    at = np.cumsum([0, 1, len(keys[1]), len(keys[2])])
    row = np.zeros(a**3, np.int32)
    whole = np.arange(a**3)
    for k in (1, 2, 3):
        short = whole % a**k
        j = np.minimum(np.searchsorted(keys[k], short), len(keys[k]) - 1)
        row = np.where(keys[k][j] == short, at[k] + j, row).astype(np.int32)
    return Model(langs, symbol, row, np.ascontiguousarray(np.stack(bits, 1)))


def learn(docs: DataFrame, labelled: Column, texts_per_language: int = TEXTS_PER_LANGUAGE, seed: int = 9) -> Model | None:
    """A model from rows of ``docs`` (doc_id, text, lang) for which ``labelled`` holds; None without such rows.

    Of a language with more than ``texts_per_language`` texts, that many count, give or take the chance of a hash of
    id and text: each is taken or not on its own, so nothing is sorted or gathered. The sample bounds the counts,
    which come to the driver. Null and empty texts and null languages teach nothing.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").alias("lang"), "text", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), "text"), F.lit(_DRAW)).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(_DRAW, _DRAW * texts_per_language // sizes[k]))))
    few = rows.where(F.col("h") < F.element_at(share, F.col("lang")))
    counts = few.select("lang", "text").mapInArrow(_grams(langs), "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["l", "gram"])
    return freeze(langs, counts["l"].to_numpy(), counts["gram"].to_numpy(), counts["n"].to_numpy())


def code_lengths(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parts of a bit for each row and language; empty rows have none."""
    a = int(model.symbol.max()) + 1
    n = np.diff(off)
    out = np.zeros((len(n), len(model.langs)), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    sym = model.symbol[buf]
    p = np.full(len(sym) + 3, model.symbol[_START], np.int32)
    p[3:] = sym
    c1, c2, c3 = p[2:-1].copy(), p[1:-2].copy(), p[:-3].copy()
    heads = off[:-1][full]
    for c, back in ((c1, 1), (c2, 2), (c3, 3)):
        for j in range(back):  # contexts do not reach into the row before
            at = heads + j
            c[at[j < n[full]]] = model.symbol[_START]
    where = model.row[(c3 * a + c2) * a + c1].astype(np.int64) * a + sym
    for k in range(0, len(model.langs), LANGUAGES_AT_ONCE):
        some = slice(k, k + LANGUAGES_AT_ONCE)
        out[full, some] = np.add.reduceat(model.bits[where, some], heads, axis=0, dtype=np.int64)
    return out


def _scored(frozen: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, score and bits a byte for each text."""
    best, score, per_byte = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for first, buf, off in text_slices(texts, SLICE_BYTES):
        bits = code_lengths(frozen, buf, off) / PARTS
        n = np.maximum(np.diff(off), 1)
        low = bits.min(1)
        at = slice(first, first + len(n))
        best[at] = bits.argmin(1)
        score[at] = 1 / np.exp2((low[:, None] - bits) * np.minimum(1, EVIDENCE_BYTES / n)[:, None]).sum(1)
        per_byte[at] = low / n
    return best, score, per_byte


def _predict(model, extra: list[str]):
    def run(batches):
        frozen: Model = model.value
        names = np.array([*frozen.langs, UNKNOWN], object)
        for batch in batches:
            ok = batch.column("__letter").to_numpy(zero_copy_only=False)
            best, score, per_byte = _scored(frozen, batch.column("text"))
            pred = pa.array(names[np.where(ok, best, len(frozen.langs))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pred, pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, per_byte, 0.0))], names=[*extra, "lang_pred", "score", "bits_per_byte"])

    return run


def _within(model, max_bits: float):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(model.value, batch.column("text"))[2] < max_bits))

    return run


def of_some_language(docs: DataFrame, model: Model | None, max_bits: float) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and takes under ``max_bits`` bits a byte in its best language; without
    a model, those with a letter. Columns, whatever their names, and texts are unchanged."""
    docs, named = set_aside(docs, "text")
    docs = docs.where(F.col("text").rlike(r"\p{L}"))
    if model is None:
        return named(docs)
    return named(docs.mapInArrow(_within(docs.sparkSession.sparkContext.broadcast(model), max_bits), docs.schema))


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` of every row with lang_pred, score (0 to 1) and bits_per_byte, from the whole text alone.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text if nothing was learnt.
    Predictions replace columns of their names. Ties go to the first language by name. Repeated rows are predicted alike; an empty table gives an empty result.
    """
    columns = [c for c in columns if c not in ("lang_pred", "score", "bits_per_byte", "__letter")]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys([*columns, "text"]), letter.alias("__letter"))
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(_predict(sent, columns), schema)
