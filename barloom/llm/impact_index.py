"""Ranked search over a bit-sliced index of term impacts.

Documents are packed into blocks. For each term of a block the index has the places of its documents and one bitmap for
each bit of their impacts. A query adds its terms' bitmaps slice by slice with carries, for all documents of a block at
once and for many queries side by side, and finds the best documents from the most significant slice down. Impacts
are whole numbers, so scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, partitions, text_slices, words, workspace, written
from .parity_join import small

TOP = 20
#: Documents of a block at most (places have 16 bits), and postings from which on it is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 2_000_000
#: Terms with fewer postings in a block have their impacts written as numbers; their bits are set when they are read.
SLICED = 64
#: Characters of queries that are searched for at once, about; more are searched in blocks of queries.
QUERY_CHARS = 1 << 20
#: Bytes of sums and of terms' bitmaps that a search holds at a time, about.
SUM_BYTES, TERM_BYTES = 32 << 20, 64 << 20
#: Terms of a task whose documents are counted before they are passed on.
_COUNTED = 1_000_000
_INDEX = "block long, term long, n int, dense boolean, places binary, impacts binary, bits int"


@dataclass(frozen=True)
class Index:
    """Rows of blocks and terms, and the documents and words that they are of. A row without a term has the block's ids."""

    rows: DataFrame
    documents: int
    words: int


def _term_counts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each term of each row, by row and term; and the words of each row."""
    _, _, word, at = words(buf, off, ALNUM)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((word, row))
    word = word[order]
    head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])[: len(word)])
    return row[head], word[head].view(np.int64), np.diff(np.append(head, len(word))), n


def _summed(term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(term, kind="stable")
    term = term[order]
    head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
    return term[head], np.add.reduceat(n[order], head) if len(head) else n[:0]


def _frequencies(batches):
    """Documents of each term, and a row without a term with all documents and words."""
    term, count, docs, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0

    def out(t, n, w):
        return pa.RecordBatch.from_arrays([t, n, w], names=["term", "docs", "words"])

    held = []
    for batch in batches:
        for _, buf, off in text_slices(batch.column(0)):
            _, own, _, n = _term_counts(buf, off)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            held.append(_summed(own, np.ones(len(own), np.int64)))
            if sum(len(t) for t, _ in held) > _COUNTED:
                term, count = _summed(*(np.concatenate(x) for x in zip((term, count), *held, strict=True)))
                held = []
                if len(term) > _COUNTED:
                    yield out(pa.array(term), pa.array(count), pa.nulls(len(term), pa.int64()))
                    term, count = term[:0], count[:0]
    term, count = _summed(*(np.concatenate(x) for x in zip((term, count), *held, strict=True)))
    yield out(pa.array(term), pa.array(count), pa.nulls(len(term), pa.int64()))
    yield out(pa.array([None], pa.int64()), pa.array([docs]), pa.array([total]))


def _frequent(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A term's share of its document's score for each unit of the term's weight."""
    exact = object if 25 * int(n.max(initial=0)) * docs >= 1 << 63 else np.int64
    m = 75 + (25 * n.astype(exact) * docs) // total
    return ((1_000_000_000 * tf.astype(exact)) // (1000 * tf + 12 * m)).astype(np.int64)


def _postings(docs: int, total: int, block_docs: int, block_postings: int):
    """Blocks of documents (doc_id, text): a row for each term, with places and frequencies, and one with the ids."""

    def block(number: int, ids: list, row: list, term: list, value: list):
        ids = pa.chunked_array(ids).combine_chunks()
        known = np.asarray(ids.is_valid())
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((plain, ~known))  # by id, null last, so the first place of equal scores goes first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, term, value = place[np.concatenate(row)], np.concatenate(term), np.concatenate(value)
        by = np.lexsort((row, term))
        row, term, value = row[by].astype(np.uint16), term[by], value[by]
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        n = np.diff(np.append(head, len(term)))
        yield number, pa.array([None], pa.int64()), pa.array([len(order)], pa.int32()), pa.array([False]), pa.array([plain[order][: known.sum()].tobytes()]), pa.array([b""])
        dense = n * 16 > len(order)
        for kind in (False, True):
            some = np.flatnonzero(dense == kind)
            for a in range(0, len(some), 20_000 if not kind else 500):
                own = some[a : a + (20_000 if not kind else 500)]
                take = np.concatenate([np.arange(head[i], head[i] + n[i]) for i in own]) if kind else np.repeat(head[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
                ends = np.concatenate([[0], np.cumsum(n[own])])
                values = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((8 * ends).astype(np.int32).tobytes()), pa.py_buffer(value[take].tobytes())])
                if kind:
                    flags = np.zeros((len(own), -(-len(order) // 8) * 8), np.uint8)
                    flags[np.repeat(np.arange(len(own)), n[own]), row[take]] = 1
                    places = pa.array([x.tobytes() for x in np.packbits(flags, axis=1, bitorder="little")], pa.binary())
                else:
                    places = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(row[take].tobytes())])
                yield number, pa.array(term[head[own]]), pa.array(n[own].astype(np.int32)), pa.array(np.full(len(own), kind)), places, values

    def rows(*args):
        for number, term, *rest in block(*args):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), number)), term, *rest], names=["block", "term", "n", "dense", "places", "values"])

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, ([], [], [], [])
        size = documents = 0
        for batch in batches:
            for first, buf, off in text_slices(batch.column(1)):
                row, term, tf, n = _term_counts(buf, off)
                lo = 0
                full = np.flatnonzero(n)
                while lo < len(full):  # as many documents as the block has room for
                    some = full[lo : lo + block_docs - documents]
                    own = (row >= some[0]) & (row <= some[-1])
                    held[0].append(batch.column(0).take(pa.array(first + some)))
                    held[1].append(documents + np.searchsorted(some, row[own]))
                    held[2].append(term[own])
                    held[3].append(_frequent(tf[own], n[row[own]], docs, total))
                    size, documents, lo = size + len(held[2][-1]), documents + len(some), lo + len(some)
                    if size >= block_postings or documents == block_docs:
                        yield from rows(number, *held)
                        number, held, size, documents = number + 1, ([], [], [], []), 0, 0
        if documents:
            yield from rows(number, *held)

    return run


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap for each bit of the values, packed, and their number."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    flags = ((values >> np.arange(bits)[:, None]) & 1).astype(np.uint8)
    return np.packbits(flags, axis=1, bitorder="little"), bits


def _sliced(batches):
    """Multiplies frequencies by the terms' weights and cuts them into slices."""
    for batch in batches:
        out, bits = [], np.zeros(batch.num_rows, np.int32)
        for i, (n, weight, values) in enumerate(zip(batch.column(2).to_pylist(), batch.column(6).to_pylist(), batch.column(5), strict=True)):
            if weight is None:
                out.append(b"")
                continue
            impact = np.frombuffer(values.as_buffer(), np.int64) * weight
            if n < SLICED:
                out.append(impact.tobytes())
            else:
                packed, bits[i] = slices(impact)
                out.append(packed.tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(out, pa.binary()), pa.array(bits)], names=["block", "term", "n", "dense", "places", "impacts", "bits"])


def build(docs: DataFrame, path: str | None = None, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Index:
    """The index of ``docs`` (doc_id, text), written to ``path`` or the shared folder.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z as a-z, told apart by 64-bit hashes. A first
    pass counts the documents of each term; their table is broadcast if it is small and else joined by a shuffle. No text
    is shuffled. Null and empty texts, and those without a term, have no place in the index. Repeated rows and ids are
    documents of their own, null ids too; other columns are ignored; an empty table gives an empty index.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_frequencies, "term long, docs long, words long")
    counts = written(counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")), "terms")
    every = counts.where("term is null").first()
    n, total = (every.docs, every.words) if every else (0, 0)
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("docs") + 1))).cast("long")
    weights = written(counts.where("term is not null").select("term", weight.alias("weight")), "weights")
    path = path or workspace(docs.sparkSession, "index")
    postings = rows.mapInArrow(_postings(n, max(total, 1), block_docs, block_postings), "block long, term long, n int, dense boolean, places binary, values binary")
    postings.join(small(weights), "term", "left").select("block", "term", "n", "dense", "places", "values", "weight").mapInArrow(_sliced, _INDEX).write.parquet(path)
    return Index(docs.sparkSession.read.schema(_INDEX).parquet(path), n, total)


# --- search ------------------------------------------------------------------


def add(sums: np.ndarray, some: np.ndarray, term: np.ndarray, shift: int) -> None:
    """Adds slices ``term`` (queries, bits, words), times two to the ``shift``, to the rows ``some`` of the sums
    (queries, bits, words), which have room for all carries."""
    carry = None
    for b in range(shift, sums.shape[1]):
        own = sums[some, b]
        if b - shift < term.shape[1]:
            other = term[:, b - shift]
            either = own ^ other
            both = own & other
        elif carry is not None and carry.any():
            either, both = own, None
        else:
            return
        sums[some, b] = either if carry is None else either ^ carry
        kept = None if carry is None else either & carry
        carry = kept if both is None else both if kept is None else both | kept


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sure documents and of those that tie for the places left, for each row of the sums.

    From the most significant slice down: if the sure ones and the candidates with the bit are over k, only those with
    the bit remain candidates; else they are sure, and the others remain. Documents that score nothing are no candidates.
    """
    maybe = np.bitwise_or.reduce(sums, axis=1)
    sure = np.zeros_like(maybe)
    for b in range(sums.shape[1] - 1, -1, -1):
        bit = maybe & sums[:, b]
        n = np.bitwise_count(sure | bit).sum(1)
        over, full = (n > k)[:, None], (n == k)[:, None]
        sure = np.where(over, sure, sure | bit)
        maybe = np.where(over, bit, np.where(full, np.uint64(0), maybe & ~sums[:, b]))
    return sure, maybe


def _bitmaps(row: dict, docs: int) -> np.ndarray:
    """Slices (bits, words) of a term over all places of a block."""
    n = row["n"]
    if row["dense"]:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(row["places"], np.uint8), bitorder="little"))
    else:
        at = np.frombuffer(row["places"], np.uint16)
    if row["bits"]:
        own = np.unpackbits(np.frombuffer(row["impacts"], np.uint8).reshape(row["bits"], -1), axis=1, count=n, bitorder="little")
    else:
        value = np.frombuffer(row["impacts"], np.int64)
        own = (value >> np.arange(max(1, int(value.max()).bit_length()))[:, None]) & 1
    flags = np.zeros((len(own), -(-docs // 64) * 64), np.uint8)
    flags[:, at] = own
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _search(queries, k: int):
    """The k best documents of each block for each query; rows come sorted by block."""

    def block(rows: list[dict]):
        docs = next(x for x in rows if x["term"] is None)
        ids, n = np.frombuffer(docs["places"], np.int64), docs["n"]
        words_ = -(-n // 64)
        terms = {x["term"]: x for x in rows if x["term"] is not None}
        own = [(number, [(t, c) for t, c in query if t in terms]) for number, query in queries.value]
        own = [x for x in own if x[1]]
        size = {t: x["bits"] or max(1, int(np.frombuffer(x["impacts"], np.int64).max()).bit_length()) for t, x in terms.items()}
        room = {number: sum(c << size[t] for t, c in query).bit_length() for number, query in own}
        at = 0
        while at < len(own):
            group, maps, held, width = [], {}, 0, 0
            while at < len(own):
                number, query = own[at]
                more = sum(8 * words_ * size[t] for t, _ in query if t not in maps)
                wide = max(width, room[number])
                if group and (held + more > TERM_BYTES or 8 * words_ * wide * (len(group) + 1) > SUM_BYTES):
                    break
                held, width = held + more, wide
                for t, _ in query:
                    if t not in maps:
                        maps[t] = _bitmaps(terms[t], n)
                group.append(own[at])
                at += 1
            yield from summed(group, maps, width, words_, ids, n)

    def summed(group, maps, width, words_, ids, n):
        sums = np.zeros((len(group), width, words_), np.uint64)
        # Each query's terms, as often as their counts have bits; those of one place and shift are added side by side.
        steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, (_, query) in enumerate(group):
            for j, (t, c) in enumerate(query):
                for shift in range(c.bit_length()):
                    if c >> shift & 1:
                        steps.setdefault((j, shift), []).append((i, t))
        for (_, shift), pairs in steps.items():
            some = np.array([i for i, _ in pairs])
            term = np.zeros((len(pairs), max(len(maps[t]) for _, t in pairs), words_), np.uint64)
            for p, (_, t) in enumerate(pairs):
                term[p, : len(maps[t])] = maps[t]
            add(sums, some, term, shift)
        sure, maybe = best(sums, k)
        query, doc = [], []
        for i in range(len(group)):
            a = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            b = np.flatnonzero(np.unpackbits(maybe[i].view(np.uint8), bitorder="little"))[: k - len(a)]
            doc += [a, b]
            query += [i] * (len(a) + len(b))
        query, doc = np.array(query, np.int64), np.concatenate(doc)
        bit = (sums[query, :, doc >> 6] >> (doc & 63).astype(np.uint64)[:, None]) & np.uint64(1)
        score = (bit << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)
        known = doc < len(ids)
        named = pa.array(np.append(ids, 0)[np.minimum(doc, len(ids))], mask=~known)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([g[0] for g in group], np.int64)[query]), named, pa.array(score)], names=["query", "doc_id", "score"])

    def run(batches):
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[-1]["block"] != row["block"]:
                    yield from block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from block(rows)

    return run


def _hashed(numbers: list[int], texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]]]]:
    out = []
    for first, buf, off in text_slices(pa.array(texts, pa.string())):
        row, term, n, _ = _term_counts(buf, off)
        at = np.searchsorted(row, np.arange(len(off)))
        out += [(numbers[first + i], list(zip(term[at[i] : at[i + 1]].tolist(), n[at[i] : at[i + 1]].tolist(), strict=True))) for i in range(len(off) - 1) if at[i + 1] > at[i]]
    return out


def search(index: Index, queries: DataFrame, k: int = TOP, query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents with a score above 0 for each row of ``queries``
    (item_id, text), by score and then ascending doc_id (null last); all, if they are fewer.

    A term counts as often as it stands in the query. Each row is a query of its own, also where item ids repeat or are
    null; null and empty texts find nothing. Queries come to the driver and the tasks in blocks of about QUERY_CHARS. Only
    rows of their terms are shuffled, by block of documents, and each block gives k documents for a query at most.
    """
    spark = queries.sparkSession
    rows = written(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("string").alias("text")), "queries")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n, found = max(1, -(-total // query_chars)), None
    for part in range(n):
        own = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("query"), F.lit(n)) == part)).select("query", "text").collect()
        hashed = _hashed([r.query for r in own], [r.text for r in own])
        terms = sorted({t for _, query in hashed for t, _ in query})
        if not terms:
            continue
        sent = spark.sparkContext.broadcast(hashed)
        wanted = spark.createDataFrame([(t,) for t in terms], "term long").coalesce(1)
        hits = index.rows.where("term is not null").join(F.broadcast(wanted), "term", "left_semi").select(*index.rows.columns)
        dealt = index.rows.where("term is null").unionAll(hits).repartition(partitions(index.rows), "block").sortWithinPartitions("block")
        step = dealt.mapInArrow(_search(sent, k), "query long, doc_id long, score long")
        if n > 1:  # each block's results are written before the next is sent
            step = written(step, "found")
            sent.destroy()
        found = step if found is None else found.unionAll(step)
    kind = rows.schema["item_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(small(rows.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score")
