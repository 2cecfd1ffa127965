"""Benchmark decontamination with suffix arrays over the training documents.

Each task sorts the word suffixes of its shards (runs of whole documents of about 1 MB) by their first words and finds
every window of the benchmark by binary search, as a range of training positions. Windows that follow each other both in
a document and in an item are one verbatim match, so each item's longest match in a document comes from the same hits,
whatever its length. No training text is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, text_slices, words, written

WINDOW = 10
#: Words of benchmark items that tasks hold at a time; more are searched block by block.
BLOCK_WORDS = 4_000_000
#: Pairs of places of one document and one item that are listed to find their longest match; more are searched by ranks.
MEETINGS = 4096
#: Such pairs that are listed at a time.
LISTED = 2_000_000


@dataclass(frozen=True)
class Items:
    """Words of benchmark items: ids, their hashes in order of word ids from 1, and the distinct windows."""

    vocabulary: np.ndarray  # sorted hashes; a word's id is its place here plus one
    windows: np.ndarray  # (window, WINDOW) word ids, 0 beyond a short item
    length: np.ndarray  # words of each window
    owner: np.ndarray  # (pair, 2): window, item
    place: np.ndarray  # (place, 3): window, item, the item's word at which the window begins
    place_at: np.ndarray  # first place of each pair of owner, the number of places last
    names: list[str]


def prepare(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Items:
    hashes = []
    for first, buf, off in text_slices(pa.array(texts, pa.string())):
        _, _, h, at = words(buf, off, ALNUM)
        hashes += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    rows, owner, begin = [], [], []
    for i, h in enumerate(hashes):
        w = np.searchsorted(vocabulary, h) + 1
        if 0 < len(w) < window:
            rows.append(np.pad(w, (0, window - len(w)))[None])
        elif len(w):
            rows.append(np.lib.stride_tricks.sliding_window_view(w, window))
        owner += [i] * (len(rows[-1]) if len(w) else 0)
        begin += range(len(rows[-1]) if len(w) else 0)
    stacked = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
    unique, at = np.unique(stacked, axis=0, return_inverse=True)
    place = np.stack([at.ravel(), np.array(owner, np.int64), np.array(begin, np.int64)], 1)
    place = place[np.lexsort(place.T[::-1])]
    first = np.flatnonzero(np.diff(place[:, :2], axis=0, prepend=-1).any(1))
    return Items(vocabulary, unique, (unique > 0).sum(1), place[first, :2], place, np.append(first, len(place)), [str(x) for x in ids])


def _packed(w: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of word ids as a few 64-bit keys whose order is that of the rows."""
    per = 64 // bits
    keys = []
    for a in range(0, w.shape[1], per):
        k = np.zeros(len(w), np.uint64)
        for j in range(a, a + per):
            k = (k << np.uint64(bits)) | (w[:, j].astype(np.uint64) if j < w.shape[1] else np.uint64(0))
        keys.append(k)
    return keys


def _bisect(keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many queries at once in rows sorted by several keys."""
    lo, hi = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, q in zip(keys, query, strict=True):
            x = k[mid]
            less |= same & (x < q)
            same &= x == q
        up = less | same if right else less
        lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def search_shard(items: Items, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the windows in a shard: first word and length of each hit, and the rows (document, item, first word
    in the document, first word in the item, words) of each pair's longest match.

    word: hashes of the shard's words; at: the index of each document's first word, the number of words last.
    """
    none, nothing = np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
    v, width = len(items.vocabulary), items.windows.shape[1]
    if not v or not len(word):
        return none, none, nothing
    place = np.minimum(np.searchsorted(items.vocabulary, word), v - 1)
    ids = np.zeros(len(word) + width, np.int64)
    ids[: len(word)] = np.where(items.vocabulary[place] == word, place + 1, 0)
    doc_end = np.repeat(at[1:], np.diff(at))
    # The suffix array has the suffixes that begin like some benchmark suffix; no other can match.
    begin = np.flatnonzero(ids[: len(word)])
    second = np.where(begin + 1 < doc_end[begin], ids[begin + 1], 0)
    pairs = np.unique(items.windows[:, 0] * (v + 1) + (items.windows[:, 1] if width > 1 else 0))
    alone = np.isin(ids[begin], items.windows[items.length == 1, 0])
    key = ids[begin] * (v + 1) + second
    j = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    begin = begin[(pairs[j] == key) | alone]
    if not len(begin):
        return none, none, nothing
    span = begin[:, None] + np.arange(width)
    rows = np.where(span < doc_end[begin][:, None], ids[span], 0)
    bits = max(8, int(v + 1).bit_length())
    top = (1 << bits) - 1
    keys = _packed(rows, bits)
    order = np.lexsort(keys[::-1])
    suffixes, keys = begin[order], [k[order] for k in keys]
    low = items.windows
    high = np.where(np.arange(width) < items.length[:, None], items.windows, top)
    lo, hi = _bisect(keys, _packed(low, bits), False), _bisect(keys, _packed(high, bits), True)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    first = suffixes[place]
    doc = np.searchsorted(at, first, "right") - 1
    return first, items.length[window], _longest(items, first, window, doc, at)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of which each has n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _longest(items: Items, first: np.ndarray, window: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The longest match of each document and each item with a window in it; of equal ones the first in the document,
    then in the item.

    A match of k windows that follow each other in both is of k - 1 words more than a window. Where a document and an
    item have few places in common, these are sorted by their distance, so that a match is a run; where windows
    repeat in both, the places are not paired.
    """
    order = np.lexsort((first, window, doc))
    first, window, doc = first[order], window[order], doc[order]
    hit = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(window, prepend=-1))
    hits = np.diff(np.append(hit, len(doc)))
    owners = np.searchsorted(items.owner[:, 0], np.arange(len(items.windows) + 1))
    k = owners[window[hit] + 1] - owners[window[hit]]
    # One entry for each document, item and window of both: ``hits`` places here, ``n`` places there.
    own, hit, hits = _spread(owners[window[hit]], k), np.repeat(hit, k), np.repeat(hits, k)
    item, n = items.owner[own, 1], np.diff(items.place_at)[own]
    pair, entry_pair = np.unique(np.stack([doc[hit], item], 1), axis=0, return_inverse=True)
    entry_pair = entry_pair.ravel()
    entries = np.argsort(entry_pair, kind="stable")
    entry_at = np.searchsorted(entry_pair[entries], np.arange(len(pair) + 1))
    meetings = np.bincount(entry_pair, hits * n, len(pair)).astype(np.int64)
    out = np.zeros((len(pair), 5), np.int64)
    out[:, :2] = pair
    few = np.flatnonzero(meetings <= MEETINGS)
    total = np.cumsum(meetings[few])
    a = 0
    while a < len(few):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LISTED, "right")))
        e = entries[_spread(entry_at[few[a:b]], np.diff(entry_at)[few[a:b]])]
        every = hits[e] * n[e]
        t = _spread(np.zeros(len(e), np.int64), every)
        e = np.repeat(e, every)
        s, o = first[hit[e] + t // n[e]], items.place[items.place_at[own[e]] + t % n[e], 2]
        by = np.lexsort((s, s - o, entry_pair[e]))
        p, s, o = entry_pair[e][by], s[by], o[by]
        head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] - o[1:] != s[:-1] - o[:-1]) | (s[1:] != s[:-1] + 1)]))
        run = np.diff(np.append(head, len(p)))
        best = np.lexsort((o[head], s[head], -run, p[head]))
        best = best[np.flatnonzero(np.diff(p[head][best], prepend=-1))]
        out[p[head[best]], 2:] = np.stack([s[head[best]], o[head[best]], run[best]], 1)
        a = b
    for j in np.flatnonzero(meetings > MEETINGS):
        e = entries[entry_at[j] : entry_at[j + 1]]
        text = np.full(at[pair[j, 0] + 1] - at[pair[j, 0]], -1, np.int64)
        text[first[_spread(hit[e], hits[e])] - at[pair[j, 0]]] = np.repeat(window[hit[e]], hits[e])
        places = items.place[_spread(items.place_at[own[e]], n[e])]
        other = np.full(places[:, 2].max() + 1, -2, np.int64)
        other[places[:, 2]] = places[:, 0]
        s, o, run = _common_run(text, other)
        out[j, 2:] = s + at[pair[j, 0]], o, run
    # A short item has one window, of all its words.
    length = np.zeros(len(pair), np.int64)
    length[entry_pair] = items.length[window[hit]]
    out[:, 4] += length - 1
    return out


def _common_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """First places and number of the longest run of numbers that a and b have in common; they have one at least."""
    names, m = np.concatenate([a, b]), len(a)
    ranks = [np.unique(names, return_inverse=True)[1].ravel()]  # of the runs of 1, 2, 4, ... from each place

    def common(n: int) -> tuple[int, int] | None:
        k = n.bit_length() - 1
        top = len(a) + len(b) + 1
        key = lambda x, y: ranks[k][x : y - n + 1] * top + ranks[k][x + n - (1 << k) : y - (1 << k) + 1]
        if min(m, len(b)) < n:
            return None
        left, right = key(0, m), key(m, len(names))
        i = np.flatnonzero(np.isin(left, right))
        return (int(i[0]), int(np.flatnonzero(right == left[i[0]])[0])) if len(i) else None

    low, found = 1, common(1)
    while True:
        k = 1 << (len(ranks) - 1)
        if 2 * k > min(m, len(b)):
            break
        r = ranks[-1]
        after = np.concatenate([r[k:] + 1, np.zeros(k, np.int64)])
        ranks.append(np.unique(r * (len(names) + 2) + after, return_inverse=True)[1].ravel())
        if (at := common(2 * k)) is None:
            break
        low, found = 2 * k, at
    high = min(2 * low, min(m, len(b)) + 1)  # too long, or not tried
    while high - low > 1:
        mid = (low + high) // 2
        if (at := common(mid)) is None:
            high = mid
        else:
            low, found = mid, at
    return *found, low


def _documents(items, emit):
    def run(batches):
        known: Items = items.value
        for batch in batches:
            rows = len(batch.column("text"))
            n_words, n_hit, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            names: list[list[str]] = [[] for _ in range(rows)]
            spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
            matches: list[list[dict]] = [[] for _ in range(rows)]
            for row, buf, off in text_slices(batch.column("text")):
                _, _, word, at = words(buf, off, ALNUM)
                n_words[row : row + len(off) - 1] = np.diff(at)
                first, length, found = search_shard(known, word, at)
                if not len(first):
                    continue
                edge = np.zeros(len(word) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + length, -1)
                hit = np.cumsum(edge[:-1]) > 0
                for d in np.unique(found[:, 0]):
                    a, b = at[d], at[d + 1]
                    own = hit[a:b]
                    n_hit[row + d] = own.sum()
                    flip = np.diff(own.astype(np.int8), prepend=0, append=0)
                    begin, end = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)
                    spans[row + d] = list(zip(begin.tolist(), end.tolist(), strict=True))
                    longest[row + d] = (end - begin).max()
                found[:, 2] -= at[found[:, 0]]
                for d, i, start, item_start, n in found.tolist():
                    names[row + d].append(known.names[i])
                    matches[row + d].append({"item_id": known.names[i], "start": start, "item_start": item_start, "length": n})
            yield emit(batch, n_words, n_hit, longest, names, spans, matches)

    return run


def _digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_MATCHES = "array<struct<item_id: string, start: long, item_start: long, length: long>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))


def _report(batch, n_words, n_hit, longest, names, spans, matches):
    ordered = [sorted(x, key=lambda m: tuple(m.values())) for x in matches]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(set(x)) for x in names], pa.int64()), pa.array([_digest(set(x)) for x in names]), pa.array(n_hit > 0), pa.array(longest), pa.array(ordered, _MATCH)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_run", "matches"],
    )


def _located(batch, n_words, n_hit, longest, names, spans, matches):
    return pa.RecordBatch.from_arrays(
        [batch.column("key"), batch.column("doc_id"), pa.array(n_words), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(matches, _MATCH)],
        names=["key", "doc_id", "n_words", "spans", "matches"],
    )


def _clean(batch, n_words, n_hit, longest, names, spans, matches):
    return batch.filter(pa.array(n_hit == 0))


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Broadcasts of the benchmark's items (item_id, text), of about ``block_words`` words each at most.

    Items come to the driver one block at a time, so neither the driver nor a task holds more than a block and the
    longest item. Null and empty texts have no windows; rows with the same item_id are one item with the windows of all.
    """
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    for k in range(n):
        own = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
        yield spark.sparkContext.broadcast(prepare([r.item_id or "" for r in own], [r.text for r in own], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_hit (words within an occurrence of a window), n_items,
    items_sha256, contaminated, longest_run (the longest run of hit words, whichever windows they are of) and matches:
    for each item with a window in the text, its longest verbatim match as item_id, the first word in the text (start) and
    in the item (item_start), and length in words, by item_id (one for each benchmark row; n_items counts different
    ids). An item shorter than a window matches as a whole.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z as a-z. Null and empty texts have no
    words. Repeated rows are reported each. A benchmark without words hits nothing. With a benchmark of several blocks
    rows are told apart by a number written with them.
    """
    parts = blocks(benchmark, window, block_words)
    part, after = next(parts), next(parts, None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if after is None:
        return rows.mapInArrow(_documents(part, _report), f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_run long, matches {_MATCHES}")
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "numbered")
    every = None
    while part is not None:  # each block's places are written before the next but one is sent to the tasks
        found = written(rows.mapInArrow(_documents(part, _located), f"key long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, matches {_MATCHES}"), "located")
        every = found if every is None else every.unionAll(found)
        part.destroy()
        part, after = after, next(parts, None)
    merged = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.sort_array(F.flatten(F.collect_list("matches"))).alias("matches"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    items = F.array_distinct("matches.item_id")
    runs = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("most")),
        lambda a, s: F.struct(
            F.when(s["start"] <= a["end"], a["start"]).otherwise(s["start"]).alias("start"),
            F.greatest(a["end"], s["end"]).alias("end"),
            F.greatest(a["most"], F.greatest(a["end"], s["end"]) - F.when(s["start"] <= a["end"], a["start"]).otherwise(s["start"])).alias("most"),
        ),
    )["most"]
    return merged.select(
        "doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), runs.alias("longest_run"), "matches",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a word within an occurrence of a benchmark window; columns and texts unchanged."""
    parts = blocks(benchmark, window, block_words)
    part, after = next(parts), next(parts, None)
    while after is not None:  # what a block leaves is written, so that its items can go
        docs = written(docs.mapInArrow(_documents(part, _clean), docs.schema), "clean")
        part.destroy()
        part, after = after, next(parts, None)
    return docs.mapInArrow(_documents(part, _clean), docs.schema)
