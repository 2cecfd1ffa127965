"""Exact Jaccard join of word shingles by parity sketches.

A text's shingles are XOR-hashed into a parity sketch: every shingle flips one bit. Two sketches differ in at most as
many bits as the sets have elements apart, and sets of sizes a and b with a Jaccard index of 3/4 are at most
(a + b) / 7 apart. Cut into more blocks than that, such sketches agree in some block (the pigeonhole). Sketches are
joined on equal blocks, per band of sizes; what meets is verified against the texts.

A sketch for the join has 2**58 bits a block and so is kept sparsely: a block is named by the XOR of its shingles'
64-bit hashes. A dense sketch of SKETCH_BITS, folded from the same hashes, rejects most chance meetings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DARK, discard, mix, partitions, perhaps, set_aside, text_slices, words, written

SHINGLE = 5
#: Bytes of texts whose shingles are hashed at a time, keys that are passed on in a batch, and keys that are packed together.
SLICE_BYTES, KEYS, PACKED = 1 << 18, 1 << 16, 1 << 19
#: Low bytes of a key that are shuffled; its top 16 bits give the partition. And the most keys in a run of one set's.
KEY_BYTES, RUN = 5, 127
#: Links have num * union <= den * intersection; the bounds below are for this ratio.
NUMERATOR, DENOMINATOR = 75, 100
SKETCH_BITS = 4096
#: Sets with fewer elements keep a sketch folded to this size; it also stands first in every comparison.
FOLDED_BITS, FOLD_BELOW = 1024, 512
#: Rounds in which each component tries the most frequent meetings with leaders of buckets, and the leaders a bucket has
#: in each (one in the first), before buckets are compared in full.
LEADERS = (1, 4)
#: Rows of a table that is broadcast at most, some 10 MB of the driver's; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Members of a bucket that are compared in one piece; more are dealt to pairs of pieces.
TILE = 2048
#: Buckets with more members have their last pairs verified in place, so that they give one row for each component at most.
LISTED = 512
#: Elements of sets in one piece of such a bucket, about.
TILE_ELEMENTS = 500_000
#: Classes, about, from which it is estimated how many have a shingle; it is frequent if so many of all have it, and
#: FREQUENT_SEEN of these. And the most frequent shingles that are told apart. Only the order of keys rests on them.
SEEN, FREQUENT_FROM, FREQUENT_SEEN, FREQUENT = 1 << 14, 64, 4, 1 << 18
_LARGEST = 1 << 40
_M = np.uint64(0xD6E8FEB86659FD93)
_PACK = "part int, cids array<long>, counts array<byte>, keys binary"
#: Members up to which a bucket is told by its set of members.
WHOLE = 1 << 16


@dataclass(frozen=True)
class Likeness:
    """What links two sets, and the sketches that find such sets.

    Sets of ``shingle`` words are linked if den * intersection >= num * union. ``sketches(tokens, off)`` gives a sketch
    in bytes for each set and, or None, an array of keys for each; ``block_keys(tokens, off, band, frequent)`` gives keys and
    rows if the sketches don't. Linked sets have a key in common. ``matrices(sketches, n)`` arranges sketches for
    ``may_link(n, matrices, x, y)``, which tells for rows x and y, pair by pair, whether a link is possible.
    """

    shingle: int
    num: int
    den: int
    sketches: Callable
    matrices: Callable
    may_link: Callable
    block_keys: Callable | None = None

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and self.den * both >= self.num * (len(x) + len(y) - both)


def _bands() -> np.ndarray:
    """Lower ends of size bands: sets that can be linked are of one band or of two that follow each other.

    Bands are as wide as three steps from a set's size to the largest that it can be linked with, so only the last third
    of a band, by the logarithm of sizes, has keys in the next one too.
    """
    low = [3]
    while low[-1] < _LARGEST:
        n = low[-1]
        for _ in range(3):
            n = 4 * (n - 1) // 3 + 1
        low.append(max(n, low[-1] + 1))
    return np.array(low, np.int64)


BANDS = _bands()


def shingle_sets(col: pa.Array, shingle: int = SHINGLE):
    """Yields (first row, hashes of distinct shingles row by row, sorted within a row; offsets of the rows)."""
    for first, buf, off in text_slices(col, SLICE_BYTES):
        _, _, w, at = words(buf, off, DARK)
        n = np.diff(at)
        with np.errstate(over="ignore"):
            h = np.zeros(len(w), np.uint64)
            for j in range(shingle):
                h[: max(0, len(w) - j)] = h[: max(0, len(w) - j)] * _M + w[j:]
            for short in range(1, shingle):  # the whole text as one
                rows = np.flatnonzero(n == short)
                if len(rows):
                    s = np.full(len(rows), short, np.uint64)
                    for j in range(short):
                        s = s * _M + w[at[rows] + j]
                    h[at[rows]] = s
        h = mix(h)
        size = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        sets, sizes = [], np.zeros(len(n), np.int64)
        for i, (a, k) in enumerate(zip(at[:-1].tolist(), size.tolist(), strict=True)):
            x = np.sort(h[a : a + k])
            if k > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            sets.append(x)
            sizes[i] = len(x)
        yield first, np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def _content_ids(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; sets without elements get 0."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(mix(tokens ^ _M), off[:-1][full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def _dense(tokens: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity of the shingles at each of SKETCH_BITS places, or FOLDED_BITS for a small set."""
    out = []
    for x, n in ((tokens[a:b], b - a) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        size = SKETCH_BITS if n >= FOLD_BELOW else FOLDED_BITS
        count = np.bincount(((x >> np.uint64(3)) % np.uint64(size)).astype(np.int64), minlength=size)
        out.append(np.packbits((count & 1).astype(np.uint8)).tobytes())
    return out


def _matrices(sketches: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded sketches of all sets, and whole ones of those from FOLD_BELOW elements on (others: zeros)."""
    large = n >= FOLD_BELOW
    whole = np.zeros((len(n), SKETCH_BITS // 64), np.uint64)
    folded = np.zeros((len(n), FOLDED_BITS // 64), np.uint64)
    whole[large] = np.frombuffer(b"".join(x for x, big in zip(sketches, large, strict=True) if big), np.uint64).reshape(-1, SKETCH_BITS // 64)
    folded[large] = np.bitwise_xor.reduce(whole[large].reshape(-1, SKETCH_BITS // FOLDED_BITS, FOLDED_BITS // 64), axis=1)
    folded[~large] = np.frombuffer(b"".join(x for x, big in zip(sketches, large, strict=True) if not big), np.uint64).reshape(-1, FOLDED_BITS // 64)
    return folded, whole


def _may_link(n: np.ndarray, sketches: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a link between the rows x and y, pair by pair. Each test sees what the last left."""
    folded, whole = sketches
    at = np.flatnonzero(4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
    limit = (n[x] + n[y]) // 7
    at = at[np.bitwise_count(folded[x[at]] ^ folded[y[at]]).sum(1) <= limit[at]]
    both = np.flatnonzero((n[x[at]] >= FOLD_BELOW) & (n[y[at]] >= FOLD_BELOW))
    far = np.bitwise_count(whole[x[at[both]]] ^ whole[y[at[both]]]).sum(1) > limit[at[both]]
    out = np.zeros(len(x), bool)
    out[at] = True
    out[at[both[far]]] = False
    return out


def _plausible(like: Likeness):
    """Of pairs (a, b, na, nb, sa, sb), those that sizes and sketches allow."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            sketches = like.matrices(batch.column(4).to_pylist() + batch.column(5).to_pylist(), n)
            keep = pa.array(like.may_link(n, sketches, np.arange(rows), np.arange(rows) + rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _classes(like: Likeness):
    def run(batches):
        for batch in batches:
            for first, tokens, off in shingle_sets(batch.column(1), like.shingle):
                rows = len(off) - 1
                for a in range(0, rows, 2000):
                    b = min(rows, a + 2000)
                    own = off[a : b + 1] - off[a]
                    t = tokens[off[a] : off[b]]
                    sketch, keys = like.sketches(t, own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first + a, b - a), batch.column(2).slice(first + a, b - a), pa.array(np.diff(own)), pa.array(_content_ids(t, own)), pa.array(sketch, pa.binary()),
                            pa.nulls(b - a, pa.list_(pa.int64())) if keys is None else keys,
                        ],
                        names=["doc_id", "h", "n", "cid", "sketch", "keys"],
                    )

    return run


def block_keys(tokens: np.ndarray, off: np.ndarray, band_of: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sparse sketches' blocks that have to be joined, and the rows they are of.

    ``band_of``: for each row, the band of the larger set of the pairs to be found: its own or the next, which has none
    for a set whose largest partner is of its own band. With d the
    most elements that its pairs are apart and z its empty blocks of B, a linked set agrees in at least s = B - d - z
    blocks that are not empty. So, of all keys in one common order, the first d + 1 of each set have one in common
    (the prefix filter). Blocks of ``frequent`` shingles only (sorted hashes and their levels) come last, as all texts
    with one line or passage would meet in them; before them the fullest come first, as they meet least by chance. Equal
    blocks have equal shingles, so the order is a common one whatever is taken for frequent. A row with s < 1, which is
    rare, gives all its keys and one that stands for empty blocks.
    """
    n = np.diff(off)
    ok = np.flatnonzero((n >= BANDS[0]) & (4 * n // 3 >= BANDS[band_of]))
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = band_of[ok]
    blocks = (76 * BANDS[g]) // 100 + 6
    apart = (n[ok] + np.minimum(4 * n[ok] // 3, BANDS[g + 1] - 1)) // 7
    base = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(ok)), n[ok])
    take = np.repeat(off[:-1][ok], n[ok]) + np.arange(len(row)) - np.repeat(np.cumsum(n[ok]) - n[ok], n[ok])
    t = tokens[take]
    with np.errstate(over="ignore"):
        b = ((mix(t * _M) >> np.uint64(32)) * blocks[row].astype(np.uint64)) >> np.uint64(32)
        slot = base[row] + b.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, t = slot[order], t[order]
        head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        parity, count = np.bitwise_xor.reduceat(t, head), np.diff(np.concatenate([head, [len(slot)]]))
        level = np.zeros(len(head), np.int8)
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], t), len(frequent[0]) - 1)
            level = np.minimum.reduceat(np.where(frequent[0][at] == t, frequent[1][at], 0), head)
        slot = slot[head]
        doc = np.searchsorted(base, slot, "right") - 1
        where = (slot - base[doc]).astype(np.uint64) + (g[doc].astype(np.uint64) << np.uint64(48))
        key = mix(parity ^ mix(where + _M))
    full = np.bincount(doc, minlength=len(ok))
    sure = full - apart
    order = np.lexsort((key, -count, level, doc))
    doc, key = doc[order], key[order]
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    kept = (rank <= apart[doc]) | (sure[doc] < 1)
    rare = np.flatnonzero(sure < 1)
    with np.errstate(over="ignore"):
        empty = mix(g[rare].astype(np.uint64) * _M + np.uint64(1))
    return np.concatenate([key[kept], empty]).view(np.int64), np.concatenate([ok[doc[kept]], ok[rare]])


def _shingles(like: Likeness):
    """The shingles of each set."""

    def run(batches):
        for batch in batches:
            for _, tokens, _ in shingle_sets(batch.column(0), like.shingle):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["shingle"])

    return run


def frequent_shingles(rows: DataFrame, classes: DataFrame, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and for each how often it was seen, as a logarithm.

    They are looked for in some SEEN classes, so that this is no more work for more rows. They only order keys: whichever
    are missed or wrongly taken, the join finds the same links.
    """
    share = max(1, classes.count() // SEEN)
    some = classes.where(F.pmod(F.xxhash64("cid"), F.lit(share)) == 0).select(F.col("first").alias("doc_id"))
    least = max(FREQUENT_SEEN, FREQUENT_FROM // share)
    seen = rows.join(F.broadcast(some), "doc_id").select("text").mapInArrow(_shingles(like), "shingle long")
    seen = written(seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least), "frequent")
    found = seen.orderBy(F.desc("k"), "shingle").limit(FREQUENT).toArrow()
    discard(seen)
    shingle, k = found.column("shingle").to_numpy().view(np.uint64), found.column("k").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], (1 + np.log2(np.maximum(k[order], 1)).astype(np.int64)).astype(np.int8)


def _keys(like: Likeness, parts: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
    """Keys of all sets, packed by the partition they go to."""

    def found(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, tokens, off in shingle_sets(batch.column(0), like.shingle):
                cid = _content_ids(tokens, off)
                own = np.searchsorted(BANDS, np.diff(off), "right") - 1
                new = np.array([c not in seen and not seen.add(c) for c in cid.tolist()], bool)
                n = np.where(new, np.diff(off), 0)
                keep = np.repeat(new, np.diff(off))
                tokens, off = tokens[keep], np.concatenate([[0], np.cumsum(n)])
                for step in (0, 1):
                    key, row = like.block_keys(tokens, off, np.maximum(own, 0) + step, frequent)
                    yield key, cid[row]

    def run(batches):
        held, many = [], 0
        for key, cid in chain(found(batches), [(None, None)]):
            if key is not None:
                held.append((key, cid))
                many += len(key)
            if many and (key is None or many >= PACKED):
                key, cid = (np.concatenate(x) for x in zip(*held, strict=True))
                held, many = [], 0
                for a in range(0, len(key), PACKED):
                    yield pack_keys(key[a : a + PACKED], cid[a : a + PACKED], parts)

    return run


def pack_keys(key: np.ndarray, cid: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each partition that keys go to: the cids of runs of keys of one set, the runs' lengths, the keys' low bytes.

    A key keeps its partition, some log2(parts) bits, and KEY_BYTES: equal keys stay equal, and the few others that become
    equal are meetings by chance.
    """
    key = key.view(np.uint64)
    part = (((key >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.int64)
    order = np.lexsort((cid, part))
    key, cid, part = key[order], cid[order], part[order]
    head = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (cid[1:] != cid[:-1])]))
    at = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
    head = np.flatnonzero(at % RUN == 0)
    row = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    runs = np.searchsorted(head, np.append(row, len(key)))
    low = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.array(values))

    counts = np.diff(np.append(head, len(key))).astype(np.int8)
    ends = (KEY_BYTES * np.append(row, len(key))).astype(np.int32)
    keys = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(low)])
    return pa.RecordBatch.from_arrays([pa.array(part[row].astype(np.int32)), lists(cid[head]), lists(counts), keys], names=["part", "cids", "counts", "keys"])


def unpacked(packed: DataFrame) -> DataFrame:
    """Rows (key, cid) of packed keys, each key as a hash of its partition and bytes.

    Spark's own expressions do it: a second Python function in the task that sorts keys would take a second worker for
    each core, which stays and comes to hold as much as the first.
    """
    cids = F.flatten(F.transform(F.arrays_zip("cids", "counts"), lambda x: F.array_repeat(x["cids"], x["counts"].cast("int"))))
    # Apart from the list's making, the generator compiles; interpreted, it would copy all bytes for each key.
    each = packed.select("part", "keys", cids.alias("cids")).select("part", "keys", F.posexplode_outer("cids").alias("i", "cid"))
    return each.select(F.xxhash64("part", F.expr(f"substring(keys, {KEY_BYTES} * i + 1, {KEY_BYTES})")).alias("key"), "cid")


def unpack_keys(batches):
    """Rows (key, cid) of packed keys in batches, with the keys' own bits; ``unpacked`` does it for a table."""
    for batch in batches:
        for part, *lists, keys in zip(*(batch.column(k) for k in range(4)), strict=True):
            (cids, counts), low = (x.values.to_numpy() for x in lists), np.frombuffer(keys.as_buffer(), np.uint8)
            key = np.zeros((len(low) // KEY_BYTES, 8), np.uint8)
            key[:, :KEY_BYTES] = low.reshape(-1, KEY_BYTES)
            key = key.view("<u8").ravel().astype(np.int64) + (part.as_py() << 8 * KEY_BYTES)
            cid = np.repeat(cids, counts)
            for a in range(0, len(key), KEYS):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + KEYS]), pa.array(cid[a : a + KEYS])], names=["key", "cid"])


def _meetings(alike: bool):
    """Of rows sorted by key and cid, those whose key has several cids, with the key's first cid and a weight of 1.

    With ``alike``, buckets of the same members become one, as far as they are at hand: its key is made of its members and
    its weight is the number of these buckets. Those with more than WHOLE members are not held for that and keep their key.
    """

    def out(k, c, head, weight):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(head), pa.array(weight)], names=["key", "cid", "head", "weight"])

    def closed(k, c):
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        weight = np.ones(len(first), np.int64)
        use = np.flatnonzero(size > 1)
        if alike and len(use):
            with np.errstate(over="ignore"):
                name = mix(np.add.reduceat(mix(c.view(np.uint64) ^ _M), first) + size.astype(np.uint64)).view(np.int64)
            _, at, several = np.unique(name[use], return_index=True, return_counts=True)
            weight[use[at]] = several
            use = use[at]
            k = np.repeat(name, size)
        if len(use):
            take = np.repeat(first[use], size[use]) + np.arange(size[use].sum()) - np.repeat(np.cumsum(size[use]) - size[use], size[use])
            yield out(k[take], c[take], np.repeat(c[first[use]], size[use]), np.repeat(weight[use], size[use]))

    def run(batches):
        k = c = np.zeros(0, np.int64)
        wide = None  # key, first and last cid of a bucket whose rows go on at once
        for batch in chain(batches, [None]):
            if batch is not None:
                k, c = np.concatenate([k, batch.column(0).to_numpy()]), np.concatenate([c, batch.column(1).to_numpy()])
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c = k[new], c[new]
            if wide and len(k):
                end = int(np.searchsorted(k, wide[0], "right"))
                own = c[:end][c[:end] != wide[2]]
                if len(own):
                    yield out(np.full(len(own), wide[0]), own, np.full(len(own), wide[1]), np.ones(len(own), np.int64))
                    wide = (*wide[:2], own[-1])
                k, c = k[end:], c[end:]
                if len(k):
                    wide = None
            if not len(k):
                continue
            cut = len(k) if batch is None else int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield from closed(k[:cut], c[:cut])
            k, c = k[cut:], c[cut:]
            if len(k) > WHOLE:
                yield out(k, c, np.full(len(k), c[0]), np.ones(len(k), np.int64))
                wide = (k[0], c[0], c[-1])
                k, c = k[:0], c[:0]

    return run


def _near_pairs(like: Likeness, forest: bool):
    """Pairs of one bucket's piece, of different components, whose sizes and dense sketches allow a link: all of them, or
    as many as join the components that they connect. Where rows bring their sets, only linked pairs count."""

    def compared(t: pa.Table, group: np.ndarray):
        order = np.lexsort((t.column("n").to_numpy(), group))  # by size: past the first set too large, all are
        t, group = t.take(pa.array(order)), group[order]
        key, cid, comp, n, side = (t.column(x).to_numpy() for x in ("key", "cid", "comp", "n", "side"))
        sketches, sets = like.matrices(t.column("sketch").to_pylist(), n), t.column("set")
        node = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)[1].ravel()
        label = np.arange(node.max() + 1)
        up = label.tolist()

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        i, found = np.arange(len(cid)), []
        for step in range(1, len(cid)):
            i = i[i + step < len(cid)]
            i = i[(group[i] == group[i + step]) & (like.num * n[i + step] <= like.den * n[i])]
            if not len(i):
                break
            j = i + step
            m = (label[node[i]] != label[node[j]]) & ((side[i] != side[j]) | (side[i] == 2))
            x, y = i[m], j[m]
            near = like.may_link(n, sketches, x, y)
            x, y = x[near], y[near]
            if forest and len(x):
                joins = []
                for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                    p_, q_ = root(node[p]), root(node[q])
                    if p_ != q_ and (not sets[p].is_valid or like.linked(*(np.frombuffer(sets[v].as_buffer(), np.uint64) for v in (p, q)))):
                        up[q_] = p_
                        joins.append(k)
                x, y = x[joins], y[joins]
                if joins:
                    label = np.array([root(k) for k in range(len(up))])
            found.append(np.stack([key[x], np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])]))
        p = np.concatenate([*found, np.zeros((3, 0), np.int64)], axis=1)
        if not forest:  # the same two may meet in many buckets
            p = p[:, np.unique(p[1:], axis=1, return_index=True)[1]]
        if p.shape[1]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, p)], names=["key", "a", "b"])

    def pairs(t: pa.Table):
        k, g, n = (t.column(x).to_numpy() for x in ("key", "tile", "n"))
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]), [True]]))
        weight = np.concatenate([[0], np.cumsum(n)])[start] if t.column("set").null_count < len(t) else start * 0
        at = 0
        while at < len(start) - 1:  # whole pieces, some thousand rows at a time
            stop = min(int(np.searchsorted(start, start[at] + 8192, "right")), int(np.searchsorted(weight, weight[at] + 4 * TILE_ELEMENTS, "right"))) - 1
            stop = max(at + 1, stop)
            yield from compared(t.slice(start[at], start[stop] - start[at]), np.repeat(np.arange(stop - at), np.diff(start[at : stop + 1])))
            at = stop

    def run(batches):
        rest: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            k, g = t.column("key").to_numpy(), t.column("tile").to_numpy()
            tail = np.flatnonzero((k != k[-1]) | (g != g[-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            if cut:
                yield from pairs(pa.concat_tables([*rest, t.slice(0, cut)]).combine_chunks())
                rest = []
            elif rest and (rest[-1].column("key")[-1].as_py(), rest[-1].column("tile")[-1].as_py()) != (int(k[-1]), int(g[-1])):
                yield from pairs(pa.concat_tables(rest).combine_chunks())
                rest = []
            rest.append(t.slice(cut))
        if rest:
            yield from pairs(pa.concat_tables(rest).combine_chunks())

    return run


def _verified(like: Likeness):
    """Pairs of texts whose shingle sets are linked."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for step in range(0, batch.num_rows, 500):
                part = batch.slice(step, 500)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                for r, ((i, x), (j, y)) in enumerate(zip(_sets(part.column(2), like), _sets(part.column(3), like), strict=True)):
                    # Another text may have the same doc_id: the ids of the contents tell.
                    keep[step + r] = i == a[r] and j == b[r] and like.linked(x, y)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _set_rows(like: Likeness):
    """cid and the set, as bytes, of texts that have the cid they are said to have, a few at a time."""

    def run(batches):
        for batch in batches:
            want = batch.column(0).to_pylist()
            for step in range(0, len(want), 100):
                part = batch.slice(step, min(100, len(want) - step))
                same = [(cid, x.tobytes()) for (cid, x), w in zip(_sets(part.column(1), like), want[step:], strict=False) if cid == w]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in same], pa.int64()), pa.array([x for _, x in same], pa.binary())], names=["cid", "set"])

    return run


def _sets(col: pa.Array, like: Likeness):
    """Yields the content id and the set of each row."""
    for _, tokens, off in shingle_sets(col, like.shingle):
        for i, cid in enumerate(_content_ids(tokens, off).tolist()):
            yield cid, tokens[off[i] : off[i + 1]]


def _parity_sketches(tokens: np.ndarray, off: np.ndarray) -> tuple[list[bytes], None]:
    return _dense(tokens, off), None


PARITY = Likeness(SHINGLE, NUMERATOR, DENOMINATOR, _parity_sketches, _matrices, _may_link, block_keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts_of(need: DataFrame, rows: DataFrame) -> DataFrame:
    """cid and text of the rows that have an id of ``need`` (cid, doc_id), a written table. Where it is too large for a
    broadcast a filter goes before the shuffle, which then has few texts that are not needed."""
    many = need.count()
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(need), "doc_id").select("cid", "text")
    return perhaps(rows.select("doc_id", "text"), need, ["doc_id"], many).where("__perhaps").join(need, "doc_id").select("cid", "text")


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` but those that are equal to one of ``gone``, a written table, in ``on``. Where it is too large for a
    broadcast, only rows that a filter doesn't clear are shuffled."""
    many = gone.count()
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), on, "left_anti")
    marked = perhaps(rows, gone, on, many)
    return marked.where("not __perhaps").unionByName(marked.where("__perhaps").join(gone, on, "left_anti")).drop("__perhaps")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over ``edges`` (a, b), for all nodes of edges.

    Every node hooks on to its smallest neighbour, trees are flattened by pointer jumping, and the edges between roots
    that remain are the next round's. Each step is a written table, so no lineage grows and none is lost.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = written(hooks.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            total = written(total.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        for end in ("a", "b"):
            step = hooks.select(F.col("node").alias(end), F.col("root").alias("to"))
            edges = edges.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of content ids whose texts are linked, as a written table.

    Sizes and dense sketches come first; only texts of documents that stand for a class in a pair that is left are
    shuffled.
    """
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    pairs = written(pairs.mapInArrow(_plausible(like), "a long, b long"), "pairs")
    if pairs.isEmpty():
        return pairs
    some = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
    need = written(some.join(classes, "cid").select("cid", F.col("first").alias("doc_id")), "needed")
    texts = texts_of(need, rows)
    left, right = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verified(like), "a long, b long").distinct(), "links")


def _named(rows: DataFrame, roots: DataFrame | None, cid: str = "cid", out: str = "comp") -> DataFrame:
    """Adds the component of a content id: its root, or itself."""
    if roots is None:
        return rows.withColumn(out, F.col(cid))
    return rows.join(roots.select(F.col("node").alias(cid), F.col("root").alias("__root")), cid, "left").withColumn(out, F.coalesce("__root", cid)).drop("__root")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after more links."""
    edges = _named(_named(links, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    upper = components(edges)
    if roots is None:
        return upper
    step = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = upper.join(roots.select("node"), "node", "left_anti")
    return written(old.unionByName(new), "roots")


def near_groups(docs: DataFrame, like: Likeness = PARITY) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, with A-Z as a-z; a set has the distinct shingles of five
    words, or a shorter text as one. Sets with 100 * intersection >= 75 * union are linked; component_id is the smallest
    doc_id reachable; ``like`` may set other shingles, ratios and sketches. Null and empty texts have no set and are
    linked with nothing. Repeated rows and copies all stay; other columns are ignored; an empty table gives an empty result. A text all of whose rows have a null
    id is linked with nothing and its component is null.

    Equal sets are one class from the start, so copies are never paired. In each of some rounds every component tries
    its most frequent meetings with the leaders of buckets, chosen anew in each round; buckets within one component are
    then settled. Those that are left give a forest of likely pairs, and where one of it fails, every pair of different
    components is compared, in pieces of bounded size (``_rest``); so nothing depends on the rounds' luck.
    Links within a component that follow from others are not looked for, as they change no component;
    ``jaccard_join`` has them all. Classes, keys and sets are told apart by 64-bit hashes.
    """
    return _grouped(docs, like).select("doc_id", "n_shingles", "component_id")


def _row_id() -> list:
    """What tells rows of different ids or texts apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")]


def _buckets(rows: DataFrame, like: Likeness = PARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The class of each row (doc_id, text, and h, which is passed on), all classes with sets, and the buckets with several."""
    each = written(rows.select("doc_id", "text", "h").mapInArrow(_classes(like), "doc_id long, h long, n long, cid long, sketch binary, keys array<long>"), "classes")
    classes = written(each.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "classes")
    parts, met = partitions(rows), "key long, cid long, head long, weight long"
    if not like.block_keys:
        keys = classes.select(F.explode("keys").alias("key"), "cid").repartition(parts, "key").sortWithinPartitions("key", "cid")
        return each, classes, written(keys.mapInArrow(_meetings(False), met), "buckets")
    packed = rows.select("text").mapInArrow(_keys(like, parts, frequent_shingles(rows, classes, like)), _PACK).repartitionById(parts, F.col("part"))
    keys = unpacked(packed).sortWithinPartitions("key", "cid")
    # Kin share many keys, and most of these have the same members.
    buckets = keys.mapInArrow(_meetings(True), met).groupBy("key", "cid").agg(F.min("head").alias("head"), F.sum("weight").alias("weight"))
    return each, classes, written(buckets, "buckets")


def _compared(named: DataFrame, classes: DataFrame, parts: int, like: Likeness, forest: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Pairs (key, a, b) of classes of one bucket and different ``comp`` that sizes and dense sketches allow, as a written
    table: all, or a forest over the components that they connect; with ``sets`` (cid, set) only linked ones.

    ``named``: key, cid, comp. A bucket in several pieces is compared piece with piece; the component that has most of
    it meets the others' pieces only.
    """
    counted = named if sets is None else named.join(classes.select("cid", "n"), "cid")
    per = counted.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), (F.lit(0) if sets is None else F.max("n")).alias("n"))
    heads = per.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("k"), F.max("n").alias("largest")).where("k > most")
    rows = classes.select("cid", "n", "sketch")
    rows = rows.join(sets, "cid") if sets is not None else rows.withColumn("set", F.lit(None).cast("binary"))
    open_ = named.join(heads, "key").join(rows, "cid")
    tile = F.lit(TILE) if sets is None else F.greatest(F.least(F.lit(TILE), F.lit(TILE_ELEMENTS) / F.col("largest")), F.lit(16))
    open_ = open_.withColumns({"__minors": F.ceil((F.col("k") - F.col("most")) / tile).cast("long"), "__mains": F.ceil(F.col("most") / tile).cast("long"), "__minor": F.col("comp") != F.col("main")})
    open_ = open_.withColumn("__own", F.pmod(F.xxhash64("cid"), F.when(F.col("__minor"), F.col("__minors")).otherwise(F.col("__mains"))))
    own, minors, mains = F.col("__own"), F.col("__minors"), F.col("__mains")
    cell = lambda tile, side: F.struct(tile.cast("long").alias("tile"), side.cast("int").alias("side"))
    # side tells the two pieces of a cell apart, 2 if they are the same.
    with_minors = F.transform(F.sequence(F.lit(0).cast("long"), minors - 1), lambda o: cell(F.least(own, o) * minors + F.greatest(own, o), F.when(own == o, 2).when(own < o, 0).otherwise(1)))
    with_mains = F.transform(F.sequence(F.lit(0).cast("long"), mains - 1), lambda o: cell(minors * minors + own * mains + o, F.lit(0)))
    as_main = F.transform(F.sequence(F.lit(0).cast("long"), minors - 1), lambda o: cell(minors * minors + o * mains + own, F.lit(1)))
    cells = F.when(F.col("k") <= tile, F.array(cell(F.lit(0), F.lit(2)))).when(F.col("__minor"), F.concat(with_minors, with_mains)).otherwise(as_main)
    dealt = open_.select("key", "cid", "comp", "n", "sketch", "set", F.inline(cells)).repartition(parts, "key", "tile").sortWithinPartitions("key", "tile")
    return written(dealt.mapInArrow(_near_pairs(like, forest), "key long, a long, b long"), "near")


def _rest(named: DataFrame, classes: DataFrame, rows: DataFrame, roots: DataFrame | None, parts: int, like: Likeness) -> DataFrame | None:
    """Roots after all buckets (key, cid, comp) are settled.

    Buckets first give a forest of likely pairs. If all of a bucket's are links, nothing in it is left to be found. In
    the others every pair of different components is compared: small ones list what their sketches allow, and large ones
    verify it in place, with the sets.
    """
    likely = _compared(named, classes, parts, like, forest=True)
    if likely.isEmpty():
        return roots
    links = verify(likely.select("a", "b").distinct(), classes, rows, like)
    roots = _merged(roots, links)
    unsure = likely.join(links, ["a", "b"], "left_anti").select("key").distinct()
    again = _named(named.join(unsure, "key", "left_semi").select("key", "cid"), roots)
    size = again.groupBy("key").agg(F.count(F.lit(1)).alias("__k"), F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo <> __hi")
    again = written(again.join(size, "key").select("key", "cid", "comp", (F.col("__k") > LISTED).alias("large")), "unsure")
    few, large = again.where("not large"), again.where("large").drop("large")
    if not few.isEmpty():
        roots = _merged(roots, verify(_compared(few, classes, parts, like).select("a", "b").distinct(), classes, rows, like))
    if not large.isEmpty():
        need = written(large.select("cid").distinct().join(classes, "cid").select("cid", F.col("first").alias("doc_id")), "needed")
        texts = texts_of(need, rows)
        sets = written(texts.mapInArrow(_set_rows(like), "cid long, set binary").dropDuplicates(["cid"]), "sets")
        large = large if roots is None else written(_named(large.select("key", "cid"), roots), "large")
        found = _compared(large, classes, parts, like, forest=True, sets=sets)
        if not found.isEmpty():
            roots = _merged(roots, found.select("a", "b").distinct())
    return roots


def jaccard_join(docs: DataFrame, like: Likeness = PARITY) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links between different sets, and the class of each row of ``docs`` (doc_id, text).

    Links are rows (a, b) of class ids, a < b, each pair once. The second table has doc_id, n_shingles, class_id and
    n_links, the number of classes that the row's class is linked with. Rows with equal sets are one class, so they are
    linked by it and not listed; a row without a set has a null class and no links. Words, sets and links are as in
    ``near_groups``. Ids may be null or repeat: rows go by a number that is written with them.

    Every pair of a bucket is compared and what passes is verified, whatever else links the two; the work grows with
    the number of links, which in a group of k different near texts is up to k * (k - 1) / 2.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("h"))
    rows = written(keyed, "numbered")
    each, classes, buckets = _buckets(rows, like)
    # ``_meetings`` gives several cids of a key, each once.
    near = _compared(buckets.select("key", "cid", F.col("cid").alias("comp")), classes, partitions(docs), like)
    links = verify(near.select("a", "b").distinct(), classes, rows, like)
    ends = links.select(F.col("a").alias("cid")).unionAll(links.select(F.col("b").alias("cid")))
    degree = written(ends.groupBy("cid").agg(F.count(F.lit(1)).alias("n_links")), "degrees")
    out = each.select(F.col("h").alias("doc_id"), "n", "cid").join(small(degree), "cid", "left")
    return links, out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _grouped(docs: DataFrame, like: Likeness = PARITY) -> DataFrame:
    """near_groups with ``h``, the hash of the text, and ``top``, which tells components apart (null without a set):
    rows of one id can be in several, so component_id does not."""
    rows = docs.select(*_row_id(), F.col("text").cast("string").alias("text"))
    each, classes, buckets = _buckets(rows, like)
    join = _rounds if like.block_keys else _clusters
    return _labelled(each, classes, join(buckets, classes, rows, partitions(docs), like))


def _clusters(buckets: DataFrame, classes: DataFrame, rows: DataFrame, parts: int, like: Likeness) -> DataFrame | None:
    """Roots of all classes that are linked, for sketches by which few pairs pass that are no links.

    Buckets give forests of likely pairs. Of each class the pair that most buckets have is verified, which joins most of
    a group. What likely pairs connect is a cluster; in each that has several components, these are compared with the
    sets at hand, each class once, however many buckets it is in.
    """
    likely = _compared(buckets.select("key", "cid", F.col("cid").alias("comp")), classes, parts, like, forest=True)
    met = written(likely.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), "met")
    if met.isEmpty():
        return None
    ends = met.select(F.explode(F.array("a", "b")).alias("cid"), "a", "b", "k")
    best = ends.groupBy("cid").agg(F.max_by(F.struct("a", "b"), F.struct("k", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = verify(best, classes, rows, like)
    roots = None if links.isEmpty() else _merged(None, links)
    named = _named(_named(met, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    cluster = components(named).select(F.col("node").alias("comp"), F.col("root").alias("key"))
    if cluster.isEmpty():
        return roots
    members = _named(ends.select("cid").distinct(), roots).join(cluster, "comp").select("key", "cid", "comp")
    members = written(members, "members")
    need = written(members.join(classes, "cid").select("cid", F.col("first").alias("doc_id")), "needed")
    texts = texts_of(need, rows)
    sets = written(texts.mapInArrow(_set_rows(like), "cid long, set binary").dropDuplicates(["cid"]), "sets")
    found = _compared(members, classes, parts, like, forest=True, sets=sets)
    return roots if found.isEmpty() else _merged(roots, found.select("a", "b").distinct())


def _rounds(buckets: DataFrame, classes: DataFrame, rows: DataFrame, parts: int, like: Likeness) -> DataFrame | None:
    """Roots of all classes that are linked: links with leaders of buckets first, then what ``_rest`` finds.

    At first each class is a component of its own, no bucket is settled, and a bucket's leader is its first class, with
    which ``_meetings`` names its rows; nothing is joined for that round.
    """
    roots, tried, named = None, None, buckets.select("key", "cid", F.col("cid").alias("comp"))
    for turn, leaders in enumerate(LEADERS):
        if turn:
            # Buckets within one component are settled; the others go on.
            named = _unsettled(buckets, roots)
            discard(buckets)
            buckets = named
            lead = lambda j, turn=turn: F.min(F.struct(F.xxhash64("comp", F.lit(100 * turn + j)), "comp", "cid")).alias(f"h{j}")
            heads = named.groupBy("key").agg(*map(lead, range(leaders)))
            slots = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"h{j}.comp").alias("comp"), F.col(f"h{j}.cid").alias("cid")) for j in range(leaders)))
            met = named.join(heads, "key").select("cid", "comp", "weight", F.explode(slots).alias("h")).where("comp <> h.comp")
            met = met.groupBy("comp", "h.j", F.least("cid", "h.cid").alias("a"), F.greatest("cid", "h.cid").alias("b")).agg(F.sum("weight").alias("k"))
            met = met.where("k > 1")  # chance meets once, kin often; what is left out here is compared at the end
        else:
            met = buckets.where("cid <> head").groupBy(F.col("cid").alias("comp"), F.lit(0).alias("j"), F.col("head").alias("a"), F.col("cid").alias("b")).agg(F.sum("weight").alias("k"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        best = written(met.groupBy("comp", "j").agg(F.max_by(F.struct("a", "b"), F.struct("k", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "tries")
        if best.isEmpty():
            continue
        links = verify(best, classes, rows, like)
        tried = best if tried is None else written(tried.unionAll(best), "tried")
        if not links.isEmpty():
            roots = small(_merged(roots, links))
    if roots is not None:
        named = _unsettled(buckets, roots)
        discard(buckets)
    return _rest(named, classes, rows, roots, parts, like)


def _unsettled(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (key, cid, comp, weight) of buckets that are in several components, as a written table."""
    named = _named(buckets.select("key", "cid", "weight"), roots)
    ends = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return written(named.join(ends, "key").select("key", "cid", "comp", "weight"), "open")


def _labelled(each: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with the smallest doc_id of their component."""
    tops = _named(classes.select("cid", "first"), roots, "cid", "top")
    ids = tops.groupBy("top").agg(F.min("first").alias("component_id"))
    member = written(tops.join(ids, "top").select("cid", "top", "component_id"), "members")
    # A class may hold a third of all rows: its id is joined by a broadcast where that is small, else by a join that
    # Spark splits.
    out = each.select("doc_id", "h", "n", "cid").join(small(member), "cid", "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("top")).alias("top"))


def one_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and of several such rows the first by text.

    A row goes only if its own text is in a component that has another row. Rows without a set and rows with a null id
    all stay. Texts are told apart by 64-bit hashes; only rows of components that have their smallest id repeatedly are
    shuffled with their texts.
    """
    docs, original = set_aside(docs, "doc_id", "text")
    groups = written(_grouped(docs).where("top is not null and doc_id is not null"), "groups")
    dropped = written(groups.where("component_id <> doc_id").select("doc_id", "h").distinct(), "dropped")
    doc_id, h = _row_id()
    rows = docs.withColumns({"__id": doc_id, "__h": h})
    named = lambda t: t.withColumnsRenamed({"doc_id": "__id", "h": "__h", "top": "__top"})
    kept = without(rows, named(dropped), ["__id", "__h"])
    first = groups.where("component_id = doc_id")
    several = first.groupBy("top").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("top")
    again = written(named(first.join(several, "top").select("doc_id", "h", "top").distinct()), "again")
    if again.isEmpty():
        return original(kept)
    # Of rows that are equal throughout, any is the first.
    place = F.row_number().over(Window.partitionBy("__top").orderBy(F.col("text").cast("string"), F.to_json(F.struct(*docs.columns))))
    chosen = kept.join(small(again), ["__id", "__h"]).withColumn("__place", place).where("__place = 1")
    return original(without(kept, again, ["__id", "__h"]).select(*docs.columns).unionAll(chosen.select(*docs.columns)))
