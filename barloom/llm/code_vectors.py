"""Product codes of vectors by filtering Lloyd iterations.

Each partition packs its vectors into chunks and builds, for each part position, a kd-tree over the chunk's parts whose
nodes keep their bounding box, sum and count. The trees are written once. A round walks them level by level with the
codebook: an entry that is farther than another from every point of a node's box is dropped for that node, and a node
with one entry left is assigned as a whole by its cached sum and count. Only what is left at the leaves is compared
point by point. All arithmetic is on whole numbers, so results do not depend on how vectors are dealt.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .parity_join import small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole numbers saturate here, so that squared distances and sums fit in 64 bits.
LIMIT = 1 << 26
#: Vectors of a chunk at most, and bytes of their whole numbers.
CHUNK, CHUNK_BYTES = 16_384, 4 << 20
#: Points of a leaf at least. Fewer give smaller boxes, but the boxes of more nodes to compare with the entries.
LEAF = 32
#: Pairs of nodes or points with entries that are compared at once.
_AT_ONCE = 1 << 17


@dataclass
class Tree:
    """A balanced kd-tree: points in tree order, and its nodes level by level."""

    points: np.ndarray  # (n, width)
    order: np.ndarray  # place of each point in the chunk
    low: np.ndarray  # (nodes, width)
    high: np.ndarray
    sums: np.ndarray


def levels(n: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level over n points, halved until they have under twice LEAF."""
    out = [np.array([0, n])]
    while n >> (len(out) - 1) >= 2 * LEAF:
        b = out[-1]
        mid = (b[:-1] + b[1:]) // 2
        out.append(np.append(np.stack([b[:-1], mid], 1).ravel(), n))
    return out


def build(points: np.ndarray) -> Tree:
    """The tree over ``points`` (n > 0 rows): each node is halved at the median of its widest side."""
    order, low, high, sums = np.arange(len(points)), [], [], []
    every = levels(len(points))
    for k, bounds in enumerate(every):
        at = bounds[:-1]
        low.append(np.minimum.reduceat(points, at))
        high.append(np.maximum.reduceat(points, at))
        sums.append(np.add.reduceat(points, at, dtype=np.int64))
        if k < len(every) - 1:
            node = np.repeat(np.arange(len(at)), np.diff(bounds))
            side = (high[-1] - low[-1]).argmax(1)
            by = np.lexsort((points[np.arange(len(points)), side[node]], node))
            points, order = points[by], order[by]
    return Tree(points, order, np.concatenate(low), np.concatenate(high), np.concatenate(sums))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in floating point where whole numbers of that size are."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def _survivors(low: np.ndarray, high: np.ndarray, node: np.ndarray, entry: np.ndarray, book: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Of pairs of nodes (rows of low and high) and entries, sorted by both, those that the node's box doesn't rule out.

    The entry next to the box's centre rules out those that it is nearer than, or as near with a lower index, at every
    point of the box; the difference of two squared distances is linear, so its least value is at a corner.
    """
    out = np.zeros(len(node), bool)
    centre = low + high  # twice the centre
    gap = np.concatenate([squares[entry[a : a + _AT_ONCE]] - (centre[node[a : a + _AT_ONCE]] * book[entry[a : a + _AT_ONCE]]).sum(1) for a in range(0, len(node), _AT_ONCE)])
    head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    group = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
    least = np.minimum.reduceat(gap, head)[group]
    near = np.minimum.reduceat(np.where(gap == least, entry, ENTRIES), head)[group]
    for a in range(0, len(node), _AT_ONCE):
        s = slice(a, a + _AT_ONCE)
        other = book[entry[s]] - book[near[s]]
        # Least of |p - entry|^2 - |p - near|^2 over the box.
        worst = squares[entry[s]] - squares[near[s]] - (centre[node[s]] * other).sum(1) - ((high - low)[node[s]] * np.abs(other)).sum(1)
        out[s] = ~((worst > 0) | ((worst == 0) & (near[s] < entry[s]))) | (near[s] == entry[s])
    return out


def assign(tree: Tree, book: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each point in tree order (ties to the lower index), sums and counts of each entry's points,
    and how many points were assigned with their whole subtree."""
    n, book = len(tree.points), book.astype(np.int64)
    squares = (book * book).sum(1)
    code, total, count = np.zeros(n, np.int64), np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    at, whole = 0, 0
    node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
    every = levels(n)
    for k, bounds in enumerate(every):
        rows = slice(at, at + len(bounds) - 1)
        low, high = tree.low[rows].astype(np.int64), tree.high[rows].astype(np.int64)
        keep = _survivors(low, high, node, entry, book, squares)
        node, entry = node[keep], entry[keep]
        left = np.bincount(node, minlength=len(bounds) - 1)
        alone = left[node] == 1
        size = np.diff(bounds)[node[alone]]
        np.add.at(total, entry[alone], tree.sums[at + node[alone]])
        np.add.at(count, entry[alone], size)
        code[np.repeat(bounds[node[alone]] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(entry[alone], size)
        whole += int(size.sum())
        node, entry = node[~alone], entry[~alone]
        at += len(bounds) - 1
        if not len(node):
            break
        if k < len(every) - 1:
            node, entry = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
            by = np.lexsort((entry, node))
            node, entry = node[by], entry[by]
            continue
        allowed = np.zeros((len(bounds) - 1, len(book)), bool)
        allowed[node, entry] = True
        leaf = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        rest = np.flatnonzero(allowed.any(1)[leaf])
        step = max(1, 8 * _AT_ONCE // len(book))
        for a in range(0, len(rest), step):
            own = rest[a : a + step]
            far = squares - 2 * _products(tree.points[own], book)
            far[~allowed[leaf[own]]] = np.iinfo(np.int64).max
            code[own] = far.argmin(1)
            if counted:
                np.add.at(total, code[own], tree.points[own].astype(np.int64))
                count += np.bincount(code[own], minlength=len(book))
    return code, total, count, whole


def _lists(values: list[bytes]) -> pa.Array:
    return pa.array([values], pa.list_(pa.binary()))


_TREES = "points array<binary>, places array<binary>, boxes array<binary>, sums array<binary>"


def _trees(width: int):
    """Chunks of vectors (vec_id, label, vector) with a tree for each part position."""
    most = max(1, min(CHUNK, CHUNK_BYTES // (4 * PARTS * width)))

    def chunk(t: pa.Table) -> pa.RecordBatch:
        v = t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        v = np.pad(v, ((0, 0), (0, PARTS * width - v.shape[1])))
        trees = [build(np.ascontiguousarray(v[:, p * width : (p + 1) * width])) for p in range(PARTS)]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks()) for c in ("vec_id", "label")]
        parts = [
            [x.points.tobytes() for x in trees], [x.order.astype(np.int32).tobytes() for x in trees],
            [np.stack([x.low, x.high]).tobytes() for x in trees], [x.sums.tobytes() for x in trees],
        ]
        return pa.RecordBatch.from_arrays([*listed, *map(_lists, parts)], names=["vec_id", "label", "points", "places", "boxes", "sums"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == most:
                    yield chunk(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield chunk(pa.Table.from_batches(held))

    return run


def _read(batch: pa.RecordBatch, width: int):
    """Yields the row and the four trees of each chunk."""
    for i in range(batch.num_rows):
        points, places, boxes, sums = (batch.column(c)[i].as_py() for c in ("points", "places", "boxes", "sums"))
        trees = []
        for p in range(PARTS):
            low, high = np.frombuffer(boxes[p], np.int32).reshape(2, -1, width)
            trees.append(Tree(np.frombuffer(points[p], np.int32).reshape(-1, width), np.frombuffer(places[p], np.int32), low, high, np.frombuffer(sums[p], np.int64).reshape(-1, width)))
        yield i, trees


def _sums(books: np.ndarray):
    """Counts and sums of a task's parts by part position and entry."""

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, trees in _read(batch, books.shape[2]):
                for p, tree in enumerate(trees):
                    _, t, c, _ = assign(tree, books[p])
                    total[p] += t
                    count[p] += c
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), *(pa.array(total[part, entry, j]) for j in range(books.shape[2]))], names=["part", "entry", "n", *(f"s{j}" for j in range(books.shape[2]))])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        for batch in batches:
            for i, trees in _read(batch, books.shape[2]):
                n = len(trees[0].points)
                code, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(trees):
                    c = assign(tree, books[p], counted=False)[0]
                    code[tree.order, p] = c
                    error[tree.order] += ((tree.points.astype(np.int64) - books[p][c]) ** 2).sum(1)
                text = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, 2 * PARTS * n + 1, 2 * PARTS, dtype=np.int32).tobytes()), pa.py_buffer(code.tobytes().hex().encode()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector as floor(1024 * x), of rows whose vector is not null and has finite components only."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("vector"))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each row of ``vectors`` (vec_id, embedding, label) that can be coded, as a written
    table, and the codebooks (part position, entry, component).

    A row whose vector is null or has null or non-finite components is left out. Components become floor(1024 * x), which
    saturates at LIMIT either way. Vectors are cut into four equal parts; a length that four doesn't divide is filled up
    with zeros. Vectors of another length than that of the first one are left out, as they have no such parts. The
    codebooks start as the parts of the ``entries`` first vectors, by vec_id (null last) and vector, or of all if they are
    fewer; ties go to the lower index and unused entries stay. Repeated rows and ids are coded each; other columns are
    ignored; an empty table gives an empty result. The driver holds the codebooks only.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    first = [r.vector for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    length = len(first[0]) if first else 0
    width = max(1, -(-length // PARTS))
    start = np.array([v + [0] * (PARTS * width - length) for v in first if len(v) == length], np.int64).reshape(-1, PARTS, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    label = rows.schema["label"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"), books
    rows = rows.where(F.size("vector") == length)
    trees = written(rows.mapInArrow(_trees(width), f"vec_id array<long>, label array<{label}>, {_TREES}"), "trees")
    columns = [f"s{j}" for j in range(width)]
    for _ in range(rounds):
        found = trees.mapInArrow(_sums(books), "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
        found = found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *columns))).collect()
        books = books.copy()
        for r in found:
            books[r.part, r.entry] = np.array([r[c] for c in columns], np.int64) // r.n
    return written(trees.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long"), "codes"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``compress`` with label_error, the error summed over rows of equal labels (nulls together), and codebooks_sha256."""
    codes, books = compress(vectors, entries, rounds)
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = codes.join(small(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
