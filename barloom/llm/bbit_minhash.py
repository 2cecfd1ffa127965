"""Near-duplicate documents by b-bit MinHash.

Each set of word shingles has HASHES minima under as many hash functions. Keys of BANDS_OF bands of ROWS_OF whole minima
name candidates: sets with a Jaccard index of 0.8 or more miss each other in all bands with probability below 1e-11.
Of each minimum only the low BITS bits are kept, packed into a signature; minima that differ agree in them with
probability 2**-BITS, so the share of equal fields, corrected for that, estimates the Jaccard index from bit counts.
Candidates far below the threshold go by the estimate; the others are confirmed on their full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .parity_join import Likeness, near_groups

SHINGLE = 4
NUMERATOR, DENOMINATOR = 80, 100
BITS = 2
BANDS_OF, ROWS_OF = 64, 5
HASHES = BANDS_OF * ROWS_OF
#: Chance, at most, that the estimate turns down a pair of sets exactly at the threshold.
REJECTED = 1e-10
#: Sets with fewer elements are linked with equal sets only, which are one class from the start.
LEAST = NUMERATOR // (DENOMINATOR - NUMERATOR)
#: Shingles that are hashed at once.
_PIECE = 1 << 17

_XOR = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ODD = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FIELDS = 64 // BITS
#: The lowest bit of each field of a word.
_LOWEST = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def least_agreeing(hashes: int = HASHES, bits: int = BITS, num: int = NUMERATOR, den: int = DENOMINATOR, rejected: float = REJECTED) -> int:
    """The largest number of equal fields that a pair at the threshold falls short of with a chance of at most ``rejected``."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * num / den
    below = 0.0
    for k in range(hashes + 1):
        below += math.exp(math.lgamma(hashes + 1) - math.lgamma(k + 1) - math.lgamma(hashes - k + 1) + k * math.log(p) + (hashes - k) * math.log1p(-p))
        if below > rejected:
            return k
    return hashes


AGREEING = least_agreeing()


def minima(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """HASHES minima for each set that has elements, as rows of 32-bit integers; pieces of long sets are reduced one by one."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    out = np.full((len(full), HASHES), np.iinfo(np.uint32).max, np.uint32)
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    start = off[:-1][full]
    for a in range(0, len(x), _PIECE):
        b = min(len(x), a + _PIECE)
        lo, hi = int(np.searchsorted(start, a, "right")) - 1, int(np.searchsorted(start, b, "left"))
        heads, piece = np.maximum(start[lo:hi], a) - a, x[a:b]
        for j in range(HASHES):
            least = np.minimum.reduceat((piece ^ _XOR[j]) * _ODD[j], heads)
            np.minimum(out[lo:hi, j], least, out=out[lo:hi, j])
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, after its high bits are folded into them, packed into 64-bit words."""
    m = least ^ (least >> np.uint32(16))
    m ^= m >> np.uint32(8)
    fields = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), HASHES // _FIELDS, _FIELDS)
    return np.bitwise_or.reduce(fields << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    m = least.reshape(len(least), BANDS_OF, ROWS_OF).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS_OF, dtype=np.uint64), m.shape[:2])
    for j in range(ROWS_OF):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, j])
    return key.view(np.int64)


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal fields of packed signatures, row by row."""
    differ = a ^ b
    for k in range(1, BITS):
        differ = differ | ((a ^ b) >> np.uint64(k))
    return HASHES - np.bitwise_count(differ & _LOWEST).sum(1).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard indexes of the sets of two lists of signatures, corrected for chance agreement; may fall below 0."""
    chance = 2.0**-BITS
    return (equal_fields(a, b) / HASHES - chance) / (1 - chance)


def _sketches(tokens: np.ndarray, off: np.ndarray) -> tuple[list[bytes], pa.Array]:
    n = np.diff(off)
    full, least = np.flatnonzero(n), minima(tokens, off)
    sketch = [b""] * len(n)
    for i, row in zip(full.tolist(), packed(least), strict=True):
        sketch[i] = row.tobytes()
    keyed = n[full] >= LEAST
    lengths = np.zeros(len(n), np.int64)
    lengths[full[keyed]] = BANDS_OF
    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(band_keys(least[keyed]).ravel()))
    return sketch, keys


def _matrix(sketches: list[bytes], n: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(n), HASHES // _FIELDS)


def _may_link(n: np.ndarray, signatures: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = DENOMINATOR * np.minimum(n[x], n[y]) >= NUMERATOR * np.maximum(n[x], n[y])
    at = np.flatnonzero(out)
    out[at] = equal_fields(signatures[x[at]], signatures[y[at]]) >= AGREEING
    return out


MINHASH = Likeness(SHINGLE, NUMERATOR, DENOMINATOR, _sketches, _matrix, _may_link)


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, with A-Z as a-z; a set has the distinct shingles of four
    words, or a shorter text as one. Sets with 100 * intersection >= 80 * union are linked; component_id is the smallest
    doc_id reachable, and kept tells whether that is the row's own. Null and empty texts have no set and are linked with
    nothing. Repeated rows and copies all stay, and those of the smallest id are all kept; other columns are ignored; an
    empty table gives an empty result. A row with a null id goes where rows with ids have its set; a set all of whose
    rows have null ids is linked with nothing, its component is null and its rows are kept.

    Equal sets are one class, which alone has keys. Bands with several classes give forests of pairs that the estimates
    allow; what these connect is compared on full sets until its components are sure (``parity_join._clusters``).
    """
    groups = near_groups(docs.select("doc_id", "text"), MINHASH)
    return groups.withColumn("kept", F.col("doc_id").cast("long").eqNullSafe(F.col("component_id")))
