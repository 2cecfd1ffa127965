"""Token ids in ORC: run-length encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept, partitions, workspace

END = 2
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
#: Entries of either half of a worker's piece cache; each takes some 200 bytes.
CACHE_ENTRIES = 200_000
#: Entries that a worker keeps for its next task.
KEPT_ENTRIES = 20_000
#: Characters of texts that are cut into pieces at a time; a longer text is one such run, and a run takes some 30 bytes a character.
RUN_CHARS = 1 << 20
#: Signs that end many words.
_TAIL = frozenset(".,;:!?)")
#: White space other than single spaces and line feeds between dark characters, markers of special tokens, and NUL.
_UNCUT = "<\\||\\x00|[ \n][ \n]|^[ \n]|[ \n]$|[\\t\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: The printable character that byte-level tokenizers write for each byte.
_BYTE_CHARS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
_BYTE_CHARS |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _BYTE_CHARS)}
_SPACE = _BYTE_CHARS[ord(" ")]


class _Pieces(dict):
    """Little-endian 32-bit ids of a piece, encoded on first use.

    The least recent half goes when both halves have CACHE_ENTRIES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def shrink(self) -> None:
        """Leaves KEPT_ENTRIES at most: those that were first looked up again, so mostly frequent ones."""
        few = dict(islice(self.items(), KEPT_ENTRIES))
        self.old = {}
        self.clear()
        self.update(few)

    def encode(self, piece: str) -> bytes:
        if len(piece) > 2 and piece[-1] in _TAIL and piece[-2].isalpha():  # a sign never joins the letters before it
            return self[piece[:-1]] + self[piece[-1]]
        if piece[piece[:1] == " " :].isalpha():  # one run of letters is one word to the model
            mapped = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()
        return self.whole(piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> _Pieces:
    """The worker's own, made anew if it has done other work meanwhile."""
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = _Pieces(path)
    return encoders[path]


def encode_all(pieces: _Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: none) in a row, and the offsets of the texts.

    A byte-level tokenizer never merges across a single space or line feed between dark characters: the space opens
    the next piece, the line feed is one of its own. Texts without other white space are cut into pieces, and each
    different piece is looked up once; all others, and texts with markers of special tokens, are encoded in one call.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    uncut = pc.match_substring_regex(texts, _UNCUT)
    cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
    lists = pc.split_pattern(pc.if_else(uncut, "", cut), "\0")
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
    found = list(map(pieces.__getitem__, pc.binary_join(distinct, "\0")[0].as_py().split("\0")))
    whole = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
    code[at[whole]] = np.arange(len(found), len(found) + len(whole))  # such a text has one empty piece
    found += [pieces.whole(texts[i].as_py()) for i in whole.tolist()]
    size = np.array([len(x) // 4 for x in found], np.int64)
    begin, n = (np.cumsum(size) - size)[code], size[code]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
    return ids, total[at]


def encode(pieces: _Pieces, text: str) -> bytes:
    """Ids of one whole text, as 32-bit little-endian integers."""
    return encode_all(pieces, pa.array([text], pa.string()))[0].tobytes()


def _encode_partition(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        pieces, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            size = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy())])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + RUN_CHARS, "right")) - 1)
                tokens, at = encode_all(pieces, texts.slice(lo, hi - lo))
                tokens = np.insert(tokens, at[1:], end)
                n = np.diff(at) + 1
                stop = start + np.cumsum(n)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(stop - n), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32)))],
                    names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                start, lo = int(stop[-1]), hi
        pieces.shrink()  # the worker may be idle for long
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, partitions_: int | None = None) -> str:
    """Encodes ``docs`` (doc_id, text; other columns are ignored) and writes ORC files in ascending doc_id order.

    Rows are dealt by ranges of doc_id, so each file holds one range and a reader prunes files, stripes and row groups
    by their minima, maxima and Bloom filters; any stripe can be read on its own. ``part`` numbers the ranges and
    ``part_start`` counts the tokens before a document in its range.

    Null and empty texts give the end id alone. Rows with the same doc_id all stay, ordered by text; null ids come
    first. An empty table gives files without rows. All rows of one doc_id are of one range and so of one task, which
    streams them: ids are meant to be keys. A text and a run of RUN_CHARS are the most a task must hold besides a batch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions_ or partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.mapInArrow(_encode_partition(tokenizer, end), FILE_SCHEMA)
        .write.option("orc.compress", "SNAPPY")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of ``write_tokens`` with ``start``, the tokens of all documents before each.

    The sums of the ranges are a row for each file, so adding them up in one place is bounded by the number of
    partitions written. Filters on doc_id reach the ORC reader.
    """
    from pyspark.sql import Window

    files = spark.read.schema(FILE_SCHEMA).orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def _crcs(batches):
    for batch in batches:
        lists = batch.column(3)
        values, off = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` and returns the digests read back from the files."""
    spark = docs.sparkSession
    return token_digests(read_tokens(spark, write_tokens(docs, path or workspace(spark, "tokens"), tokenizer)))
