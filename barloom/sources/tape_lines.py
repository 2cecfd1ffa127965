"""Lines of text tapes as a data source: byte ranges of files, batch or stream.

A range has the lines that begin in it. Each line comes with ``seq``, the number of its file and its place in it, so the
order of lines is known without counting them. Kinds that the option ``kinds`` doesn't list go in the reader. It is an
option and no pushed filter, as Spark keeps what one query pushes for the next one over the same table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

from barloom.session import ship_package

#: Rows of a text tape by their first field; each names the kind of event that it makes.
ROW_KINDS = {"c": "contract", "T": "trade", "A": "add", "AddLimit": "add", "R": "reduce", "ReduceLimit": "reduce", "r": "set"}
SCHEMA = "seq long, kind string, value string"
_ARROW = pa.schema([("seq", pa.int64()), ("kind", pa.string()), ("value", pa.string())])
#: Bytes of a range, and of what is read of it at a time.
SPLIT_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
#: Bits of ``seq`` for the place in a file.
PLACE_BITS = 44
_FIRST = {k.encode() + b",": v for k, v in ROW_KINDS.items()}


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    stop: int


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files at a path, by name; hidden ones and markers don't count."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size) for f in found)


def _open(path: str, name: str):
    store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    return store.open_input_file(name)


def _last_line_end(path: str, name: str, size: int, start: int) -> int:
    """The end of the last whole line before ``size``; ``start`` if there is none after it."""
    with _open(path, name) as f:
        while size > start:
            a = max(start, size - PIECE_BYTES)
            f.seek(a)
            at = f.read(size - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            size = a
    return start


def lines_of(path: str, part: Range, kinds: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Batches of the lines that begin in a range, of the given kinds; a last line needs no line end."""
    with _open(path, part.path) as f:
        size, at, rest = f.size(), part.start, b""
        if at:  # the line that goes on into the range belongs to the one before
            at -= 1
            f.seek(at)
            while at < part.stop and (piece := f.read(PIECE_BYTES)):
                end = piece.find(b"\n")
                if end >= 0:
                    at += end + 1
                    break
                at += len(piece)
        if at >= part.stop:
            return
        f.seek(at)
        while at < part.stop:
            piece = f.read(PIECE_BYTES)
            data = rest + piece
            done = data.rfind(b"\n") + 1 if piece else len(data)
            if not done and piece:
                rest = data
                continue
            yield from _batch(data[:done], part.number, at, part.stop, kinds)
            at, rest = at + done, data[done:]
            if not piece or at >= size and not rest:
                return


def _batch(data: bytes, number: int, at: int, stop: int, kinds: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends + 1])
    begins = begins[(begins < len(raw)) & (at + begins < stop)]
    out: list[tuple[int, str, bytes]] = []
    first = raw[begins]
    wanted = np.isin(first, np.frombuffer(b"".join({k[:1] for k, v in _FIRST.items() if kinds is None or v in kinds}), np.uint8))
    ends = np.append(ends, len(raw))
    for a, b in zip(begins[wanted].tolist(), ends[np.searchsorted(ends, begins[wanted])].tolist(), strict=True):
        line = data[a:b].rstrip(b"\r\n")
        kind = _FIRST.get(line[: line.find(b",") + 1])
        if kind and (kinds is None or kind in kinds):
            out.append(((number << PLACE_BITS) + at + a, kind, line))
    if out:
        seq, kind, value = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(kind, pa.string()), pa.array([v.decode("utf-8", "replace") for v in value], pa.string())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.kinds = frozenset(options["kinds"].split(",")) if "kinds" in options else None

    def partitions(self):
        return [Range(name, k, a, min(a + self.split, size)) for k, (name, size) in enumerate(_files(self.path)) for a in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition):
        return lines_of(self.path, partition, self.kinds) if partition.stop else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the bytes of whole lines that each file has; files are numbered as they are first seen, by name."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for name, size in _files(self.path):
            number, known = self.seen.get(name, (None, 0))
            if number is None:
                number = len(self.seen)
            self.seen[name] = [number, _last_line_end(self.path, name, size, known)]
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        for name, place in after.items():  # after a restart, files keep the numbers that the checkpoint has
            self.seen.setdefault(name, place)
        return [
            Range(name, number, a, min(a + self.split, stop))
            for name, (number, stop) in sorted(after.items(), key=lambda x: x[1][0])
            for a in range(before.get(name, [0, 0])[1], stop, self.split)
        ] or [Range("", 0, 0, 0)]

    def read(self, partition):
        return lines_of(self.path, partition, None) if partition.stop else iter(())

    def commit(self, end: dict) -> None:
        for name, place in json.loads(end["files"]).items():
            self.seen.setdefault(name, place)


class TapeLines(DataSource):
    """``tape_lines``: option ``path``, a file or a folder in a file system that Arrow reads, ``splitBytes``, and ``kinds``,
    those to read, joined by commas (of batches; all if it isn't given)."""

    @classmethod
    def name(cls) -> str:
        return "tape_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(TapeLines)


class Progress(StreamingQueryListener):
    """What share of the bytes at ``path`` each query over it has read, by the query's id; 1 for an empty folder."""

    def __init__(self, path: str):
        self.path, self.fractions, self.ended = path, {}, set()

    def onQueryStarted(self, event) -> None:
        self.fractions[str(event.id)] = 0.0

    def onQueryProgress(self, event) -> None:
        for source in event.progress.sources:
            if source.endOffset and "files" in source.endOffset:
                read = sum(stop for _, stop in json.loads(json.loads(source.endOffset)["files"]).values())
                total = sum(size for _, size in _files(self.path))
                self.fractions[str(event.progress.id)] = min(1.0, read / total) if total else 1.0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
