"""A data source for open-data files of amounts: byte ranges of plain files, whole gzip files, told apart by content.

The driver lists names and sizes.  A partition is a byte range of one large file or some small
ones; its reader looks at the first two bytes of the file itself, so a name says nothing.  A gzip file
cannot be cut: the range that begins it reads it all and the others read nothing.  Rows carry their
file and the offset of their line in the (unpacked) text, which is an order that does not depend on ranges.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.load import Refused

RANGE_BYTES = 64 << 20
_MARK = "﻿".encode()
_ROWS = 20_000


@dataclass
class _Ranges(InputPartition):
    """(path, first byte, byte after the last) of the pieces that one task reads."""

    pieces: list[tuple[str, int, int]]


def _plan(files: list[tuple[str, int]], size: int) -> list[_Ranges]:
    """Large files in ranges of ``size`` bytes, small ones together up to that."""
    out, now, used = [], [], 0
    for path, length in sorted(files):
        if length > size:
            out += [_Ranges([(path, lo, min(length, lo + size))]) for lo in range(0, length, size)]
            continue
        if now and used + length > size:
            out.append(_Ranges(now))
            now, used = [], 0
        now.append((path, 0, length))
        used += length
    return [*out, _Ranges(now)] if now else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.sep = options["path"], options.get("sep", ";")
        self.columns = [options["amount"], options["kind"]]
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        system, path = self._open(self.root)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(path, recursive=True))
            files = [(f.path, f.size) for f in listed if f.is_file and f.size and not f.base_name.startswith((".", "_"))]
        else:
            files = [(found.path, found.size)] if found.is_file else []
        if not files:
            raise Refused(f"{self.root}: no file")
        return list(_plan(files, self.size))

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = self._open(self.root)
        for path, lo, hi in partition.pieces:
            with system.open_input_file(path) as found, io.BufferedReader(found, 1 << 20) as raw:
                zipped = raw.peek(2)[:2] == b"\x1f\x8b"
                if not zipped:
                    yield from self._rows(path, raw, lo, hi)
                elif lo == 0:
                    with gzip.open(raw) as text:
                        yield from self._rows(path, text, 0, None)

    def _rows(self, path: str, reader: io.BufferedIOBase, lo: int, hi: int | None) -> Iterator[pa.RecordBatch]:
        """Lines that begin in [lo, hi); the first line of the file names the columns."""
        head = reader.readline()
        names = [c.strip().strip('"') for c in head.decode().rstrip("\r\n").lstrip("﻿").split(self.sep)]
        if missing := [c for c in self.columns if c not in names]:
            raise Refused(f"{path}: columns {missing} are missing")
        place, width = [names.index(c) for c in self.columns], len(names)
        at = len(head)
        if lo > at:
            reader.seek(lo - 1)  # a line that begins at ``lo`` is ours
            at = lo - 1 + len(reader.readline())
        rows: list[tuple] = []
        while hi is None or at < hi:
            line = reader.readline()
            if not line:
                break
            cells = line.decode().rstrip("\r\n").split(self.sep)
            if cells != [""]:
                if len(cells) != width:
                    raise Refused(f"{path}: {len(cells)} cells at byte {at}, declared {width}")
                rows.append((cells[place[0]].strip('"'), cells[place[1]].strip('"'), path, at))
            at += len(line)
            if len(rows) >= _ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["amount", "kind", "file", "at"])


class AmountsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provmart_amounts"

    def schema(self) -> str:
        return "amount string, kind string, file string, at long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def rows(spark: SparkSession, path: str, amount: str, kind: str, sep: str = ";", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(amount, kind, file, at) of all files under ``path``, cells as written."""
    spark.dataSource.register(AmountsSource)
    return spark.read.format("provmart_amounts").options(path=path, amount=amount, kind=kind, sep=sep, rangebytes=range_bytes).load()
