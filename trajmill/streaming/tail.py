"""A streaming source that follows text logs while other processes append to them.

Offsets are byte positions, one per file: the end of its last whole line. A line that is still being written stays for the next trigger, a
restarted query goes on where its checkpoint stands, and each new range of bytes is split into partitions that
read the lines which begin in their part.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import posixpath
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_files"
PART_BYTES = 32 << 20
_LOOK_BACK = 1 << 16
_BATCH = 10_000


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str, pattern: str) -> dict[str, int]:
    """Sizes of the followed file, or of the matching files of a folder, by name relative to ``path``."""
    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.File:
        return {"": info.size}
    if info.type == pafs.FileType.NotFound:
        return {}
    found = system.get_file_info(pafs.FileSelector(root))
    return {f.base_name: f.size for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"}


def _open(path: str, name: str):
    system, root = _system(path)
    return system.open_input_file(posixpath.join(root, name) if name else root)


def _last_line_end(path: str, name: str, begin: int, size: int) -> int:
    """The byte after the last line break in [begin, size), or ``begin``."""
    with _open(path, name) as file:
        high = size
        while high > begin:
            low = max(begin, high - _LOOK_BACK)
            file.seek(low)
            at = file.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return begin


class Range(InputPartition):
    """Lines of one file that begin in [begin, end); ``stop`` is the end of the whole lines known."""

    def __init__(self, name: str, begin: int, end: int, stop: int):
        self.name, self.begin, self.end, self.stop = name, begin, end, stop


class GrowingFiles(DataSource):
    """Options: path (file or folder), columns (JSON list), pattern, from_end, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"])) + ", _stream_source string, _stream_row_index bigint, _received_utc string"

    def streamReader(self, schema) -> "GrowingFilesReader":
        return GrowingFilesReader(dict(self.options))


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.columns = json.loads(options["columns"])
        self.pattern = options.get("pattern", "*.csv")
        self.from_end = options.get("from_end", "false").lower() == "true"
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return self._line_ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._line_ends()

    def _line_ends(self) -> dict:
        now = {}
        for name, size in sorted(_files(self.path, self.pattern).items()):
            known = self.ends.get(name, 0)
            now[name] = known if size == known else _last_line_end(self.path, name, known if size > known else 0, size)
        # A file that is gone keeps its place, so that the order of offsets never runs back.
        self.ends = dict(sorted({**self.ends, **now}.items()))
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts = []
        for name, stop in end.items():
            begin = start.get(name, 0)
            if stop < begin:  # the file was written anew
                begin = 0
            parts += [Range(name, low, min(low + self.part_bytes, stop), stop) for low in range(begin, stop, self.part_bytes)]
        return parts or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if partition.begin >= partition.end:
            return
        received = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        source = partition.name or posixpath.basename(_system(self.path)[1])
        with _open(self.path, partition.name) as file:
            header, first = self._header(file)
            place = [header.index(c) if c in header else None for c in self.columns]
            rows: list[list[str | None]] = []
            positions: list[int] = []
            for at, line in _lines(file, max(partition.begin, first), partition):
                cells = next(csv.reader([line]), [])
                if not cells:
                    continue
                rows.append([(cells[i] or None) if i is not None and i < len(cells) else None for i in place])
                positions.append(at)
                if len(rows) == _BATCH:
                    yield self._batch(rows, positions, source, received)
                    rows, positions = [], []
            if rows:
                yield self._batch(rows, positions, source, received)

    def _header(self, file) -> tuple[list[str], int]:
        """Column names in the first line, and where the second line begins."""
        head = b""
        file.seek(0)
        while b"\n" not in head and (more := file.read(_LOOK_BACK)):
            head += more
        first = head.find(b"\n") + 1
        return [c.strip() for c in next(csv.reader([head[:first].decode("utf-8-sig", "replace").rstrip("\r\n")]), [])], first

    def _batch(self, rows, positions, source, received) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array(c, pa.string()) for c in zip(*rows)] if self.columns else []
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([source] * n), pa.array(positions, pa.int64()), pa.array([received] * n)],
            names=[*self.columns, "_stream_source", "_stream_row_index", "_received_utc"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _lines(file, begin: int, part: Range):
    """(position, text) of the lines that begin in [begin, part.end); one may reach past the end, up to ``part.stop``.

    ``begin`` is a line's start only at the start of the new range; elsewhere the line under it belongs to the partition before.
    """
    if begin > 0:
        file.seek(begin - 1)
        rest = b"" if file.read(1) == b"\n" else None
    else:
        file.seek(0)
        rest = b""
    at = begin
    position = begin
    while position < part.stop and at < part.end:
        block = file.read(min(1 << 20, part.stop - position))
        if not block:
            return
        position += len(block)
        lines = block.split(b"\n")
        for i, piece in enumerate(lines):
            if i == len(lines) - 1:  # no break after it yet
                if rest is None:
                    at += len(piece)
                else:
                    rest += piece
                break
            if rest is None:
                rest = b""
                at += len(piece) + 1
                continue
            line = rest + piece
            rest = b""
            if at >= part.end:
                return
            yield at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1


def follow_stream(spark: SparkSession, path: str, columns: list[str], *, pattern: str = "*.csv", start_at_end: bool = False,
                  case: str | None = None, case_value=None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Stream over one appended file, or all matching files of a folder: ``columns`` as text, by the names in the first line.

    A record is one line; empty cells, short lines and absent columns give nulls. ``_stream_row_index`` is the position of the line
    in its file. A file that became shorter is read from its start. ``start_at_end`` leaves out what is there at the first start. Local
    paths and the addresses that pyarrow opens (s3, gs, hdfs) are read by the executors themselves.
    """
    spark.dataSource.register(GrowingFiles)
    stream = (spark.readStream.format(FORMAT).option("columns", json.dumps(columns)).option("pattern", pattern)
              .option("from_end", str(start_at_end).lower()).option("part_bytes", str(part_bytes)).load(path))
    return stream if case is None or case_value is None else stream.where(F.col(case) == str(case_value))
