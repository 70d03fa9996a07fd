"""A Spark data source for large line formats: plain files are read in byte ranges, each line by the range it begins in.

Formats: `matrixmarket` gives (row, col, val) from 0, `lines` gives (file, begins_at, line), `star_counts` gives (file, gene, value). A file's
head (banner and size line, or column names) is read once, when the plan is made. With the option pushdown (and spark.sql.python.filterPushdown.enabled) bounds on row or col of
entries are applied by the reader. Compressed files cannot be cut and are one part each. Paths are
local, or URIs of a file system that Arrow knows; what Spark alone can reach is read by the functions of matrixmarket and geo.
"""

from __future__ import annotations

import bz2
import gzip
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

NAME = "textparts"
#: Bytes of a part, of a read, and rows of a batch.
PART, READ, BATCH = 64 << 20, 1 << 20, 65536
SCHEMAS = {"matrixmarket": "row bigint, col bigint, val double", "lines": "file string, begins_at bigint, line string", "star_counts": "file string, gene string, value double"}


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in order."""
    system, at = _open(path)
    info = system.get_file_info(at)
    found = [info] if info.type == arrow_fs.FileType.File else [f for f in system.get_file_info(arrow_fs.FileSelector(at, recursive=False)) if f.type == arrow_fs.FileType.File] if info.type == arrow_fs.FileType.Directory else []
    if not found:
        raise FileNotFoundError(path)
    return [(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if not posixpath.basename(f.path).startswith((".", "_"))]


def _stream(system: arrow_fs.FileSystem, path: str, start: int = 0) -> tuple[object, bool]:
    """(readable from start, whether it is compressed): by the first bytes, whatever the name."""
    with system.open_input_file(path) as f:
        magic = f.read(3)
    if magic[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=system.open_input_stream(path, compression=None)), True
    if magic == b"BZh":
        return bz2.BZ2File(system.open_input_stream(path, compression=None)), True
    f = system.open_input_file(path)
    f.seek(start)
    return f, False


def lines_of(system: arrow_fs.FileSystem, path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(byte it begins at, line) of lines that begin in [start, end), without their ends; all lines where end is None. The first line belongs to whoever starts at 0, others to the part that holds their first byte."""
    f, _ = _stream(system, path, max(0, start - 1))
    with f:
        at, rest = max(0, start - 1), b""
        skip = start > 0  # up to and with the line end at or after start - 1
        while data := f.read(READ):
            rest += data
            cut = rest.split(b"\n")
            rest = cut.pop()
            for line in cut:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif end is not None and begin >= end:
                    return
                else:
                    yield begin, line.removesuffix(b"\r")
        if rest and not skip and (end is None or at < end):
            yield at, rest.removesuffix(b"\r")


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, head: dict):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.head = path, start, end, head


class TextParts(DataSource):
    """spark.read.format("textparts").option("layout", ...).option("part_bytes", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        layout = self.options.get("layout", "lines")
        if layout not in SCHEMAS:
            raise ValueError(f"no layout {layout}")
        return SCHEMAS[layout]

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else TextReader)(self.options)


class TextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout, self.size = options["path"], options.get("layout", "lines"), int(options.get("part_bytes", PART))
        self.column = options.get("column", "tpm_unstranded")
        self.bounds: dict[str, tuple[float, float]] = {}

    def _head(self, system: arrow_fs.FileSystem, path: str) -> dict:
        if self.layout == "matrixmarket":
            for at, line in lines_of(system, path, 0, None):
                if at == 0 and not line.startswith(b"%%MatrixMarket matrix coordinate"):
                    raise ValueError(f"{path} is no MatrixMarket coordinate file")
                if line.strip() and not line.startswith(b"%"):
                    size = line.split()
                    if len(size) != 3:
                        raise ValueError(f"{path} has no size line")
                    return {"size_line": at, "size": [int(x) for x in size]}
            raise ValueError(f"{path} has no size line")
        if self.layout == "star_counts":
            for _, line in lines_of(system, path, 0, None):
                if line.strip() and not line.startswith(b"#"):
                    names = line.decode().split("\t")
                    if self.column not in names:
                        raise ValueError(f"{path} has no column {self.column}")
                    return {"column": names.index(self.column), "names": line}
            raise ValueError(f"{path} has no column names")
        return {}

    def partitions(self) -> list[Part]:
        system, _ = _open(self.path)
        out = []
        for path, size in _files(self.path):
            head = self._head(system, path)
            f, compressed = _stream(system, path)
            f.close()
            step = max(1, self.size)
            out += [Part(path, 0, None, head)] if compressed or size <= step else [Part(path, a, min(size, a + step), head) for a in range(0, size, step)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        lines = lines_of(system, partition.path, partition.start, partition.end)
        make = {"matrixmarket": self._entries, "lines": self._lines, "star_counts": self._counts}[self.layout]
        rows, names = [], [c.split()[0] for c in SCHEMAS[self.layout].split(", ")]
        kinds = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in SCHEMAS[self.layout].split(", ")]
        for row in make(partition, lines):
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def _entries(self, part: Part, lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        (a, b), (c, d) = (self.bounds.get(x, (float("-inf"), float("inf"))) for x in ("row", "col"))
        for at, line in lines:
            if line.startswith(b"%") or not line.strip() or at == part.head["size_line"]:
                continue
            f = line.split()
            row, col = int(f[0]) - 1, int(f[1]) - 1
            if a <= row <= b and c <= col <= d:
                yield row, col, float(f[2]) if len(f) > 2 else 1.0

    def _lines(self, part: Part, lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        for at, line in lines:
            yield part.path, at, line.decode("utf-8", "replace")

    def _counts(self, part: Part, lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        for _, line in lines:
            if line == part.head["names"] or line.startswith((b"#", b"N_")) or not line.strip():
                continue
            f = line.decode().split("\t")
            try:
                value = float(f[part.head["column"]])
            except (IndexError, ValueError):
                value = None
            yield part.path, f[0].split(".")[0], value


class PushingReader(TextReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds on row and col of MatrixMarket entries, wholly; the others are Spark's."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            low, high = self.bounds.get(name, (float("-inf"), float("inf")))
            kinds = {EqualTo: (f.value, f.value) if hasattr(f, "value") else None, GreaterThanOrEqual: (getattr(f, "value", 0), high), LessThanOrEqual: (low, getattr(f, "value", 0)), GreaterThan: (None, high), LessThan: (low, None)}
            if self.layout != "matrixmarket" or name not in ("row", "col") or type(f) not in kinds or not isinstance(f.value, int):
                yield f
                continue
            a, b = kinds[type(f)]
            a, b = f.value + 1 if a is None else a, f.value - 1 if b is None else b
            self.bounds[name] = max(low, a), min(high, b)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextParts)


def size_of(path: str) -> tuple[int, int, int]:
    """(rows, columns, entries) as a MatrixMarket file states them."""
    reader = TextReader({"path": path, "layout": "matrixmarket"})
    return tuple(reader._head(_open(path)[0], _files(path)[0][0])["size"])
