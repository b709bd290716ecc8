"""Object files as a table: ``spark.read.format("objectfile").load(folder)``.

A Python data source over ELF files (32 or 64 bits, either byte order). Planning lists the
files and deals them out by bytes; each task reads headers, symbol tables and the bytes of
functions by offset, so a large file is not held whole. A file gives a row for each function
that it defines, or one row that says why there is none:

empty, not an object file, unsupported object file, cut off, no functions, timed out, unreadable.

Options: path (a folder or file, also by uri), extension (``.o``), partitionBytes (64 MB of
files a task), timeout (seconds a file, 300), code (false leaves the bytes out).
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from struct import Struct

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, function_id int, function_name string, start_addr long, size long, section string, machine int, code binary, error string"
TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
#: rows of a batch
ROWS = 1000

# fixed values of the format
MAGIC = b"\x7fELF"
SYMBOL_TABLE, NO_BYTES = 2, 8
FUNCTION = 2
FIRST_RESERVED = 0xFF00
#: by class: file header from byte 16, section header, symbol
HEADER = {1: "HHIIIIIHHHHHH", 2: "HHIQQQIHHHHHH"}
SECTION = {1: "IIIIIIIIII", 2: "IIQQQQIIQQ"}
SYMBOL = {1: "IIIBBH", 2: "IBBHQQ"}


class CutOff(ValueError):
    """A part that a header names lies outside of the file."""


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class _Object:
    """The parts of one file, read by offset."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size
        head = self.part(0, 16)
        self.bits, self.order = head[4], {1: "<", 2: ">"}.get(head[5])

    def part(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise CutOff
        self.file.seek(at)
        return self.file.read(n)

    def unpack(self, kinds: dict[int, str], at: int, n: int = 1) -> list[tuple]:
        s = Struct(self.order + kinds[self.bits])
        return list(s.iter_unpack(self.part(at, s.size * n)))

    def sections(self) -> tuple[int, list[tuple]]:
        """The machine's number and the section headers."""
        h = self.unpack(HEADER, 16)[0]
        machine, at, count = h[1], h[5], h[11]
        return machine, self.unpack(SECTION, at, count) if at and count else []

    def name(self, table: bytes, at: int) -> str:
        return table[at : table.find(b"\0", at)].decode("utf-8", "replace")


def functions(file: pa.NativeFile, size: int, deadline: float, code: bool = True) -> Iterator[tuple]:
    """(name, address, size, section, machine, bytes) of each defined function."""
    o = _Object(file, size)
    machine, sections = o.sections()
    names = b""
    if sections:
        h = o.unpack(HEADER, 16)[0]
        if h[12] < len(sections):
            names = o.part(sections[h[12]][4], sections[h[12]][5])
    for s in sections:
        if s[1] != SYMBOL_TABLE:
            continue
        strings = o.part(sections[s[6]][4], sections[s[6]][5])
        width = Struct(o.order + SYMBOL[o.bits]).size
        for k, y in enumerate(o.unpack(SYMBOL, s[4], s[5] // width)):
            if not k % ROWS and time.monotonic() > deadline:
                raise TimeoutError
            name, value, length, info, home = (y[0], y[1], y[2], y[3], y[5]) if o.bits == 1 else (y[0], y[4], y[5], y[1], y[3])
            if info & 15 != FUNCTION or not 0 < home < min(FIRST_RESERVED, len(sections)):
                continue
            where = sections[home]
            text = o.part(where[4] + value - where[3], length) if code and where[1] != NO_BYTES else None
            yield o.name(strings, name), value, length, o.name(names, where[0]), machine, text


def rows_of(fs: pafs.FileSystem, path: str, size: int, timeout: float, code: bool) -> Iterator[tuple]:
    """The rows of one file. What was found before a fault stays, the fault is a row of its own."""
    count, error = 0, None
    if not size:
        error = "empty"
    else:
        try:
            with fs.open_input_file(path) as f:
                head = f.read(16)
                f.seek(0)
                if head[:4] != MAGIC:
                    error = "not an object file"
                elif len(head) == 16 and (head[4] not in HEADER or head[5] not in (1, 2)):
                    error = "unsupported object file"
                else:
                    for row in functions(f, size, time.monotonic() + timeout, code):
                        count += 1
                        yield (path, count, *row, None)
        except CutOff:
            error = "cut off"
        except TimeoutError:
            error = "timed out"
        except (OSError, IndexError, ValueError) as e:
            error = f"unreadable: {type(e).__name__}"
    if error or not count:
        yield path, None, None, None, None, None, None, None, error or "no functions"


def batches_of(paths: list[tuple[str, int | None]], timeout: float, code: bool) -> Iterator[pa.RecordBatch]:
    """The rows of files, given with their sizes (looked up where None)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], names)

    for path, size in paths:
        fs, plain = _filesystem(path)
        size = fs.get_file_info(plain).size if size is None else size
        # a file that is not there has no size, and fails when it is opened
        for row in rows_of(fs, plain, -1 if size is None else size, timeout, code):
            held.append((path, *row[1:]))
            if len(held) == ROWS:
                yield batch()
                held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        if "path" not in options:
            raise ValueError("objectfile needs a path")
        self.path = options["path"]
        self.extension = options.get("extension", ".o")
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.timeout = float(options.get("timeout", 300))
        self.code = options.get("code", "true").lower() == "true"

    def partitions(self) -> list[Files]:
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.extension)]
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else ""
        parts: list[Files] = [Files([])]
        held = 0
        for f in sorted(found, key=lambda f: f.path):
            if parts[-1].paths and held + f.size > self.bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append((scheme + f.path, f.size))
            held += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches_of(partition.paths, self.timeout, self.code)


class ObjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objectfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_objects(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The functions of the object files below ``path``, and a row for each file without any."""
    spark.dataSource.register(ObjectFiles)
    return spark.read.format("objectfile").options(**options).load(path)
