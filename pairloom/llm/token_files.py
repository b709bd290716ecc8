"""Token ids in seekable zstandard files.

A file holds the documents of one range of ids in ascending order, each in an
independent zstandard frame (with the format's content checksum), then a skippable frame
with the document ids, then the seek table of the public zstd seekable format: for each
frame its compressed and decompressed size and a checksum. A reader takes the tail, then
only the frames of the documents asked for.

Defined results: a null text is one document of the end id alone; null ids come first;
rows that share an id are ordered by text; an empty table writes no file; other columns
are neither read nor returned.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, settle, split_count
from .tokens import encoder

SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, sink, width: int, level: int = 1):
        self.sink, self.width = sink, width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.compressor.compress(raw)
        self.sink.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        n = len(self.ids)
        null = np.packbits(np.array([i is None for i in self.ids], bool)).tobytes()
        body = struct.pack("<BI", self.width, n) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + null
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        table = [*self.table, (8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        self.sink.write(struct.pack("<II", SEEK_FRAME, 12 * len(table) + 9))
        self.sink.write(b"".join(struct.pack("<III", *row) for row in table))
        self.sink.write(struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC))


class Reader:
    """Random access to a file's documents; reads only what it is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * frames
        if struct.unpack("<II", self._at(start - 8, 8)) != (SEEK_FRAME, 12 * frames + 9):
            raise ValueError("the seek table's frame is damaged")
        self.table = np.frombuffer(self._at(start, 12 * frames), "<u4").reshape(frames, 3)[:-1]
        index = int(np.frombuffer(self._at(start, 12 * frames), "<u4").reshape(frames, 3)[-1, 0])
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        kind, length = struct.unpack("<II", self._at(start - 8 - index, 8))
        if kind != INDEX_FRAME or length != index - 8:
            raise ValueError("the index frame is damaged")
        body = self._at(start - index, length)
        self.width, n = struct.unpack_from("<BI", body)
        null = np.unpackbits(np.frombuffer(body, np.uint8, offset=5 + 8 * n), count=n).astype(bool)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(body, "<i8", n, 5), null, strict=True)]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(int(offset))
        got = self.source.read(int(n))
        if len(got) != n:
            raise ValueError("the file is cut short")
        return got

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, i: int) -> np.ndarray:
        """Ids of the i-th document; raises if either checksum fails."""
        size, length, check = (int(x) for x in self.table[i])
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[i], size), max_output_size=length)
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.read(i) for i, d in enumerate(self.doc_ids) if d == doc_id]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One file for this task, under its final name only once it is whole."""
    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    encode = encoder(tokenizer, spaces=True)
    width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    fs, root = _open(folder)
    name, temp = f"{root}/tokens-{part:06d}.zst", f"{root}/.tokens-{part:06d}-{attempt}.tmp"
    n, tokens, end = 0, 0, np.array([end_id], "<u4")
    sink = writer = None
    for b in batches:
        for at in range(0, len(b), 2048):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(temp)
                writer = Writer(sink, width)
            texts = [t or "" for t in b.column("text")[at : at + 2048].to_pylist()]
            for id_, raw in zip(b.column("id")[at : at + 2048].to_pylist(), encode(texts), strict=True):
                ids = np.concatenate([np.frombuffer(raw, "<u4"), end])
                writer.add(id_, ids)
                n, tokens = n + 1, tokens + len(ids)
    if writer is not None:
        writer.close()
        sink.close()
        settle(fs, temp, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"tokens-{part:06d}.zst"]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], names=["file_no", "name", "n_docs", "n_tokens"])


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Writes the files to ``folder`` (a URI that all executors reach); lazily returns the manifest: file_no, name, n_docs, n_tokens."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange(files or split_count(docs.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return ordered.mapInArrow(lambda it: _write(it, folder, path, end_id), "file_no int, name string, n_docs long, n_tokens long")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    for b in batches:
        for name, at in zip(b.column("name").to_pylist(), b.column("before").to_pylist(), strict=True):
            with fs.open_input_file(f"{root}/{name}") as f:
                reader = Reader(f)
                for lo in range(0, len(reader), 10_000):
                    ids, start, n, crc = [], [], [], []
                    for i in range(lo, min(lo + 10_000, len(reader))):
                        x = reader.read(i)
                        ids.append(reader.doc_ids[i])
                        start.append(at)
                        n.append(len(x))
                        crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                        at += len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, start, n, crc)], names=["id", "start", "n_tokens", "ids_crc32"])


def read_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document as the files have it: id, start, n_tokens, ids_crc32.

    The manifest has a row for each file; the running sum over it is the only global step.
    """
    before = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("name", F.coalesce(before, F.lit(0)).alias("before"))
    out = files.repartition(split_count(manifest.sparkSession), "name").mapInArrow(lambda it: _read(it, folder), "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "token-files")
    folder = tmp.path("files")
    manifest = tmp.save(write_files(documents(spark, sf_dir, "doc_id", "text"), folder), "manifest")
    return read_files(manifest, folder)
