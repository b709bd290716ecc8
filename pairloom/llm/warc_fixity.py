"""WARC archives and their Merkle fixity audit.

An archive is a set of shards (``.warc.gz``: one gzip member a record, as the format asks)
and an index of record offsets. For an audit each replica hashes its stored bytes record
by record; records are gathered into ordered offset ranges and these into a tree of
``fanout`` children a node, for each shard and then over the shards. Two replicas compare
their roots and descend only where digests differ, down to the damaged records.

A group of any level is bounded: a range holds the records that start in ``range_bytes``
bytes, a node ``fanout`` children. Shards are about ``shard_bytes`` of text each, so
their number follows the input, and a shard is written and read as a stream.

Defined results: null urls and pages count as empty; null ids are carried as null and come
first in their shard; repeated rows are records of their own, dealt over all shards; a
missing or shortened replica file makes its records ``missing``; bytes added after the last
record of a shard are a leaf of their own (null id, a sequence number past the last);
files that no index names are not part of an archive; an empty table writes nothing and audits to
an empty result; columns other than id, url and page are neither read nor returned.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settle, split_count

INDEX = "shard int, seq long, id long, offset long, length long"
LEAVES = "shard int, seq long, id long, offset long, length long, sha256 string"


def record(url: str, page: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One response record as a gzip member; its id follows from its content."""
    body = page.encode()
    name = hashlib.md5(url.encode() + b"\0" + body).hexdigest()
    uuid = "-".join((name[:8], name[8:12], name[12:16], name[16:20], name[20:]))
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.warc.gz"


class _Sink:
    """A shard under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        self.name = f"{root}/{shard_name(shard)}"
        self.temp = f"{root}/.{shard_name(shard)}-{context.taskAttemptId() if context else 0}.tmp"
        self.out, self.at, self.seq = self.fs.open_output_stream(self.temp), 0, 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.seq += 1

    def close(self) -> None:
        self.out.close()
        settle(self.fs, self.temp, self.name)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    shard, sink = None, None
    for b in batches:
        rows = []
        for s, id_, url, page in zip(*(b.column(c) for c in ("shard", "id", "url", "page")), strict=True):
            if s.as_py() != shard:
                if sink:
                    sink.close()
                shard, sink = s.as_py(), _Sink(folder, s.as_py())
            data = record(url.as_py() or "", page.as_py() or "")
            rows.append((shard, sink.seq, id_.as_py(), sink.at, len(data)))
            sink.add(data)
        yield _batch(rows, INDEX)
    if sink:
        sink.close()


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", page_col: str = "html", shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes the shards below ``folder`` (a URI all executors reach); lazily returns the index: shard, seq, id, offset, length."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(page_col).alias("page"))
    total = source.agg(F.sum(F.coalesce(F.octet_length("page"), F.lit(0)) + 300)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # by position too, as a row may be repeated any number of times; one task writes one shard
    dealt = source.withColumn("shard", F.pmod(F.xxhash64("id", "url", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "url", "page")
    return dealt.mapInArrow(lambda it: _write(it, folder), INDEX)


def _in_shards(index: DataFrame, parts: int) -> DataFrame:
    return index.repartition(parts, "shard").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Index batches with the stored bytes of each record (None: not there in full)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    shard, f = None, None
    for b in batches:
        got = []
        for s, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if s != shard:
                if f:
                    f.close()
                shard = s
                path = f"{root}/{shard_name(s)}"
                f = fs.open_input_file(path) if fs.get_file_info(path).type == pafs.FileType.File else None
            data = b""
            if f and offset < f.size():
                f.seek(offset)
                data = f.read(n)
            got.append(data if len(data) == n else None)
        yield b, got
    if f:
        f.close()


def _tail(folder: str, shard: int, seq: int, offset: int, end: int) -> pa.RecordBatch:
    """A leaf for the bytes that follow a shard's last record; it has that record's offset, so it joins its range."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{shard_name(shard)}"
    info = fs.get_file_info(path)
    rows = []
    if info.type == pafs.FileType.File and info.size > end:
        digest = hashlib.sha256()
        with fs.open_input_file(path) as f:
            f.seek(end)
            while part := f.read(1 << 20):
                digest.update(part)
        rows = [(shard, seq + 1, None, offset, info.size - end, digest.hexdigest())]
    return _batch(rows, LEAVES)


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """The index with the SHA-256 of each record's stored bytes (null: missing), and of what stands after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b, data in _ranges(batches, folder):
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "seq", "offset", "length")), strict=True):
                if last and last[0] != row[0]:
                    yield _tail(folder, last[0], last[1], last[2], last[2] + last[3])
                last = row
            digests = [None if x is None else hashlib.sha256(x).hexdigest() for x in data]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "seq", "id", "offset", "length")), pa.array(digests, pa.string())], names=[x.split()[0] for x in LEAVES.split(", ")])
        if last:
            yield _tail(folder, last[0], last[1], last[2], last[2] + last[3])

    return _in_shards(index, split_count(index.sparkSession)).select("shard", "seq", "id", "offset", "length").mapInArrow(run, LEAVES)


def copy_archive(index: DataFrame, source: str, target: str, flip: str = "flip") -> DataFrame:
    """Copies the shards; records whose column ``flip`` is true get one byte changed. Returns shard, seq of the copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sink = None, None
        for b, data in _ranges(batches, source):
            for s, x, bad in zip(b.column("shard").to_pylist(), data, b.column("__flip").to_pylist(), strict=True):
                if s != shard:
                    if sink:
                        sink.close()
                    shard, sink = s, _Sink(target, s)
                x = x or b""
                sink.add(x[: len(x) // 2] + bytes([x[len(x) // 2] ^ 1]) + x[len(x) // 2 + 1 :] if bad and x else x)
            yield _batch(list(zip(b.column("shard").to_pylist(), b.column("seq").to_pylist(), strict=True)), "shard int, seq long")
        if sink:
            sink.close()

    rows = index.withColumn("__flip", F.coalesce(F.col(flip), F.lit(False)))
    return _in_shards(rows, split_count(index.sparkSession)).select("shard", "seq", "offset", "length", "__flip").mapInArrow(run, "shard int, seq long")


class Tree:
    """Merkle tree of a replica: levels[0] are offset ranges, the last level is the root.

    A node is (shard, node, digest); above the shards' own roots, shard is -1.
    """

    def __init__(self, leaf: DataFrame, tmp: Scratch, name: str, range_bytes: int = 1 << 16, fanout: int = 16, levels: int | None = None):
        self.leaf, self.range_bytes, self.fanout = leaf, range_bytes, fanout
        of = leaf.select("shard", F.floor(F.col("offset") / range_bytes).alias("node"), "offset", F.concat_ws(":", "offset", "length", F.coalesce("sha256", F.lit("missing"))).alias("entry"))
        self.levels = [tmp.save(self._digest(of, "offset"), f"{name}-0")]
        top = self.levels[0].agg(F.max("node"), F.max("shard")).first()
        self.within = self._height(top[0])
        self.above = self._height(top[1])
        for k in range(1, self.within + self.above + 1):
            below = self.levels[-1]
            if k == self.within + 1:
                below = below.select(F.lit(-1).alias("shard"), F.col("shard").cast("long").alias("node"), "digest")
            of = below.select("shard", F.floor(F.col("node") / fanout).alias("node"), F.col("node").alias("offset"), F.concat_ws(":", "node", "digest").alias("entry"))
            self.levels.append(tmp.save(self._digest(of, "offset"), f"{name}-{k}"))

    def _height(self, largest: int | None) -> int:
        """Levels until nodes 0..largest have one parent; at least one."""
        n, k = largest or 0, 1
        while n >= self.fanout:
            n, k = n // self.fanout, k + 1
        return k

    @staticmethod
    def _digest(rows: DataFrame, order: str) -> DataFrame:
        entries = F.transform(F.array_sort(F.collect_list(F.struct(order, "entry"))), lambda x: x["entry"])
        return rows.groupBy("shard", "node").agg(F.sha2(F.array_join(entries, "\n"), 256).alias("digest"))

    def root(self) -> str | None:
        row = self.levels[-1].select("digest").first()
        return row[0] if row else None


def audit(a: Tree, b: Tree, tmp: Scratch) -> DataFrame:
    """Records that differ between two replicas: shard, seq, id, offset, length, sha256_a, sha256_b.

    Equal roots end it. Otherwise each level looks only at the children of the nodes that
    differ one level up. Both trees have the same shape, as they share one index.
    """
    if (len(a.levels), a.within) != (len(b.levels), b.within):
        raise ValueError("the replicas have indexes of different shape")
    spark = a.leaf.sparkSession
    if a.root() == b.root():
        return spark.createDataFrame([], "shard int, seq long, id long, offset long, length long, sha256_a string, sha256_b string")
    bad: DataFrame | None = None
    for k in reversed(range(len(a.levels))):
        x, y = (t.levels[k] for t in (a, b))
        if bad is not None:
            crossing = k == a.within
            parent = (F.lit(-1) if crossing else F.col("shard")).alias("shard"), F.floor((F.col("shard") if crossing else F.col("node")) / a.fanout).alias("node")
            x, y = (z.withColumns({"__s": parent[0], "__n": parent[1]}).join(bad.select(F.col("shard").alias("__s"), F.col("node").alias("__n")), ["__s", "__n"], "left_semi").drop("__s", "__n") for z in (x, y))
        both = x.join(y.withColumnRenamed("digest", "other"), ["shard", "node"], "full")
        bad = tmp.save(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("shard", "node"), f"bad-{k}")
    of = lambda t, name: t.leaf.withColumn("node", F.floor(F.col("offset") / t.range_bytes)).join(bad, ["shard", "node"], "left_semi").select("shard", "seq", "id", "offset", "length", F.col("sha256").alias(name))
    rows = of(a, "sha256_a").join(of(b, "sha256_b").select("shard", "seq", "sha256_b"), ["shard", "seq"], "full")
    return rows.where(~F.col("sha256_a").eqNullSafe(F.col("sha256_b")))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as an archive and a replica in which about one record of 200 has a changed byte; the audit's verdict on each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    tmp = Scratch(spark, "warc")
    index = tmp.save(write_archive(pages, tmp.path("a")), "index")
    flipped = index.withColumn("flip", F.crc32(F.col("id").cast("string")) % 211 == 5)
    tmp.save(copy_archive(flipped, tmp.path("a"), tmp.path("b")), "copied")
    la, lb = (tmp.save(leaves(index, tmp.path(r)), f"leaves-{r}") for r in "ab")
    found = audit(Tree(la, tmp, "tree-a"), Tree(lb, tmp, "tree-b"), tmp)
    return verdicts(la, found)


def verdicts(leaf: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, shard, offset, length, sha256, status: a row for each record of the first copy, and for each that only the replica has (added)."""
    status = F.when(F.col("__bad").isNull(), "ok").when(F.col("sha256_b").isNull(), "missing").otherwise("damaged")
    rows = leaf.join(found.select("shard", "seq", "sha256_b", F.lit(True).alias("__bad")), ["shard", "seq"], "left")
    rows = rows.select(F.col("id").alias("page_id"), "shard", "offset", "length", "sha256", status.alias("status"))
    # what only the replica has is in no index, so it has no place in the first copy
    added = found.where("offset IS NULL").select(F.col("id").alias("page_id"), "shard", "offset", "length", F.col("sha256_b").alias("sha256"), F.lit("added").alias("status"))
    return rows.unionByName(added)
