"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each tree gives a vector a string of ``BITS`` sign bits of random projections; an extra
coordinate makes all vectors equally long, so that strings agree where inner products are
large. A tree is the sorted array of its strings, stored as blocks: cells of a common
prefix, and a cell of more than ``BLOCK`` entries in several sorted arrays.

A query descends each tree to its longest matching prefixes and then ascends in all trees
at once, one bit at a time, until the entries that share the prefix number at least
``wanted`` in all trees together; those entries are scored. Counts come from binary search in
the arrays, below a cell's prefix, and from sums over cells above it.

``wanted`` is fitted: at most ``PROBES`` vectors of the queries, drawn by hash, are compared with
all entries, and it is the least number with which they find ``recall`` of their true
neighbours. (The vectors are a broadcast of that bounded number; each task returns at
most ``k`` + 1 neighbours of each.)

Equal vectors are one entry, with the ``k`` + 1 smallest of their ids: no more can be among
the nearest. Scores are sums of products in double precision in the order of the
components, so they do not depend on where a vector lies.

Defined results: vectors that are null, zero or hold null or non-finite components take
no part, nor do those of another length than the most frequent one (of ties, the
longest), nor rows without id; a query's own row is every row of its id; a repeated row
counts once; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, settings, trimmed

TREES = 16
#: bits of a tree's strings
BITS = 48
#: entries of a block
BLOCK = 4096
#: queries that meet a block at a time
QUERIES = 1024
#: few rows at a time, where a row is a block
NARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}
PROBES = 128
RECALL = 0.95
#: scores closer than this to the k-th by matrix product are computed again in order
MARGIN = 1e-9


def planes(dim: int, trees: int, seed: int = 42) -> np.ndarray:
    """Normals of the hyperplanes, dim + 1 rows; a column for each bit of each tree."""
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS))


def strings(x: np.ndarray, longest: float, normals: np.ndarray, query: bool) -> np.ndarray:
    """The strings of vectors as numbers in their order: a row each, a column for each tree."""
    x = x / longest
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
    bits = np.column_stack([x, extra]) @ normals > 0
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return bits.reshape(len(x), -1, BITS) @ weights


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows (id, v) that take part, of any length."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.size("v") > 0).where(finite & F.exists("v", lambda c: c != 0))


def extent(rows: DataFrame) -> tuple[int, float]:
    """The most frequent length, and the largest norm of vectors of that length."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    top = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).first()
    return (top.dim, top.longest) if top else (0, 1.0)


def _keyed(rows: DataFrame, longest: float, normals: np.ndarray, query: bool) -> DataFrame:
    """id, key (128 bits of the vector), v, hashes (a number for each tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v")) + 0.0  # -0 becomes 0
                keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
                h = strings(x, longest, normals, query)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), b.column("v"), lists], ["id", "key", "v", "hashes"])

    return rows.mapInArrow(run, "id long, key binary, v array<double>, hashes array<long>")


def _packed(rows: DataFrame, by: list[str], most: int, kind: str | None = None) -> DataFrame:
    """Rows of at most ``most`` entries: ``by``, and (as bytes) h sorted, keys, first ids, depths, and the vectors as ``kind`` if that is given.

    ``rows``: ``by`` (int or long columns), h, key, first, depth, v.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            x = _matrix(t.column("v")).astype(kind).tobytes() if kind else b""
            cells = [pa.array([t.column(c)[0].as_py()], t.schema.field(c).type) for c in by]
            numbers = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("h", "first", "depth")]
            return pa.RecordBatch.from_arrays([*cells, pa.array([t.num_rows]), *(pa.array([z], pa.binary()) for z in (*numbers, b"".join(t.column("key").to_pylist()), x))], [*by, "n", "h", "first", "depth", "keys", "x"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in by:
                values = b.column(c).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            at = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for lo, hi in zip(at, at[1:], strict=False):
                if held and any(held[-1].column(c)[-1] != b.column(c)[lo] for c in by):
                    yield flush()
                    size = 0
                while lo < hi:
                    part = b.slice(lo, min(hi - lo, most - size))
                    held.append(part)
                    lo, size = lo + part.num_rows, size + part.num_rows
                    if size == most:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    sorted_ = rows.select(*by, "h", "first", "depth", "key", "v").sortWithinPartitions(*by, "h", "key")
    kinds = dict(rows.dtypes)
    return sorted_.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, h binary, first binary, depth binary, keys binary, x binary")


def _per_tree(keyed: DataFrame, prefix: int, *more: str) -> DataFrame:
    """A row for each tree: tree, cell (the first ``prefix`` bits), h and the other columns."""
    return keyed.select("key", "v", *more, F.posexplode("hashes").alias("tree", "h")).withColumn("cell", F.shiftright("h", BITS - prefix))


def _ancestors(cells: DataFrame, prefix: int) -> DataFrame:
    """Each cell with each of its prefixes: depth, node."""
    return cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(prefix))).alias("depth")).withColumn("node", F.expr(f"shiftright(cell, {prefix} - depth)"))


class Forest:
    """The stored index of the vectors of a table."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES, block: int = BLOCK):
        spark = vectors.sparkSession
        self.tmp = Scratch(spark, "hash-forest")
        self.k, self.trees = k, trees
        rows = usable(vectors, id_col, vector)
        self.dim, self.longest = extent(rows)
        #: vectors are stored as they came
        self.kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
        self.normals = planes(self.dim, trees)
        keyed = self.tmp.save(_keyed(rows.where(F.size("v") == self.dim), self.longest, self.normals, query=False), "rows")
        rank = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
        ids = keyed.select("key", "id").withColumn("r", rank).where(F.col("r") <= k + 1)
        #: key, ids: the smallest k + 1 ids of each vector
        self.ids = self.tmp.save(ids.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")), "ids")
        #: key, v, hashes, first: the entries, each vector once
        self.entries = self.tmp.save(keyed.groupBy("key").agg(F.first("v").alias("v"), F.first("hashes").alias("hashes"), F.min("id").alias("first")), "entries")
        n = self.entries.count()
        #: bits of a cell: about ``block`` entries to a cell
        self.prefix = max(0, int(np.ceil(np.log2(max(1, n) / block))))
        per_tree = _per_tree(self.entries, self.prefix, "first").withColumn("depth", F.lit(0).cast("long"))
        sizes = per_tree.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("entries"))
        #: tree, cell, entries, pieces
        self.cells = self.tmp.save(sizes.withColumn("pieces", F.ceil(F.col("entries") / block).cast("int")), "cells")
        dealt = per_tree.join(self.cells.select("tree", "cell", "pieces"), ["tree", "cell"]).withColumn("piece", F.pmod(F.xxhash64("key"), "pieces").cast("int"))
        dealt = dealt.repartition("tree", "cell", "piece")
        #: tree, cell, piece and a sorted array of its entries
        self.blocks = self.tmp.save(_packed(dealt, ["tree", "cell", "piece"], 2 * block, self.kind), "blocks")

    def _queries(self, queries: DataFrame, id_col: str, vector: str) -> DataFrame:
        """id, key, v, hashes of the queries that take part."""
        return _keyed(usable(queries, id_col, vector).where(F.size("v") == self.dim), self.longest, self.normals, query=True)

    def counts(self, q: DataFrame) -> DataFrame:
        """Of each query vector (key, v, hashes) the entries that share d bits with it, over all trees: key, c (array by d)."""
        prefix, bits = self.prefix, BITS
        own = _per_tree(q, prefix).withColumns({"first": F.lit(0).cast("long"), "depth": F.lit(0).cast("long"), "v": F.array(F.lit(0.0))})
        own = self.tmp.save(_packed(self._dealt(own, "met"), ["tree", "cell"], QUERIES), "descent")
        nodes = _ancestors(self.cells, prefix).groupBy("tree", "depth", "node").agg(F.sum("entries").alias("entries"))
        above = _ancestors(own.select("tree", "cell").distinct(), prefix).join(nodes, ["tree", "depth", "node"], "left")
        above = above.groupBy("tree", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("entries", F.lit(0)).alias("entries")))), lambda x: x.entries).alias("above"))
        arrays = self.blocks.select("tree", "cell", F.col("h").alias("b_h"))
        upper = own.join(above, ["tree", "cell"]).select("keys", "h", "above", F.lit(None).cast("binary").alias("b_h"))
        lower = own.join(arrays, ["tree", "cell"]).select("keys", "h", F.lit(None).cast("array<long>").alias("above"), "b_h")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for keys, h, up, array in zip(*(b.column(c).to_pylist() for c in ("keys", "h", "above", "b_h")), strict=True):
                    h = np.frombuffer(h, "<i8")
                    c = np.zeros((len(h), bits + 1), np.int64)
                    if array is None:
                        c[:, : prefix + 1] = up
                    else:
                        sorted_ = np.frombuffer(array, "<i8")
                        for d in range(prefix + 1, bits + 1):
                            low = (h >> (bits - d)) << (bits - d)
                            c[:, d] = np.searchsorted(sorted_, low + (1 << (bits - d))) - np.searchsorted(sorted_, low)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i : i + 16] for i in range(0, len(keys), 16)], pa.binary()), *(pa.array(c[:, d]) for d in range(bits + 1))], ["key", *(f"c{d}" for d in range(bits + 1))])

        found = upper.unionByName(lower).mapInArrow(run, "key binary, " + ", ".join(f"c{d} long" for d in range(bits + 1)))
        with settings(q.sparkSession, NARROW):
            return self.tmp.save(found.groupBy("key").agg(F.array(*(F.sum(f"c{d}") for d in range(bits + 1))).alias("c")), "counts")

    def _dealt(self, rows: DataFrame, name: str) -> DataFrame:
        """Queries partitioned by tree and cell, and where a cell has more than a pack of them, also by key."""
        full = rows.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("packs"))
        full = self.tmp.save(full, name)
        return rows.join(full, ["tree", "cell"]).withColumn("pack", F.pmod(F.xxhash64("key"), "packs").cast("int")).repartition("tree", "cell", "pack")

    def fit(self, q: DataFrame, counts: DataFrame, recall: float, probes: int = PROBES) -> int:
        """The least number of entries to score with which drawn queries find ``recall`` of their true neighbours."""
        drawn = q.orderBy(F.xxhash64("key"), "key").limit(probes).join(counts, "key").collect()
        if not drawn:
            return 1
        x, k, trees, dim = np.array([r.v for r in drawn]), self.k, self.trees, self.dim
        h = np.array([r.hashes for r in drawn])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, depth = np.full((len(x), 0), -np.inf), np.zeros((len(x), 0), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                e, eh = _matrix(b.column("v")).reshape(-1, dim), _matrix(b.column("hashes")).reshape(-1, trees)
                s = x @ e.T
                best = np.argpartition(-s, min(k, len(e) - 1), axis=1)[:, : k + 1]
                differ = np.bitwise_xor(h[:, None, :], eh[best]).min(2)
                score = np.concatenate([score, np.take_along_axis(s, best, 1)], 1)
                depth = np.concatenate([depth, BITS - np.frexp(differ.astype(float))[1]], 1)
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                score, depth = np.take_along_axis(score, best, 1), np.take_along_axis(depth, best, 1)
            i = np.repeat(np.arange(len(x)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(score.ravel()), pa.array(depth.ravel().astype(np.int64))], ["q", "score", "depth"])

        near = self.entries.select("v", "hashes").mapInArrow(run, "q long, score double, depth long")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "depth"))).where(F.col("r") <= k + 1).groupBy("q", "depth").count().collect()
        #: of each drawn query, the share of its neighbours that share d bits in some tree
        share = np.zeros((len(x), BITS + 1))
        for r in near:
            share[r.q, : r.depth + 1] += r["count"]
        share /= np.maximum(share[:, :1], 1)
        c = np.array([r.c for r in drawn])
        choices = np.unique(c)
        lo, hi = 0, len(choices) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            at = (c >= choices[mid]).sum(1) - 1
            enough = (at < 0) | (share[np.arange(len(x)), np.maximum(at, 0)] >= 0)
            got = np.where(enough, share[np.arange(len(x)), np.maximum(at, 0)], 1.0).mean()
            lo, hi = (lo, mid) if got >= recall else (mid + 1, hi)
        return int(choices[lo])

    def search(self, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL, wanted: int | None = None) -> DataFrame:
        """The ``k`` nearest found of each query, nearest first: query_id, rank, vec_id, score (ties: smaller id)."""
        k, prefix, bits, dim, tmp = self.k, self.prefix, BITS, self.dim, self.tmp
        kind = self.kind
        schema = "query_id long, rank int, vec_id long, score double"
        if not dim:
            return queries.sparkSession.createDataFrame([], schema)
        asked = tmp.save(self._queries(queries, id_col, vector), "asked")
        q = tmp.save(asked.groupBy("key").agg(F.first("v").alias("v"), F.first("hashes").alias("hashes")), "queries")
        counts = self.counts(q)
        if wanted is None:
            wanted = self.fit(q, counts, recall)

        # counts fall with the depth: the deepest with enough entries, or the root
        stop = F.greatest(F.size(F.filter("c", lambda n: n >= wanted)) - 1, F.lit(0)).cast("long")
        ascents = _per_tree(q.join(counts.select("key", stop.alias("depth")), "key"), prefix, "depth")
        deep = ascents.where(F.col("depth") > prefix)
        shallow = ascents.where(F.col("depth") <= prefix).withColumn("node", F.expr(f"shiftright(cell, {prefix} - depth)")).drop("cell")
        reached = _ancestors(self.cells.select("tree", "cell"), prefix).withColumn("depth", F.col("depth").cast("long"))
        visits = deep.unionByName(shallow.join(reached, ["tree", "depth", "node"]).drop("node")).withColumn("first", F.lit(0).cast("long"))
        packs = _packed(self._dealt(visits, "met-again"), ["tree", "cell"], QUERIES, self.kind)
        packs = tmp.save(packs.select("tree", "cell", F.col("h").alias("q_h"), F.col("depth").alias("q_depth"), F.col("keys").alias("q_keys"), F.col("x").alias("q_x")), "visits")
        met = packs.join(self.blocks.select("tree", "cell", "h", "first", "keys", "x"), ["tree", "cell"]).select("q_h", "q_depth", "q_keys", "q_x", "h", "first", "keys", "x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    yield _best(*(b.column(c)[row].as_buffer() for c in ("q_h", "q_depth", "q_keys", "q_x", "h", "first", "keys", "x")), dim, kind, k + 1)

        found = met.mapInArrow(lambda batches: trimmed(run(batches)), "q binary, key binary, first long, score double")
        # a vector found in several trees is one: the same score, id and key
        rank = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "key"))
        with settings(queries.sparkSession, NARROW):
            found = tmp.save(found.withColumn("r", rank).where(F.col("r") <= k + 1).select("q", "key", "score").distinct(), "found")
        rows = found.join(self.ids, "key").select("q", "score", F.explode("ids").alias("vec_id"))
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        near = tmp.save(rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "near")
        mine = asked.select("id", F.col("key").alias("q")).distinct().join(near, "q")
        others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("id")), 1, k)
        return mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "n")).select("query_id", (F.col("at") + 1).alias("rank"), "n.vec_id", "n.score")


def _best(q_h: pa.Buffer, q_depth: pa.Buffer, q_keys: pa.Buffer, q_x: pa.Buffer, h: pa.Buffer, first: pa.Buffer, keys: pa.Buffer, x: pa.Buffer, dim: int, kind: str, k: int) -> pa.RecordBatch:
    """The k best entries of a block for each query, among those that share the prefix at which it stopped."""
    q_h, depth, h, first = (np.frombuffer(z, "<i8") for z in (q_h, q_depth, h, first))
    q_keys, keys = np.frombuffer(q_keys, "V16"), np.frombuffer(keys, "V16")
    q, x = (np.frombuffer(z, kind).astype(float).reshape(-1, dim) for z in (q_x, x))
    low = (q_h >> (BITS - depth)) << (BITS - depth)
    lo, hi = np.searchsorted(h, low), np.searchsorted(h, low + (np.int64(1) << (BITS - depth)))
    scale = np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0)
    out = []
    # neighbours in the order of strings have like ranges: a few matrix products each over the range of some
    for at in range(0, len(q), 64):
        a, z = int(lo[at : at + 64].min()), int(hi[at : at + 64].max())
        if a >= z:
            continue
        s = q[at : at + 64] @ x[a:z].T
        column = np.arange(a, z)
        s[(column[None] < lo[at : at + 64, None]) | (column[None] >= hi[at : at + 64, None])] = -np.inf
        if z - a > k:
            least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= (least - MARGIN * scale[at : at + 64])[:, None]) & (s > -np.inf))
        i, j = i + at, j + a
        exact = in_order(q[i], x[j])
        order = np.lexsort((first[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        begins = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        nth = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
        top = nth < k
        out.append((i[top], j[top], exact[top]))
    i, j, s = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64 if c < 2 else float) for c in range(3))
    as_bytes = lambda v: pa.array(v.tolist(), pa.binary())
    return pa.RecordBatch.from_arrays([as_bytes(q_keys[i]), as_bytes(keys[j]), pa.array(first[j]), pa.array(s)], ["q", "key", "first", "score"])


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of the vectors whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return Forest(vectors).search(vectors.where("vec_id % 20 = 0"))
