"""A collection of functions and vectors with a stored inverted file.

The lists of the inverted file are the partitions of the collection's Parquet table: an
insert puts each row into the list of its nearest centroid, a search reads the lists that
its queries look into and no others. Centroids come from a bounded sample of the first insert
and stay; ``rebuild`` makes new ones from all rows.

How many lists a query looks into is stored too: after an insert that has doubled the
collection, at most ``PROBES`` stored vectors drawn by hash are compared with all rows, and
the number of lists that hold a given share of their true neighbours is kept.

Rows are told apart by 128 bits of their four columns. An insert that fails leaves no
rows, and one that is repeated adds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.vectors import BLOCK, best_of_rows, fit_centroids, unit_sample

NAMES = ["project_name", "file_name", "function_name", "function_code"]
#: stored vectors that tell how many lists to look into
PROBES = 256
SHARES = (0.5, 0.8, 0.9, 0.95, 0.99, 1.0)
#: cells over which the rows of a list are dealt in a search
PIECES = 8


def _units(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _order(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The lists by nearness, a row for each vector."""
    return np.argsort(-np.round(m @ centres.T, 9), axis=1, kind="stable")


class VectorStore:
    """An append-only collection under ``path``: project, file, function, code, vector of ``dim`` numbers."""

    def __init__(self, spark: SparkSession, path: str, dim: int, lists: int = 128):
        self.spark, self.path, self.dim, self.lists = spark, path.rstrip("/"), dim, lists

    # --- files

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._at(f"{name}/_SUCCESS")
        return fs.exists(path)

    def drop(self) -> None:
        fs, path = self._at("")
        fs.delete(path.getParent() if path.getName() == "" else path, True)

    # --- contents

    def table(self) -> DataFrame:
        """list and the columns of the collection."""
        if not self._exists("rows"):
            return self.spark.createDataFrame([], schemas.FUNCTION_CODES + ", list int")
        return self.spark.read.schema(schemas.FUNCTION_CODES + ", list int").parquet(f"{self.path}/rows")

    def count(self) -> int:
        return self.table().count()

    def centres(self) -> np.ndarray:
        """Unit centroids of the lists, in the order of their numbers."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r.centre for r in rows]).reshape(-1, self.dim)

    def insert(self, df: DataFrame) -> DataFrame:
        """Adds the functions that are not there yet. Returns the rows refused: those without a vector of ``dim`` finite numbers.

        Of equal functions in one insert the one with the smallest vector stays.
        """
        usable = F.coalesce((F.size("embedding") == self.dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        rows = df.where(usable).select(F.md5(F.to_json(F.array(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in NAMES)))).alias("id"), *NAMES, F.col("embedding").cast("array<float>").alias("embedding"))
        rows = rows.groupBy("id").agg(*(F.first(c).alias(c) for c in NAMES), F.min("embedding").alias("embedding"))
        first = not self._exists("rows")
        if first:
            self._write_centres(fit_centroids(unit_sample(rows, "embedding"), self.lists))
        else:
            rows = rows.join(self.table().select("id"), "id", "left_anti")
        self._listed(rows, self.centres()).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")
        stored = self.count()
        if stored >= 2 * self._known():
            self.tune(stored)
        return df.where(~usable)

    def _write_centres(self, centres: np.ndarray) -> None:
        # an empty first insert has one list, at the origin
        centres = centres if len(centres) else np.zeros((1, self.dim))
        df = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def _listed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """Rows with the number of their list, one file a list and task of a few."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _units(b.column("embedding"), dim)
                best = np.round(m @ centres.T, 9).argmax(1).astype(np.int32) if len(m) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], [*b.schema.names, "list"])

        return rows.mapInArrow(run, schemas.FUNCTION_CODES + ", list int").repartition("list", F.pmod(F.xxhash64("id"), F.lit(4)))

    def rebuild(self, lists: int | None = None) -> None:
        """New centroids from all rows; the collection is written anew beside the old rows and then takes their place."""
        rows = self.table().drop("list")
        self.lists = lists or self.lists
        centres = fit_centroids(unit_sample(rows, "embedding"), self.lists)
        self._listed(rows, centres if len(centres) else np.zeros((1, self.dim))).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/rebuilt")
        fs, old = self._at("rows")
        fs.delete(old, True)
        self._write_centres(centres)
        fs.rename(self._at("rebuilt")[1], old)
        self.tune(self.count())

    # --- how many lists to look into

    def _known(self) -> int:
        """Rows of the collection when it was last tuned."""
        return self.spark.read.parquet(f"{self.path}/tuned").first().stored if self._exists("tuned") else 0

    def probes(self, recall: float) -> int:
        """Lists in which drawn vectors had at least ``recall`` of their true neighbours."""
        r = self.spark.read.parquet(f"{self.path}/tuned").where(F.col("share") >= recall - 1e-9).orderBy("share").first()
        if r is None:
            raise ValueError("a recall is at most 1")
        return r.probes

    def tune(self, stored: int, k: int = 10) -> None:
        """Compares drawn vectors with all rows: one pass over the collection."""
        dim, centres = self.dim, self.centres()
        drawn = self.table().orderBy(F.xxhash64("id"), "id").limit(PROBES).select("id", "embedding").collect()
        q = np.array([r.embedding for r in drawn], float).reshape(-1, dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        own = [r.id for r in drawn]
        place = np.argsort(_order(q, centres), axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sim = q @ _units(b.column("embedding"), dim).T
                    ids, home = b.column("id").to_pylist(), b.column("list").to_numpy()
                    at = {x: i for i, x in enumerate(ids)}
                    for i, x in enumerate(own):
                        if x in at:
                            sim[i, at[x]] = -np.inf
                    row, column = best_of_rows(sim, np.arange(len(ids)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(sim[row, column]), pa.array(home[column].astype(np.int32))], ["q", "sim", "list"])

        near = self.table().select("id", "embedding", "list").mapInArrow(run, "q long, sim double, list int")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "list"))).where(F.col("r") <= k).select("q", "list").collect()
        needed = np.sort([place[r.q, r.list] for r in near]) + 1
        rows = [(s, int(needed[int(np.ceil(s * len(needed))) - 1]) if len(needed) else len(centres), stored) for s in SHARES]
        self.spark.createDataFrame(rows, "share double, probes int, stored long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tuned")

    # --- search

    def search(self, queries: DataFrame, k: int = 5, q_id: str = "q_id", vector: str = "embedding", lists: int | None = None, probes: int | None = None, recall: float = 0.95) -> DataFrame:
        """Cosine top-k with the stored columns: q_id, rank, sim, and the function; ties go to the smaller id.

        ``lists`` rebuilds a collection that was not made with so many lists.

        Without ``probes``, as many lists as the stored tuning gives for ``recall``; with as
        many as there are lists the result is exact. Queries without a vector of ``dim``
        numbers find nothing.
        """
        if lists and lists != self.lists:
            self.rebuild(lists)
        centres = self.centres()
        probes = min(len(centres), probes or self.probes(recall))
        asked = self._asked(queries, q_id, vector, centres, probes)
        # at most as many numbers as there are lists: they choose the partitions to read
        looked = sorted(r.list for r in asked.select("list").distinct().collect())
        stored = self.table().where(F.col("list").isin(looked)) if looked else self.table().limit(0)
        found = self._best(asked, stored, k)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return found.join(stored.select("list", "id", *NAMES), ["list", "id"]).select(F.col("q").alias("q_id"), "rank", "sim", *NAMES)

    def _asked(self, queries: DataFrame, q_id: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
        """Blocks of queries for each list they look into: list, q_ids, q_m."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, ids = _units(b.column("v"), dim), b.column("q").to_numpy().astype("<i8")
                if not len(m):
                    continue
                near = _order(m, centres)[:, :probes]
                row, listed = np.repeat(np.arange(len(m)), near.shape[1]), near.ravel()
                by = np.argsort(listed, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(listed[by])) + 1):
                    for at in range(0, len(part), BLOCK):
                        some = row[part[at : at + BLOCK]]
                        yield pa.RecordBatch.from_arrays([pa.array([int(listed[part[0]])], pa.int32()), pa.array([ids[some].tobytes()]), pa.array([m[some].tobytes()])], ["list", "q_ids", "q_m"])

        rows = queries.where(F.coalesce(F.size(vector) == dim, F.lit(False))).select(F.col(q_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
        return rows.mapInArrow(run, "list int, q_ids binary, q_m binary")

    def _best(self, asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
        """q, list, id, sim: the best k of each query and block of stored rows."""
        dim = self.dim

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = b.column("list").to_numpy()
                cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    for at in range(lo, hi, BLOCK):
                        part = b.slice(at, min(BLOCK, hi - at))
                        m = _units(part.column("embedding"), dim)
                        yield pa.RecordBatch.from_arrays([pa.array([int(home[at])], pa.int32()), pa.array(["".join(part.column("id").to_pylist())]), pa.array([m.tobytes()])], ["list", "k_ids", "k_m"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    q = np.frombuffer(b.column("q_m")[r].as_buffer()).reshape(-1, dim)
                    m = np.frombuffer(b.column("k_m")[r].as_buffer()).reshape(-1, dim)
                    q_ids, text = np.frombuffer(b.column("q_ids")[r].as_buffer(), "<i8"), b.column("k_ids")[r].as_py()
                    ids = np.array([text[i : i + 32] for i in range(0, len(text), 32)])
                    sim = np.round(q @ m.T, 6)
                    row, column = best_of_rows(sim, np.argsort(np.argsort(ids)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(np.full(len(row), b.column("list")[r].as_py(), np.int32)), pa.array(ids[column].tolist(), pa.string()), pa.array(sim[row, column])], ["q", "list", "id", "sim"])

        keys = stored.select("list", "id", "embedding").mapInArrow(blocks, "list int, k_ids string, k_m binary")
        keys = keys.withColumn("piece", F.pmod(F.xxhash64("k_ids"), F.lit(PIECES)).cast("int"))
        spread = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
        return spread.join(keys, ["list", "piece"]).select("list", "q_ids", "q_m", "k_ids", "k_m").mapInArrow(best, "q long, list int, id string, sim double")
