"""Vector operators: normalising, cosine, pooling, blockwise search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import matrix, meet

#: keys that are multiplied at a time
BLOCK = 2048
#: numbers of the queries that a task holds, and of a matrix of similarities (16 and 8 MB)
HELD = 1 << 21
SLICE = 1 << 20
#: pairs of rows for which a further cell is made
CELL = 1 << 25


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; a norm under ``eps`` counts as ``eps``, so a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def pool(hidden: Column, mask: Column, strategy: str) -> Column:
    """Pools array<array<double>> token vectors by ``last``, ``eos``, ``end``, ``mean`` or ``weighted``.

    last and eos take the last token that the mask keeps, end the last position as such.
    """
    if strategy in ("last", "eos"):
        position = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i + 1).otherwise(0)))
        return F.when(position > 0, F.element_at(hidden, position))
    if strategy == "end":
        return F.element_at(hidden, -1)
    if strategy not in ("mean", "weighted"):
        raise ValueError(f"unknown pooling strategy {strategy!r}")
    weights = F.transform(mask, lambda m, i: m.cast("double") * (i + 1 if strategy == "weighted" else F.lit(1.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    zero = F.transform(F.element_at(hidden, 1), lambda _: F.lit(0.0))
    summed = F.aggregate(F.zip_with(hidden, weights, lambda h, w: F.transform(h, lambda x: x.cast("double") * w)), zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.greatest(total, F.lit(1e-9)))


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function, by a rational approximation of erfc with a relative error under 2e-7."""
    z = np.abs(x) / 2**0.5
    t = 1 / (1 + 0.5 * z)
    poly = np.polyval([0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223], t)
    half = 0.5 * t * np.exp(-z * z + poly)
    return x * np.where(x >= 0, 1 - half, half)


def project(weights: dict[str, np.ndarray], column: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """Projection head in evaluation mode: linear, GELU, linear, layer norm (w1, b1, w2, b2, gamma, beta)."""

    def apply(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[column].to_numpy()).astype(float)
                    h = gelu(x @ weights["w1"].T + weights["b1"]) @ weights["w2"].T + weights["b2"]
                    h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
                    pdf = pdf.assign(**{column: list(h * weights["gamma"] + weights["beta"])})
                yield pdf

        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, schema)

    return apply


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Offline stand-in for an encoder: counts of words by md5 bucket, unit length."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    count = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))
    return let(let(places, count), normalize)


def grid(queries: DataFrame, keys: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Queries and keys (n, v, ...) with the cells in which each query meets each key once, and the number of cells.

    Queries are dealt to the rows of a grid and keys to its columns; each is copied along its
    row or column. There are as many cells as the work asks for, shuffle partitions at most, but
    always so many rows that a task holds about ``HELD`` numbers of queries. ``counted`` has the
    same number of rows as ``queries`` at least and is cheaper to count.
    """
    asked, dim = (counted or queries).agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    side = min(math.isqrt(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1, math.ceil(math.sqrt(asked * keys.count() / CELL)))
    rows = max(1, side, math.ceil(asked * (dim or 1) / HELD))
    columns = max(1, math.ceil(side * side / rows))
    own = lambda n: F.pmod(F.xxhash64("n", "v"), F.lit(n))
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("at", along(columns)).withColumn("cell", own(rows) * columns + F.col("at")).drop("at")
    k = keys.withColumn("at", along(rows)).withColumn("cell", F.col("at") * columns + own(columns)).drop("at")
    return q, k, rows * columns


def _units(column: pa.Array) -> np.ndarray:
    m = matrix(column)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """Rows so many at a time that a matrix with these columns has ``SLICE`` numbers."""
    step = max(1, SLICE // max(1, columns))
    return (slice(at, at + step) for at in range(0, rows, step))


class _Nearest:
    """The k best keys of held queries, by cosine to 6 digits, then by id."""

    def __init__(self, held: pa.Table, k: int, exclude_self: bool, centres: np.ndarray | None, probes: int):
        self.k, self.exclude_self, self.centres = k, exclude_self, centres
        self.ids, self.m = held["n"].to_numpy(), _units(held["v"].combine_chunks())
        self.sim = np.full((len(self.ids), k), -np.inf)
        self.key = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        if centres is not None:
            self.looks = np.zeros((len(self.ids), len(centres)), bool)
            for some in _slices(len(self.ids), len(centres)):
                near = np.argsort(-np.round(self.m[some] @ centres.T, 9), axis=1, kind="stable")[:, :probes]
                np.put_along_axis(self.looks[some], near, True, 1)

    def meet(self, passing: pa.RecordBatch) -> None:
        ids, m = passing.column("n").to_numpy(), _units(passing.column("v"))
        if self.centres is None:
            for at in range(0, len(ids), BLOCK):
                self._offer(np.arange(len(self.ids)), ids[at : at + BLOCK], m[at : at + BLOCK])
            return
        home = np.round(m @ self.centres.T, 9).argmax(1)
        for listed in np.unique(home):
            of_list, rows = np.flatnonzero(home == listed), np.flatnonzero(self.looks[:, listed])
            for at in range(0, len(of_list), BLOCK):
                some = of_list[at : at + BLOCK]
                self._offer(rows, ids[some], m[some])

    def _offer(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        for part in _slices(len(rows), len(ids)):
            some = rows[part]
            sim = self.m[some] @ m.T
            if self.exclude_self:
                sim[self.ids[some][:, None] == ids[None]] = -np.inf
            # no number that rounds to the least of the best, or more, is below this
            bar = self.sim[some, -1] - 1e-6
            if len(ids) > self.k and np.count_nonzero(sim >= bar[:, None]) > 8 * self.k * len(some):
                sim[np.isnan(sim)] = -np.inf
                bar = np.maximum(bar, np.partition(sim, -self.k, axis=1)[:, -self.k] - 2e-6)
            row, column = np.nonzero(sim >= bar[:, None])
            if not len(row):
                continue
            better = np.unique(row)
            of = np.concatenate([np.repeat(better, self.k), row])
            value = np.concatenate([self.sim[some[better]].ravel(), np.round(sim[row, column], 6)])
            key = np.concatenate([self.key[some[better]].ravel(), ids[column]])
            by = np.lexsort((key, -value, of))
            best = by[np.searchsorted(of[by], better)[:, None] + np.arange(self.k)]
            self.sim[some[better]], self.key[some[better]] = value[best], key[best]

    def found(self) -> pa.RecordBatch:
        row, column = np.nonzero(self.sim > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.key[row, column]), pa.array(self.sim[row, column])], ["q", "k", "sim"])


class _Ahead:
    """How many keys are ahead of held queries' true keys (t, own: its cosine to 6 digits)."""

    def __init__(self, held: pa.Table):
        self.ids, self.t, self.own = (held[c].to_numpy() for c in ("n", "t", "own"))
        self.m = _units(held["v"].combine_chunks())
        self.n = np.zeros(len(self.ids), np.int64)

    def meet(self, passing: pa.RecordBatch) -> None:
        every, m = passing.column("n").to_numpy(), _units(passing.column("v"))
        for at in range(0, len(every), BLOCK):
            ids = every[at : at + BLOCK]
            for some in _slices(len(self.ids), len(ids)):
                sim, own = self.m[some] @ m[at : at + BLOCK].T, self.own[some, None]
                # only numbers next to the own one have to be rounded
                clear = sim > own + 1e-6
                row, column = np.nonzero((sim >= own - 1e-6) & ~clear)
                value = np.round(sim[row, column], 6)
                ahead = (value > own[row, 0]) | ((value == own[row, 0]) & (ids[column] < self.t[some][row]))
                self.n[some] += clear.sum(1) + np.bincount(row[ahead], minlength=len(sim))

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.n)], ["q", "n"])


def best_of_rows(sim: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite numbers of each row, best first; ties go to the smaller ``order`` of the column."""
    if sim.shape[1] > k:
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((sim >= least) & (sim > -np.inf))
    else:
        row, column = np.nonzero(sim > -np.inf)
    by = np.lexsort((order[column], -sim[row, column], row))
    row, column = row[by], column[by]
    first = np.searchsorted(row, np.arange(len(sim)))
    among = np.arange(len(row)) - first[row] < k
    return row[among], column[among]


def _numbered(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("n"), F.col(vector).alias("v"))


def top_k(queries: DataFrame, keys: DataFrame, k: int, q_id: str, k_id: str, vector: str, exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k: q_id, k_id, sim, rank; ties go to the smaller key id.

    A cell of the grid yields k candidates a query; the final window sees k rows a column.
    """
    return _ranked(_numbered(queries, q_id, vector), _numbered(keys, k_id, vector), k, exclude_self)


def _ranked(queries: DataFrame, keys: DataFrame, k: int, exclude_self: bool, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The best k keys of each query, with ``centres`` among those in its ``probes`` nearest lists."""
    q, keyed, cells = grid(queries, keys)
    found = meet(q, keyed, cells, lambda held: _Nearest(held, k, exclude_self, centres, probes), "q long, k long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "k"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("q_id"), F.col("k").alias("k_id"), "sim", "rank")


def unit_sample(keys: DataFrame, vector: str, sample_rows: int = 20_000, seed: int = 42) -> np.ndarray:
    """About ``sample_rows`` unit vectors (a documented bound, twice that at most), drawn by hash, on the driver."""
    rows = keys.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    share = sample_rows / max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * sample_rows).collect()
    if not drawn:
        return np.zeros((0, 0))
    x = np.array(sorted(list(r.v) for r in drawn), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centroids(x: np.ndarray, lists: int, steps: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids of at most ``lists`` inverted lists, by spherical k-means."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(steps if len(x) else 0):
        best = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        used = np.linalg.norm(sums, axis=1) > 1e-12
        centres[used] = sums[used] / np.linalg.norm(sums[used], axis=1, keepdims=True)
    return centres


def fit_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 500) -> int:
    """Lists to look into so that ``recall`` of the k nearest of some vectors of the sample are found.

    Neighbours in a sample are farther away than among all keys, so this is rather too many
    for keys like the sample; it is no bound for the whole table.
    """
    q = np.arange(0, len(x), max(1, len(x) // asked))
    sim = x[q] @ x.T
    sim[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-sim, axis=1)[:, : min(k, len(x) - 1)]
    home = (x @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(x[q] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else len(centres)


def ann_top_k(queries: DataFrame, keys: DataFrame, k: int, q_id: str, k_id: str, vector: str, lists: int = 128, probes: int | None = None, exclude_self: bool = False, recall: float = 0.95) -> DataFrame:
    """Approximate cosine top-k by an inverted file: q_id, k_id, sim, rank.

    Every key is in its nearest list; a query looks into its ``probes`` nearest ones, or, if
    that is None, into as many as a sample needs for ``recall`` (an estimate: neighbours in a
    sample are not those among all keys; ``VectorStore`` tunes on all rows). With as many probes as
    lists the result is exact. Rows are dealt as for the exact search, not by lists: a query
    is sent to the columns of the grid, however many lists it looks into, and a list that
    holds much of the keys is no single task; a task scores only what its queries look into.
    Null vectors are left out; an empty table on either side gives an empty result.
    """
    sample = unit_sample(keys, vector)
    centres = fit_centroids(sample, lists)
    q, keyed = _numbered(queries, q_id, vector), _numbered(keys, k_id, vector)
    if not len(centres):
        return _ranked(q, keyed, k, exclude_self)
    if probes is None:
        probes = fit_probes(sample, centres, k, recall)
    return _ranked(q, keyed, k, exclude_self, centres, probes)


def score_of_distance(distance: Column) -> Column:
    """1 / (1 + distance): falls with the distance; null at -1, where it has no value."""
    return F.lit(1.0) / F.nullif(distance + 1, F.lit(0.0))


def most_similar(queries: DataFrame, candidates: DataFrame, q_id: str, c_id: str, text: str, vector: str, k: int = 5) -> DataFrame:
    """q_id, rank, text and score of the k candidates closest to each query."""
    found = top_k(queries, candidates, k, q_id, c_id, vector)
    texts = candidates.select(F.col(c_id).cast("long").alias("k_id"), F.col(text).alias("text"))
    return found.join(texts, "k_id").select("q_id", "rank", "text", F.col("sim").alias("score"))


def target_ranks(queries: DataFrame, keys: DataFrame, pairs: DataFrame, q_id: str, k_id: str, vector: str) -> DataFrame:
    """1-based rank of each query's true key among all keys: q_id, rank (ties: smaller key id first).

    ``pairs``: q_id, k_id. A cell of the grid yields one count a query; no pair of rows is emitted.
    """
    q = queries.select(F.col(q_id).alias("q"), F.col(vector).alias("qv")).join(pairs.select(F.col("q_id").alias("q"), F.col("k_id").alias("t")), "q")
    t = keys.select(F.col(k_id).alias("t"), F.col(vector).alias("tv"))
    both = q.join(t, "t").where("qv IS NOT NULL AND tv IS NOT NULL").select(F.col("q").cast("long").alias("n"), F.col("t").cast("long").alias("t"), F.col("qv").alias("v"), "tv")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = np.round((_units(b.column("v")) * _units(b.column("tv"))).sum(1), 6)
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("t"), b.column("v"), pa.array(value)], ["n", "t", "v", "own"])

    asked = both.mapInArrow(own, f"n long, t long, v {both.schema['v'].dataType.simpleString()}, own double")
    dealt, keyed, cells = grid(asked, _numbered(keys, k_id, vector), _numbered(queries, q_id, vector))
    counts = meet(dealt, keyed, cells, _Ahead, "q long, n long")
    return counts.groupBy(F.col("q").alias("q_id")).agg((F.sum("n") + 1).alias("rank"))
