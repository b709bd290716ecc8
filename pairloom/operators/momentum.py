"""Contrast against a queue of earlier rows, at the queue's real size.

A batch is compared with the last ``queue`` rows before it. A task holds a block of rows
while a share of the keys that they look back on pass by in order, so a row travels once
for each block of rows that a queue spans, not once for each batch. What is kept are two
numbers a row and direction: the largest logit and the sum of exponentials below it. An
aggregate merges them (online log-sum-exp), so the logits themselves are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import matrix, meet
from .vectors import dot, normalize

#: keys that are multiplied at a time, and rows
BLOCK = 2048
SLICE = 256
#: rows that a task holds (16 MB of 64-d vectors), and logits for which a further task is made
ROWS = 16_384
CELL = 1 << 28


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, number: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """blk, ids, and a matrix of each of the vector columns: the rows with ``number`` div ``block`` = blk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            cells = [t.column("n").to_numpy().astype("<i8").tobytes(), *(_vectors(t.column(c)).astype("<f8").tobytes() for c in columns)]
            return pa.RecordBatch.from_arrays([t.column("blk").slice(0, 1), *(pa.array([x], pa.binary()) for x in cells)], ["blk", "ids", *columns])

        for b in batches:
            blk = b.column("blk").to_numpy()
            cuts = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), len(blk)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and held[-1].column("blk")[-1] != b.column("blk")[lo]:
                        yield flush()
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield flush()

    blk = F.floor(F.col(number) / block).cast("long")
    numbered = rows.select(blk.alias("blk"), F.col(number).cast("long").alias("n"), *columns).repartition("blk").sortWithinPartitions("blk", "n")
    return numbered.mapInArrow(run, "blk long, ids binary, " + ", ".join(f"{c} binary" for c in columns))


class _Queued:
    """Largest logit and sum of exponentials below it of held rows against keys that pass by in order."""

    def __init__(self, held: pa.Table, batch_size: int, tau: float, queue: int):
        self.i, self.tau, self.queue = held["n"].to_numpy(), tau, queue
        self.end = self.i // batch_size * batch_size
        self.sides = [matrix(held[c].combine_chunks()) for c in ("x", "y")]
        self.top = np.full((2, len(self.i)), -np.inf)
        self.sum = np.zeros((2, len(self.i)))
        self.met = np.zeros(len(self.i), bool)

    def meet(self, passing: pa.RecordBatch) -> None:
        every = passing.column("n").to_numpy()
        keys = [matrix(passing.column(c)) for c in ("x", "y")]
        for start in range(0, len(every), BLOCK):
            j = every[start : start + BLOCK]
            lo, hi = np.searchsorted(j, self.end - self.queue), np.searchsorted(j, self.end)
            for at in range(0, len(self.i), SLICE):
                some = slice(at, at + SLICE)
                left, right = int(lo[some].min()), int(hi[some].max())
                if left >= right:
                    continue
                place = np.arange(left, right)[None]
                outside = (place < lo[some, None]) | (place >= hi[some, None])
                rows = np.flatnonzero(~outside.all(1))
                outside, rows = outside[rows], rows + at
                self.met[rows] = True
                for d in range(2):
                    logits = self.sides[d][rows] @ keys[d][start + left : start + right].T / self.tau
                    logits[outside] = -np.inf
                    top = np.maximum(self.top[d, rows], logits.max(1))
                    self.sum[d, rows] = self.sum[d, rows] * np.exp(self.top[d, rows] - top) + np.exp(logits - top[:, None]).sum(1)
                    self.top[d, rows] = top

    def found(self) -> pa.RecordBatch:
        columns = [self.i, self.top[0], self.sum[0], self.top[1], self.sum[1]]
        return pa.RecordBatch.from_arrays([pa.array(c[self.met]) for c in columns], ["i", "m_a2s", "z_a2s", "m_s2a", "z_s2a"])


def dealt(rows: DataFrame, keys: DataFrame, batch_size: int, queue: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (n, x: a, y: s) and keys (n, x: ks, y: ka) with the cells in which they meet, and the number of cells.

    A cell is a block of rows and a share of the keys that they look back on: as many shares
    as bring a cell's logits to ``CELL``. A key travels once for each block that a queue spans.
    """
    first, last = rows.agg(F.floor(F.min("i") / block), F.floor(F.max("i") / block)).first()
    first, last = first or 0, last or 0
    shares = -(-(queue + block) * block // CELL)
    x = rows.select(F.col("i").cast("long").alias("n"), F.col("a").alias("x"), F.col("s").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    x = x.withColumn("blk", F.floor(F.col("n") / block))
    y = keys.select(F.col("j").cast("long").alias("n"), F.col("ks").alias("x"), F.col("ka").alias("y"), F.pmod("j", F.lit(shares)).alias("share"))
    # the first row to look back on key j is j + 1, the last one is before the end of the batch of j + queue
    low, high = F.greatest(F.lit(first), F.floor(F.col("n") / block)), F.least(F.lit(last), F.floor((F.col("n") + queue + batch_size) / block))
    y = y.where(low <= high).withColumn("blk", F.explode(F.sequence(low, high)))
    cell = ((F.col("blk") - first) * shares + F.col("share")).cast("long").alias("cell")
    return x.select(cell, "n", "x", "y"), y.select(cell, "n", "x", "y"), (last - first + 1) * shares


def queue_terms(rows: DataFrame, keys: DataFrame, batch_size: int, tau: float, queue: int, block: int = ROWS) -> DataFrame:
    """i and for each direction the largest logit against the queue (m_a2s, m_s2a) and the sum of exp(logit - m) (z_a2s, z_s2a).

    ``rows``: i, a, s; ``keys``: j, ka, ks (unit vectors). Row i of batch b = i div
    ``batch_size`` meets the keys b * batch_size - queue <= j < b * batch_size; rows whose
    queue is empty are not returned.
    """
    x, y, cells = dealt(rows, keys, batch_size, queue, block)
    # numbers with gaps would make empty cells: several cells can share a task
    parts = min(cells, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = meet(x, y, parts, lambda held: _Queued(held, batch_size, tau, queue), "i long, m_a2s double, z_a2s double, m_s2a double, z_s2a double")
    # a row has as many parts as its keys have shares
    merged = parts.groupBy("i").agg(F.collect_list(F.struct("m_a2s", "z_a2s", "m_s2a", "z_s2a")).alias("p"), F.max("m_a2s").alias("m_a2s"), F.max("m_s2a").alias("m_s2a"))
    total = lambda d: F.aggregate("p", F.lit(0.0), lambda t, x: t + x[f"z_{d}"] * F.exp(x[f"m_{d}"] - F.col(f"m_{d}"))).alias(f"z_{d}")
    return merged.select("i", "m_a2s", total("a2s"), "m_s2a", total("s2a"))


def _contrasted(pairs: DataFrame, batch_size: int, tau: float, queue: int, initial: DataFrame | None, block: int) -> DataFrame:
    """batch, i, and for each direction the own logit and the queue's terms (null where the queue is empty)."""
    moving = [c if c in pairs.columns else c[0] for c in ("am", "sm")]
    unit = pairs.select("batch", "i", *(normalize(F.col(c)).alias(f"__{c}") for c in dict.fromkeys(["a", "s", *moving])))
    unit = unit.select("batch", "i", *(F.col(f"__{c}").alias(k) for c, k in zip(["a", "s", *moving], ["a", "s", "ka", "ks"], strict=True)))
    keys = unit.select(F.col("i").alias("j"), "ka", "ks")
    if initial is not None:
        # slot t is overwritten by row t, so it stands for row t - queue
        keys = keys.unionByName(initial.where(F.col("slot") < queue).select((F.col("slot") - queue).alias("j"), normalize(F.col("a")).alias("ka"), normalize(F.col("s")).alias("ks")))
    own = unit.select("batch", "i", (dot(F.col("a"), F.col("ks")) / tau).alias("own_a2s"), (dot(F.col("s"), F.col("ka")) / tau).alias("own_s2a"))
    return own.join(queue_terms(unit.select("i", "a", "s"), keys, batch_size, tau, queue, block), "i", "left")


def _entropy(direction: str) -> Column:
    """Cross entropy of the own logit among itself and the queue's."""
    own, m, z = (F.col(f"{c}_{direction}") for c in ("own", "m", "z"))
    top = F.greatest(own, m)  # null is passed over
    return top + F.log(F.exp(own - top) + F.coalesce(z * F.exp(m - top), F.lit(0.0))) - own


def _batches(terms: DataFrame, **columns: Column) -> DataFrame:
    return terms.groupBy("batch").agg(*[F.round(c, 6).alias(n) for n, c in columns.items()])


def momentum(pairs: DataFrame, batch_size: int, tau: float = 0.07, queue: int = 65_536, initial: DataFrame | None = None, block: int = ROWS) -> DataFrame:
    """batch, loss, loss_a2s, loss_s2a: cross entropy against the last ``queue`` rows before the batch, both ways.

    ``pairs``: batch, i, a, s, and where keys come from encoders of their own am, sm; row
    numbers i are unique and a batch's are ``batch_size`` from batch * batch_size on.
    ``initial`` (slot, a, s) is what the queue holds before the first batch, slots from 0;
    a slot counts until rows have taken its place. Without it the queue begins empty.
    """
    terms = _contrasted(pairs, batch_size, tau, queue, initial, block)
    x, y = F.avg(_entropy("a2s")), F.avg(_entropy("s2a"))
    return _batches(terms, loss=(x + y) / 2, loss_a2s=x, loss_s2a=y)


def momentum_accuracy(pairs: DataFrame, batch_size: int, tau: float = 0.07, queue: int = 65_536, initial: DataFrame | None = None, block: int = ROWS) -> DataFrame:
    """batch, acc_a2s, acc_s2a: share of rows whose own logit no logit of the queue exceeds; an empty queue is beaten."""
    terms = _contrasted(pairs, batch_size, tau, queue, initial, block)
    share = lambda d: F.avg(F.when(F.col(f"m_{d}") > F.col(f"own_{d}"), 0.0).otherwise(1.0))
    return _batches(terms, acc_a2s=share("a2s"), acc_s2a=share("s2a"))
