"""Two tables of vectors dealt to cells: a task holds one side of a cell while the other passes by.

Rows travel as they are, so an Arrow batch is a few megabytes however many rows there are,
and what a task holds is bounded by how the caller deals the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Held(Protocol):
    """The held rows of a cell, and what has been found for them so far."""

    def meet(self, passing: pa.RecordBatch) -> None: ...

    def found(self) -> pa.RecordBatch: ...


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of doubles; null components are NaN."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError(f"vectors of {sizes.min()} to {sizes.max()} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def meet(held: DataFrame, passing: DataFrame, parts: int, start: Callable[[pa.Table], Held], schema: str) -> DataFrame:
    """What each cell's held rows have found when its passing rows are through, in order of n.

    Both tables have cell and n (long) and columns of their own or in common. Cells are dealt
    to ``parts`` partitions in turn; one without held or without passing rows finds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, state = None, [], None
        for b in batches:
            cells, passes = b.column("cell").to_numpy(), b.column("passes").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (passes[1:] != passes[:-1])) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    if state:
                        yield state.found()
                    cell, waiting, state = cells[lo], [], None
                if not passes[lo]:
                    waiting.append(b.slice(lo, hi - lo))
                elif waiting or state:
                    if not state:
                        state = start(pa.Table.from_batches(waiting).combine_chunks())
                        waiting = []
                    state.meet(b.slice(lo, hi - lo))
        if state:
            yield state.found()

    both = held.withColumn("passes", F.lit(False)).unionByName(passing.withColumn("passes", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.pmod(F.col("cell"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("cell", "passes", "n").mapInArrow(run, schema)
