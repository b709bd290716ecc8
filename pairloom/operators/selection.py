"""Selecting rows and keeping simple counts: limits, exact splits, zips, running means, refreshed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import Scratch
from .ordinal import seeded, with_ordinal


def head(df: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    """The first n rows in order; all rows if n is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def sample_files(files: DataFrame, path: str = "path", n: int = 10, seed: int = 42) -> DataFrame:
    """At most n files in seeded order, those read ahead of the others."""
    return files.orderBy(seeded(seed, path), path).limit(n)


def exact_split(df: DataFrame, id_col: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds split: floor(n * train) rows in seeded order are train, the rest test."""
    placed = with_ordinal(df.withColumn("__h", seeded(seed, F.col(id_col).cast("string"))), "__h", id_col)
    cut = df.agg(F.floor(F.count(F.lit(1)) * F.lit(train)).alias("__cut"))
    split = F.when(F.col("ordinal") < F.col("__cut"), "train").otherwise("test")
    return placed.join(F.broadcast(cut)).withColumn("split", split).drop("__h", "__cut", "ordinal")  # one row


def positional_zip(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """position, left, right (structs): the n-th row of each side; rows beyond the shorter side are left out."""
    a = with_ordinal(left.select(F.struct(*left.columns).alias("left"), F.col(left_order).alias("__o")), "__o", name="position").drop("__o")
    b = with_ordinal(right.select(F.struct(*right.columns).alias("right"), F.col(right_order).alias("__o")), "__o", name="position").drop("__o")
    return a.join(b, "position")


def running_means(df: DataFrame, epoch: str, metrics: list[str]) -> DataFrame:
    """epoch, n_batches and the mean of each of the metrics named; nulls do not count."""
    return df.groupBy(epoch).agg(F.count(F.lit(1)).alias("n_batches"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics])


def success_counts(df: DataFrame, project: str, ok: Column) -> DataFrame:
    """project, n_ok, n_total; an unknown outcome is no success."""
    return df.groupBy(project).agg(F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n_total"))


def selection_rows(df: DataFrame, asm: str, src: str, prompts: bool = True) -> DataFrame:
    """asm, src, label 1: rows of the selection task, wrapped for an encoder or as they are."""
    wrap = (lambda c, kind: text.prompt(F.col(c), kind)) if prompts else (lambda c, kind: F.col(c))
    return df.withColumns({"asm": wrap(asm, "asm"), "src": wrap(src, "c"), "label": F.lit(1)})


def row_slice(df: DataFrame, lo: int, hi: int, order: str, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows lo (included) to hi (excluded) in order with their ordinal, through ``hook`` if one is given."""
    rows = with_ordinal(df, order).where((F.col("ordinal") >= lo) & (F.col("ordinal") < hi))
    return rows if hook is None else hook(rows)


class RefreshingTable:
    """A written table that is made anew every ``interval`` steps; between them all steps read the same one."""

    def __init__(self, make: Callable[[int], DataFrame], interval: int):
        if interval < 1:
            raise ValueError("an interval is one step at least")
        self.make, self.interval, self.held, self._scratch, self._table = make, interval, None, None, None

    def at(self, step: int) -> DataFrame:
        turn = step // self.interval
        if turn != self.held:
            df = self.make(step)
            self._scratch = self._scratch or Scratch(df.sparkSession, "refreshed")
            fresh = self._scratch.save(df, f"turn-{turn}")
            if self.held is not None:
                self._scratch.drop(f"turn-{self.held}")
            self.held, self._table = turn, fresh
        return self._table
