"""Shared helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from typing import TypeVar

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

__all__ = ["Scratch", "ascii_lower", "documents", "pick_rows", "row_key", "settings", "settle", "split_count", "trimmed"]

T = TypeVar("T")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to an all-ASCII text, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def split_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; the old ones come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def settle(fs, temp: str, name: str) -> None:
    """Gives a whole file its final name, also where a first attempt of the task has done so before.

    Both attempts wrote the same bytes; some file systems refuse to move onto a file.
    """
    if fs.get_file_info(name).is_file:
        fs.delete_file(name)
    fs.move(temp, name)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def trimmed(results: Iterator[T]) -> Iterator[T]:
    """The results of a task; after the last one, free memory goes back to the system, as the worker process lives on."""
    yield from results
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def row_key(id_: Column, text_hash: Column) -> Column:
    """A key of 128 bits for rows of the same id (or null) and text."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), text_hash))


def pick_rows(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each of the wanted keys (column ``key``).

    Rows of one key are merged before the shuffle, so a row repeated any number of times
    costs one row a task. The columns travel in a struct: their names clash with nothing.
    """
    whole = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.groupBy("key").agg(F.first("doc").alias("doc")).join(wanted, "key", "left_semi").select("doc.*")
