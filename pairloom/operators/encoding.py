"""Encoding texts by a model that Python workers hold.

A worker process loads the model once and keeps it over tasks and queries. Texts of an Arrow batch
are cut to ``max_tokens``, sorted by length and dealt into model batches of about equal
lengths, so little of a batch is padding; results go back to the order of the input. A
model batch that fails leaves an error for its rows, the others go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: sequence lengths of the encoders in use: training, embedding of functions, whole files
LENGTHS = (512, 2048, 4096)
#: rows whose tokens a worker holds at a time
ROWS = 1024


class Model(Protocol):
    """What a worker holds. ``encode`` gives a vector for each list of tokens."""

    def tokens(self, text: str) -> list: ...

    def encode(self, batch: list[list]) -> np.ndarray: ...


@dataclass
class Loader:
    """How to get a model; workers keep one for each name."""

    name: str
    load: Callable[[], Model]
    dim: int


_models: dict[str, Model] = {}


def _model(loader: Loader) -> Model:
    if loader.name not in _models:
        _models[loader.name] = loader.load()
    return _models[loader.name]


def model_batches(lengths: list[int], batch_tokens: int, batch_rows: int) -> list[list[int]]:
    """Rows by descending length, so many that rows times the longest is ``batch_tokens`` at most (or one row)."""
    out: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if not out or len(out[-1]) == batch_rows or (len(out[-1]) + 1) * longest > batch_tokens:
            out.append([])
            longest = max(1, lengths[i])
        out[-1].append(i)
    return out


def accelerator_profile(cores: int, memory: str, gpus: int = 1) -> ResourceProfile:
    """Executors with accelerators for the encoding stage alone; a task holds one accelerator."""
    executor = ExecutorResourceRequests().cores(cores).memory(memory).resource("gpu", gpus)
    task = TaskResourceRequests().cpus(max(1, cores // gpus)).resource("gpu", 1)
    return ResourceProfileBuilder().require(executor).require(task).build


def encode(rows: DataFrame, text: str, loader: Loader, max_tokens: int = LENGTHS[0], batch_tokens: int = 16_384, batch_rows: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """Adds embedding (null on an error), n_tokens (those that count), truncated, and encode_error (null where all went well).

    A null text has no embedding and no error; an empty one is encoded as no tokens. All
    columns of ``rows`` stay, in order, and so does the order of rows in a partition. A
    worker sorts ``ROWS`` rows at a time; ``profile`` gives the stage its executors.
    """
    added = ["embedding", "n_tokens", "truncated", "encode_error"]
    clash = [c for c in added if c in rows.columns]
    if clash:
        raise ValueError(f"the table has columns {clash} already")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(loader)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = b.column(names.index(text)).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            cut, whole = [], []
            for i in known:
                # what is cut off is let go before the next text
                tokens = model.tokens(texts[i])
                whole.append(len(tokens))
                cut.append(tokens[:max_tokens])
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for group in model_batches([len(t) for t in cut], batch_tokens, batch_rows):
                try:
                    made = np.asarray(model.encode([cut[g] for g in group]), np.float32)
                    if made.shape != (len(group), loader.dim):
                        raise ValueError(f"vectors of shape {made.shape}")
                    for g, v in zip(group, made, strict=True):
                        vectors[known[g]] = v
                except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its rows
                    for g in group:
                        errors[known[g]] = f"{type(e).__name__}: {e}"[:200]
            n: list = [None] * len(texts)
            truncated: list = [None] * len(texts)
            for i, t, w in zip(known, cut, whole, strict=True):
                n[i], truncated[i] = len(t), w > max_tokens
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(n, pa.int32()), pa.array(truncated, pa.bool_()), pa.array(errors, pa.string())], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>, n_tokens int, truncated boolean, encode_error string", profile=profile)


@dataclass
class HashedWords:
    """Offline stand-in for a model: counts of words by md5 bucket, unit length. It cannot encode ``refused`` words."""

    dim: int = 64
    refused: frozenset[str] = field(default_factory=frozenset)

    def tokens(self, text: str) -> list[str]:
        return text.split()

    def encode(self, batch: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(batch), self.dim))
        for row, words in zip(out, batch, strict=True):
            for w in words:
                if w in self.refused:
                    raise ValueError(f"cannot encode {w!r}")
                row[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def dense(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that were encoded, without the columns that tell of the encoding."""
    return rows.where(F.col(vector).isNotNull()).drop("n_tokens", "truncated", "encode_error")
