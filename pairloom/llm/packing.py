"""Cost-balanced packing of tokenized documents into sequences.

A piece of n tokens costs ``linear`` * n + ``quadratic`` * n * n (attention within a
document). Documents longer than a sequence are first cut into full sequences and a
rest. Rests and short documents, by descending cost, then go to the cheapest sequence
with room for them; when no sequence has room, the piece is cut at the room of the
cheapest that is not full, and its tail takes its place in the descending order. There
are as many sequences as the tokens need, so all but the last of a cell end up full.

A cell is what one task has read up to ``cell_tokens`` tokens: packing needs no shuffle,
its memory is bounded, and a cell wastes less than one sequence.

Defined results: a null or empty text is one document of the end id alone; null ids and
repeated rows are packed like others; an empty table gives no pieces; other columns are
neither read nor returned.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, trimmed
from .tokens import encoder

SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_cell(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1e-3) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one cell."""
    out, rest = [], []
    full = 0
    for d, n in enumerate(lengths):
        whole = n // capacity if n > capacity else 0
        for k in range(whole):
            out.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n - whole * capacity:
            rest.append((n - whole * capacity, d, whole * capacity))
    rest = [(-n, d, start) for n, d, start in rest]
    heapq.heapify(rest)
    count = -(-sum(-r[0] for r in rest) // capacity)
    room, cost = [capacity] * count, [0.0] * count
    #: sequences with room for the piece in hand, cheapest first; pieces descend, so they stay here until used
    ready = [(0.0, s) for s in range(count)]
    #: the others by room, and cheapest first; entries that no longer hold are passed over
    narrow: list[list[int]] = [[] for _ in range(capacity + 1)]
    cheap: list[tuple[float, int]] = []
    waits = [False] * count
    least = capacity
    while rest:
        n, d, start = heapq.heappop(rest)
        n = -n
        for r in range(n, least):
            for s in narrow[r]:
                if waits[s] and room[s] == r:
                    waits[s] = False
                    heapq.heappush(ready, (cost[s], s))
            narrow[r] = []
        least = n
        if ready:
            s = heapq.heappop(ready)[1]
        else:
            c, s = heapq.heappop(cheap)
            while not waits[s] or cost[s] != c:
                c, s = heapq.heappop(cheap)
            waits[s] = False
        part = min(n, room[s])
        out.append((d, start, part, full + s, capacity - room[s]))
        room[s] -= part
        cost[s] += linear * part + quadratic * part * part
        if room[s] >= n:
            heapq.heappush(ready, (cost[s], s))
        elif room[s]:
            waits[s] = True
            narrow[room[s]].append(s)
            heapq.heappush(cheap, (cost[s], s))
        if part < n:
            heapq.heappush(rest, (part - n, d, start + part))
    return out


def _cells(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, cell_tokens: int, linear: float, quadratic: float, keep: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, spaces=False, keep=keep)
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    end = np.array([end_id], "<u4").tobytes()
    ids, tokens, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal sequence, ids, tokens, held
        pieces = pack_cell([len(t) // 4 for t in tokens], capacity, linear, quadratic)
        columns = list(zip(*((ids[d], s, n, zlib.crc32(tokens[d][4 * s : 4 * (s + n)]), len(tokens[d]) // 4, sequence + q, o) for d, s, n, q, o in pieces), strict=True))
        sequence += max(p[3] for p in pieces) + 1
        ids, tokens, held = [], [], 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for b in batches:
        texts = b.column("text")
        for at in range(0, len(b), 2048):
            group = [t or "" for t in texts[at : at + 2048].to_pylist()]
            for id_, t in zip(b.column("id")[at : at + 2048].to_pylist(), encode(group), strict=True):
                ids.append(id_)
                tokens.append(t + end)
                held += len(tokens[-1]) // 4
                if held >= cell_tokens:
                    yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, cell_tokens: int = 4_000_000, linear: float = 1.0, quadratic: float = 1e-3, keep: int = 600_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``keep`` bounds the tokenizer's remembered pieces in a worker process; it does not change the result.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
    packed = source.mapInArrow(lambda it: trimmed(_cells(it, path, end_id, capacity, cell_tokens, linear, quadratic, keep)), SCHEMA)
    return packed.withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))
